import itertools

import numpy as np
import pyarrow as pa

from tessera.llm import langid


def model(probs):
    hashes, order = langid._hashes(list(probs))
    names = [list(probs)[i] for i in order]
    table = np.array([[probs[n]] for n in names] + [[1e-6], [0]])
    return langid._Scorer(hashes, table)


def brute(word, probs):
    """Sum over all ways to cut the word."""
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(word)]
        p = 1.0
        for a, b in zip(at, at[1:]):
            p *= probs.get(word[a:b], 1e-6 if b - a == 1 else 0)
        total += p
    return total


def test_forward_sums_all_segmentations():
    probs = {" ": 0.1, " a": 0.2, "ab": 0.05, "a": 0.3, "b": 0.1, "abc": 0.02, "c": 0.03, " ab": 0.07}
    m = model(probs)
    words = [" a", " ab", " abc", " abab", " xyz", " abcabc", " é"]
    assert np.allclose(np.exp(m.logs(words)[:, 0]), [brute(w, probs) for w in words], rtol=1e-9)


def test_long_runs_are_whole_and_long_pieces_count():
    probs = {" ": 0.1, " a": 0.2, "ab": 0.05, "a": 0.3, "b": 0.1, "abababababab": 0.2, "c": 0.03}
    m = model(probs)

    def exact(word):
        """The log of the sum over all ways to cut, by exact fractions."""
        from fractions import Fraction

        import math

        alpha = [Fraction(1)] + [Fraction(0)] * len(word)
        for j in range(1, len(word) + 1):
            for k in range(1, min(12, j) + 1):
                p = probs.get(word[j - k : j], 1e-6 if k == 1 else 0)
                alpha[j] += alpha[j - k] * Fraction(p) if p else 0
        return math.log(alpha[-1].numerator) - math.log(alpha[-1].denominator)

    words = [" " + "ab" * n for n in (3, 15, 16, 40, 41, 150)] + [" " + "xyz" * 120, " " + "ab" * 20 + "é" * 9]
    assert np.allclose(m.logs(words)[:, 0], [exact(w) for w in words], rtol=1e-9)
    assert langid.clean(b"x" * 65, None) == [" " + "x" * 65] and langid.clean(b"1", None) == []
    vocab = langid.pieces(langid.vocabulary_path())
    assert max(map(len, vocab)) > 8


def test_expected_counts_add_up():
    probs = {" ": 0.2, " a": 0.2, "ab": 0.1, "a": 0.3, "b": 0.2}
    m = model(probs)
    counts = m.expected([" ab", " aab"], np.array([0, 0]), np.array([2.0, 1.0]))
    names = [list(probs)[i] for i in langid._hashes(list(probs))[1]]
    letters = sum(c * len(n) for c, n in zip(counts[:-2, 0], names))
    assert np.isclose(letters, 2 * 3 + 4)  # every letter of every word lies in one piece


def test_cleaning():
    assert langid.clean("Hé,llo!".encode()) == [" héllo"] and langid.clean(b"12-34") == [] and [len(x) for x in langid.clean(b"x" * 65)] == [31, 30, 5]


def test_documents_add_up_words(docs):
    m = model({" ": 0.2, " a": 0.2, "a": 0.3, "b": 0.2})
    logs, some = m.documents(pa.array(["a ab", None, "12 !", "ab a", ""]))
    one = m.logs([" a", " ab"]).sum()
    assert np.allclose(logs[[0, 3], 0], one, rtol=1e-5) and some.tolist() == [True, False, False, True, False]


def test_held_out_accuracy(spark):
    rows = langid.query(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(odd, docs, clash):
    known = docs([(i, t, l) for i, (t, l) in enumerate([("the house is big", "en"), ("das haus ist groß", "de"), ("x", None), (None, "fr")] * 5)])
    m = langid.fit(known)
    assert m["langs"] == ["de", "en"]
    got = {r.doc_id: r for r in langid.predict(clash(odd), m).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and got[1].score == 0.0 and got[4].lang_pred in ("de", "en")
    none = langid.fit(known.where("false"))
    assert {r.lang_pred for r in langid.predict(odd, none).collect()} == {"und"} and langid.predict(docs([]), m).count() == 0
