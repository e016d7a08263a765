import hashlib
import random
from collections import Counter

from tessera.llm import suffix_dedup


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + length] for b in raw for k in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, other = prose(120), prose(90)
    texts = [prose(200) + shared + prose(30), shared, prose(10) + shared[5:], shared[:399], shared[:400], shared[:401] + "z", other + " x " + other, prose(300), None, "", "ab" * 900, "ab" * 900 + "c", "a" * 1200, prose(50) + shared[100:520] + prose(20)]
    base = prose(150)
    for _ in range(12):  # copies with one letter changed
        k = rng.randrange(len(base))
        texts.append(base[:k] + "Q" + base[k + 1 :])
    return texts + [base, base]


def test_equals_brute_force(docs, clash):
    texts = corpus()
    rows = clash(docs(list(enumerate(texts))))
    got = suffix_dedup.removed(rows).orderBy("doc_id").collect()
    want = brute(texts, suffix_dedup.LENGTH)
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got] == want
    assert any(w[1] for w in want) and all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_odd_rows(odd, docs):
    got = {(r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.removed(odd, digest_only=True).collect()}
    assert {g[0] for g in got} == {1, 2, 3, 4, 5, 6, 7} and (7, 15000, 15000) in got and (1, 0, 0) in got
    assert suffix_dedup.removed(docs([])).count() == 0


def test_planted_passages_go_from_400_bytes_on(docs):
    """Passages of over 50 words in two documents each: the contract counts bytes, so only those of 400 and more are removed, and no document without one is touched."""
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(n))
    passages = [prose(n) for n in range(51, 81)]
    texts = [f"{prose(60)}\x01{p}\x02{prose(60)}" if copy else f"{prose(60)}\x03{p}\x04{prose(60)}" for p in passages for copy in (0, 1)]
    got = {r.doc_id: r.n_removed for r in suffix_dedup.removed(docs(list(enumerate([*texts, *(prose(150) for _ in range(60))]))), digest_only=True).collect()}
    sizes = [len(p) for p in passages for _ in (0, 1)]
    assert min(sizes) < 400 < max(sizes)
    assert [got[i] for i in range(120)] == [n if n >= 400 else 0 for n in sizes] + [0] * 60
