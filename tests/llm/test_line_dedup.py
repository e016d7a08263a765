import hashlib
import random

import pytest

from tessera.llm import line_dedup


def near(a, b, edits):
    """Whether the edit distance is at most `edits`, by the textbook table."""
    if abs(len(a) - len(b)) > edits:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)) if abs(i - j) <= edits else edits + 1)
        if min(row) > edits:
            return False
    return row[-1] <= edits


def brute(rows, edits=line_dedup.EDITS):
    """(doc_id, text) -> doc_id: text without the lines that go, number gone."""
    solid = [(d, i, x) for d, t in rows if t is not None for i, x in enumerate(t.split("\n")) if x.strip(" \t\r\x0b\f")]
    uniq = sorted({x for _, _, x in solid})
    root = {x: x for x in uniq}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(uniq):
        for y in uniq[:i]:
            if min(len(x), len(y)) >= line_dedup.LEAST and near(x, y, edits):
                root[find(x)] = find(y)
    first = {}
    for d, i, x in sorted(solid, key=lambda s: s[:2]):
        first.setdefault(find(x), (d, i))
    gone = {(d, i) for d, i, x in solid if first[find(x)] != (d, i)}
    return {d: (None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone), sum(g[0] == d for g in gone)) for d, t in rows}


def corpus():
    rng = random.Random(4)
    line = lambda n: "".join(rng.choices("abcdefg é", k=n))
    bases = [line(rng.choice([5, 19, 20, 21, 22, 40, 90])) for _ in range(40)]
    counted = "page number %d of the whole book"
    rows = []
    for d in range(60):
        own = []
        for _ in range(rng.randrange(1, 7)):
            b = rng.choice(bases)
            for _ in range(rng.choice([0, 1, 1, 2])):
                k, how = rng.randrange(len(b)), rng.randrange(3)
                b = b[:k] + ("" if how == 0 else rng.choice("XYZ")) + b[k + (how < 2) :]
            own.append(b)
        own += [counted % rng.randrange(500)] * rng.randrange(2) + ["", "  "][: rng.randrange(3)]
        rows.append((d, "\n".join(own)))
    return rows + [(100, None), (101, ""), (102, "\n\n"), (103, "short\nshort\nshorf"), (104, "x" * 5000 + "\n" + "x" * 4999)]


@pytest.mark.parametrize(("most", "edits"), [(16, 1), (16, 2), (2, 2), (2, 3)])
def test_equals_brute_force(docs, clash, monkeypatch, most, edits):
    monkeypatch.setattr(line_dedup, "LIST", most)
    rows = corpus()
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.deduplicated(clash(docs(rows)), edits).collect()}
    assert got == brute(rows, edits)


def test_common_thirds_do_not_link(docs, monkeypatch):
    """Lines that share one segment or more but are further apart, beside chains of close ones, on lists that are too long."""
    monkeypatch.setattr(line_dedup, "LIST", 3)
    rng = random.Random(7)
    word = lambda n: "".join(rng.choices("abcdef", k=n))
    head, tail = word(40), word(40)
    lines = [head + word(20) + tail for _ in range(25)]
    for x in lines[:12]:
        k = rng.randrange(len(x) - 1)
        lines += [x[:k] + "Z" + x[k + 1 :], x[:k] + x[k + 2 :], "Q" + x[:k] + x[k + 1 :]]
    rows = [(i, x) for i, x in enumerate(lines)]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.deduplicated(docs(rows)).collect()}
    assert got == brute(rows)
    assert 12 <= sum(n for _, n in got.values()) <= 40


def test_repeated_and_missing_ids(docs):
    a, b = "a line that is long enough", "another line, long enough too"
    rows = [(None, a), (1, a + "\n" + b), (1, a + "\n" + b), (2, b), (2, b + "\nmore of it here, yes"), (3, a)]
    got = line_dedup.deduplicated(docs(rows)).collect()
    of = lambda d: sorted((r.text, r.n_removed) for r in got if r.doc_id == d)
    assert of(None) == [(a, 0)] and of(1) == [(b, 1)] * 2 and of(3) == [("", 1)]
    assert of(2) == [("", 1), ("more of it here, yes", 1)]


def test_odd_rows(odd, docs):
    assert line_dedup.deduplicated(odd).count() == 9
    assert line_dedup.deduplicated(docs([])).count() == 0


def test_query_digest(spark):
    rows = line_dedup.query(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    want = brute(sorted(texts.items()))
    assert all((r.n_removed, r.kept_md5) == (want[r.doc_id][1], hashlib.md5(want[r.doc_id][0].encode()).hexdigest()) for r in rows)
