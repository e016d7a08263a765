import random

import numpy as np
import pytest

from tessera.llm import decontaminate as d


def greedy(item, text, size):
    """The definition: mark the longest unmarked match, the earliest of several, until none is long enough."""
    size = min(size, len(item))
    m, u = [False] * len(item), [False] * len(text)
    while size:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                k = 0
                while i + k < len(item) and j + k < len(text) and item[i + k] == text[j + k] and not m[i + k] and not u[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        if best[0] < size:
            break
        for k in range(best[0]):
            m[best[1] + k] = u[best[2] + k] = True
    return m


@pytest.mark.parametrize("seed", range(12))
def test_tiling_equals_definition(seed):
    rng = random.Random(seed)
    item = [rng.randrange(4 if seed % 2 else 30) for _ in range(rng.randrange(1, 25))]
    text = [rng.randrange(4 if seed % 2 else 30) for _ in range(40)] + item[8:] + item[:8]
    got = d.tile(np.array(item, np.uint64), np.array(text, np.uint64), 3)
    assert got.sum() == sum(greedy(item, text, 3))


def test_catches_reordered_and_leaves_clean(spark, docs, clash):
    rng = random.Random(1)
    prose = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    items = [prose(40) for _ in range(5)] + [["short", "item"], [], ["solo"]]
    j = " ".join
    a = items[0]
    texts = [
        (0, j(prose(50) + a + prose(50))), (1, j(a[20:] + prose(9) + a[:20])), (2, j(a[:30])), (3, j(prose(200))), (4, j(a).upper().replace(" ", ", ")), (5, j(a[:10] + ["x"] + a[11:24] + ["y"] + a[25:])),
        (6, "a short item here"), (7, "short of item"), (8, None), (9, ""), (10, j(prose(3000) + items[1] + prose(3000) + items[2])), (11, j(x for w in a for x in (w, "z"))), (None, j(a)),
    ]
    bench = spark.createDataFrame([(i, j(t)) for i, t in enumerate(items)] + [(50, None), (51, "... !")], "item_id bigint, text string")
    got = {}
    for r in d.leaks(clash(docs(texts)), clash(bench)).collect():
        got.setdefault(r.doc_id, set()).add(r.item_id)
    assert got == {0: {0}, 1: {0}, 4: {0}, 5: {0}, 6: {5}, 10: {1, 2}, None: {0}}
    assert {r.doc_id for r in d.decontaminated(docs(texts), bench).collect()} == {2, 3, 7, 8, 9, 11, None}


def test_many_passes_give_the_same(spark, docs, monkeypatch):
    texts = [(i, " ".join(f"w{(i * 7 + k) % 97}" for k in range(30))) for i in range(40)]
    bench = spark.createDataFrame([(i, texts[i][1]) for i in range(10)], "item_id bigint, text string")
    once = sorted(map(tuple, d.leaks(docs(texts), bench).collect()))
    monkeypatch.setattr(d, "PASS_WORDS", 60)
    assert sorted(map(tuple, d.leaks(docs(texts), bench).collect())) == once and once


def naive(item, text):
    return sum(greedy(item, text, d.MATCH)) / len(item)


@pytest.mark.parametrize("by_shuffle", [False, True])
def test_query_equals_brute_force(spark, docs, monkeypatch, tmp_path, by_shuffle):
    rng = random.Random(5)
    prose = lambda n: [f"w{rng.randrange(60)}" for _ in range(n)]
    common = prose(12)  # a passage of every item and document
    items = [common + prose(rng.randrange(3, 14)) for _ in range(8)] + [prose(k) for k in (1, 2, 3, 4, 5, 6)]
    texts = [common + prose(rng.randrange(0, 25)) for _ in range(30)]
    for k, item in enumerate(items):
        at = rng.randrange(1, len(item)) if len(item) > 1 else 0
        texts += [prose(7) + item + prose(3), prose(2) + item[at:] + prose(2) + item[:at], item[: max(1, 3 * len(item) // 4)]]
    docs([(i, " ".join(t)) for i, t in enumerate(texts)]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, ", ".join(t)) for i, t in enumerate(items)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    if by_shuffle:
        monkeypatch.setattr(d, "PASS_WORDS", 10)
    got = {r.doc_id: (r.contaminated, r["items"], round(r.coverage, 9)) for r in d.query(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        share = {k: naive(item, t) for k, item in enumerate(items)}
        held = [k for k, v in share.items() if v >= d.THRESHOLD]
        assert got[i] == (bool(held), held, round(max((share[k] for k in held), default=0.0), 9)), (i, held, got[i])
    assert len({v[0] for v in got.values()}) == 2 and len(got) == len(texts)


def test_repeated_and_missing_ids(spark, docs, tmp_path):
    item = " ".join(f"b{k}" for k in range(20))
    docs([(1, item), (1, "clean text"), (None, item), (2, item), (2, item), (3, "clean")]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, item), (7, item), (None, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [(r.doc_id, r.contaminated) for r in d.query(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([(1, True), (1, True), (2, True), (2, True), (3, False), (None, False)], key=str)
    rest = d.decontaminated(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/benchmark.parquet"))
    assert sorted((r.doc_id or 0) for r in rest.collect()) == [0, 3]


def test_empty(spark, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert d.leaks(docs([(1, "a b c d e f")]), none).count() == 0 and d.leaks(docs([]), none).count() == 0
