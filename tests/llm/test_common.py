import random

import numpy as np
import pyarrow as pa

from tessera.llm import common
from tessera.llm.words import Known, shingles, words


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(400 + i, 401 + i) for i in range(60)] + [(500, 500)] + [(600, 600 + i) for i in range(50)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {(x, find(x)) for x in root if find(x) != x}
    assert {tuple(r) for r in common.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()} == want
    assert common.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_running_totals(spark):
    rng = random.Random(2)
    rows = [(k, rng.randrange(5)) for k in rng.sample(range(10_000), 900)]
    got = {r.k: r.before for r in common.running_totals(spark.createDataFrame(rows, "k bigint, v bigint").repartition(7), "k", "v", "before").collect()}
    at = 0
    for k, v in sorted(rows):
        assert got[k] == at
        at += v
    assert common.running_totals(spark.createDataFrame([], "k bigint, v bigint"), "k", "v", "before").count() == 0


def test_words_and_shingles():
    texts = ["Ab  ab\tAB", None, "", " x", "é É", "one two three four five six", "one two three four five"]
    h, cut, _, _ = words(pa.array(texts))
    assert np.diff(cut).tolist() == [3, 0, 0, 1, 2, 6, 5] and len(set(h[:3].tolist())) == 1 and h[4] != h[5]
    sizes = [len(s) for s in shingles(h, cut)]
    assert sizes == [1, 0, 0, 1, 1, 2, 1]
    five = shingles(h, cut)[6]
    assert five[0] in shingles(h, cut)[5]


def test_steps_keep_every_row():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["x" * n for n in (0, 5, 100, 3, 3, 200, 0)] + [None]), "i": list(range(8))})
    parts = list(common.steps(iter([batch]), limit=8))
    assert [i for p in parts for i in p.column("i").to_pylist()] == list(range(8)) and max(p.num_rows for p in parts) >= 2


def test_known():
    known, rng = Known(), np.random.default_rng(1)
    known.RECENT = 50
    hashes = rng.permutation(np.arange(1, 400, dtype=np.uint64) * np.uint64(7919))
    for at in range(0, 390, 13):
        known.add(np.sort(hashes[at : at + 13]), np.sort(hashes[at : at + 13]).astype(np.int64))
    assert len(known) == 390 and (known.find(hashes[:390]) == hashes[:390].astype(np.int64)).all() and (known.find(hashes[390:]) == -1).all()
