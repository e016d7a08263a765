import hashlib
import math
import random

import duckdb
import numpy as np

from tessera.llm import hadamard_clusters as hc

SF = "/root/testdata/sf0.001"
FIELDS = "vec_id bigint, embedding array<double>"


def brute(rows):
    """The contract in Python's integers, distances over plain components."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "~", r[1]))
    centers = [v for _, v in first[:8]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centers)) for _, v in kept]

    for _ in range(10):
        near = assign()
        for k in range(len(centers)):
            own = [v for (_, v), (_, c) in zip(kept, near, strict=True) if c == k]
            if own:
                centers[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    near = assign()

    def fits(x):
        return x if x is not None and x < 1 << 63 else None

    def total(ds):
        return fits(sum(ds)) if all(d < 1 << 63 for d in ds) else None

    whole = total([d for d, _ in near])
    return sorted(
        ((i, k, fits(d), total([e for e, c in near if c == k]), whole, hashlib.sha256(",".join(map(str, centers[k])).encode()).hexdigest()) for (i, _), (d, k) in zip(kept, near, strict=True)),
        key=repr,
    )


def run(df):
    return sorted((tuple(r) for r in hc.clustered(df).collect()), key=repr)


def test_transform_is_exact():
    x = np.random.default_rng(1).integers(-9000, 9000, (50, 64))
    c = hc.transform(x)
    assert (hc.inverse(c) == x).all() and (hc.transform(x.astype(object)) == c).all()
    assert (((c[:, None] - c[None]) ** 2).sum(axis=2) == 64 * ((x[:, None] - x[None]) ** 2).sum(axis=2)).all()
    assert sorted(c[0].tolist()) == sorted((hc._WALSH @ x[0]).tolist()) and c[0, 0] == x[0].sum()


def test_search_with_ties():
    rng = np.random.default_rng(2)
    x, z = rng.integers(-2, 3, (500, 64)), rng.integers(-2, 3, (6, 64))
    z[4], x[:9] = z[1], z[1]
    found, sums = hc.nearest(hc.transform(x), hc.transform(z))
    d = ((x[:, None] - z[None]) ** 2).sum(axis=2)
    assert (found == d.argmin(axis=1)).all() and (sums == 64 * d.min(axis=1)).all() and (found[:9] == 1).all()


def test_given_vectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert run(spark.read.parquet(f"{SF}/embeddings.parquet")) == brute(rows)


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    rel = con.sql(hc.ORACLE_SQL)
    want = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    got = [r.asDict() for r in hc.query(spark, SF).collect()]
    assert sorted(map(repr, (sorted(r.items()) for r in want))) == sorted(map(repr, (sorted(r.items()) for r in got)))


def test_odd_rows(spark, clash):
    rng = random.Random(3)
    rows = [(i, [rng.choice((-0.5, 0.0, 0.25)) + (i % 3) for _ in range(64)]) for i in range(60)]
    rows += [(60, rows[0][1]), (0, rows[0][1]), (0, rows[1][1]), (None, rows[2][1])]
    rows += [(70, None), (71, []), (72, [1.0] * 63), (73, [1.0] * 65), (74, [1.0] * 63 + [None]), (75, [math.nan] * 64), (76, [math.inf] * 64)]
    df = spark.createDataFrame(rows, FIELDS)
    assert run(clash(df)) == brute(rows)
    assert run(df.where("false")) == []
    assert run(spark.createDataFrame(rows[:3], FIELDS)) == brute(rows[:3])  # fewer vectors than centers
    same = [(i, [0.5] * 64) for i in range(20)]
    assert run(spark.createDataFrame(same, FIELDS)) == brute(same)  # all but the first center lose their vectors


def test_components_past_64_bits(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) * 10 ** (6 * (i % 7)) for _ in range(64)]) for i in range(40)]
    assert run(spark.createDataFrame(rows, FIELDS)) == brute(rows)
