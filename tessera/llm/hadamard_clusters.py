"""Centroid clustering whose nearest-centroid search runs over Walsh-Hadamard coefficients, from coarse to fine.

The transform of integers is integer and keeps distances but for the factor 64, so sums of squared differences of the
first coefficients are exact lower bounds. A centroid whose sum exceeds the whole distance of a rival is strictly worse
and leaves the search; what stays is summed over all coefficients. Each round is one pass over a written table of
coefficients; only sums of clusters come to the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import drop, table, written

SIZE, CENTERS, ROUNDS, SEED, SCALE = 64, 8, 10, "3:", 1024
#: Ends of the levels of coefficients, coarse to fine.
LEVELS = (4, 8, 16, 32, SIZE)
#: Components up to this size have distances that fit 64-bit integers, times 64; larger ones are handled as Python's integers.
NARROW = 1 << 22
#: Bits of the parts in which sums travel: parts of many tasks add up without overflow.
PART = 32
_WALSH = np.array([[(-1) ** (i & j).bit_count() for j in range(SIZE)] for i in range(SIZE)])
#: Rows of the matrix by their changes of sign: coarse first.
_COARSE = np.argsort((np.diff(_WALSH, axis=1) != 0).sum(axis=1))


def transform(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard coefficients of rows of 64 integers, coarse first; exact, no division."""
    for width in (1, 2, 4, 8, 16, 32):
        pairs = x.reshape(len(x), -1, 2, width)
        x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), SIZE)
    return x[:, _COARSE]


def inverse(coefficients: np.ndarray) -> np.ndarray:
    """The integers whose transform this is."""
    back = np.empty_like(coefficients)
    back[:, _COARSE] = coefficients
    out = transform(back)
    back[:, _COARSE] = out
    return back // SIZE


def nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of coefficients: the nearest center (ties: the smaller number) and 64 times its squared distance."""
    n, rows = len(x), np.arange(len(x))
    sums = ((x[:, None, : LEVELS[0]] - centers[None, :, : LEVELS[0]]) ** 2).sum(axis=2)
    rival = sums.argmin(axis=1)
    bound = ((x - centers[rival]) ** 2).sum(axis=1)
    stays = (sums <= bound[:, None]).astype(bool)
    for begin, end in zip(LEVELS, LEVELS[1:], strict=False):
        r, c = np.nonzero(stays)
        sums[r, c] += ((x[r, begin:end] - centers[c, begin:end]) ** 2).sum(axis=1)
        stays[r, c] = (sums[r, c] <= bound[r]).astype(bool)
    found = np.where(stays, sums, bound[:, None] + 1).argmin(axis=1) if n else np.empty(0, np.int64)
    return found, sums[rows, found]


def _parts(value: int) -> list[int]:
    """Signed parts of PART bits, lowest first, whose weighted sum is the value."""
    sign, rest, out = (1 if value >= 0 else -1), abs(value), []
    while rest:
        out.append(sign * (rest & ((1 << PART) - 1)))
        rest >>= PART
    return out


def _exact(rows: list[list[float]]) -> np.ndarray:
    out = np.empty((len(rows), SIZE), object)
    for i, row in enumerate(rows):
        out[i] = [int(v) for v in row]
    return out


def _blocks(batch: pa.RecordBatch, centers: list[list[int]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places in the batch, coefficients, coefficients of the centers), first of rows that 64-bit integers hold, then of the others."""
    usual = all(abs(v) <= NARROW for c in centers for v in c)
    wide = np.array(batch.column("wide").is_valid()) if batch.num_rows else np.empty(0, bool)
    for big in (False, True):
        at = np.flatnonzero(wide == big)
        if not len(at):
            continue
        part = batch.take(pa.array(at))
        if big:
            x = transform(_exact(part.column("wide").to_pylist()))
        else:
            x = part.column("coefficients").flatten().to_numpy().reshape(-1, SIZE)
        if big or not usual:
            yield at, x.astype(object), transform(_exact(centers))
        else:
            yield at, x, transform(np.array(centers, np.int64))


def prepared(vectors: DataFrame, id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """id, coefficients, wide: vectors of exactly 64 finite components as floor(1024 x).

    Rows whose components pass 2**22 carry the integers themselves in `wide` (floats that are whole numbers) and no
    coefficients. A component so large that 1024 x is no finite number leaves its row out, as infinite ones do."""
    fit = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id).cast("bigint").alias("id"), F.transform(column, lambda x: x.cast("double") * float(SCALE)).alias("v")).where(F.col("v").isNotNull() & (F.size("v") == SIZE) & fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, SIZE))
            wide = (np.abs(x) > NARROW).any(axis=1)
            coefficients = transform(np.where(wide[:, None], 0, x).astype(np.int64))
            lists = pa.FixedSizeListArray.from_arrays(pa.array(coefficients.ravel()), SIZE).cast(pa.list_(pa.int64()))
            big = pa.array([x[i].tolist() if w else None for i, w in enumerate(wide)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists, big], ["id", "coefficients", "wide"])

    return rows.mapInArrow(run, "id bigint, coefficients array<bigint>, wide array<double>")


def _first(rows: DataFrame, centers: int, seed: str) -> list[list[int]]:
    """The vectors with the smallest hashes of their ids (ids that are null: after all others; equal ids: smaller components first)."""
    hashed = rows.withColumn("h", F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256))
    chosen = hashed.orderBy(F.col("h").asc_nulls_last(), "coefficients", "wide").limit(centers).collect()
    out = [_exact([r.wide]) if r.wide else inverse(np.array([r.coefficients], np.int64)) for r in chosen]
    return [[int(v) for v in x[0]] for x in out]


def _moved(rows: DataFrame, centers: list[list[int]]) -> list[list[int]]:
    """One round: every center goes to the floor of the mean of its vectors; centers without vectors stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [[0] * (SIZE + 1) for _ in centers]
        for batch in batches:
            for _, x, z in _blocks(batch, centers):
                found, _ = nearest(x, z)
                for k in np.unique(found):
                    own = x[found == k]
                    sums[k] = [a + b for a, b in zip(sums[k], [*(int(v) for v in own.sum(axis=0)), len(own)], strict=True)]
        out = [(k, i, p, v) for k, s in enumerate(sums) for i, total in enumerate(s) for p, v in enumerate(_parts(total))]
        yield pa.RecordBatch.from_pylist([dict(zip(("center", "i", "part", "v"), r, strict=True)) for r in out], pa.schema([("center", pa.int32()), ("i", pa.int32()), ("part", pa.int32()), ("v", pa.int64())]))

    # some parts of 65 sums for each center, however many vectors there are
    found = rows.mapInArrow(run, "center int, i int, part int, v bigint").groupBy("center", "i", "part").agg(F.sum("v").alias("v")).collect()
    sums = [[0] * (SIZE + 1) for _ in centers]
    for r in found:
        sums[r.center][r.i] += r.v << (PART * r.part)
    out = []
    for old, total in zip(centers, sums, strict=True):
        n = total[SIZE]
        out.append([int(v) // n for v in inverse(np.array([total[:SIZE]], object))[0]] if n else old)
    return out


def clustered(vectors: DataFrame, centers: int = CENTERS, rounds: int = ROUNDS, seed: str = SEED, id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector of 64 finite components; other rows are left out.

    The first centers are the vectors with the smallest sha256 of seed and id; fewer vectors make fewer centers, none
    makes no rows. Repeated ids are rows of their own, a null id stays null. Everything is exact; a distance or sum that
    does not fit 64 bits is null."""
    rows = written(prepared(vectors, id, column))
    at = _first(rows, centers, seed)
    for _ in range(rounds if at else 0):
        at = _moved(rows, at)
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not at:
                continue
            cluster, distance = np.empty(batch.num_rows, np.int32), np.empty(batch.num_rows, object)
            for place, x, z in _blocks(batch, at):
                cluster[place], sums = nearest(x, z)
                distance[place] = sums // SIZE
            fits = [int(d) if d < 1 << 63 else None for d in distance]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cluster), pa.array(fits, pa.int64()), pa.array([hashes[k] for k in cluster], pa.string())], ["id", "cluster", "distance", "centroid_sha256"])

    found = written(rows.mapInArrow(run, "id bigint, cluster int, distance bigint, centroid_sha256 string"))
    drop(rows)

    def total(column: str):
        return F.when(F.count("*") == F.count(column), F.sum(F.col(column).cast("decimal(38,0)")))

    per = found.groupBy("cluster").agg(total("distance").alias("own"))  # one row for each center
    every = Window.partitionBy(F.lit(0))
    whole = F.when(F.count("*").over(every) == F.count("own").over(every), F.sum("own").over(every))
    sums = per.withColumn("whole", whole).select("cluster", F.expr("try_cast(own as bigint)").alias("cluster_inertia"), F.expr("try_cast(whole as bigint)").alias("inertia"))
    return found.join(F.broadcast(sums), "cluster").select(F.col("id").alias(id), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    """The same by plain squared distances over all components, one common table after another for each round."""
    parts = [
        f"kept AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings "
        f"WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {SIZE})",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY sha256('{SEED}' || vec_id), v) - 1 AS INTEGER) AS k, v AS c FROM kept ORDER BY k LIMIT {CENTERS})",
    ]
    for r in range(ROUNDS + 1):
        parts.append(
            f"a{r} AS MATERIALIZED (SELECT vec_id, v, x.k, x.d FROM (SELECT vec_id, v, min(struct_pack(d := CAST(list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT), k := k)) AS x "
            f"FROM (SELECT *, row_number() OVER () AS row FROM kept), c{r} GROUP BY row, vec_id, v))"
        )
        if r < ROUNDS:
            parts.append(
                f"m{r} AS MATERIALIZED (SELECT k, list(CAST(s // n - CASE WHEN s % n < 0 THEN 1 ELSE 0 END AS BIGINT) ORDER BY i) AS c FROM (SELECT k, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, {SIZE + 1}) t(i) GROUP BY k, i) GROUP BY k)"
            )
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT c{r}.k, coalesce(m{r}.c, c{r}.c) AS c FROM c{r} LEFT JOIN m{r} USING (k))")
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT vec_id, k AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, "
        f"sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a{ROUNDS} JOIN c{ROUNDS} USING (k)"
    )


ORACLE_SQL = _oracle()
