"""Helpers the corpus operators share: scratch tables, Arrow slicing, running totals, connected components."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy step inside a task handles; a longer document is handled alone.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; where that is unset on one machine (tests), a new temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _delete(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; the folder is the cluster's to clear
        pass


def written(df: DataFrame, compression: str = "zstd", **options: str) -> DataFrame:
    """df as a table in the shared folder, read back: lineage ends here and lost executors cost nothing. It is deleted by drop() or when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tessera-{uuid.uuid4().hex}"
    df.write.option("compression", compression).options(**options).parquet(path)
    atexit.register(_delete, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch__ = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes tables that written() made, once all that follows from them is written itself."""
    for t in tables:
        if path := getattr(t, "scratch__", None):
            _delete(t.sparkSession, path)


#: Rows of a table of ids up to which it is sent to every task.
SENT_ROWS = 1_000_000


def sent(df: DataFrame) -> DataFrame:
    """A written table of ids for a join: sent to every task if its rows are few (some 50 bytes each), else shuffled."""
    return F.broadcast(df) if df.count() <= SENT_ROWS else df


def bytes_of(column: pa.Array | pa.ChunkedArray) -> tuple["np.ndarray", "np.ndarray"]:
    """The UTF-8 bytes of a string column, one after another, and where each row's begin (rows + 1 offsets). Nulls are empty."""
    import numpy as np

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def steps(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in slices of about `limit` bytes of text, so that a task's memory does not follow the batch."""
    import numpy as np

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            begun = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, begun + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def running_totals(df: DataFrame, key: str | list[str], value: str, out: str) -> DataFrame:
    """Adds `out`: the sum of `value` over all rows of a smaller `key`, one column or several (null is the smallest; rows of one key follow each other).

    Rows are dealt by ranges of the key, each task adds up its own range, and one row per task carries the offsets."""
    schema = df.schema.fieldNames()
    # a filter-free deal by ranges: every task holds consecutive keys
    keys = [key] if isinstance(key, str) else key
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    local = f"{out}__local"

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            sums = pc.cumulative_sum(batch.column(value).cast(pa.int64()))
            begin = pc.add(pc.subtract(sums, batch.column(value).cast(pa.int64())), total)
            total += sums[-1].as_py()
            yield pa.RecordBatch.from_arrays([*batch.columns, begin, pa.array([part] * batch.num_rows, pa.int32())], [*batch.schema.names, local, "range__"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    rows = written(dealt.mapInArrow(add, f"{types}, `{local}` bigint, range__ int"))
    per = rows.groupBy("range__").agg(F.sum(value).alias("sum__"))
    from pyspark.sql import Window

    before = per.select("range__", F.coalesce(F.sum("sum__").over(Window.orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before__"))
    # one row for each task of the deal above: its size is bounded by the number of partitions
    return rows.join(F.broadcast(before), "range__").select(*schema, (F.col(local) + F.col("before__")).cast("bigint").alias(out))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(a, b))"), F.lit(0)), F.coalesce(F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31))), F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> one row (a, b) for each node that is not its component's smallest: b is that smallest node.

    Alternating large-star and small-star rounds on DataFrames; each round's edges are written to the shared folder. So are the
    least neighbours: a join with a table of its own may be split where one node has very many edges."""
    e = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(e)
    while mark[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        least = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large)
        below = written(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(below, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*").where("a != b").distinct()
        e = written(small)
        before, mark = mark, _mark(e)
        if mark == before:
            break
    return e


def crc_of(column: str) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))
