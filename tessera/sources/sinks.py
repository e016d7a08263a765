"""Sinks: fixed-column CSV, insert-only and keep-larger tables, numbered batches with checksums, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.resolve import checkpointed


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def snapshot(tables: list[DataFrame]) -> DataFrame:
    """One frame of all rows under the union of the columns; nested columns as JSON text."""
    out = None
    for df in tables:
        flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes])
        out = flat if out is None else out.unionByName(flat, allowMissingColumns=True)
    return out


def insert_only(plan: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the plan whose key the target does not have yet, one for each key: running it twice adds nothing."""
    return plan.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")


def keep_larger(target: DataFrame, rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Upsert that keeps, for each key, the row of the larger value (the other columns follow it)."""
    rest = [c for c in target.columns if c not in keys]
    both = target.unionByName(rows)
    best = both.groupBy(*keys).agg(F.max(F.struct(F.col(value).alias("__v"), *[F.col(c) for c in rest if c != value])).alias("m"))
    return best.select(*keys, *[F.col("m.__v").alias(c) if c == value else F.col(f"m.{c}") for c in rest])


def batches(df: DataFrame, order: list, pilot: int, size: int) -> DataFrame:
    """Adds batch: 0 for the first `pilot` rows in order, then 1, 2, ... of `size` rows each.

    Rows are dealt by ranges of the order and counted where they lie; one number for each range tells how many come before it."""
    dealt = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    per = dealt.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = per.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    n = place + F.col("__before") + 1
    out = dealt.withColumn("__part", part).join(F.broadcast(before), "__part")  # a row for each range
    return out.withColumn("batch", F.when(n <= pilot, F.lit(0)).otherwise(1 + F.floor((n - pilot - 1) / size)).cast("int")).select(*df.columns, "batch")


def manifest(df: DataFrame, key: str, payload: Column) -> DataFrame:
    """batch, n, checksum: md5 over the batch's payloads in key order."""
    return df.groupBy("batch").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), payload.alias("p")))), lambda x: x["p"]), "|")).alias("checksum"))


def guarded(current: DataFrame, plan: DataFrame, key: str, snapshot_col: str, fields: list[str]) -> DataFrame:
    """key, outcome of an update guarded by the snapshot the plan was made from: updated, changed_since or missing."""
    marker = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(f).cast("string"), F.lit("<null>")) for f in fields]))
    now = current.select(key, marker.alias("__now"))
    return plan.join(now, key, "left").select(key, F.when(F.col("__now").isNull(), "missing").when(F.col("__now") == F.col(snapshot_col), "updated").otherwise("changed_since").alias("outcome"))
