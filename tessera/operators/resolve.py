"""Entity resolution that refuses ambiguity, duplicate clusters, and survivors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def unique_keys(df: DataFrame, key: Column, id_: str = "id") -> DataFrame:
    """k, id, n: rows by key; an id only where the key has one row."""
    g = df.select(key.alias("k"), F.col(id_).alias("__id")).where("k is not null and k != ''").groupBy("k").agg(F.count("*").alias("n"), F.min("__id").alias("id"))
    return g.select("k", F.when(F.col("n") == 1, F.col("id")).alias("id"), "n")


def ladder(left: DataFrame, right: DataFrame, tiers: list[tuple[str, Column, Column]], id_: str = "id") -> DataFrame:
    """Adds match and outcome: the first tier whose key occurs on the right decides; a key held by several rows refuses and ends the search."""
    out = left
    match, outcome = F.lit(None), F.lit("unmatched")
    for name, lk, rk in reversed(tiers):
        keys = unique_keys(right, rk, id_).select(F.col("k").alias(f"__k_{name}"), F.col("id").alias(f"__id_{name}"), F.col("n").alias(f"__n_{name}"))
        out = out.withColumn(f"__l_{name}", lk).join(keys, F.col(f"__l_{name}") == F.col(f"__k_{name}"), "left")
        n, found = F.col(f"__n_{name}"), F.col(f"__id_{name}")
        match = F.when(n == 1, found).when(n > 1, F.lit(None)).otherwise(match)
        outcome = F.when(n == 1, F.lit(name)).when(n > 1, F.lit(f"{name}_ambiguous")).otherwise(outcome)
    return out.withColumns({"match": match, "outcome": outcome}).select(*left.columns, "match", "outcome")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the folder that spark.checkpoint.dir names (on one machine without that setting, to a temporary one) and read back."""
    _folder(df)
    return df.checkpoint()


def _folder(df: DataFrame) -> None:
    """Sets the folder of checkpoints where none is set yet."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoint-"))


#: Whether Spark deletes what a written table's plan shuffled as soon as the table is there; else it stays until the driver collects its garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the folder of checkpointed(), read back: for tables of many rows, which a checkpoint would hold uncompressed.

    What its plan shuffled is deleted once it is written."""
    _folder(df)
    spark = df.sparkSession
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/stored-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before) if before is not None else spark.conf.unset(_CLEAN)
    out = spark.read.schema(df.schema).parquet(path)
    out.path__ = path
    return out


def together(tables: list[DataFrame]) -> DataFrame:
    """Tables of one schema that stored() made, as one."""
    return tables[0].sparkSession.read.schema(tables[0].schema).parquet(*(t.path__ for t in tables))


def clusters(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id, cluster (the smallest id reachable over links a, b). nodes: id.

    Labels shrink to their neighbours' least and are then looked up once more in each round, so rounds grow with the
    logarithm of the longest chain; each round's labels are checkpointed, in the folder that spark.checkpoint.dir names."""
    both = checkpointed(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = nodes.select("id", F.col("id").alias("cluster"))
    last = -1
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "cluster"), "b").groupBy("a").agg(F.min("cluster").alias("low"))
        step = labels.join(near, F.col("id") == F.col("a"), "left").select("id", F.least("cluster", F.coalesce("low", "cluster")).alias("cluster"))
        hop = step.join(step.select(F.col("id").alias("cluster"), F.col("cluster").alias("via")), "cluster").select("id", F.least("cluster", "via").alias("cluster"))
        labels = checkpointed(hop)
        total = labels.agg(F.sum(F.col("cluster").cast("decimal(38,0)"))).first()[0]
        if total == last:
            return labels
        last = total


def survivors(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row for each key: the first in order."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, action: insert, missing, conflict or same, from a full outer join on the key."""
    o = old.select(key, F.struct(*fields).alias("o"), F.lit(True).alias("in_old"))
    n = new.select(key, F.struct(*fields).alias("n"), F.lit(True).alias("in_new"))
    action = F.when(F.col("in_old").isNull(), "insert").when(F.col("in_new").isNull(), "missing").when(~F.col("o").eqNullSafe(F.col("n")), "conflict").otherwise("same")
    return o.join(n, key, "full").select(key, action.alias("action"))
