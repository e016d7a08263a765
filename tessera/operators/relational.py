"""Pages, rankings, counts and set operations over entity frames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """The number-th page (from 1) in a total order; Spark keeps number * size rows of each task at most."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


#: Rows of which a task works out what is costly by row, about.
TASK_ROWS = 20_000


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt by a key of many values to a task for about TASK_ROWS rows, where what follows is costly by row: files of few bytes come as few tasks, whatever their rows."""
    return df.repartition(max(1, math.ceil(df.count() / TASK_ROWS)), key)


def top(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_per(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each key with their rank; Spark drops later rows before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k).withColumn(rank, F.col(rank).cast("bigint"))


def with_count(df: DataFrame, edges: DataFrame, key: str, out: str) -> DataFrame:
    """Adds how many rows of `edges` carry the row's id under `key`, 0 without any."""
    n = edges.groupBy(F.col(key).alias("id")).agg(F.count("*").alias(out))
    return df.join(n, "id", "left").withColumn(out, F.coalesce(out, F.lit(0)))


def first_wins(frames: list[DataFrame], key: str) -> DataFrame:
    """The union of frames, each key from the first frame that has it; adds origin (from 0)."""
    out = None
    for i, df in enumerate(frames):
        one = df.withColumn("origin", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return top_per(out, [key], [F.col("origin")], 1, "__k").drop("__k")


def contains_any(columns: list[str], text: str) -> Column:
    """Case-insensitive substring in any of the columns; % and _ of the text stand for themselves."""
    pattern = "%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    found = F.lit(False)
    for c in columns:
        found = found | F.col(c).ilike(pattern)
    return found


def ring(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """id, step, next_id: the k rows after each in order, going round. For published entities of one kind: one ordered pass."""
    n = df.select("id", F.row_number().over(Window.orderBy(*order)).alias("pos"))
    total = F.broadcast(n.agg(F.count("*").alias("total")))
    at = n.crossJoin(total).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k)))).where("step < total")
    at = at.withColumn("to", (F.col("pos") + F.col("step") - 1) % F.col("total") + 1)
    return at.join(n.select(F.col("pos").alias("to"), F.col("id").alias("next_id")), "to").select("id", "step", "next_id")
