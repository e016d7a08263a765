"""Curation jobs: top-ups, new recommendations in stages, verification and proposals as ladders of reasons, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ladder(*rules: tuple[Column, str], otherwise: str) -> Column:
    """The name of the first rule that holds."""
    out = F.lit(otherwise)
    for cond, name in reversed(rules):
        out = F.when(F.coalesce(cond, F.lit(False)), F.lit(name)).otherwise(out)
    return out


def top_up(primary: DataFrame, secondary: DataFrame, key: str, id_: str, k: int) -> DataFrame:
    """key, id, rank, filled: a key's first results, and where they are fewer than k, the second ones that are not among them.

    Both: key, id, place (from 1, unique for each key)."""
    rest = secondary.join(primary.select(key, id_), [key, id_], "left_anti").withColumn("filled", F.lit(True))
    both = primary.withColumn("filled", F.lit(False)).unionByName(rest)
    rank = F.row_number().over(Window.partitionBy(key).orderBy("filled", "place", id_))
    return both.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k).select(key, id_, "rank", "filled")


def new_links(candidates: DataFrame, existing: DataFrame, keys: list[str], strength: str, order: list[Column]) -> DataFrame:
    """Candidates strong or medium enough whose pair is not there yet, the best one for each pair."""
    fit = candidates.where(F.col(strength).isin("strong", "medium")).join(existing.select(*keys).distinct(), keys, "left_anti")
    return fit.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def staged_insert(plan: DataFrame, entities: DataFrame, links: DataFrame, key: str, other: str) -> dict[str, DataFrame]:
    """What one insert does, stage by stage: entities that are missing, links that are missing, and counts of the entities touched.

    plan: key, other. entities: key. links: key, other."""
    pairs = plan.select(key, other).distinct()
    add = pairs.join(links.select(key, other), [key, other], "left_anti")
    before = links.select(key, other).distinct().join(add.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.count("*").alias("before"))
    counts = add.groupBy(key).agg(F.count("*").alias("added")).join(before, key, "left").withColumn("before", F.coalesce("before", F.lit(0)))
    return {"entities": pairs.select(key).distinct().join(entities.select(key), key, "left_anti"), "links": add, "counts": counts.select(key, "before", "added", (F.col("before") + F.col("added")).alias("after"))}


def discover(df: DataFrame) -> dict[str, str]:
    """The columns of an export and the one that orders it: an id, else a time, else the first."""
    names = df.columns
    order = next((c for c in ("id", "key", "created_at", "updated_at") if c in names), None) or next((c for c in names if c.endswith(("_id", "key"))), names[0] if names else "")
    return {"columns": ",".join(names), "order": order}


def summary(df: DataFrame, key: str, values: dict[str, Column]) -> DataFrame:
    """One JSON document of aggregates by key, its keys in order."""
    per = df.groupBy(F.col(key).cast("string").alias("k")).agg(*[v.alias(n) for n, v in values.items()])
    # the keys of a summary are few by nature (kinds, states, reasons)
    entries = F.sort_array(F.collect_list(F.struct("k", F.struct(*values).alias("v"))))
    return per.agg(F.to_json(F.map_from_entries(entries)).alias("summary"))
