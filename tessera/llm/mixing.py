"""Mixing sources to target weights by Sainte-Lague apportionment.

A source's documents are dealt into shards of about SHARD_WORDS words and lie there one after another in a seeded order,
cut into blocks of BLOCK words. Blocks go to shards by the highest quotients target / (2 k + 1): integer quotas. A quota
takes a shard's blocks in whole rounds, and the rest from a seeded block on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import running_totals, table, written

BLOCK = 8
SHARD_WORDS = 100_000
WEIGHTS = (3.0, 1.0, 2.0)
SEED = 42
WORD = r"[^\x20\x09-\x0D]+"


def _targets(sources: DataFrame, budget: float, most: float) -> DataFrame:
    """Adds target: the budget shared by weight; no target above `most` times the source's size, the excess shared again."""
    level, capped = 0.0, -1
    while True:
        over = F.col("w") * F.lit(level) > most * F.col("source_size")
        free, used, now = sources.agg(F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0.0)), F.coalesce(F.sum(F.when(over, most * F.col("source_size"))), F.lit(0.0)), F.count_if(over)).first()
        if now == capped or not free:
            break
        capped, level = now, (budget - used) / free
    return sources.withColumn("target", F.least(F.col("w") * F.lit(level), most * F.col("source_size")) if budget else F.lit(0.0))


def _quotas(shards: DataFrame, seats: int) -> DataFrame:
    """Adds q: Sainte-Lague seats by weight `share`, at most `cap`. A seat count follows from a divisor; the divisor is
    found by narrowing, 64 at a time in one aggregation; what ties leave goes to the first shards in order."""

    def at(d):
        return F.least(F.floor(F.col("share") / d + 0.5).cast("bigint"), F.col("cap"))

    top, room = shards.agg(F.coalesce(F.max("share"), F.lit(0.0)), F.coalesce(F.sum("cap"), F.lit(0))).first()
    seats = min(seats, room)
    if not seats or not top:
        return shards.withColumn("q", F.lit(0).cast("bigint"))
    lo, hi = top / (4.0 * seats + 4), 2.1 * top  # at hi nobody has a seat; at lo the largest has more than all
    while True:
        sums = shards.agg(F.sum(at(F.lit(lo)))).first()[0]
        if sums >= seats:
            break
        lo /= 64
    got = 0
    for _ in range(12):
        ds = [lo * (hi / lo) ** (i / 64) for i in range(65)]
        sums = shards.agg(F.array(*[F.sum(at(F.lit(d))) for d in ds])).first()[0]
        k = max(i for i in range(65) if sums[i] >= seats or i == 0)
        if sums[k] == seats:
            return shards.withColumn("q", at(F.lit(ds[k])))
        if k == 64 or ds[k] == lo and ds[k + 1] == hi:
            break
        lo, hi, got = ds[k], ds[k + 1], sums[k + 1]
        if hi / lo < 1 + 1e-14:
            break
    tied = shards.where(at(F.lit(lo)) > at(F.lit(hi))).select("key", "shard", F.explode(F.sequence(F.lit(1).cast("bigint"), at(F.lit(lo)) - at(F.lit(hi)))).alias("k")).orderBy("k", "key", "shard").limit(int(seats - got))
    more = tied.groupBy("key", "shard").agg(F.count("*").alias("more"))
    return shards.join(more, ["key", "shard"], "left").withColumn("q", at(F.lit(hi)) + F.coalesce("more", F.lit(0))).drop("more")


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple = WEIGHTS, seed: int = SEED) -> DataFrame:
    """doc_id, size (words), source_size, target (its source's), taken (words the mix takes, repeats counted).

    The mix has `share` times all words. Sources in code point order, null last, weigh `weights`, repeating; a target is at
    most `most` times its source's size. Null and blank texts have size 0 and nothing is taken of them. Reruns agree."""
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col("source").cast("string")))
    rows = written(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), key.alias("key"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size")))
    per = written(rows.groupBy("key").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("bigint")))
    per = running_totals(per, "key", "one", "rank")
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod("rank", F.lit(len(weights))) + 1).cast("int"))).select("key", "source_size", "w")
    per = written(per)
    total = per.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    per = written(_targets(per, share * total, most).withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS))))
    # the number of sources is small beside that of documents; the join below may still split a hot one
    dealt = rows.join(per, "key").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("shards")))
    line = Window.partitionBy("key", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id")
    dealt = written(dealt.withColumn("begin", F.sum("size").over(line) - F.col("size")).select("doc_id", "key", "shard", "size", "source_size", "target", "begin"))
    shards = dealt.groupBy("key", "shard").agg(F.sum("size").alias("words"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    shards = shards.withColumn("blocks", F.ceil(F.col("words") / BLOCK)).withColumn("share", F.when(F.col("source_size") > 0, F.col("target") * F.col("words") / F.col("source_size")).otherwise(0.0)).withColumn("cap", F.floor(most * F.col("blocks")).cast("bigint"))
    shards = _quotas(written(shards), round(share * total / BLOCK))
    some = F.col("blocks") > 0
    shards = written(shards.select("key", "shard", "words", "blocks", F.when(some, F.floor(F.col("q") / F.col("blocks"))).otherwise(0).alias("rounds"), F.when(some, F.pmod("q", "blocks")).otherwise(0).alias("rest"), F.when(some, F.pmod(F.xxhash64(F.lit(seed + 2), "key", "shard"), "blocks")).otherwise(0).alias("at")))

    def overlap(lo, hi):
        return F.greatest(F.lit(0), F.least(F.col("begin") + F.col("size"), hi) - F.greatest(F.col("begin"), lo))

    begin, end = F.col("at") * BLOCK, (F.col("at") + F.col("rest")) * BLOCK
    part = overlap(begin, F.least(end, F.col("words"))) + overlap(F.lit(0), F.greatest(F.lit(0), F.col("at") + F.col("rest") - F.col("blocks")) * BLOCK)
    return dealt.join(shards, ["key", "shard"]).select("doc_id", "size", "source_size", "target", (F.col("rounds") * F.col("size") + part).cast("bigint").alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
