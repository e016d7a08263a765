"""Set-similarity joins by rare tokens, and the matching ladder of one person's books."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.match import jaccard
from tessera.operators.resolve import stored, together


def _ordered(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Adds rare: the row's distinct tokens, the rarest first."""
    each = rows.select("id", F.explode("tokens").alias("w")).join(counts, "w")
    per = each.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "w"))), lambda x: x["w"]).alias("rare"))  # as long as the row's own text
    return rows.join(per, "id")


def _prefix(n: Column, threshold: float) -> Column:
    """How many of n tokens two sets of that similarity cannot both go without sharing one."""
    return (n - F.ceil(F.lit(threshold) * n - 1e-9) + 1).cast("int")


def candidates(left: DataFrame, right: DataFrame, threshold: float, scope: list[str] | None = None) -> DataFrame:
    """lid, rid, lt, rt: pairs of one scope that share one of their rarest tokens and whose sizes allow the similarity.

    left, right: id, tokens (distinct), scope columns. Tokens are ordered by how many rows of both sides have them: of a set of n
    only the n - ceil(threshold n) + 1 rarest are joined, so a word that is everywhere brings pairs only to sets of nothing else."""
    scope = scope or []
    both = left.select("tokens").unionByName(right.select("tokens"))
    counts = both.select(F.explode("tokens").alias("w")).groupBy("w").agg(F.count("*").alias("n"))

    def side(rows: DataFrame, p: str) -> DataFrame:
        rows = _ordered(rows.select("id", "tokens", *scope).where(F.size("tokens") > 0), counts)
        return rows.select(F.col("id").alias(f"{p}id"), F.col("tokens").alias(f"{p}t"), *scope, F.explode(F.slice("rare", F.lit(1), _prefix(F.size("tokens"), threshold))).alias("w"))

    pairs = side(left, "l").join(side(right, "r"), [*scope, "w"])
    nl, nr = F.size("lt"), F.size("rt")
    fits = (nr >= F.lit(threshold) * nl - 1e-9) & (nl >= F.lit(threshold) * nr - 1e-9)
    return pairs.where(fits).select("lid", "rid", "lt", "rt").dropDuplicates(["lid", "rid"])


def set_join(left: DataFrame, right: DataFrame, threshold: float, scope: list[str] | None = None) -> DataFrame:
    """lid, rid, score of the pairs whose token Jaccard reaches the threshold; ids are unique on each side. Empty sets are like nothing."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0 and at most 1")
    pairs = candidates(left, right, threshold, scope).select("lid", "rid", jaccard(F.col("lt"), F.col("rt")).alias("score"))
    return pairs.where(F.col("score") >= threshold - math.ulp(threshold))


#: A title of so few words is too common to match by its name alone; likeness that titles need.
GENERIC_WORDS, LIKE = 3, 0.82


def normalised(c: Column) -> Column:
    """Small letters and digits, words apart by one blank."""
    s = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "['‘’“”\"`]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, r"[^a-z0-9\s]", " "), r"\s+", " "))


def words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(normalised(c), " "), lambda w: w != ""))


#: Rows of which a task matches the people, and rows of both sides that are matched in one go, about.
TASK_ROWS, GO_ROWS = 100_000, 20_000_000


def matched(wanted: DataFrame, held: DataFrame) -> DataFrame:
    """cid, match, status, score: which book of the same person a candidate names; the first tier with any hit decides, several hits are ambiguous and end the search.

    wanted: cid, person, title, author; held: person, item, title, author. Tiers: title and author as written, both normalised,
    normalised title and surname, titles alike by LIKE with a word of the author's name. The last two need a title of more than
    GENERIC_WORDS words. Scores: 1, 0.97, 0.9, the likeness.

    Rows travel once, as written, to their person's task; keys are made and compared there. Beyond GO_ROWS rows the people are
    matched in several goes, whose results are stored: what a go shuffles is deleted before the next."""
    rows = wanted.select(F.lit(0).alias("side"), F.col("cid").alias("id"), "person", "title", "author").unionByName(held.select(F.lit(1).alias("side"), F.col("item").alias("id"), "person", "title", "author"))
    n = rows.count()
    goes = max(1, math.ceil(n / GO_ROWS))
    tasks = max(1, math.ceil(n / goes / TASK_ROWS))
    if goes == 1:
        return _in_place(rows.repartition(tasks, "person"))
    return together([stored(_in_place(rows.where(F.pmod(F.xxhash64("person"), F.lit(goes)) == go).repartition(tasks, "person"))) for go in range(goes)])


def _in_place(rows: DataFrame) -> DataFrame:
    """matched() of rows (side: 0 for wanted, 1 for held; id, person, title, author) that are dealt by person: nothing here moves a row to another task."""
    lower = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = rows.select("row", "side", "id", "person", lower("title").alias("lt"), lower("author").alias("la"), normalised(F.col("title")).alias("t"), normalised(F.col("author")).alias("a"))
    rows = rows.withColumn("last", F.coalesce(F.try_element_at(F.split("a", " "), F.lit(-1)), F.lit("")))
    named, long = F.col("lt") != "", F.size(F.split("t", " ")) > GENERIC_WORDS
    tiers = [("exact_title_author", 1.0, ["lt", "la"], named), ("normalized_title_author", 0.97, ["t", "a"], named), ("title_author_surname", 0.9, ["t", "last"], long & (F.col("last") != ""))]
    result = F.lit(None).cast(f"struct<n: bigint, item: {rows.schema['id'].dataType.simpleString()}, status: string, score: double>")
    for place, (_, _, keys, _) in enumerate(tiers):
        same = Window.partitionBy("person", *keys)
        rows = rows.withColumn(f"n{place}", F.sum("side").over(same)).withColumn(f"item{place}", F.min(F.when(F.col("side") == 1, F.col("id"))).over(same))
    for place, (name, score, _, asks) in reversed(list(enumerate(tiers))):
        hit = F.struct(F.col(f"n{place}").alias("n"), F.col(f"item{place}").alias("item"), F.lit(name).alias("status"), F.lit(score).alias("score"))
        result = F.when(asks & F.col("person").isNotNull() & (F.col(f"n{place}") > 0), hit).otherwise(result)
    rows = rows.select("row", "side", "id", "person", F.when(F.col("side") == 0, result).alias("result"), words(F.col("t")).alias("tokens"), words(F.col("a")).alias("names"), long.alias("long"))
    # of a set of n words two alike ones share one of the first few, in any order that is the same for all: long words are the rarer ones
    first = F.transform(F.array_sort(F.transform("tokens", lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"])
    first = F.when(F.size("tokens") > 0, F.slice(first, F.lit(1), _prefix(F.size("tokens"), LIKE)))
    open_ = (F.col("side") == 1) | (F.col("result").isNull() & F.col("long"))
    rows = rows.withColumn("w", F.explode(F.when(open_ & F.col("person").isNotNull(), first).when(F.col("side") == 0, F.array(F.lit(None).cast("string")))))
    one = F.struct("row", "id", "result", "tokens", "names")
    met = rows.groupBy("person", "w").agg(F.collect_list(F.when(F.col("side") == 0, one)).alias("l"), F.collect_list(F.when(F.col("side") == 1, F.struct("id", "tokens", "names"))).alias("r"))
    met = met.where(F.size("l") > 0).select("person", F.explode("l").alias("l"), "r")
    nl = F.size("l.tokens")

    def alike(x: Column) -> Column:
        nr = F.size(x["tokens"])
        fits = (nr >= F.lit(LIKE) * nl - 1e-9) & (nl >= F.lit(LIKE) * nr - 1e-9)
        return fits & F.arrays_overlap(F.col("l.names"), x["names"]) & (jaccard(F.col("l.tokens"), x["tokens"]) >= LIKE - math.ulp(LIKE))

    fuzzy = F.transform(F.filter("r", alike), lambda x: F.struct(x["id"].alias("item"), jaccard(F.col("l.tokens"), x["tokens"]).alias("score")))
    met = met.select("person", F.col("l.row").alias("row"), F.col("l.id").alias("id"), F.col("l.result").alias("result"), F.when(F.size("l.tokens") > 0, fuzzy).alias("fuzzy"))
    per = met.groupBy("person", "row").agg(F.first("id").alias("id"), F.first("result").alias("x"), F.array_distinct(F.flatten(F.collect_list("fuzzy"))).alias("fuzzy"))
    n = F.coalesce(F.col("x.n"), F.size("fuzzy").cast("bigint"))
    found = F.get("fuzzy", F.lit(0))
    status = F.when(n == 0, "unmatched").when(n > 1, "ambiguous").otherwise(F.coalesce("x.status", F.lit("fuzzy")))
    return per.select(F.col("id").alias("cid"), F.when(n == 1, F.coalesce("x.item", found["item"])).alias("match"), status.alias("status"), F.when(n == 1, F.coalesce("x.score", found["score"])).otherwise(0.0).alias("score"))
