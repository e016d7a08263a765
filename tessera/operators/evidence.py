"""Evidence attribution: owners by longest prefix or token run, values common to all, log compaction, fuzzy matches that refuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.match import tokens
from tessera.operators.resolve import clusters


def longest_prefix(df: DataFrame, address: str, owners: DataFrame, out: str = "owner") -> DataFrame:
    """Adds the owner whose prefix (host, or host/path) is the longest that the address begins with, at a boundary.

    An address has few prefixes that end at a slash, so they are listed and meet owners by equality: no theta join."""
    parts = F.split(F.col(address), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    # an address is its own key: however often a source is read again, equal addresses have equal owners
    hits = df.select(address).distinct().select(address, F.explode(prefixes).alias("prefix")).join(owners.select("prefix", F.col("owner").alias("__o")), "prefix")
    best = hits.groupBy(address).agg(F.max_by("__o", F.struct(F.length("prefix"), "__o")).alias(out))
    return df.join(best, address, "left")


def token_run(df: DataFrame, key: str, text: Column, names: DataFrame, longest: int = 4) -> DataFrame:
    """key, owner, outcome: names (name, owner) that stand as a run of whole tokens in a text; the longest wins, several owners of
    that length refuse. Runs of up to `longest` tokens meet names by equality."""
    toks = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    rows = df.select(key, F.array_join(toks, " ").alias("__t")).where("__t != ''")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(longest)), lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("t") - n + 1)), lambda i: F.array_join(F.slice("t", i, n), " "))))
    # least and greatest owner tell whether there is one, and add up before every shuffle: no name, however common, brings a row for each owner
    span = [F.min("lo").alias("lo"), F.max("hi").alias("hi")]
    flat = names.select(F.trim(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", " ")).alias("run"), F.col("owner").alias("lo"), F.col("owner").alias("hi")).where("run != ''").groupBy("run").agg(*span)
    # a text is its own key: however many rows say the same, its runs are listed once
    texts = rows.select("__t").distinct().select("__t", F.split("__t", " ").alias("t"))
    hits = texts.select("__t", F.explode(F.array_distinct(runs)).alias("run")).join(flat, "run").withColumn("n", F.size(F.split("run", " ")))

    def longest_of(found: DataFrame, by: str) -> DataFrame:
        per = found.groupBy(by, "n").agg(*span)
        return per.groupBy(by).agg(F.max_by(F.struct("n", "lo", "hi"), "n").alias("top")).select(by, "top.*")

    best = longest_of(rows.join(longest_of(hits, "__t"), "__t"), key)
    one = F.coalesce(F.col("lo") == F.col("hi"), F.lit(False))
    return best.select(key, F.when(one, F.col("lo")).alias("owner"), F.when(one, "owned").otherwise("ambiguous").alias("outcome"))


def aliased(names: DataFrame, pairs: DataFrame, every_owner: bool = True) -> DataFrame:
    """name, owner: every name that leads to an owner's, over any number of pairs. names: name, owner; pairs: a, b, names of one person.

    Names are compared as token_run compares them. Where pairs join the names of several owners, each name has them all, and
    token_run refuses it under whichever name it comes. To refuse, two owners do: without every_owner a name of several has the
    least and the greatest, so that many names of many owners stay as many rows as names."""
    key = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    own = names.select(key(F.col("name")).alias("name"), "owner").where("name != ''").distinct()
    links = pairs.select(key(F.col("a")).alias("x"), key(F.col("b")).alias("y")).where("x != '' and y != ''")
    every = own.select("name").union(links.select("x")).union(links.select("y")).distinct().select("name", F.xxhash64("name").alias("id"))
    group = clusters(every.select("id"), links.select(F.xxhash64("x").alias("a"), F.xxhash64("y").alias("b")))
    grouped = every.join(group, "id").select("name", "cluster")
    owners = own.join(grouped, "name").select("cluster", "owner")
    if every_owner:
        owners = owners.distinct()
    else:
        ends = owners.groupBy("cluster").agg(F.array_distinct(F.array(F.min("owner"), F.max("owner"))).alias("owners"))
        owners = ends.select("cluster", F.explode("owners").alias("owner"))
    return grouped.join(owners, "cluster").select("name", "owner")


def common_to_all(df: DataFrame, group: str, member: str, value: str) -> DataFrame:
    """group, value: values that every member of a group has, from counts (no sets are collected)."""
    d = df.select(group, member, value).distinct()
    members = d.select(group, member).distinct().groupBy(group).agg(F.count("*").alias("members"))
    return d.groupBy(group, value).agg(F.count("*").alias("n")).join(members, group).where("n = members").select(group, value)


def last_decision(log: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """The last row of each key in a log."""
    best = log.groupBy(key).agg(F.max(F.struct(*order, *fields)).alias("m"))
    return best.select(key, *[F.col(f"m.{c}") for c in [*order, *fields]])


def corroborated(df: DataFrame, key: str, year: str, within: int = 2) -> DataFrame:
    """key, year: the earliest of a key's years that another follows within `within` years; null without one."""
    g = df.where(F.col(year).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set(year)).alias("y"))
    near = F.filter("y", lambda x, i: F.get("y", i + 1) - x <= within)
    return g.select(key, F.get(near, F.lit(0)).alias("year"))


def fuzzy_unique(left: DataFrame, right: DataFrame, text: str, threshold: float = 0.85) -> DataFrame:
    """id, match, outcome: the one right row whose token Jaccard reaches the threshold; several refuse. Candidates share a token."""
    def words(df: DataFrame, p: str) -> DataFrame:
        return df.select(F.col("id").alias(f"{p}id"), tokens(F.col(text)).alias(f"{p}t"))

    a, b = words(left, "l"), words(right, "r")
    pairs = a.withColumn("w", F.explode("lt")).join(b.withColumn("w", F.explode("rt")), "w").groupBy("lid", "rid").agg(F.count("*").alias("both"), F.first(F.size("lt")).alias("nl"), F.first(F.size("rt")).alias("nr"))
    good = pairs.where(F.col("both") >= threshold * (F.col("nl") + F.col("nr") - F.col("both"))).groupBy("lid").agg(F.count("*").alias("k"), F.min("rid").alias("rid"))
    out = left.select("id").join(good, F.col("id") == F.col("lid"), "left")
    return out.select("id", F.when(F.col("k") == 1, F.col("rid")).alias("match"), F.when(F.col("k") == 1, "match").when(F.col("k") > 1, "ambiguous").otherwise("none").alias("outcome"))


def reasons(*rules: tuple[str, Column]) -> Column:
    """The names of the rules that hold, in order, joined."""
    return F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for name, cond in rules])), "; ")


def unique_slugs(df: DataFrame, slug: str, order: list[Column], out: str = "unique_slug") -> DataFrame:
    """Adds slugs that differ: the first of equal ones stays, the k-th gets -k; if that form occurs naturally, a second hyphen sets it apart."""
    k = F.row_number().over(Window.partitionBy(slug).orderBy(*order))
    natural = df.select(F.col(slug).alias("__form")).distinct().withColumn("__taken", F.lit(True))
    rows = df.withColumn("__k", k).withColumn("__form", F.when(F.col("__k") > 1, F.concat(F.col(slug), F.lit("-"), F.col("__k").cast("string"))))
    rows = rows.join(natural, "__form", "left")
    return rows.withColumn(out, F.when(F.col("__k") == 1, F.col(slug)).when(F.col("__taken"), F.concat(F.col(slug), F.lit("--"), F.col("__k").cast("string"))).otherwise(F.col("__form"))).drop("__k", "__form", "__taken")


def merge_links(links: DataFrame, merge: DataFrame, key: str, other: str) -> DataFrame:
    """Links of duplicates moved to their canonical rows; a link that the canonical row (or an earlier duplicate) has is dropped.

    merge: dup, canon. Returns key, other, action (kept, moved, dropped), one row for each link that came in."""
    rows = links.join(merge.withColumnRenamed("dup", key), key, "left").withColumn("canon", F.coalesce("canon", key))
    w = Window.partitionBy("canon", other).orderBy(F.desc(F.col(key) == F.col("canon")), F.asc(key))
    action = F.when(F.row_number().over(w) > 1, "dropped").when(F.col(key) == F.col("canon"), "kept").otherwise("moved")
    return rows.select(F.col("canon").alias(key), other, action.alias("action"))


def greedy_covers(candidates: DataFrame, lists: int = 120, covers: int = 3) -> DataFrame:
    """list, covers: lists in order take their best covers that no earlier list took. candidates: list, place, cover, rank (few for each).

    Taking is sequential by nature; it is one fold over at most `lists` lists."""
    c = candidates.where(F.col("place") <= lists).groupBy("place", "list").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "cover"))), lambda x: x["cover"]).alias("all"))
    one = c.agg(F.sort_array(F.collect_list(F.struct("place", "list", "all"))).alias("rows"))
    empty = F.struct(F.array().cast("array<string>").alias("used"), F.array().cast("array<struct<list:bigint,covers:array<string>>>").alias("out"))

    def step(state: Column, row: Column) -> Column:
        mine = F.slice(F.array_except(row["all"], state["used"]), 1, covers)
        return F.struct(F.concat(state["used"], mine).alias("used"), F.concat(state["out"], F.array(F.struct(row["list"].cast("bigint").alias("list"), mine.alias("covers")))).alias("out"))

    return one.select(F.explode(F.aggregate("rows", empty, step)["out"]).alias("x")).select("x.list", "x.covers")


def page_numbers(page: int, pages: int, around: int = 2) -> list[int | None]:
    """The numbers a pager shows: first, last and those around the page; None for a gap."""
    shown = sorted({1, pages, *range(max(1, page - around), min(pages, page + around) + 1)}) if pages else []
    out: list[int | None] = []
    for n in shown:
        if out and n - out[-1] > 1:
            out.append(None)
        out.append(n)
    return out
