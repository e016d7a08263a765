"""Sourcing research: re-attribution of joined evidence, candidate choice, completeness, grades, bibliographies."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import evidence, urls
from tessera.functions.match import sequence_ratio
from tessera.operators.resolve import stored

#: Rows of one address from which on they are not brought together: what is known of it is sent to them.
OFTEN = 200_000


def reattributed(recs: DataFrame, owners: DataFrame) -> DataFrame:
    """What becomes of each address in evidence that joins several.

    recs: rec_id, item, person, source_url, quote. owners: url, owner (whom an address belongs to). Returns rec_id, place, url,
    owner, quote, action:
    KEEP_OWN (the row's own best address), MOVE_TO_EXISTING (the owner has a row for the item without clean evidence),
    CREATE_FOR_OTHER (the owner has none), DUPLICATE (served already), DROP (nobody's). A quote goes along only if the same address
    carries it alone elsewhere, or if it is the one quote that all joined rows with the address share."""
    joined = F.col("source_url").contains("|") | F.coalesce(F.col("quote").contains("|"), F.lit(False))
    rows = recs.where(joined).withColumn("quotes", evidence.segments(F.col("quote")))
    seg = stored(rows.select("rec_id", "item", "person", "quotes", F.posexplode(evidence.segments(F.col("source_url"))).alias("place", "url")))
    alone = recs.where(~joined & F.col("quote").isNotNull()).select(F.trim("source_url").alias("url"), F.trim("quote").alias("known")).distinct()
    spread = seg.select("url", "item", F.explode("quotes").alias("q")).distinct()
    items = seg.select("url", "item").distinct().groupBy("url").agg(F.count("*").alias("items")).where("items > 1")
    shared = spread.groupBy("url", "q").agg(F.count("*").alias("n")).join(items, "url").where("n = items").groupBy("url").agg(F.count("*").alias("k"), F.min("q").alias("cross")).where("k = 1").select("url", "cross")
    facts = owners.join(shared, "url", "full")
    often = seg.groupBy("url").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN).select("url")
    seg = seg.join(F.broadcast(often), "url", "left_anti").join(facts, "url", "left").unionByName(seg.join(F.broadcast(often.join(facts, "url", "left")), "url"))
    proven = seg.where("owner is not null").withColumn("known", F.explode("quotes")).join(alone, ["url", "known"]).groupBy("rec_id", "place").agg(F.count_distinct("known").alias("k"), F.min("known").alias("q"))
    seg = seg.join(proven, ["rec_id", "place"], "left")
    cross = F.when(F.array_contains("quotes", F.col("cross")), F.col("cross"))
    seg = seg.withColumn("quote", F.when(F.col("owner").isNotNull(), F.when(F.col("k") == 1, F.col("q")).when(F.col("k").isNull(), cross))).drop("k", "q", "cross", "quotes")
    quality = [F.when(F.length("quote") >= 50, 0).when(F.col("quote").isNotNull(), 1).otherwise(2), F.asc("place"), F.asc("rec_id")]
    own = F.col("owner").eqNullSafe(F.col("person"))
    seg = seg.withColumn("own", own).withColumn("rank", F.when(F.col("own"), F.row_number().over(Window.partitionBy("rec_id", "own").orderBy(*quality))).otherwise(F.row_number().over(Window.partitionBy("item", "owner", "own").orderBy(*quality))))
    keeps = seg.where("own and rank = 1").select(F.col("rec_id").alias("target"), F.lit(True).alias("keeps"))
    clean = (~joined & (F.size(urls.split_urls(F.col("source_url"))) == 1)).alias("clean")
    target = recs.groupBy("item", F.col("person").alias("owner")).agg(F.min("rec_id").alias("target"), F.max(clean).alias("clean"))
    # most segments have no target: looked up by it they would all meet in one task
    seg = seg.join(target.join(keeps, "target", "left"), ["item", "owner"], "left")
    action = (
        F.when(F.col("owner").isNull(), "DROP").when(F.col("own") & (F.col("rank") == 1), "KEEP_OWN").when(F.col("rank") > 1, "DUPLICATE")
        .when(F.col("target").isNull(), "CREATE_FOR_OTHER").when(F.coalesce("keeps", F.lit(False)) | F.coalesce("clean", F.lit(False)), "DUPLICATE").otherwise("MOVE_TO_EXISTING")
    )
    return seg.select("rec_id", "place", "url", "owner", "quote", action.alias("action"))


def best_candidate(candidates: DataFrame, key: str, order: list[Column], score: str, fields: list[str], near: float = 0.7) -> DataFrame:
    """The first candidate of each key; its empty fields are filled from the next ones that score `near` or more, in order."""
    ranked = candidates.withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    usable = ranked.where((F.col("__k") == 1) | (F.col(score) >= near))
    blank = lambda c: F.when(F.trim(F.col(c).cast("string")) != "", F.col(c))
    filled = [F.min_by(c, F.when(blank(c).isNotNull(), F.col("__k"))).alias(c) for c in fields]
    return usable.groupBy(key).agg(F.max(F.when(F.col("__k") == 1, F.col(score))).alias(score), *filled)


def missing_works(series: DataFrame, works: DataFrame, least: float = 0.85) -> DataFrame:
    """series, title: works of a series' author that no member's title is like. series: series, author, title; works: author, title.

    Titles meet within an author only; equal and contained titles are settled before the slower similarity."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    main = series.groupBy("series", "author").agg(F.count("*").alias("n")).groupBy("series").agg(F.max_by("author", F.struct("n", "author")).alias("author"))
    want = main.join(works.select("author", F.col("title").alias("work")), "author").withColumn("w", norm("work"))
    pairs = want.join(series.select("series", norm("title").alias("t")).distinct(), "series")
    quick = F.when(F.col("w") == F.col("t"), 1.0).when((F.col("t") != "") & (F.col("w").contains(F.col("t")) | F.col("t").contains(F.col("w"))), 0.88)
    pairs = pairs.withColumn("quick", quick)
    slow = pairs.where("quick is null").withColumn("sim", sequence_ratio("w", "t"))
    both = pairs.where("quick is not null").withColumn("sim", F.col("quick")).unionByName(slow)
    return both.groupBy("series", "work").agg(F.max("sim").alias("sim")).where(F.col("sim") < least).select("series", F.col("work").alias("title"))


def source_grade(own: Column, kind: Column, names_title: Column, quoted: Column, year: Column, published: Column, cited: Column) -> Column:
    """strong, medium, weak or rejected: whose page it is caps the grade; what it says, how often it is cited and when it is from lower it."""
    early = F.coalesce(year < published - 1, F.lit(False))
    base = F.when(own & quoted, "strong").when(own & names_title, "medium").when(kind.isin("podcast", "youtube", "article") & names_title, "medium").otherwise("weak")
    return F.when(early, "rejected").when((base == "strong") & (cited >= 5), "medium").when((base == "medium") & (cited >= 5), "weak").otherwise(base)


def bibliography(pages: DataFrame) -> DataFrame:
    """page, title, year, ord from wiki text (page, text): rows of tables that have a title and a year column, then bullets under
    headings that are a year. Pages are parsed one by one where they lie."""

    def plain(s: str) -> str:
        s = re.sub(r"<ref[^>]*?(?:/>|>.*?</ref>)", "", s, flags=re.S)
        s = re.sub(r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", r"\1", s)
        return " ".join(re.sub(r"'{2,}|\{\{[^}]*\}\}|<[^>]+>", "", s).split())

    def year(s: str) -> int | None:
        m = re.search(r"\b(?:1[89]|20)\d\d\b", s)
        return int(m[0]) if m else None

    def entries(text: str) -> Iterator[tuple[str, int]]:
        for grid in re.findall(r"\{\|.*?^\|\}", text, flags=re.S | re.M):
            blocks = re.split(r"^\|-.*$", grid, flags=re.M)
            heads: list[str] = []
            for block in blocks:
                marks = [plain(h.split("|")[-1]).lower() for line in re.findall(r"^!(.*)$", block, flags=re.M) for h in line.split("!!")]
                if marks:
                    heads = marks
                    continue
                cells = [plain(c if "[[" in c.split("|")[0] else c.split("|")[-1]) for line in re.findall(r"^\|(?![}+\-])(.*)$", block, flags=re.M) for c in line.split("||")]
                at = {name: next((i for i, h in enumerate(heads) if name in h), None) for name in ("title", "year")}
                if None not in at.values() and max(at.values()) < len(cells) and cells[at["title"]] and year(cells[at["year"]]):
                    yield cells[at["title"]], year(cells[at["year"]])
        now = None
        for line in text.splitlines():
            if head := re.match(r"==+(.*?)==+\s*$", line):
                now = year(head[1]) if re.fullmatch(r"\s*\d{4}\s*", head[1]) else None
            elif now and (bullet := re.match(r"\*+\s*(''.+?''|\[\[.+?\]\])", line)) and plain(bullet[1]):
                yield plain(bullet[1]), now

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(page, *e, k) for page, text in zip(f.page, f.text, strict=True) for k, e in enumerate(entries(text or ""), 1)]
            yield pd.DataFrame(rows, columns=["page", "title", "year", "ord"])

    return pages.select("page", "text").mapInPandas(run, "page bigint, title string, year int, ord int")


def author_match(a: Column, b: Column) -> Column:
    """strong, weak or null for two authors' names, first of several each.

    Strong: the same words in any order, or the words of one among the other's (two at least), or one last name (or one letter apart from
    six letters on) with given names that may be each other's short form or initial. Weak: one last name, other given names."""
    def words(c: Column) -> Column:
        first = F.split(F.regexp_replace(F.lower(c), "[.']", " "), r"\s*(?:,|&|;|/|\band\b|\bwith\b)\s*").getItem(0)
        return F.filter(F.split(first, "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin("dr", "mr", "mrs", "ms", "sir", "jr", "sr", "phd", "md"))

    x, y = words(a), words(b)
    last = lambda w: F.try_element_at(w, F.lit(-1))
    given = lambda w: F.when(F.size(w) > 1, F.get(w, F.lit(0)))
    surname = (last(x) == last(y)) | ((F.least(F.length(last(x)), F.length(last(y))) >= 6) & (F.levenshtein(last(x), last(y)) <= 1))
    gx, gy = given(x), given(y)
    short = gx.isNull() | gy.isNull() | gx.startswith(gy) | gy.startswith(gx)
    inside = (F.least(F.size(x), F.size(y)) >= 2) & ((F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(None)).when((F.array_sort(x) == F.array_sort(y)) | inside | (surname & short), "strong").when(surname, "weak")
