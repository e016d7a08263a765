"""Cards of a page: each title with the author and the source that stand near behind it, by offsets of tokens in the page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.html import visible_text

#: How far behind a title's end an author and a source may end.
AUTHOR_WITHIN, SOURCE_WITHIN = 400, 2500


def tokens(pages: DataFrame, key: str, html: str, pattern: str) -> DataFrame:
    """key, at, end, groups: every match of a pattern in a page with the offset of its first character and of the one behind it.

    A page is split at the matches; the lengths of what lies between and of the matches add up to the offsets."""
    parts = F.split(html, pattern, -1)
    whole = F.regexp_extract_all(html, F.lit(f"({pattern})"), F.lit(1))
    each = pages.where(F.col(html).isNotNull()).select(key, F.posexplode(F.arrays_zip(parts.alias("part"), whole.alias("match"))).alias("no", "x"))
    before = F.sum(F.length("x.part") + F.coalesce(F.length("x.match"), F.lit(0))).over(Window.partitionBy(key).orderBy("no"))
    return each.withColumn("end", before).where("x.match is not null").select(key, (F.col("end") - F.length("x.match")).alias("at"), "end", F.col("x.match").alias("match"))


def plain(c: Column) -> Column:
    """The text of a piece of HTML: without tags, entities resolved, blanks joined."""
    return F.trim(F.regexp_replace(visible_text(c), r"\s+", " "))


def cards(pages: DataFrame, key: str, html: str, title: str, author: str, source: str, source_holds: list[str] | None = None) -> DataFrame:
    """key, no, title, author, source, label: the titles of each page in order, with the nearest author and source behind each.

    title, author: patterns whose group 1 is the text; source: group 1 the address, group 2 the label, of which one of
    `source_holds` must be a part (in any case). An author counts if it begins at or after the title's end and ends within
    AUTHOR_WITHIN characters of it, a source within SOURCE_WITHIN; the first of each is the card's. Titles without text make no
    card. Pages without HTML have none. Titles, authors and sources meet by one ordered pass over each page's tokens."""
    rows = tokens(pages, key, html, title).select(key, "at", "end", F.lit("t").alias("kind"), "match")
    rows = rows.unionByName(tokens(pages, key, html, author).select(key, "at", "end", F.lit("a").alias("kind"), "match"))
    found = tokens(pages, key, html, source).select(key, "at", "end", F.lit("s").alias("kind"), "match")
    if source_holds:
        label = F.lower(F.regexp_extract("match", source, 2))
        found = found.where(F.exists(F.array(*map(F.lit, source_holds)), lambda t: F.contains(label, t)))
    rows = rows.unionByName(found)
    # a title looks at what begins where it ends or later: it is placed at its end, before what begins there
    place = F.when(F.col("kind") == "t", F.col("end")).otherwise(F.col("at"))
    w = Window.partitionBy(key).orderBy("place", "order", "at").rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("place", place).withColumn("order", F.when(F.col("kind") == "t", 0).otherwise(1))
    nearest = lambda kind: F.first(F.when(F.col("kind") == kind, F.struct("end", "match")), ignorenulls=True).over(w)
    rows = rows.select(key, "kind", "at", "end", "match", nearest("a").alias("a"), nearest("s").alias("s")).where("kind = 't'")
    text = plain(F.regexp_extract("match", title, 1))
    near_a, near_s = F.col("a.end") - F.col("end") <= AUTHOR_WITHIN, F.col("s.end") - F.col("end") <= SOURCE_WITHIN
    rows = rows.select(
        key, "at", text.alias("title"), F.when(near_a, plain(F.regexp_extract("a.match", author, 1))).alias("author"),
        F.when(near_s, F.regexp_extract("s.match", source, 1)).alias("source"), F.when(near_s, F.regexp_extract("s.match", source, 2)).alias("label"),
    ).where("title != ''")
    return rows.withColumn("no", F.row_number().over(Window.partitionBy(key).orderBy("at"))).select(key, "no", "title", "author", "source", "label")
