"""Plans of the sourcing research over derived evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import research
from tessera.plans.registry import query
from tessera.sources.mapping import Catalogue, over


@query(over("recs_", """, r AS (SELECT rec_id, item, person, CASE WHEN rec_id % 4 = 0 THEN 'https://p' || person || '.example/x | https://p' || (person + 1) || '.example/y | https://nobody.example/z' WHEN rec_id % 4 = 1 THEN 'https://p' || person || '.example/x' END AS src FROM recs_),
s AS (SELECT rec_id, item, person, 0 AS place, person AS owner FROM r WHERE rec_id % 4 = 0 UNION ALL SELECT rec_id, item, person, 1, person + 1 FROM r WHERE rec_id % 4 = 0 UNION ALL SELECT rec_id, item, person, 2, NULL FROM r WHERE rec_id % 4 = 0),
k AS (SELECT *, CASE WHEN person = owner THEN row_number() OVER (PARTITION BY rec_id, person = owner ORDER BY place) ELSE row_number() OVER (PARTITION BY item, owner, person = owner ORDER BY place, rec_id) END AS n FROM s),
t AS (SELECT item, person AS owner, min(rec_id) AS target, max((rec_id % 4 = 1)::INT) AS clean FROM r GROUP BY 1, 2)
SELECT action, count(*) AS n FROM (SELECT CASE WHEN k.owner IS NULL THEN 'DROP' WHEN k.owner = person AND n = 1 THEN 'KEEP_OWN' WHEN n > 1 THEN 'DUPLICATE' WHEN target IS NULL THEN 'CREATE_FOR_OTHER' WHEN clean = 1 OR target % 4 = 0 THEN 'DUPLICATE' ELSE 'MOVE_TO_EXISTING' END AS action FROM k LEFT JOIN t ON k.item = t.item AND k.owner = t.owner) GROUP BY action"""))
def reattribution(c: Catalogue) -> DataFrame:
    """Actions on addresses in joined evidence: own, another's, nobody's."""
    p = F.col("person")
    page = lambda who, tail: F.concat(F.lit("https://p"), who.cast("string"), F.lit(".example/" + tail))
    source = F.when(F.col("rec_id") % 4 == 0, F.concat_ws(" | ", page(p, "x"), page(p + 1, "y"), F.lit("https://nobody.example/z"))).when(F.col("rec_id") % 4 == 1, page(p, "x"))
    recs = c.recs.select("rec_id", "item", "person", source.alias("source_url"), F.lit(None).cast("string").alias("quote"))
    who = c.people.select("id").union(c.people.agg((F.max("id") + 1).alias("id")))
    owners = who.select(page(F.col("id"), "x").alias("url"), F.col("id").alias("owner")).union(who.select(page(F.col("id"), "y"), "id"))
    return research.reattributed(recs, owners).groupBy("action").agg(F.count("*").alias("n"))


@query(over("items", """, c AS (SELECT title AS k, id, size / 50.0 AS score, CASE WHEN id % 3 = 0 THEN author END AS author, CASE WHEN id % 5 = 0 THEN kind ELSE '' END AS kind FROM items),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, id) AS n FROM c), u AS (SELECT * FROM r WHERE n = 1 OR score >= 0.7)
SELECT k, round(max(score) FILTER (WHERE n = 1), 6) AS score, arg_min(author, n) FILTER (WHERE author IS NOT NULL) AS author, arg_min(kind, n) FILTER (WHERE kind <> '') AS kind FROM u GROUP BY k"""))
def enrichment_pick(c: Catalogue) -> DataFrame:
    """The best candidate of each title with its gaps filled from near ones."""
    rows = c.items.select(F.col("title").alias("k"), "id", (F.col("size") / 50).alias("score"), F.when(F.col("id") % 3 == 0, F.col("author")).alias("author"), F.when(F.col("id") % 5 == 0, F.col("kind")).otherwise("").alias("kind"))
    best = research.best_candidate(rows, "k", [F.desc("score"), F.asc("id")], "score", ["author", "kind"])
    return best.select("k", F.round("score", 6).alias("score"), "author", "kind")


@query()
def missing_works(c: Catalogue) -> DataFrame:
    """Works of a series' author that the series lacks, by similarity (no SQL for it: tested against difflib). Members are the items of more than 25."""
    have = c.items.where("size > 25").select("series", F.col("series").alias("author"), "title")
    works = c.items.select(F.col("series").alias("author"), "title").distinct()
    return research.missing_works(have, works, 0.85)


@query(over("recs_ items", """SELECT grade, count(*) AS n FROM (SELECT CASE WHEN 1990 + rec_id % 9 < year(at_) - 1 THEN 'rejected' WHEN rec_id % 2 = 0 AND rec_id % 3 = 0 THEN CASE WHEN person % 7 >= 5 THEN 'medium' ELSE 'strong' END WHEN rec_id % 2 = 0 OR rec_id % 5 = 0 THEN CASE WHEN person % 7 >= 5 THEN 'weak' ELSE 'medium' END ELSE 'weak' END AS grade FROM recs_) GROUP BY grade"""))
def source_grades(c: Catalogue) -> DataFrame:
    """Grades of sources by whose they are, what they say, how often they are cited and when they are from."""
    r = F.col("rec_id")
    kind = F.when(r % 5 == 0, "article").otherwise("tweet")
    grade = research.source_grade(r % 2 == 0, kind, F.lit(True), r % 3 == 0, 1990 + r % 9, F.year("at"), F.col("person") % 7)
    return c.recs.groupBy(grade.alias("grade")).agg(F.count("*").alias("n"))


@query(over("people", """SELECT CASE WHEN id % 3 = 2 THEN 'weak' ELSE 'strong' END AS verdict, count(*) AS n FROM people GROUP BY 1"""))
def author_matches(c: Catalogue) -> DataFrame:
    """Names against forms of themselves: turned round, with an initial, with another given name."""
    name = F.concat(F.lit("Alice "), F.translate(F.lpad(F.col("id").cast("string"), 6, "0"), "0123456789", "abcdefghij"))
    last = F.element_at(F.split(name, " "), 2)
    other = F.when(F.col("id") % 3 == 0, F.concat_ws(" ", last, F.lit("Alice"))).when(F.col("id") % 3 == 1, F.concat_ws(" ", F.lit("A."), last)).otherwise(F.concat_ws(" ", F.lit("Bob"), last))
    return c.people.groupBy(research.author_match(name, other).alias("verdict")).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT doc_id, 1900 + doc_id % 100 AS y, trim(regexp_extract(text, '^[A-Za-z]+')) AS t FROM documents) SELECT doc_id AS page, t AS title, y::INTEGER AS year, 1 AS ord FROM p WHERE t <> ''""")
def bibliographies(c: Catalogue) -> DataFrame:
    """Titles under year headings, from wiki text made of each document's first word."""
    word = F.regexp_extract("text", "^[A-Za-z]+", 0)
    y = (1900 + F.col("doc_id") % 100).cast("string")
    text = F.concat(F.lit("== Works ==\n=== "), y, F.lit(" ===\n* ''"), word, F.lit("'' (novel)\n== Notes ==\n* ''Not one''\n"))
    return research.bibliography(c.t("documents").select(F.col("doc_id").alias("page"), text.alias("text")))


