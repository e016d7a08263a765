"""Catalogue reads: pages, rankings, counts, look-ups, search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import classify_role, is_numeric_title, slugify, surname_alias
from tessera.operators.relational import contains_any, first_wins, page, ring, top, top_per, with_count
from tessera.plans.registry import query
from tessera.sources.mapping import Catalogue, over

SLUG = r"trim(regexp_replace(regexp_replace(lower(trim({})), '[^a-z0-9\s-]', '', 'g'), '[\s-]+', '-', 'g'), '-')"


@query(over("counted", f"""
, eligible AS (SELECT author, {SLUG.format('author')} AS slug, recs FROM counted WHERE price IS NOT NULL AND author <> '' AND size > 5),
grouped AS (SELECT author, slug, count(*) AS items, sum(recs)::BIGINT AS total FROM eligible WHERE slug <> '' GROUP BY author, slug),
names AS (SELECT slug FROM grouped GROUP BY slug HAVING count(*) = 1)
SELECT author AS author_name, slug AS author_catalog_slug, items AS eligible_item_count, total AS total_recommendation_count
FROM grouped JOIN names USING (slug) ORDER BY items DESC, total DESC, slug LIMIT 10"""))
def author_catalog(c: Catalogue, limit: int = 10) -> DataFrame:
    """Authors with the most eligible items. Items of a series (here: of size 5 or less) leave by an anti join; a slug that
    two spellings share is dropped; three keys order."""
    in_series = c.items.where("size <= 5").select("id")
    eligible = c.counted_items.where("price is not null and author != ''").join(in_series, "id", "left_anti").withColumn("slug", slugify(F.col("author"))).where("slug != ''")
    grouped = eligible.groupBy("author", "slug").agg(F.count("*").alias("items"), F.sum("recs").alias("total"))
    names = grouped.groupBy("slug").agg(F.count("*").alias("n")).where("n = 1").select("slug")
    rows = top(grouped.join(names, "slug"), [F.desc("items"), F.desc("total"), F.asc("slug")], limit)
    return rows.select(F.col("author").alias("author_name"), F.col("slug").alias("author_catalog_slug"), F.col("items").alias("eligible_item_count"), F.col("total").alias("total_recommendation_count"))


@query(over("counted", "SELECT id, title, recs, rating FROM counted WHERE price > 0 AND NOT regexp_matches(title, '^\\s*\\d{1,5}(\\.\\d+)?\\s*$') ORDER BY recs DESC NULLS LAST, title, id LIMIT 24 OFFSET 24"))
def top_items_page2(c: Catalogue) -> DataFrame:
    rows = c.counted_items.where((F.col("price") > 0) & ~is_numeric_title(F.col("title")))
    return page(rows, [F.desc_nulls_last("recs"), F.asc("title"), F.asc("id")], 2, 24).select("id", "title", "recs", "rating")


@query(over("people counted lists", """
SELECT * FROM (SELECT 'item' AS kind, id, recs::DOUBLE AS score FROM counted ORDER BY recs DESC, id LIMIT 8)
UNION ALL SELECT * FROM (SELECT 'person', id, quality FROM people WHERE published ORDER BY quality DESC, id LIMIT 8)
UNION ALL SELECT * FROM (SELECT 'list', id, n::DOUBLE FROM lists ORDER BY n DESC, id LIMIT 8)"""))
def featured(c: Catalogue) -> DataFrame:
    def best(df, kind, score):
        return top(df, [F.desc(score), F.asc("id")], 8).select(F.lit(kind).alias("kind"), "id", F.col(score).cast("double").alias("score"))

    return best(c.counted_items, "item", "recs").union(best(c.people.where("published"), "person", "quality")).union(best(c.lists, "list", "n"))


@query(over("items", f""", keyed AS (SELECT id, {SLUG.format("title || ' ' || author")} AS slug FROM items), live AS (SELECT slug, min(id) AS live_id FROM keyed GROUP BY slug)
SELECT id AS retired_id, live_id, slug FROM keyed JOIN live USING (slug) WHERE id <> live_id"""))
def redirects(c: Catalogue) -> DataFrame:
    """Retired ids and the live row of their slug; a row never leads to itself."""
    keyed = c.items.select("id", slugify(F.concat_ws(" ", "title", "author")).alias("slug"))
    live = keyed.groupBy("slug").agg(F.min("id").alias("live_id"))
    return keyed.join(live, "slug").where("id != live_id").select(F.col("id").alias("retired_id"), "live_id", "slug")


@query(over("items", "SELECT series, id, title, size AS position, row_number() OVER (PARTITION BY series ORDER BY size NULLS LAST, id) AS ord FROM items"))
def series_items_ordered(c: Catalogue) -> DataFrame:
    w = Window.partitionBy("series").orderBy(F.asc_nulls_last("size"), "id")
    return c.items.select("series", "id", "title", F.col("size").alias("position"), F.row_number().over(w).cast("bigint").alias("ord"))


@query(over("items", "SELECT series, count(size) > 0 AS has_positions, count(*) AS n FROM items GROUP BY series"))
def series_has_positions(c: Catalogue) -> DataFrame:
    return c.items.groupBy("series").agg((F.count("size") > 0).alias("has_positions"), F.count("*").alias("n"))


@query(over("people shelves", """, rec AS (SELECT person, count(*) AS recs FROM shelves GROUP BY person), ord AS (SELECT o_custkey AS person, count(*) AS n FROM orders GROUP BY 1)
SELECT id, name, coalesce(recs, 0) AS recs, coalesce(n, 0) AS orders, quality FROM people LEFT JOIN rec ON id = rec.person LEFT JOIN ord ON id = ord.person ORDER BY recs DESC, quality DESC, name LIMIT 50"""))
def people_counts(c: Catalogue) -> DataFrame:
    rows = with_count(with_count(c.people, c.shelves, "person", "recs"), c.t("orders").withColumnRenamed("o_custkey", "person"), "person", "orders")
    return top(rows, [F.desc("recs"), F.desc("quality"), F.asc("name")], 50).select("id", "name", "recs", "orders", "quality")


@query(over("recs_ items", """, best AS (SELECT *, row_number() OVER (PARTITION BY person, item ORDER BY confidence DESC NULLS LAST, rec_id) AS k FROM recs_)
SELECT person, item, title, confidence, CAST(CAST(at_ AS DATE) AS VARCHAR) AS day FROM best JOIN items ON item = items.id WHERE k = 1"""))
def person_proof(c: Catalogue) -> DataFrame:
    """The most confident recommendation of each item by each person."""
    rows = top_per(c.recs, ["person", "item"], [F.desc_nulls_last("confidence"), F.asc("rec_id")], 1)
    return rows.join(c.items.select(F.col("id").alias("item"), "title"), "item").select("person", "item", "title", "confidence", F.col("at").cast("date").cast("string").alias("day"))


@query(over("lists", "SELECT id, title, n, count(*) OVER () AS total FROM lists WHERE quality > 0 OR id IN (1, 2, 3) ORDER BY n DESC NULLS LAST, title, id LIMIT 20"))
def lists_page1(c: Catalogue) -> DataFrame:
    """Lists that are public or on the allow-list, with the true total beside the page."""
    public = c.lists.where("quality > 0 or id in (1, 2, 3)")
    total = F.broadcast(public.agg(F.count("*").alias("total")))  # one row
    return page(public, [F.desc_nulls_last("n"), F.asc("title"), F.asc("id")], 1, 20).crossJoin(total).select("id", "title", "n", "total")


@query(over("items", """SELECT genre, count(*) AS n, min(id) AS first_id FROM (SELECT id, CASE WHEN regexp_matches(title, '(?i)\\b(ring|widget|gizmo)\\b') THEN 'fiction' WHEN regexp_matches(title, '(?i)\\b(bolt|gear|rod|old)\\b') THEN 'nonfiction' ELSE 'other' END AS genre FROM items) GROUP BY genre"""))
def topic_classes(c: Catalogue) -> DataFrame:
    """A keyword ladder: the first group of words that a title holds decides."""
    t = F.col("title")
    genre = F.when(t.rlike(r"(?i)\b(ring|widget|gizmo)\b"), "fiction").when(t.rlike(r"(?i)\b(bolt|gear|rod|old)\b"), "nonfiction").otherwise("other")
    return c.items.select("id", genre.alias("genre")).groupBy("genre").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query(over("list_members counted", "SELECT list, item, recs, rating FROM (SELECT list, item, recs, rating, row_number() OVER (PARTITION BY list ORDER BY recs DESC, rating DESC NULLS LAST, item) AS k FROM list_members JOIN counted ON item = id) WHERE k <= 10"))
def list_items_by_recs(c: Catalogue) -> DataFrame:
    rows = c.list_members.join(c.counted_items.select(F.col("id").alias("item"), "recs", "rating"), "item")
    return top_per(rows, ["list"], [F.desc("recs"), F.desc_nulls_last("rating"), F.asc("item")], 10).select("list", "item", "recs", "rating")


@query(over("ranked_members", "SELECT list, item, rank FROM ranked_members WHERE rank <= 5"))
def list_items_ranked(c: Catalogue) -> DataFrame:
    return c.ranked_members.where("rank <= 5").withColumn("rank", F.col("rank").cast("bigint"))


@query(over("items", """, s AS (SELECT DISTINCT series AS id FROM items), n AS (SELECT id, row_number() OVER (ORDER BY id) AS pos, count(*) OVER () AS total FROM s)
SELECT a.id, step, b.id AS next_id FROM n a, (VALUES (1), (2), (3)) v(step) JOIN n b ON b.pos = (a.pos + step - 1) % a.total + 1 WHERE step < a.total"""))
def ring_neighbours(c: Catalogue) -> DataFrame:
    return ring(c.items.select(F.col("series").alias("id")).distinct(), [F.asc("id")], 3)


@query(over("people shelves", """, n AS (SELECT person, count(*) AS person_recs FROM shelves GROUP BY person),
r AS (SELECT item, person, person_recs, name, row_number() OVER (PARTITION BY item ORDER BY person_recs DESC, CASE WHEN role IS NOT NULL THEN 2 ELSE 0 END DESC, name, person) AS rank FROM shelves JOIN n USING (person) JOIN people ON person = id WHERE published)
SELECT item, person, name, person_recs, rank FROM r WHERE rank <= 3"""))
def card_recommenders_top3(c: Catalogue) -> DataFrame:
    n = c.shelves.groupBy("person").agg(F.count("*").alias("person_recs"))
    rows = c.shelves.join(n, "person").join(c.people.where("published").select(F.col("id").alias("person"), "name", "role"), "person")
    return top_per(rows, ["item"], [F.desc("person_recs"), F.desc(F.when(F.col("role").isNotNull(), 2).otherwise(0)), F.asc("name"), F.asc("person")], 3).select("item", "person", "name", "person_recs", "rank")


@query(over("list_members lists", """, t AS (SELECT item, list, n, CASE WHEN quality > 8000 THEN 1 WHEN n < 300 THEN 2 WHEN nation < 5 THEN 3 ELSE 4 END AS tier FROM list_members JOIN lists ON list = id)
SELECT item, list, tier, k FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY tier, n, list) AS k FROM t) WHERE k <= 4"""))
def lists_for_item(c: Catalogue) -> DataFrame:
    """Four lists of each item: by tier, then the smallest."""
    tier = F.when(F.col("quality") > 8000, 1).when(F.col("n") < 300, 2).when(F.col("nation") < 5, 3).otherwise(4)
    rows = c.list_members.join(c.lists.withColumnRenamed("id", "list"), "list").withColumn("tier", tier)
    return top_per(rows, ["item"], [F.asc("tier"), F.asc("n"), F.asc("list")], 4, "k").select("item", "list", "tier", "k")


@query(over("counted", """, a AS (SELECT id, 'rating' AS issue, 0 AS o, recs FROM counted WHERE rating < 1 OR rating > 5 OR rating IS NULL ORDER BY recs DESC, id LIMIT 200),
b AS (SELECT id, 'price', 1, recs FROM counted WHERE price IS NULL OR price < 950 ORDER BY recs DESC, id LIMIT 200),
d AS (SELECT id, 'title', 2, recs FROM counted WHERE title ILIKE '%gizmo%' OR title ILIKE '%old%' ORDER BY recs DESC, id LIMIT 200),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM d), f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o) AS k FROM u)
SELECT issue, count(*) AS n, count(*) FILTER (WHERE recs >= 30) AS popular, sum(recs)::BIGINT AS recs FROM f WHERE k = 1 GROUP BY issue"""))
def audit_union(c: Catalogue) -> DataFrame:
    """Three diagnostics, each the most recommended of its rows, joined first-wins and rolled up."""
    it = c.counted_items
    order = [F.desc("recs"), F.asc("id")]
    parts = [("rating", it.where("rating < 1 or rating > 5 or rating is null")), ("price", it.where("price is null or price < 950")), ("title", it.where(contains_any(["title"], "gizmo") | contains_any(["title"], "old")))]
    rows = first_wins([top(df, order, 200).select("id", F.lit(name).alias("issue"), "recs") for name, df in parts], "id")
    return rows.groupBy("issue").agg(F.count("*").alias("n"), F.count_if(F.col("recs") >= 30).alias("popular"), F.sum("recs").alias("recs"))


@query(over("people counted lists", """SELECT * FROM (SELECT 'item' AS kind, id, title AS name FROM counted WHERE title ILIKE '%ed%' OR author ILIKE '%ed%' ORDER BY recs DESC, id LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'person', id, name FROM people WHERE name ILIKE '%#00000012%' ORDER BY quality DESC, id LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'list', id, title FROM lists WHERE title ILIKE '%01%' ORDER BY n DESC, id LIMIT 5)"""))
def search_ilike(c: Catalogue) -> DataFrame:
    def hits(df, kind, name, columns, text, score):
        if len(text) < 2:
            df = df.where(F.lit(False))
        return top(df.where(contains_any(columns, text)), [F.desc(score), F.asc("id")], 5).select(F.lit(kind).alias("kind"), "id", F.col(name).alias("name"))

    return hits(c.counted_items, "item", "title", ["title", "author"], "ed", "recs").union(hits(c.people, "person", "name", ["name"], "#00000012", "quality")).union(hits(c.lists, "list", "title", ["title"], "01", "n"))


@query(over("counted", """, one AS (SELECT lower(author) AS slug FROM counted GROUP BY 1 HAVING count(DISTINCT author) = 1)
SELECT author, id, recs, rank FROM (SELECT author, id, recs, row_number() OVER (PARTITION BY author ORDER BY recs DESC, id) AS rank FROM counted WHERE lower(author) IN (SELECT slug FROM one) AND size > 5 AND price >= 900) WHERE rank <= 12"""))
def author_pages(c: Catalogue) -> DataFrame:
    """The best items of each author whose slug has one spelling; filters come first, the limit last."""
    one = c.items.groupBy(F.lower("author").alias("slug")).agg(F.countDistinct("author").alias("n")).where("n = 1").select("slug")
    rows = c.counted_items.withColumn("slug", F.lower("author")).join(one, "slug", "left_semi").where("size > 5 and price >= 900")
    return top_per(rows, ["author"], [F.desc("recs"), F.asc("id")], 12).select("author", "id", "recs", "rank")


@query(over("shelves people", """, s AS (SELECT * FROM shelves WHERE item IN (SELECT p_partkey FROM part WHERE p_type = 'PROMO'))
SELECT person, name, count(*) AS backed FROM s JOIN people ON person = id GROUP BY person, name ORDER BY backed DESC, name, person LIMIT 20"""))
def recommenders_for_items(c: Catalogue) -> DataFrame:
    """People by how many items of one kind they back: the reader takes a set of items."""
    asked = c.items.where("kind = 'PROMO'").select(F.col("id").alias("item"))
    rows = c.shelves.join(asked, "item", "left_semi").groupBy("person").agg(F.count("*").alias("backed"))
    return top(rows.join(c.people.select(F.col("id").alias("person"), "name"), "person"), [F.desc("backed"), F.asc("name"), F.asc("person")], 20).select("person", "name", "backed")


@query(over("recs_", "SELECT item, CAST(CAST(max(at_) AS DATE) AS VARCHAR) AS day, count(*) AS n FROM recs_ GROUP BY item ORDER BY max(at_) DESC, item LIMIT 15"))
def recently_recommended(c: Catalogue) -> DataFrame:
    rows = c.recs.groupBy("item").agg(F.max("at").alias("last"), F.count("*").alias("n"))
    return top(rows, [F.desc("last"), F.asc("item")], 15).select("item", F.col("last").cast("date").cast("string").alias("day"), "n")


@query(over("people shelves counted lists", """, n AS (SELECT person, count(*) AS recs FROM shelves GROUP BY person)
SELECT * FROM (SELECT 'items' AS part, id, recs AS score FROM counted WHERE recs > 0 ORDER BY recs DESC, id LIMIT 24)
UNION ALL SELECT * FROM (SELECT 'people', id, recs FROM people JOIN n ON id = person WHERE published ORDER BY recs DESC, slug LIMIT 12)
UNION ALL SELECT * FROM (SELECT 'lists', id, n FROM lists WHERE n > 0 ORDER BY n DESC, id LIMIT 12)"""))
def site_nav(c: Catalogue) -> DataFrame:
    items = top(c.counted_items.where("recs > 0"), [F.desc("recs"), F.asc("id")], 24).select(F.lit("items").alias("part"), "id", F.col("recs").alias("score"))
    n = c.shelves.groupBy(F.col("person").alias("id")).agg(F.count("*").alias("recs"))
    people = top(c.people.where("published").join(n, "id"), [F.desc("recs"), F.asc("slug")], 12).select(F.lit("people"), "id", "recs")
    return items.union(people).union(top(c.lists.where("n > 0"), [F.desc("n"), F.asc("id")], 12).select(F.lit("lists"), "id", "n"))


@query(over("people", """SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(lower(role), '\\bfounder\\b') THEN 'founders' ELSE CASE role WHEN 'BUILDING' THEN 'founders' WHEN 'AUTOMOBILE' THEN 'media' WHEN 'MACHINERY' THEN 'scientists' WHEN 'HOUSEHOLD' THEN 'writers' ELSE 'other' END END AS bucket FROM people) GROUP BY bucket"""))
def role_breakdown(c: Catalogue) -> DataFrame:
    """People by profession. Market segments stand for free-text roles; the earliest keyword of a role decides."""
    told = F.create_map(*[F.lit(x) for x in ("BUILDING", "Co-founder (born 1967); author", "AUTOMOBILE", "Radio presenter and writer", "MACHINERY", "Professor; novelist", "HOUSEHOLD", "Author of a book, investor")])
    role = F.coalesce(F.element_at(told, F.col("role")), F.lit("Philanthropist"))
    # a role is classified once, however many people have it
    roles = c.people.groupBy("role").agg(F.count("*").alias("n"))
    return roles.select(classify_role(role).alias("bucket"), "n").groupBy("bucket").agg(F.sum("n").alias("n"))


@query(over("people shelves", """, n AS (SELECT person, count(*) AS recs FROM shelves GROUP BY person), f AS (SELECT id, name, quality, recs, right(name, 2) AS surname FROM people JOIN n ON id = person WHERE recs >= 6),
k AS (SELECT *, count(*) OVER (PARTITION BY surname) AS same FROM f) SELECT id, name, recs, same FROM k ORDER BY recs DESC, quality DESC, name LIMIT 60"""))
def people_hub(c: Catalogue) -> DataFrame:
    n = c.shelves.groupBy(F.col("person").alias("id")).agg(F.count("*").alias("recs")).where("recs >= 6")
    rows = c.people.join(n, "id").where(~surname_alias(F.col("name"), F.col("role")))
    rows = rows.withColumn("same", F.count("*").over(Window.partitionBy(F.expr("right(name, 2)"))))
    return top(rows, [F.desc("recs"), F.desc("quality"), F.asc("name")], 60).select("id", "name", "recs", "same")


@query(over("counted", """SELECT id, score FROM (SELECT id, recs + CASE WHEN price > 1000 THEN 15 ELSE 0 END + CASE WHEN rating >= 4 THEN 5 ELSE 0 END + CASE WHEN size % 2 = 0 THEN 5 ELSE 0 END AS score FROM counted WHERE title <> '' AND price IS NOT NULL) ORDER BY score DESC, id LIMIT 12"""))
def weighted_alternatives(c: Catalogue) -> DataFrame:
    bonus = lambda cond, n: F.when(cond, n).otherwise(0)
    score = F.col("recs") + bonus(F.col("price") > 1000, 15) + bonus(F.col("rating") >= 4, 5) + bonus(F.col("size") % 2 == 0, 5)
    return top(c.counted_items.where("title != '' and price is not null").select("id", score.alias("score")), [F.desc("score"), F.asc("id")], 12)


@query(over("lists", """, s AS (SELECT id, replace(lower(title), '#', '-') AS slug FROM lists), d AS (SELECT id, slug, left(slug, length(slug) - 1) || '0' AS canonical FROM s)
SELECT d.id, d.slug, s.slug AS canonical FROM d JOIN s ON s.slug = d.canonical WHERE d.slug <> s.slug"""))
def canonical_series(c: Catalogue) -> DataFrame:
    """A slug gives way to its canonical form only if a row of that form exists."""
    s = c.lists.select("id", F.replace(F.lower("title"), F.lit("#"), F.lit("-")).alias("slug"))
    d = s.withColumn("canonical", F.concat(F.expr("left(slug, length(slug) - 1)"), F.lit("0")))
    return d.join(s.select(F.col("slug").alias("canonical")), "canonical").where("slug != canonical").select("id", "slug", "canonical")


@query(over("counted", """SELECT author, string_agg('- ' || title || ' (' || recs || ')', chr(10) ORDER BY recs DESC, id) AS body FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY recs DESC, id) AS k FROM counted) WHERE k <= 5 GROUP BY author"""))
def catalogue_markdown(c: Catalogue) -> DataFrame:
    """A Markdown document for each author: its five best items, a line each."""
    rows = top_per(c.counted_items, ["author"], [F.desc("recs"), F.asc("id")], 5, "k")
    line = F.concat(F.lit("- "), "title", F.lit(" ("), F.col("recs").cast("string"), F.lit(")"))
    return rows.groupBy("author").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", line.alias("l")))), lambda x: x["l"]), "\n").alias("body"))


@query(over("people counted lists", """SELECT kind, count(*) AS urls, max(day) AS lastmod FROM (SELECT 'item' AS kind, '2024-01-01' AS day FROM counted WHERE recs >= 20 UNION ALL SELECT 'person', '2024-02-01' FROM people WHERE published UNION ALL SELECT 'list', '2024-03-01' FROM lists WHERE n >= 100) GROUP BY kind
UNION ALL SELECT 'hub', 1, '2024-03-01'"""))
def sitemap(c: Catalogue) -> DataFrame:
    """Addresses by kind with the newest change; the hub has the newest of all."""
    urls = c.counted_items.where("recs >= 20").select(F.lit("item").alias("kind"), F.lit("2024-01-01").alias("day")).union(c.people.where("published").select(F.lit("person"), F.lit("2024-02-01"))).union(c.lists.where("n >= 100").select(F.lit("list"), F.lit("2024-03-01")))
    per = urls.groupBy("kind").agg(F.count("*").alias("urls"), F.max("day").alias("lastmod"))
    return per.union(per.agg(F.lit("hub"), F.lit(1).cast("bigint"), F.max("lastmod")))
