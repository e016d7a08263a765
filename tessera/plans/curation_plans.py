"""Curation plans: insights, top-ups, candidates, new links, verification, proposals, descriptions, categories.

The tables hold no covers, addresses or statuses; where a plan needs one, it is derived from prices, sizes, dates and
quantities, the same way in Spark and in SQL, and the rule itself is written twice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import curation as cu
from tessera.operators import curation as op
from tessera.operators import overlap
from tessera.operators.relational import top, top_per
from tessera.plans.registry import query
from tessera.sources.mapping import Catalogue, over

FOLD = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"


@query(over("counted", """, t AS (SELECT id AS other, recs FROM counted ORDER BY recs DESC, id LIMIT 7)
SELECT id, other, rank FROM (SELECT id, other, row_number() OVER (PARTITION BY id ORDER BY t.recs DESC, other) AS rank FROM counted JOIN t ON id <> other) WHERE rank <= 6"""))
def related_items(c: Catalogue) -> DataFrame:
    """The six best-known other items, for each item: seven rows are enough, so they are sent."""
    best = F.broadcast(top(c.counted_items.select(F.col("id").alias("other"), F.col("recs").alias("r")), [F.desc("r"), F.asc("other")], 7))
    return top_per(c.items.select("id").join(best, F.col("id") != F.col("other")), ["id"], [F.desc("r"), F.asc("other")], 6).select("id", "other", "rank")


@query(over("list_members counted lists", """, co AS (SELECT m.list AS seed, o.list AS other, count(*) AS shared FROM list_members m JOIN list_members o ON m.item = o.item AND m.list <> o.list GROUP BY 1, 2 HAVING count(*) >= 14),
p AS (SELECT seed, other, row_number() OVER (PARTITION BY seed ORDER BY shared DESC, other) AS place FROM co),
s AS (SELECT a.id AS seed, b.id AS other, row_number() OVER (PARTITION BY a.id ORDER BY b.n DESC, b.id) AS place FROM lists a JOIN lists b ON a.nation = b.nation AND a.id <> b.id),
u AS (SELECT seed, other, place, false AS filled FROM p WHERE place <= 6 UNION ALL SELECT seed, other, place, true FROM s WHERE place <= 12 AND (seed, other) NOT IN (SELECT (seed, other) FROM p WHERE place <= 6))
SELECT seed, other, rank, filled FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY filled, place, other) AS rank FROM u) WHERE rank <= 6"""))
def related_lists_filled(c: Catalogue) -> DataFrame:
    """Lists with much in common; where they are fewer than six, the largest of the same nation follow."""
    co = overlap.beside(c.list_members, "list", "item", 14)
    first = top_per(co, ["seed"], [F.desc("shared"), F.asc("other")], 6, "place").select("seed", "other", "place")
    here, there = c.lists.select(F.col("id").alias("seed"), "nation"), c.lists.select(F.col("id").alias("other"), "nation", "n")
    # twelve others of a list's nation are among the nation's first thirteen lists
    there = top_per(there, ["nation"], [F.desc("n"), F.asc("other")], 13).drop("rank")
    second = top_per(here.join(there, "nation").where("seed != other"), ["seed"], [F.desc("n"), F.asc("other")], 12, "place").select("seed", "other", "place")
    return op.top_up(first, second, "seed", "other", 6)


@query(over("recs_ people shelves items", """, b AS (SELECT item, person, max(confidence) AS conf, min(at_) AS first, max(at_) AS last FROM recs_ GROUP BY 1, 2),
r AS (SELECT item, role, count(*) AS n, row_number() OVER (PARTITION BY item ORDER BY count(*) DESC, role) AS k FROM b JOIN people ON person = id GROUP BY 1, 2),
g AS (SELECT item, count(*) AS people, count(*) FILTER (WHERE conf >= 70) AS confirmed, year(min(first)) AS first_year, year(max(last)) AS last_year FROM b GROUP BY item),
e AS (SELECT item, arg_max(person, (conf, -person)) AS keenest FROM b GROUP BY item)
SELECT g.item, people, confirmed, first_year, last_year, role AS top_role, n AS top_role_people, keenest FROM g JOIN r ON g.item = r.item AND k = 1 JOIN e ON g.item = e.item"""))
def item_insights(c: Catalogue) -> DataFrame:
    """One row of insights for each item: recommenders, those with good evidence, years, the commonest role, the keenest person."""
    b = c.recs.groupBy("item", "person").agg(F.max("confidence").alias("conf"), F.min("at").alias("first"), F.max("at").alias("last"))
    g = b.groupBy("item").agg(F.count("*").alias("people"), F.count_if(F.col("conf") >= 70).alias("confirmed"), F.year(F.min("first")).alias("first_year"), F.year(F.max("last")).alias("last_year"), F.max_by("person", F.struct("conf", -F.col("person"))).alias("keenest"))
    roles = b.join(c.people.select(F.col("id").alias("person"), "role"), "person").groupBy("item", "role").agg(F.count("*").alias("n"))
    best = top_per(roles, ["item"], [F.desc("n"), F.asc("role")], 1).select("item", F.col("role").alias("top_role"), F.col("n").alias("top_role_people"))
    return g.join(best, "item").select("item", "people", "confirmed", "first_year", "last_year", "top_role", "top_role_people", "keenest")


_CORE = FOLD.format("regexp_replace({}, '\\s*[:;(\\[].*$', '')")


@query(over("items", f""", a AS (SELECT id, series, kind, title || CASE WHEN price > 1000 THEN ': a ' || lower(kind) ELSE '' END AS title, replace(series, '#', '') || ' ' || kind AS author FROM items),
b AS (SELECT id AS cand, series, kind, title || CASE WHEN size > 40 THEN ' (' || size || ')' WHEN size > 30 THEN ' again' ELSE '' END AS ct, CASE WHEN price > 1050 THEN '' WHEN price > 980 THEN kind WHEN price > 940 THEN 'Someone Else' ELSE replace(series, '#', '') || ' ' || kind END AS ca, price > 1095 AS isbn, size FROM items),
p AS (SELECT id, cand, isbn, {FOLD.format('title')} AS t, {FOLD.format('ct')} AS u, {_CORE.format('title')} AS tc, {_CORE.format('ct')} AS uc, {FOLD.format('author')} AS a, {FOLD.format('ca')} AS b FROM a JOIN b USING (series, kind) WHERE id <> cand),
q AS (SELECT *, split_part(a, ' ', -1) AS la, split_part(b, ' ', -1) AS lb FROM p),
x AS (SELECT *, t <> '' AND t = u AS full_, tc <> '' AND tc = uc AS same, t <> '' AND u <> '' AND (contains(u, t) OR contains(t, u)) AS part, a <> '' AND a = b AS whole, length(la) >= 4 AND (la = b OR la = lb) AS by_ FROM q),
s AS (SELECT id, cand, CASE WHEN isbn THEN 1.0 WHEN full_ AND whole THEN 0.97 WHEN same AND whole THEN 0.93 WHEN full_ AND by_ THEN 0.9 WHEN same AND by_ THEN 0.87 WHEN full_ AND b = '' THEN 0.65 WHEN same AND b <> '' AND NOT by_ THEN 0.4 WHEN part AND by_ THEN 0.55 WHEN part AND b = '' THEN 0.3 WHEN same THEN 0.5 ELSE 0.15 END::DOUBLE AS score,
 CASE WHEN isbn THEN 'isbn' WHEN full_ AND whole THEN 'full+author' WHEN same AND whole THEN 'core+author' WHEN full_ AND by_ THEN 'full+last' WHEN same AND by_ THEN 'core+last' WHEN full_ AND b = '' THEN 'full' WHEN same AND b <> '' AND NOT by_ THEN 'core+mismatch' WHEN part AND by_ THEN 'part+last' WHEN part AND b = '' THEN 'part' WHEN same THEN 'core' ELSE 'fuzzy' END AS method FROM x)
SELECT id, cand, score, method FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, cand) AS k FROM s) WHERE k <= 3"""))
def candidate_scores(c: Catalogue) -> DataFrame:
    """The three surest candidates of each item among those of its series and kind, with how they match."""
    a = c.items.select("id", "series", "kind", F.concat("title", F.when(F.col("price") > 1000, F.concat(F.lit(": a "), F.lower("kind"))).otherwise("")).alias("title"), F.concat_ws(" ", F.replace("series", F.lit("#"), F.lit("")), "kind").alias("author"))
    tail = F.when(F.col("size") > 40, F.concat(F.lit(" ("), F.col("size").cast("string"), F.lit(")"))).when(F.col("size") > 30, " again").otherwise("")
    by = F.when(F.col("price") > 1050, "").when(F.col("price") > 980, F.col("kind")).when(F.col("price") > 940, "Someone Else").otherwise(F.concat_ws(" ", F.replace("series", F.lit("#"), F.lit("")), "kind"))
    b = c.items.select(F.col("id").alias("cand"), "series", "kind", F.concat("title", tail).alias("ct"), by.alias("ca"), (F.col("price") > 1095).alias("isbn"))
    # what is equal is compared once: items that read alike, with candidates that read alike, of which four at most can matter to anybody
    mine, theirs = ["series", "kind", "title", "author"], ["series", "kind", "ct", "ca", "isbn"]
    few = top_per(b, theirs, [F.asc("cand")], 4, "k").groupBy(*theirs).agg(F.collect_list("cand").alias("cands")).withColumn("y", cu.score_parts(F.col("ct"), F.col("ca")))
    ours = a.select(*mine).distinct().withColumn("x", cu.score_parts(F.col("title"), F.col("author")))
    pairs = ours.join(few.select("series", "kind", "isbn", "cands", "y"), ["series", "kind"]).withColumn("s", cu.score_of(F.col("x"), F.col("y"), F.col("isbn")))
    best = top_per(pairs.select(*mine, "s.score", "s.method", F.explode("cands").alias("cand")), mine, [F.desc("score"), F.asc("cand")], 4, "k").drop("k")
    return top_per(a.join(best, mine).where("id != cand"), ["id"], [F.desc("score"), F.asc("cand")], 3, "k").select("id", "cand", "score", "method")


@query(over("items", """, y AS (SELECT l_partkey AS id, min(year(l_shipdate)) + (l_partkey % 7) AS y FROM lineitem GROUP BY l_partkey), e AS (SELECT items.id, title, series, kind, y FROM items JOIN y USING (id))
SELECT a.id AS a, b.id AS b, a.y AS year_a, b.y AS year_b FROM e a JOIN e b USING (title, series, kind) WHERE a.id < b.id AND abs(a.y - b.y) > 3"""))
def year_conflicts(c: Catalogue) -> DataFrame:
    """Editions of one title whose first years lie too far apart to be one work (years moved apart by id)."""
    y = c.t("lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.min(F.year("l_shipdate")).alias("y"))
    e = c.items.join(y, "id").withColumn("y", F.col("y") + F.col("id") % 7)
    a, b = (e.select("title", "series", "kind", F.col("id").alias(p), F.col("y").alias(f"year_{p}")) for p in "ab")
    return a.join(b, ["title", "series", "kind"]).where((F.col("a") < F.col("b")) & cu.year_conflict(F.col("year_a"), F.col("year_b"))).select("a", "b", "year_a", "year_b")


@query(over("items", """, e AS (SELECT title, id, price, kind <> 'ECONOMY' AS english, size % 4 <> 0 AS retail, author FROM items), w AS (SELECT title, max(price) AS cover FROM items GROUP BY title)
SELECT title, id AS edition, editions FROM (SELECT title, id, count(*) OVER (PARTITION BY title) AS editions, row_number() OVER (PARTITION BY title ORDER BY NOT retail, price <> cover, id) AS k FROM e JOIN w USING (title) WHERE english) WHERE k = 1"""))
def english_editions(c: Catalogue) -> DataFrame:
    """The edition of each work to show: English, with a retail number first, then the work's own cover, then the oldest."""
    work = c.items.groupBy("title").agg(F.max("price").alias("cover"))
    e = c.items.where("kind != 'ECONOMY'").join(work, "title")
    best = F.min_by("id", F.struct(F.col("size") % 4 == 0, F.col("price") != F.col("cover"), "id"))
    return e.groupBy("title").agg(best.alias("edition"), F.count("*").alias("editions"))


_CANDS = """, old AS (SELECT DISTINCT person, item FROM recs_ WHERE year(at_) < 1996), cand AS (SELECT rec_id, person, item, confidence, CASE WHEN confidence >= 70 THEN 'strong' WHEN confidence >= 40 THEN 'medium' ELSE 'weak' END AS strength, source % 3 = 0 AS tweet, source % 2 = 0 AS verified FROM recs_ WHERE year(at_) >= 1996),
pl AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY person, item ORDER BY strength <> 'strong', confidence DESC, rec_id) AS k FROM cand WHERE strength <> 'weak' AND (person, item) NOT IN (SELECT (person, item) FROM old)) WHERE k = 1)"""


def _new_links(c: Catalogue) -> tuple[DataFrame, DataFrame]:
    r, year = c.recs, F.year("at")
    old = r.where(year < 1996).select("person", "item").distinct()
    strength = F.when(F.col("confidence") >= 70, "strong").when(F.col("confidence") >= 40, "medium").otherwise("weak")
    cand = r.where(year >= 1996).select("rec_id", "person", "item", "confidence", strength.alias("strength"), (F.col("source") % 3 == 0).alias("tweet"), (F.col("source") % 2 == 0).alias("verified"))
    return op.new_links(cand, old, ["person", "item"], "strength", [F.asc(F.col("strength") != "strong"), F.desc("confidence"), F.asc("rec_id")]), old


@query(over("recs_", _CANDS + " SELECT person, item, rec_id, CASE WHEN strength = 'strong' THEN CASE WHEN NOT tweet AND NOT verified THEN 60 ELSE 80 END ELSE 60 END AS confidence FROM pl"))
def new_recommendations(c: Catalogue) -> DataFrame:
    """New pairs to write, each with its best candidate's confidence: 80 if strong and seen at its source, else 60."""
    strong = (F.col("strength") == "strong") & (F.col("tweet") | F.col("verified"))
    return _new_links(c)[0].select("person", "item", "rec_id", F.when(strong, 80).otherwise(60).alias("confidence"))


@query(over("recs_", _CANDS + """, b AS (SELECT item, count(*) AS before FROM old GROUP BY item), a AS (SELECT item, count(*) AS added FROM pl GROUP BY item)
SELECT item, coalesce(before, 0) AS before, added, coalesce(before, 0) + added AS after, before IS NULL AS is_new FROM a LEFT JOIN b USING (item)"""))
def applied_counts(c: Catalogue) -> DataFrame:
    """What one insert of the new pairs does to the counts of the items touched; items without a pair before are new."""
    plan, old = _new_links(c)
    done = op.staged_insert(plan, old.select("item").distinct(), old, "item", "person")
    new = done["entities"].withColumn("is_new", F.lit(True))
    return done["counts"].join(new, "item", "left").withColumn("is_new", F.coalesce("is_new", F.lit(False)))


@query("""WITH p AS (SELECT page_id, url, html, lower(html) AS h, regexp_extract(lower(html), '<title>([^<]*)</title>', 1) AS t FROM pages),
w AS (SELECT *, split_part(trim(t), ' ', 1) AS word, url LIKE '%.html%' AS named FROM p)
SELECT page_id, CASE WHEN html IS NULL OR html = '' THEN 'failed' WHEN url LIKE '%.pdf%' OR NOT contains(h, '<') THEN 'non_html' WHEN (length(h) - length(replace(h, '<li', ''))) / 3 >= 5 THEN 'reading_list' WHEN word <> '' AND contains(substr(h, strpos(h, '</title>') + 8), word) THEN 'content_match' WHEN named THEN 'slug_only' ELSE 'no_match' END AS status FROM w""")
def source_verification(c: Catalogue) -> DataFrame:
    """What a look at each page says: not there, not HTML, a list of many, the title's first word in its content, or no match."""
    h = F.lower("html")
    word = F.split(F.trim(F.regexp_extract(h, "<title>([^<]*)</title>", 1)), " ").getItem(0)
    body = F.expr("substr(lower(html), locate('</title>', lower(html)) + 8)")
    status = op.ladder(
        (F.col("html").isNull() | (F.col("html") == ""), "failed"), (F.col("url").contains(".pdf") | ~h.contains("<"), "non_html"),
        (F.floor((F.length(h) - F.length(F.replace(h, F.lit("<li"), F.lit("")))) / 3) >= 5, "reading_list"), ((word != "") & body.contains(word), "content_match"), (F.col("url").contains(".html"), "slug_only"), otherwise="no_match",
    )
    return c.t("pages").select("page_id", status.alias("status"))


@query(over("recs_", """, d AS (SELECT DISTINCT person, item, source FROM recs_), f AS (SELECT *, count(*) OVER (PARTITION BY person, source) AS books FROM d)
SELECT CASE WHEN books >= 4 THEN 'personal_reading_list' WHEN books >= 2 THEN 'multi_book_source' ELSE 'single' END AS kind, books, count(*) AS rows, count(DISTINCT person) AS people FROM f GROUP BY 1, 2"""))
def candidate_extraction(c: Catalogue) -> DataFrame:
    """Candidates once each, flagged by how many items of a person share a source: reading list from 4 on, several from 2 on."""
    d = c.recs.select("person", "item", "source").distinct()
    f = d.join(d.groupBy("person", "source").agg(F.count("*").alias("books")), ["person", "source"])
    kind = op.ladder((F.col("books") >= 4, "personal_reading_list"), (F.col("books") >= 2, "multi_book_source"), otherwise="single")
    return f.groupBy(kind.alias("kind"), "books").agg(F.count("*").alias("rows"), F.count_distinct("person").alias("people"))


@query(over("recs_", """, n AS (SELECT person, item, count(*) AS rows, max(source) AS now FROM recs_ GROUP BY 1, 2),
a AS (SELECT rec_id, CASE WHEN confidence < 30 THEN person + 1 ELSE person END AS person, item, CASE WHEN source % 5 = 0 THEN '' WHEN source % 7 = 0 THEN 'https://x.example/a | https://y.example/b' WHEN source % 11 = 0 THEN 'https://www.amazon.com/dp/1' ELSE 'https://s' || source || '.example/' END AS url, source FROM recs_ WHERE confidence < 60)
SELECT outcome, count(*) AS n, min(rec_id) AS first FROM (SELECT rec_id, CASE WHEN url = '' THEN 'skip:empty' WHEN contains(url, '|') THEN 'skip:piped' WHEN contains(url, 'amazon.') THEN 'skip:blocked' WHEN rows IS NULL THEN 'skip:not_found' WHEN rows > 1 THEN 'skip:several_rows' WHEN now % 2 = 0 THEN 'skip:already_safe' ELSE 'propose' END AS outcome FROM a LEFT JOIN n USING (person, item)) GROUP BY outcome"""))
def source_proposals(c: Catalogue) -> DataFrame:
    """Approved sources as proposals, or why they are skipped; the first reason that holds is told."""
    now = c.recs.groupBy("person", "item").agg(F.count("*").alias("rows"), F.max("source").alias("now"))
    s = F.col("source")
    url = F.when(s % 5 == 0, "").when(s % 7 == 0, "https://x.example/a | https://y.example/b").when(s % 11 == 0, "https://www.amazon.com/dp/1").otherwise(F.concat(F.lit("https://s"), s.cast("string"), F.lit(".example/")))
    a = c.recs.where("confidence < 60").select("rec_id", F.when(F.col("confidence") < 30, F.col("person") + 1).otherwise(F.col("person")).alias("person"), "item", url.alias("url"))
    u = F.col("url")
    outcome = op.ladder((u == "", "skip:empty"), (u.contains("|"), "skip:piped"), (u.contains("amazon."), "skip:blocked"), (F.col("rows").isNull(), "skip:not_found"), (F.col("rows") > 1, "skip:several_rows"), (F.col("now") % 2 == 0, "skip:already_safe"), otherwise="propose")
    return a.join(now, ["person", "item"], "left").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"), F.min("rec_id").alias("first"))


@query(over("counted", """, m AS (SELECT id, recs, kind = 'PROMO' AS meta, size % 5 = 0 AS missing FROM counted)
SELECT id, 100 * meta::INT + recs AS score, concat_ws('; ', CASE WHEN meta THEN 'meta' END, CASE WHEN recs >= 40 THEN 'high_recs' WHEN recs >= 30 THEN 'recs' END) AS why FROM m WHERE missing AND (recs >= 30 OR meta) ORDER BY score DESC, recs DESC, id LIMIT 500"""))
def cover_priority(c: Catalogue) -> DataFrame:
    """Which missing covers to find first: items of the great lists, then by recommendations."""
    meta, recs = F.col("kind") == "PROMO", F.col("recs")
    rows = c.counted_items.where((F.col("size") % 5 == 0) & ((recs >= 30) | meta))
    why = F.concat_ws("; ", F.when(meta, "meta"), F.when(recs >= 40, "high_recs").when(recs >= 30, "recs"))
    rows = rows.select("id", (100 * meta.cast("int") + recs).alias("score"), why.alias("why"), "recs")
    return top(rows, [F.desc("score"), F.desc("recs"), F.asc("id")], 500).select("id", "score", "why")


@query(over("items", """, f AS (SELECT id, replace(title, ' ', '_') || '_' || size || '.jpg' AS name FROM items WHERE price < 1000), o AS (SELECT DISTINCT replace(title, ' ', '_') || '_' || size || CASE WHEN kind = 'PROMO' THEN '.png' ELSE '.jpg' END AS name FROM items WHERE price >= 950)
SELECT CASE WHEN f.name IS NULL THEN 'unmatched_object' WHEN o.name IS NULL THEN 'no_object' ELSE 'synced' END AS status, count(*) AS n, min(coalesce(f.name, o.name)) AS first FROM f FULL JOIN o ON f.name = o.name GROUP BY 1"""))
def filename_sync(c: Catalogue) -> DataFrame:
    """Stored objects meet rows by exact file name; what is left on either side is reported."""
    name = lambda end: F.concat(F.replace("title", F.lit(" "), F.lit("_")), F.lit("_"), F.col("size").cast("string"), end)
    f = c.items.where("price < 1000").select("id", name(F.lit(".jpg")).alias("file"))
    o = c.items.where("price >= 950").select(name(F.when(F.col("kind") == "PROMO", ".png").otherwise(".jpg")).alias("object")).distinct()
    status = op.ladder((F.col("file").isNull(), "unmatched_object"), (F.col("object").isNull(), "no_object"), otherwise="synced")
    return f.join(o, F.col("file") == F.col("object"), "full").groupBy(status.alias("status")).agg(F.count("*").alias("n"), F.min(F.coalesce("file", "object")).alias("first"))


@query(over("counted", """, g AS (SELECT id, recs, CASE WHEN title LIKE '%ring%' THEN 'memoir' WHEN title LIKE '%bolt%' THEN 'biography' ELSE 'other' END AS genre, rating >= 2 AS sure FROM counted)
SELECT genre, id, rank FROM (SELECT genre, id, row_number() OVER (PARTITION BY genre ORDER BY recs DESC, id) AS rank FROM g WHERE sure AND genre <> 'other')"""))
def genre_lists(c: Catalogue) -> DataFrame:
    """Lists of the items surely classified as one of two genres, ranked by recommendations."""
    genre = F.when(F.col("title").contains("ring"), "memoir").when(F.col("title").contains("bolt"), "biography")
    rows = c.counted_items.where("rating >= 2").withColumn("genre", genre).where("genre is not null")
    return rows.select("genre", "id", F.row_number().over(Window.partitionBy("genre").orderBy(F.desc("recs"), "id")).cast("bigint").alias("rank"))


@query(over("recs_ people", """, r AS (SELECT rec_id, item, person, source, (person + source % 3) AS author FROM recs_ WHERE confidence >= 50 AND source % 4 = 1),
h AS (SELECT rec_id, item, person, author FROM r JOIN people ON author = id WHERE author <> person), t AS (SELECT item, person, max(confidence) AS conf FROM recs_ GROUP BY 1, 2)
SELECT CASE WHEN t.person IS NULL THEN 'CREATE_FOR_AUTHOR' WHEN conf < 50 THEN 'MOVE_TO_AUTHOR' ELSE 'REMOVE' END AS action, count(*) AS n, count(DISTINCT h.author) AS authors FROM h LEFT JOIN t ON h.item = t.item AND h.author = t.person GROUP BY 1"""))
def misattributed_posts(c: Catalogue) -> DataFrame:
    """Posts cited for a person that another wrote: made theirs, moved to their weak row, or removed if they have a good one."""
    r = c.recs.where("confidence >= 50 and source % 4 = 1").select("rec_id", "item", "person", (F.col("person") + F.col("source") % 3).alias("author"))
    h = r.join(c.people.select(F.col("id").alias("author")), "author", "left_semi").where("author != person")
    t = c.recs.groupBy("item", F.col("person").alias("author")).agg(F.max("confidence").alias("conf"))
    action = op.ladder((F.col("conf").isNull(), "CREATE_FOR_AUTHOR"), (F.col("conf") < 50, "MOVE_TO_AUTHOR"), otherwise="REMOVE")
    return h.join(t, ["item", "author"], "left").groupBy(action.alias("action")).agg(F.count("*").alias("n"), F.count_distinct("author").alias("authors"))


@query(over("recs_ items", f""", l AS (SELECT DISTINCT {FOLD.format('title')} AS k, author FROM items WHERE size > 20 AND price < 1000), r AS (SELECT rec_id, {FOLD.format('title')} AS k, author, source FROM recs_ JOIN items ON item = id),
h AS (SELECT rec_id, source, k IN (SELECT k FROM l) AS listed, (k, author) IN (SELECT (k, author) FROM l) AS agree FROM r)
SELECT rec_id, CASE WHEN NOT listed THEN 'no_match' WHEN NOT agree THEN 'author_mismatch' WHEN source % 4 = 0 THEN 'already_own' ELSE 'proposed' END AS outcome FROM h"""))
def own_list_sources(c: Catalogue) -> DataFrame:
    """Whether a person's own list bears out a row: by loose title, and by author where both are known."""
    k = cu.folded(F.col("title"))
    listed = c.items.where("size > 20 and price < 1000").select(k.alias("k"), "author").distinct()
    r = c.recs.join(c.items.select(F.col("id").alias("item"), "title", "author"), "item").withColumn("k", k)
    h = r.join(listed.select("k").distinct().withColumn("listed", F.lit(True)), "k", "left").join(listed.withColumn("agree", F.lit(True)), ["k", "author"], "left")
    outcome = op.ladder((F.col("listed").isNull(), "no_match"), (F.col("agree").isNull(), "author_mismatch"), (F.col("source") % 4 == 0, "already_own"), otherwise="proposed")
    return h.select("rec_id", outcome.alias("outcome"))


@query(over("items", f""", e AS (SELECT series AS author, {FOLD.format('title')} AS k, count(*) AS editions, min(id) AS first, max(price) AS dearest, bool_or(kind <> 'ECONOMY') AS english FROM items GROUP BY 1, 2)
SELECT author, k AS title_key, first AS id, editions FROM e WHERE editions >= 2 AND english"""))
def author_works(c: Catalogue) -> DataFrame:
    """An author's works to import: one for each title key, with enough editions, one of them English."""
    e = c.items.groupBy(F.col("series").alias("author"), cu.folded(F.col("title")).alias("title_key")).agg(F.min("id").alias("id"), F.count("*").alias("editions"), F.bool_or(F.col("kind") != "ECONOMY").alias("english"))
    return e.where("editions >= 2 and english").select("author", "title_key", "id", "editions")


@query(over("people shelves counted", """, n AS (SELECT person, count(*) AS n FROM shelves GROUP BY person), t AS (SELECT person, title, row_number() OVER (PARTITION BY person ORDER BY recs DESC, item) AS k FROM (SELECT person, title, max(recs) AS recs, min(id) AS item FROM shelves JOIN counted ON item = id GROUP BY 1, 2)),
a AS (SELECT person, max(title) FILTER (WHERE k = 1) AS t1, max(title) FILTER (WHERE k = 2) AS t2, max(title) FILTER (WHERE k = 3) AS t3 FROM t WHERE k <= 3 GROUP BY person),
m AS (SELECT id, name || ' recommends ' || n || ' books' AS base, role, t1, t2, t3 FROM people JOIN n ON id = n.person JOIN a ON id = a.person WHERE t3 IS NOT NULL)
SELECT id, CASE WHEN length(base || ', among them ' || t1 || ', ' || t2 || ' and ' || t3 || ', as ' || lower(role) || '.') <= 90 THEN base || ', among them ' || t1 || ', ' || t2 || ' and ' || t3 || ', as ' || lower(role) || '.' WHEN length(base || ', among them ' || t1 || ' and ' || t2 || '.') <= 74 THEN base || ', among them ' || t1 || ' and ' || t2 || '.' ELSE base || '.' END AS meta FROM m"""))
def people_meta(c: Catalogue) -> DataFrame:
    """A line about each person from counts and best-known titles: the first of three wordings that fits."""
    n = c.shelves.groupBy("person").agg(F.count("*").alias("n"))
    t = c.shelves.join(c.counted_items.select(F.col("id").alias("item"), "title", "recs"), "item").groupBy("person", "title").agg(F.max("recs").alias("recs"), F.min("item").alias("item"))
    best = top_per(t, ["person"], [F.desc("recs"), F.asc("item")], 3, "k").groupBy("person").agg(*[F.max(F.when(F.col("k") == i, F.col("title"))).alias(f"t{i}") for i in (1, 2, 3)]).where("t3 is not null")
    rows = c.people.select(F.col("id").alias("person"), "name", "role").join(n, "person").join(best, "person")
    base = F.concat("name", F.lit(" recommends "), F.col("n").cast("string"), F.lit(" books"))
    long_ = F.concat(base, F.lit(", among them "), "t1", F.lit(", "), "t2", F.lit(" and "), "t3", F.lit(", as "), F.lower("role"), F.lit("."))
    two = F.concat(base, F.lit(", among them "), "t1", F.lit(" and "), "t2", F.lit("."))
    return rows.select(F.col("person").alias("id"), F.coalesce(cu.first_fitting(90, long_), cu.first_fitting(74, two), F.concat(base, F.lit("."))).alias("meta"))


@query(over("recs_", """, a AS (SELECT DISTINCT person, item FROM recs_ WHERE confidence >= 90)
SELECT why, count(*) AS n FROM (SELECT CASE WHEN source % 6 = 0 THEN 'no_link' WHEN source % 6 = 1 THEN 'fetch_failed' WHEN confidence < 30 THEN 'title_not_found' WHEN confidence < 60 THEN 'quote_not_found' ELSE 'needs_look' END AS why FROM recs_ WHERE (person, item) NOT IN (SELECT (person, item) FROM a)) GROUP BY why"""))
def unresolved(c: Catalogue) -> DataFrame:
    """Rows whose pair has no accepted source, by the first reason that holds."""
    accepted = c.recs.where("confidence >= 90").select("person", "item").distinct()
    k = F.col("source") % 6
    why = op.ladder((k == 0, "no_link"), (k == 1, "fetch_failed"), (F.col("confidence") < 30, "title_not_found"), (F.col("confidence") < 60, "quote_not_found"), otherwise="needs_look")
    return c.recs.join(accepted, ["person", "item"], "left_anti").groupBy(why.alias("why")).agg(F.count("*").alias("n"))


@query(over("recs_", """, l AS (SELECT person, item, CASE WHEN source % 3 = 0 AND source % 2 = 0 AND confidence >= 60 THEN 5 WHEN source % 3 = 0 AND source % 2 = 0 THEN 4 WHEN source % 3 = 0 THEN 3 WHEN source % 5 <> 0 THEN 2 ELSE 1 END AS v FROM recs_)
SELECT best, count(*) AS pairs FROM (SELECT person, item, CASE max(v) WHEN 5 THEN 'own_tweet_names_book' WHEN 4 THEN 'own_tweet' WHEN 3 THEN 'other_tweet' WHEN 2 THEN 'other_link' ELSE 'no_link' END AS best FROM l GROUP BY 1, 2) GROUP BY best"""))
def cited_links(c: Catalogue) -> DataFrame:
    """The best kind of link that any row of a pair cites."""
    s = F.col("source")
    tweet, own, names = s % 3 == 0, s % 2 == 0, F.col("confidence") >= 60
    value = F.when(tweet & own & names, 5).when(tweet & own, 4).when(tweet, 3).when(s % 5 != 0, 2).otherwise(1)
    best = c.recs.groupBy("person", "item").agg(F.max(value).alias("v"))
    names_ = F.array(*map(F.lit, ["no_link", "other_link", "other_tweet", "own_tweet", "own_tweet_names_book"]))
    return best.groupBy(F.get(names_, F.col("v") - 1).alias("best")).agg(F.count("*").alias("pairs"))


@query("""WITH d AS (SELECT doc_id, CASE WHEN n_chars % 13 = 0 THEN NULL ELSE trim(substr(text, 1, 40 + n_chars % 120), ' ') END AS now, text FROM documents WHERE text IS NOT NULL),
s AS (SELECT *, concat_ws(',', CASE WHEN regexp_matches(now, '^\\s*"[^"]+"\\s*[-–—]') THEN 'quote_attribution' END, CASE WHEN regexp_matches(now, '^\\s*"[^"]*"\\s*$') THEN 'blurb_only' END, CASE WHEN regexp_matches(now, '(?i)\\b(?:recommended by|bestselling author of|must[- ]read)\\b') THEN 'recommendation' END, CASE WHEN length(now) < 80 THEN 'too_short' END) AS why,
 concat_ws(',', CASE WHEN length(text) < 120 THEN 'too_short' END, CASE WHEN regexp_matches(text, '^\\s*"[^"]*"\\s*$') THEN 'blurb' END, CASE WHEN regexp_matches(text, '(?i)https?://|www\\.') THEN 'address' END, CASE WHEN regexp_matches(text, '<[a-zA-Z/][^>]*>') THEN 'markup' END, CASE WHEN starts_with(ltrim(text, ' '), '*') THEN 'asterisks' END) AS flags FROM d),
c AS (SELECT CASE WHEN now IS NULL OR now = '' THEN 'empty' WHEN why <> '' THEN 'junk' ELSE 'decent' END AS state, CASE WHEN text = '' THEN 'empty' ELSE flags END AS flags, length(text) FROM s)
SELECT state, flags, CASE WHEN flags = '' AND state IN ('empty', 'junk') THEN 'would_backfill' WHEN state = 'decent' THEN 'skip' ELSE 'manual_review' END AS action, count(*) AS n FROM c GROUP BY ALL""")
def description_backfill(c: Catalogue) -> DataFrame:
    """Documents as candidates for descriptions cut from their own beginning: state, concerns, action."""
    now = F.when(F.col("n_chars") % 13 == 0, None).otherwise(F.trim(F.substring(F.col("text"), F.lit(1), (F.lit(40) + F.col("n_chars") % 120).cast("int"))))
    rows = c.t("documents").where("text is not null").select(cu.description_state(now)["state"].alias("state"), cu.description_flags(F.col("text")).alias("flags"))
    return rows.groupBy("state", "flags", cu.description_action(F.lit(0.9), F.col("flags"), F.col("state")).alias("action")).agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '&amp;', '&'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), ' ,', ','), ' .', '.'), '..', '.'), '  ', ' '), '<br>', ' ') AS t, text FROM documents WHERE text IS NOT NULL)
SELECT doc_id, t <> text AS changed, len(regexp_extract_all(t, '&[a-z]+;|&#\\d+;|<[a-z/][^>]*>|\\{\\{|\\}\\}|\\\\u[0-9a-f]{4}')) AS residual, md5(t) AS mark FROM d""")
def artifact_repair(c: Catalogue) -> DataFrame:
    """Exact replacements for artifacts, and how many others are left for a look."""
    t = cu.artifacts_replaced(F.col("text"))
    rows = c.t("documents").where("text is not null").select("doc_id", "text", t.alias("t"))
    return rows.select("doc_id", (F.col("t") != F.col("text")).alias("changed"), F.regexp_count("t", F.lit(cu.RESIDUAL)).cast("bigint").alias("residual"), F.md5("t").alias("mark"))


@query(over("counted", """, p AS (SELECT id, rating * 1.37 AS r, recs / 40.0 AS s FROM counted)
SELECT id, CASE WHEN r >= 1 AND r <= 5 THEN floor(r * 10 + 0.5) / 10 END AS rating, CASE WHEN s > 0 AND s <= 1 THEN floor(s * 100 + 0.5)::INT || '%' WHEN s > 1 AND s <= 100 THEN floor(s + 0.5)::INT || '%' END AS confidence FROM p"""))
def display_numbers(c: Catalogue) -> DataFrame:
    """Ratings to one place between 1 and 5; confidences as percentages, given as shares or as numbers."""
    return c.counted_items.select("id", cu.display_rating(F.col("rating") * 1.37).alias("rating"), cu.display_confidence(F.col("recs") / 40.0).alias("confidence"))


@query(over("recs_ people", """, u AS (SELECT rec_id, slug, CASE WHEN source % 4 = 0 THEN '' WHEN source % 4 = 1 THEN 'https://x.com/' || slug || '/status/' || rec_id WHEN source % 4 = 2 THEN 'https://twitter.com/other' || person || '/status/1' ELSE 'https://x.com/other/status/2 | https://site.example/' || item END AS urls, CASE WHEN confidence >= 20 THEN '@' || slug END AS handle FROM recs_ JOIN people ON person = id)
SELECT own, count(*) AS n FROM (SELECT CASE WHEN urls = '' THEN false WHEN handle IS NULL OR contains(urls, 'site.example') THEN true ELSE contains(urls, '/' || slug || '/status') END AS own FROM u) GROUP BY own"""))
def own_sources(c: Catalogue) -> DataFrame:
    """Rows whose evidence may be the person's own."""
    s, p = F.col("source"), F.col("person").cast("string")
    urls = F.when(s % 4 == 0, "").when(s % 4 == 1, F.concat(F.lit("https://x.com/"), "slug", F.lit("/status/"), F.col("rec_id").cast("string"))).when(s % 4 == 2, F.concat(F.lit("https://twitter.com/other"), p, F.lit("/status/1"))).otherwise(F.concat(F.lit("https://x.com/other/status/2 | https://site.example/"), F.col("item").cast("string")))
    rows = c.recs.join(c.people.select(F.col("id").alias("person"), "slug"), "person")
    handle = F.when(F.col("confidence") >= 20, F.concat(F.lit("@"), "slug"))
    return rows.groupBy(cu.own_source(urls, handle).alias("own")).agg(F.count("*").alias("n"))


@query(over("items", """, t AS (SELECT DISTINCT title FROM items) SELECT a.title AS a, b.title AS b, levenshtein(a.title, b.title) AS edits FROM t a JOIN t b ON split_part(a.title, ' ', 1) = split_part(b.title, ' ', 1) AND a.title < b.title"""))
def title_edits(c: Catalogue) -> DataFrame:
    """Edit distance between titles that begin with one word."""
    t = c.items.select("title").distinct().withColumn("w", F.split("title", " ").getItem(0))
    a, b = t.withColumnRenamed("title", "a"), t.withColumnRenamed("title", "b")
    return a.join(b, "w").where("a < b").select("a", "b", F.levenshtein("a", "b").alias("edits"))


_RAW = "CASE WHEN size % 3 = 0 THEN 'Business' WHEN size % 3 = 1 THEN 'biz' ELSE 'Memoirs' END || CASE WHEN price > 1000 THEN 'Science Fiction' WHEN price > 950 THEN ', self-help' ELSE 'True crime.LGBTQ' END || CASE WHEN kind = 'PROMO' THEN 'Adult' WHEN kind = 'ECONOMY' THEN 'PersonalDevelopmentHistory' ELSE 'Fantasy, business' END"
_PHRASES = [("Personal Development", "Personal[ -]?Development"), ("Historical Fiction", "Historical[ -]?Fiction"), ("American History", "American[ -]?History"), ("Science Fiction", "Science[ -]?Fiction"), ("Social Sciences", "Social[ -]?Sciences"), ("Graphic Novels", "Graphic[ -]?Novels"), ("True Crime", "True[ -]?Crime"), ("Self-Help", "Self[ -]?Help")]


def _categories_sql() -> str:
    marked = "raw"
    for i, (_, pattern) in enumerate(_PHRASES):
        marked = f"regexp_replace({marked}, '(?i){pattern}', '~~#{i}~', 'g')"
    names = "[" + ", ".join(f"'{p}'" for p, _ in _PHRASES) + "]"
    parents = " ".join(f"WHEN list_contains([{', '.join(chr(39) + x.replace(chr(39), chr(39) * 2) + chr(39) for x in own)}], category) THEN '{p}'" for p, own in reversed(cu.PARENTS.items()))
    return over("items", f""", r AS (SELECT id, {_RAW} AS raw FROM items), m AS (SELECT id, regexp_replace(regexp_replace({marked}, 'LGBTQ([A-Z])', 'LGBTQ~\\1', 'g'), '([a-z])([A-Z])', '\\1~\\2', 'g') AS s FROM r),
p AS (SELECT id, unnest(regexp_split_to_array(s, '[,•.~]')) AS x, generate_subscripts(regexp_split_to_array(s, '[,•.~]'), 1) AS at_ FROM m),
t AS (SELECT id, at_, CASE WHEN starts_with(x, '#') THEN {names}[substr(x, 2)::INT + 1] ELSE trim(regexp_replace(x, '\\s+', ' ', 'g')) END AS x FROM p),
f AS (SELECT id, at_, CASE lower(x) WHEN 'biz' THEN 'Business' WHEN 'sci-fi' THEN 'Science Fiction' WHEN 'memoirs' THEN 'Memoir' ELSE x END AS category FROM t WHERE length(x) >= 2),
u AS (SELECT id, arg_min(category, at_) AS category FROM f GROUP BY id, lower(category))
SELECT category, CASE {parents} ELSE 'Other' END AS parent, count(*) AS items FROM u GROUP BY 1, 2""")


@query(_categories_sql())
def clean_categories(c: Catalogue) -> DataFrame:
    """Items by clean category, and its parent."""
    rows = c.items.select("id", F.explode(cu.categories(F.expr(_RAW))).alias("category"))
    return rows.groupBy("category", cu.parent_of(F.col("category")).alias("parent")).agg(F.count("*").alias("items"))


@query(over("people", r""", n AS (SELECT id, 'Ann ' || CASE WHEN quality > 5000 THEN 'Maria ' ELSE '' END || translate(lower(name), '#0123456789', ' abcdefghij') AS ours, 'Ann ' || CASE WHEN nation % 3 = 0 THEN 'Maria ' WHEN nation % 3 = 1 THEN 'B. ' ELSE '' END || translate(lower(name), '#0123456789', ' abcdefghij') AS page FROM people),
f AS (SELECT id, trim(regexp_replace(lower(ours), '[^a-z0-9]+', ' ', 'g')) AS o, trim(regexp_replace(lower(page), '[^a-z0-9]+', ' ', 'g')) AS p FROM n)
SELECT same, count(*) AS n FROM (SELECT replace(o, ' ', '') = replace(p, ' ', '') OR (len(string_split(p, ' ')) >= 2 AND len(string_split(o, ' ')) > len(string_split(p, ' ')) AND string_split(p, ' ')[1] = string_split(o, ' ')[1] AND string_split(p, ' ')[-1] = string_split(o, ' ')[-1] AND list_has_all(string_split(o, ' '), string_split(p, ' '))) AS same FROM f) GROUP BY same"""))
def same_people(c: Catalogue) -> DataFrame:
    """Names on pages against ours: equal, or ours only adds names in the middle."""
    last = F.translate(F.lower("name"), "#0123456789", " abcdefghij")
    ours = F.concat(F.lit("Ann "), F.when(F.col("quality") > 5000, "Maria ").otherwise(""), last)
    page = F.concat(F.lit("Ann "), F.when(F.col("nation") % 3 == 0, "Maria ").when(F.col("nation") % 3 == 1, "B. ").otherwise(""), last)
    return c.people.groupBy(cu.same_person(page, ours).alias("same")).agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT role, turn, conv_id, text, CASE WHEN turn % 3 = 0 THEN 'Reading List (7 Books)' WHEN turn % 3 = 1 THEN 'Thion Heand' ELSE 'Will Anthe' END AS name FROM conversations WHERE text IS NOT NULL),
w AS (SELECT *, list_filter(regexp_split_to_array(lower(name), '[^a-z]+'), lambda x: length(x) >= 4) AS parts, regexp_split_to_array(lower(text), '[^a-z]+') AS words FROM t)
SELECT name, count(*) AS turns, count(*) FILTER (WHERE turn % 3 <> 0 AND list_has_any(parts, words)) AS leaks FROM w GROUP BY name""")
def name_leaks(c: Catalogue) -> DataFrame:
    """Turns that hold a part of a name; labels of lists are no names."""
    name = F.when(F.col("turn") % 3 == 0, "Reading List (7 Books)").when(F.col("turn") % 3 == 1, "Thion Heand").otherwise("Will Anthe")
    rows = c.t("conversations").where("text is not null").withColumn("name", name)
    return rows.groupBy("name").agg(F.count("*").alias("turns"), F.count_if(cu.name_leak(F.col("text"), F.col("name"))).alias("leaks"))


@query(over("people", """, l AS (SELECT id, name, CASE WHEN quality < 0 THEN '' WHEN quality < 2000 THEN 'CC BY-NC 4.0' WHEN quality < 4000 THEN 'CC BY 4.0' WHEN quality < 6000 THEN 'Public domain' WHEN quality < 8000 THEN 'All rights reserved' ELSE 'CC0' END AS licence FROM people)
SELECT licence, licence IN ('CC BY 4.0', 'Public domain', 'CC0') AS shown, count(*) AS n, max(CASE WHEN licence = '' THEN NULL ELSE 'Photo: ' || name || ' (' || licence || ')' END) AS credit FROM l GROUP BY licence"""))
def licence_gate(c: Catalogue) -> DataFrame:
    """Portraits by licence: what forbids comes before what allows; with the line that credits one."""
    q = F.col("quality")
    licence = F.when(q < 0, "").when(q < 2000, "CC BY-NC 4.0").when(q < 4000, "CC BY 4.0").when(q < 6000, "Public domain").when(q < 8000, "All rights reserved").otherwise("CC0")
    rows = c.people.select("name", licence.alias("licence"))
    return rows.groupBy("licence", cu.licence_ok(F.col("licence")).alias("shown")).agg(F.count("*").alias("n"), F.max(cu.photo_credit(F.col("name"), F.col("licence"))).alias("credit"))


@query(over("people counted shelves", """, n AS (SELECT person, count(*) AS n FROM shelves GROUP BY person)
SELECT 'item' AS kind, count(*) AS eligible, min(id) AS first FROM counted WHERE recs >= 25 AND title <> '' AND author <> '' AND size % 5 <> 0 AND rating >= 1
UNION ALL SELECT 'person', count(*), min(id) FROM people LEFT JOIN n ON id = person WHERE role IS NOT NULL AND coalesce(n, 0) >= 1 AND quality > 0"""))
def bulk_publish(c: Catalogue) -> DataFrame:
    """What may be published in bulk: items and people that reach every threshold."""
    items = c.counted_items.where("recs >= 25 and title != '' and author != '' and size % 5 != 0 and rating >= 1")
    people = c.people.where("role is not null and quality > 0").join(c.shelves.select(F.col("person").alias("id")).distinct(), "id", "left_semi")
    count = lambda df, kind: df.agg(F.lit(kind).alias("kind"), F.count("*").alias("eligible"), F.min("id").alias("first"))
    return count(items, "item").union(count(people, "person"))


@query(over("items recs_", """, m AS (SELECT rec_id, CASE WHEN items.id IS NULL THEN 'no_item' WHEN confidence < 20 THEN 'not_listed' WHEN source % 9 = 0 THEN 'fetch_error' WHEN confidence >= 80 THEN 'listed_exact' ELSE 'listed_loose' END AS state, source % 2 AS site FROM recs_ LEFT JOIN items ON item = items.id AND size > 3)
SELECT state, count(*) AS n, count(*) FILTER (WHERE site = 0) AS first_site, count(*) FILTER (WHERE site = 1) AS second_site FROM m GROUP BY state"""))
def orphan_counters(c: Catalogue) -> DataFrame:
    """Rows looked up again, counted by what was found and where."""
    rows = c.recs.join(c.items.where("size > 3").select(F.col("id").alias("item"), F.lit(True).alias("there")), "item", "left")
    state = op.ladder((F.col("there").isNull(), "no_item"), (F.col("confidence") < 20, "not_listed"), (F.col("source") % 9 == 0, "fetch_error"), (F.col("confidence") >= 80, "listed_exact"), otherwise="listed_loose")
    return rows.groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.count_if(F.col("source") % 2 == 0).alias("first_site"), F.count_if(F.col("source") % 2 == 1).alias("second_site"))


@query(over("items", """, s AS (SELECT id, title || ' & ' || author || '''s' AS t FROM items) SELECT id, trim(regexp_replace(regexp_replace(replace(lower(trim(t)), '&', ' and '), '[''’`]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM s"""))
def slugs_with_and(c: Catalogue) -> DataFrame:
    return c.items.select("id", cu.slug_with_and(F.concat("title", F.lit(" & "), "author", F.lit("'s"))).alias("slug"))


@query(over("recs_", """, s AS (SELECT rec_id, person, source % 5 AS kind, confidence, quantity_ FROM (SELECT *, confidence / 2 AS quantity_ FROM recs_) WHERE confidence < 70)
SELECT kind, decision, count(*) AS n FROM (SELECT kind, CASE WHEN kind = 0 THEN CASE WHEN quantity_ >= 20 THEN 'accept' ELSE 'reject' END WHEN kind IN (1, 2) THEN CASE WHEN quantity_ >= 30 THEN 'accept' WHEN quantity_ >= 15 THEN 'look' ELSE 'reject' END WHEN kind = 3 THEN 'look' ELSE 'reject' END AS decision FROM s) GROUP BY 1, 2"""))
def weak_sources(c: Catalogue) -> DataFrame:
    """Decisions on weak sources, each kind of source by its own rule."""
    kind, q = F.col("source") % 5, F.col("confidence") / 2
    decision = op.ladder(((kind == 0) & (q >= 20), "accept"), (kind == 0, "reject"), (kind.isin(1, 2) & (q >= 30), "accept"), (kind.isin(1, 2) & (q >= 15), "look"), (kind.isin(1, 2), "reject"), (kind == 3, "look"), otherwise="reject")
    return c.recs.where("confidence < 70").groupBy(kind.alias("kind"), decision.alias("decision")).agg(F.count("*").alias("n"))


@query(over("counted", """, g AS (SELECT kind, count(*) AS items, sum(recs)::BIGINT AS recs, max(id) AS last FROM counted GROUP BY kind)
SELECT '{' || string_agg('"' || kind || '":{"items":' || items || ',"recs":' || recs || ',"last":' || last || '}', ',' ORDER BY kind) || '}' AS summary FROM g"""))
def summary_document(c: Catalogue) -> DataFrame:
    """One JSON document of counts by kind, its keys in order."""
    return op.summary(c.counted_items, "kind", {"items": F.count("*"), "recs": F.sum("recs"), "last": F.max("id")})


@query(over("shelves", """, n AS (SELECT person, count(*) AS n FROM shelves GROUP BY person HAVING count(*) >= 20), big AS (SELECT person, item FROM shelves JOIN n USING (person)),
p AS (SELECT x.person AS a, y.person AS b, count(*) AS shared FROM big x JOIN big y ON x.item = y.item AND x.person < y.person GROUP BY 1, 2 HAVING count(*) >= 6)
SELECT a, b, shared, n1.n AS na, n2.n AS nb FROM p JOIN n n1 ON a = n1.person JOIN n n2 ON b = n2.person"""))
def lens_pairs(c: Catalogue) -> DataFrame:
    """Pairs whose circles of shelf size overlap in a lens of the shared size: the distance found gives the shared size back."""
    pairs = overlap.comparable(c.shelves, "person", "item", 20, 6)
    r, s = F.sqrt(F.col("na") / F.lit(3.141592653589793)), F.sqrt(F.col("nb") / F.lit(3.141592653589793))
    d = cu.lens_distance(r, s, F.col("shared").cast("double"))
    x, y = F.acos((d * d + r * r - s * s) / (2 * d * r)), F.acos((d * d + s * s - r * r) / (2 * d * s))
    area = r * r * (x - F.sin(2 * x) / 2) + s * s * (y - F.sin(2 * y) / 2)
    return pairs.select("a", "b", F.round(area).cast("bigint").alias("shared"), "na", "nb")
