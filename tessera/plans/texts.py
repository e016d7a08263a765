"""Text, URL and HTML plans over documents, pages, conversations and labels, and event-time extensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import html, text, urls
from tessera.operators.relational import spread, top_per
from tessera.plans.registry import query
from tessera.sources.mapping import Catalogue, over

_STOP = ", ".join(f"'{w}'" for w in text.ENGLISH_STOPWORDS)
_ENGLISH = f"""w AS (SELECT doc_id, text, trim(text) AS t, list_filter(regexp_split_to_array(lower(trim(text)), '[\\s,.;:!?"'']+'), lambda x: x <> '') AS words FROM documents),
j AS (SELECT doc_id, CASE WHEN text IS NULL OR text = '' THEN false WHEN length(t) < 50 THEN true WHEN regexp_matches(t, '{text.FOREIGN}') THEN false WHEN len(words) < 10 THEN true
 ELSE len(list_filter(words, lambda x: x IN ({_STOP}))) / len(words) >= 0.1 AND len(list_filter(words, lambda x: regexp_matches(x, '[^\\x00-\\x7F]'))) / len(words) <= 0.2 END AS english FROM w)"""


@query(over("people", "SELECT id, slug FROM people"))
def slugs(c: Catalogue) -> DataFrame:
    return c.people.select("id", "slug")


@query(f"WITH {_ENGLISH} SELECT lang, count(*) AS docs, count(*) FILTER (WHERE english) AS english FROM documents JOIN j USING (doc_id) GROUP BY lang")
def likely_english(c: Catalogue) -> DataFrame:
    docs = c.t("documents")
    return docs.groupBy("lang").agg(F.count("*").alias("docs"), F.count_if(text.likely_english(F.col("text"))).alias("english"))


@query(f"""WITH {_ENGLISH}, u AS (SELECT doc_id, coalesce(length(trim(text)) >= 80 AND NOT regexp_matches(trim(text), '{text.JUNK}') AND english, false) AS useful FROM documents JOIN j USING (doc_id))
SELECT quality, useful, count(*) AS docs FROM u JOIN labels USING (doc_id) GROUP BY quality, useful""")
def description_quality(c: Catalogue) -> DataFrame:
    """The description rule against the labels: a confusion matrix."""
    rows = c.t("documents").select("doc_id", text.useful_description(F.col("text")).alias("useful")).join(c.t("labels"), "doc_id")
    return rows.groupBy("quality", "useful").agg(F.count("*").alias("docs"))


@query("""WITH d AS (SELECT source, text, regexp_replace(text, '[^A-Z]', '', 'g') AS up, regexp_replace(text, '[^A-Za-z]', '', 'g') AS al FROM documents),
t AS (SELECT source, unnest(list_filter([CASE WHEN length(trim(text)) < 80 THEN 'too_short' END, CASE WHEN length(up) > 0.5 * greatest(length(al), 1) THEN 'shouting' END, CASE WHEN contains(text, ' | ') THEN 'table_marks' END,
 CASE WHEN regexp_matches(text, '[#$%&*]{3}') THEN 'symbol_noise' END, CASE WHEN contains(text, '!!') THEN 'exclamations' END, CASE WHEN regexp_matches(text, 'https?://') THEN 'url' END, CASE WHEN regexp_matches(text, '[A-Za-z0-9._]+@[A-Za-z0-9]+\\.[a-z]+') THEN 'email' END], lambda x: x IS NOT NULL)) AS tag FROM d)
SELECT tag, count(*) AS docs, count(DISTINCT source) AS sources FROM t GROUP BY tag""")
def problem_tags(c: Catalogue) -> DataFrame:
    """How many documents carry each hygiene tag (those that RE2 can check too)."""
    rows = c.t("documents").select("source", F.explode(text.problem_tags(F.col("text"), without=["repeated_word", "markup", "not_english"])).alias("tag"))
    return rows.groupBy("tag").agg(F.count("*").alias("docs"), F.countDistinct("source").alias("sources"))


@query("""WITH p AS (SELECT page_id, html, trim(regexp_extract(html, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1)) AS title, trim(regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1\\s*>', 1)) AS h1 FROM pages)
SELECT page_id, title, length(title) AS title_chars, h1, length(regexp_replace(html, '(?is)<h1\\b', chr(1), 'g')) - length(replace(regexp_replace(html, '(?is)<h1\\b', chr(1), 'g'), chr(1), '')) AS h1_count,
 len(regexp_extract_all(html, '(?i)<a\\b')) AS links, len(regexp_extract_all(html, '(?i)<img\\b')) AS images, regexp_extract(html, '(?i)<html[^>]*lang="([^"]*)"', 1) AS lang FROM p""")
def page_audit(c: Catalogue) -> DataFrame:
    """A row for each page: title, headings, links, images, language."""
    h = F.col("html")
    title = html.tag_text(h, "title")
    return c.t("pages").select("page_id", title.alias("title"), F.length(title).cast("bigint").alias("title_chars"), html.tag_text(h, "h1").alias("h1"), html.tag_count(h, "h1").cast("bigint").alias("h1_count"), html.tag_count(h, "a").cast("bigint").alias("links"), html.tag_count(h, "img").cast("bigint").alias("images"), F.regexp_extract(h, r'(?i)<html[^>]*lang="([^"]*)"', 1).alias("lang"))


@query("""WITH v AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b.*?</style\\s*>', ' ', 'g'), '(?is)<nav\\b.*?</nav\\s*>', ' ', 'g'), '(?is)<noscript\\b.*?</noscript\\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g') AS t FROM pages),
x AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM v)
SELECT page_id, length(text) AS chars, md5(text) AS digest FROM x""")
def visible_text(c: Catalogue) -> DataFrame:
    t = html.visible_text(F.col("html"))
    return c.t("pages").select("page_id", t.alias("text")).select("page_id", F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("digest"))


@query("""WITH a AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(u, '([?&])(?:utm_[a-z]+|ref|fbclid|gclid|source)=[^&]*', '\\1', 'g'), '\\?&+', '?', 'g') AS u FROM a),
d AS (SELECT page_id, regexp_replace(regexp_replace(u, '[?&]+$', ''), '/+$', '') AS u FROM b)
SELECT page_id, lower(regexp_extract(u, '^([A-Za-z]+://[^/?#]*)', 1)) || substr(u, length(regexp_extract(u, '^([A-Za-z]+://[^/?#]*)', 1)) + 1) AS clean FROM d""")
def url_normalise(c: Catalogue) -> DataFrame:
    return c.t("pages").select("page_id", urls.clean_url(F.col("url")).alias("clean"))


@query("""WITH h AS (SELECT regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '^www\\.', '') AS host FROM pages)
SELECT host, count(*) AS pages, CASE WHEN regexp_matches(host, '(^|\\.)(twitter\\.com|x\\.com)$') THEN 'nofollow' ELSE '' END AS rel FROM h WHERE host <> '' GROUP BY host""")
def hosts(c: Catalogue) -> DataFrame:
    rows = c.t("pages").select(urls.host_of(F.col("url")).alias("host"), urls.outbound_rel(F.col("url")).alias("rel")).where("host is not null")
    return rows.groupBy("host", "rel").agg(F.count("*").alias("pages")).select("host", "pages", "rel")


@query(over("people", """, s AS (SELECT id, CASE id % 6 WHEN 0 THEN 'https://twitter.com/' || slug || '/status/1700000000000000000' WHEN 1 THEN 'https://www.youtube.com/watch?v=' || id WHEN 2 THEN 'https://' || slug || '.com/books' WHEN 3 THEN 'https://example.org/podcast/episode-' || id WHEN 4 THEN 'https://en.wikipedia.org/wiki/' || slug ELSE 'https://example.org/interview/' || id END AS url FROM people)
SELECT CASE id % 6 WHEN 0 THEN 'tweet' WHEN 1 THEN 'youtube' WHEN 2 THEN 'own_site' WHEN 3 THEN 'podcast' WHEN 4 THEN 'other' ELSE 'article' END AS kind, id % 6 IN (0, 2) AS own, count(*) AS n, max(CASE WHEN id % 6 = 0 THEN 2023 END) AS year FROM s GROUP BY 1, 2"""))
def source_kinds(c: Catalogue) -> DataFrame:
    """Kinds of the sources people are cited from; addresses are derived from their slugs."""
    i, slug = F.col("id"), F.col("slug")
    url = F.when(i % 6 == 0, F.concat(F.lit("https://twitter.com/"), slug, F.lit("/status/1700000000000000000"))).when(i % 6 == 1, F.concat(F.lit("https://www.youtube.com/watch?v="), i.cast("string"))).when(i % 6 == 2, F.concat(F.lit("https://"), slug, F.lit(".com/books")))
    url = url.when(i % 6 == 3, F.concat(F.lit("https://example.org/podcast/episode-"), i.cast("string"))).when(i % 6 == 4, F.concat(F.lit("https://en.wikipedia.org/wiki/"), slug)).otherwise(F.concat(F.lit("https://example.org/interview/"), i.cast("string")))
    rows = spread(c.people.select("id", "slug", "name"), "id").select(url.alias("url"), "slug", "name").select(urls.source_kind(F.col("url"), F.col("slug"), F.col("name"), F.lit(None).cast("string")).alias("k"), urls.snowflake_year(F.col("url")).alias("year"))
    return rows.groupBy(F.col("k.kind").alias("kind"), F.col("k.own").alias("own")).agg(F.count("*").alias("n"), F.max("year").alias("year"))


@query(over("items", """, s AS (SELECT id, 'https:/a.example/' || id || ' | https://b.example/' || size || ',https://a.example/' || id || 'https://c.example/x | junk' AS f FROM items)
SELECT id, 'https://a.example/' || id || ' ' || 'https://b.example/' || (SELECT size FROM items i WHERE i.id = s.id) || ' https://c.example/x' AS urls, 3::BIGINT AS n FROM s"""))
def split_sources(c: Catalogue) -> DataFrame:
    """Fields that join several addresses in dirty ways, taken apart."""
    f = F.concat(F.lit("https:/a.example/"), F.col("id").cast("string"), F.lit(" | https://b.example/"), F.col("size").cast("string"), F.lit(",https://a.example/"), F.col("id").cast("string"), F.lit("https://c.example/x | junk"))
    found = urls.split_urls(f)
    return c.items.select("id", F.array_join(found, " ").alias("urls"), F.size(found).cast("bigint").alias("n"))


@query(over("items", """SELECT id, (id % 60 / 10)::VARCHAR || ' (' || (size * 37)::VARCHAR || ')' AS raw, CASE WHEN id % 60 / 10 > 0 AND id % 60 / 10 <= 5 THEN id % 60 / 10 END AS rating, size * 37 AS votes FROM items"""))
def parsed_ratings(c: Catalogue) -> DataFrame:
    raw = F.concat((F.col("id") % 60 / 10).cast("string"), F.lit(" ("), (F.col("size") * 37).cast("string"), F.lit(")"))
    return c.items.select("id", raw.alias("raw"), text.parse_rating(raw).alias("r")).select("id", "raw", "r.rating", "r.votes")


@query(over("items", """SELECT id, CASE WHEN length(title || ' by ' || author || ' | a guide') <= 24 THEN title || ' by ' || author || ' | a guide' WHEN length(title || ' by ' || author) <= 20 THEN title || ' by ' || author ELSE title END AS page_title FROM items"""))
def page_titles(c: Catalogue) -> DataFrame:
    """The longest form of a title that fits."""
    full = F.concat_ws(" by ", "title", "author")
    return c.items.select("id", F.coalesce(text.first_that_fits(24, F.concat(full, F.lit(" | a guide"))), text.first_that_fits(20, full), F.col("title")).alias("page_title"))


@query("""WITH i AS (SELECT item_id, trim(lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g'))) AS t FROM benchmark), d AS (SELECT doc_id, ' ' || trim(lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g'))) || ' ' AS t FROM documents)
SELECT doc_id, item_id FROM d JOIN i ON contains(d.t, ' ' || i.t || ' ') WHERE length(i.t) > 0""")
def benchmark_evidence(c: Catalogue) -> DataFrame:
    """Benchmark passages found word for word in documents. Candidates meet on a hash of a passage's first four words (all, where
    it has fewer), then containment decides."""
    flat = lambda col: F.trim(F.lower(F.regexp_replace(col, "[^A-Za-z0-9]+", " ")))
    head = lambda words, at, size: F.xxhash64(*[F.get(words, at + k) for k in range(size)])
    items = c.t("benchmark").select("item_id", flat(F.col("text")).alias("p")).where("p != ''").withColumn("w", F.split("p", " "))
    items = items.withColumn("n", F.least(F.lit(4), F.size("w")))
    docs = c.t("documents").select("doc_id", flat(F.col("text")).alias("t"))
    words, pairs = docs.select("doc_id", F.split("t", " ").alias("w")), None
    for n in sorted(r.n for r in items.select("n").distinct().collect()):  # 1 to 4
        places = F.when(F.size("w") >= n, F.sequence(F.lit(0), F.size("w") - n))
        keys = F.transform(places, lambda i: head(F.col("w"), i, n))  # noqa: B023
        grams = words.select("doc_id", F.explode(F.array_distinct(keys)).alias("key"))
        found = grams.join(items.where(F.col("n") == n).select("item_id", "p", head(F.col("w"), F.lit(0), n).alias("key")), "key").select("doc_id", "item_id", "p")
        pairs = found if pairs is None else pairs.union(found)
    if pairs is None:  # no passages at all
        return docs.join(items, F.col("t") == F.col("p")).select("doc_id", "item_id")
    both = pairs.join(docs, "doc_id")
    return both.where(F.concat(F.lit(" "), "t", F.lit(" ")).contains(F.concat(F.lit(" "), F.col("p"), F.lit(" ")))).select("doc_id", "item_id")


@query("""WITH r AS (SELECT conv_id, turn, role, CASE WHEN role = 'user' THEN turn END AS ask FROM conversations),
n AS (SELECT conv_id, turn, role, max(ask) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 40 PRECEDING AND CURRENT ROW) AS asked FROM r)
SELECT conv_id, turn, asked FROM n WHERE role = 'assistant'""")
def nearest_speaker(c: Catalogue) -> DataFrame:
    """For each answer, the turn of the nearest question before it, at most forty turns back."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-40, 0)
    ask = F.when(F.col("role") == "user", F.col("turn"))
    return c.t("conversations").select("conv_id", "turn", "role", F.last(ask, ignorenulls=True).over(w).alias("asked")).where("role = 'assistant'").select("conv_id", "turn", "asked")


@query("""WITH w AS (SELECT lang, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: length(x) >= 4)) AS word FROM documents),
n AS (SELECT lang, word, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, word) AS rank FROM w GROUP BY lang, word) SELECT lang, word, n, rank FROM n WHERE rank <= 10""")
def keyword_density(c: Catalogue) -> DataFrame:
    """The most frequent longer words of each language."""
    words = c.t("documents").select("lang", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where("length(word) >= 4")
    return top_per(words.groupBy("lang", "word").agg(F.count("*").alias("n")), ["lang"], [F.desc("n"), F.asc("word")], 10).select("lang", "word", "n", "rank")


@query(over("people", """SELECT id, slug, list_reduce([2166136261::BIGINT] || list_transform(string_split(slug, ''), lambda x: ord(x)::BIGINT), lambda h, x: (xor(h, x) * 16777619) & 4294967295) % 12 AS place FROM people"""))
def palette_places(c: Catalogue) -> DataFrame:
    """A colour of twelve for each person, from the FNV-1a hash of their slug."""
    return c.people.select("id", "slug", (text.fnv1a(F.col("slug")) % 12).alias("place"))


@query("""SELECT event_type, CAST(date_trunc('hour', ts) AS VARCHAR) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def events_by_hour(c: Catalogue) -> DataFrame:
    """Extension: tumbling windows; tessera.streaming has the same over a stream."""
    from tessera.streaming.events import hourly

    return hourly(c.t("events")).select("event_type", F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "n", F.round("total", 4).alias("total"))


@query("""WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1) SELECT CAST(day AS VARCHAR) AS day, n, lag(n) OVER (ORDER BY day) AS before, CASE WHEN lag(n) OVER (ORDER BY day) IS NULL THEN 'first' WHEN n >= lag(n) OVER (ORDER BY day) THEN 'publish' ELSE 'hold' END AS decision FROM d""")
def day_over_day(c: Catalogue) -> DataFrame:
    """Each day against the newest before it; one row for each day, so one ordered pass is enough."""
    d = c.t("events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    before = F.lag("n").over(Window.orderBy("day"))
    return d.select(F.col("day").cast("string").alias("day"), "n", before.alias("before"), F.when(before.isNull(), "first").when(F.col("n") >= before, "publish").otherwise("hold").alias("decision"))


@query("""SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def rollup_lines(c: Catalogue) -> DataFrame:
    """Extension: grouping sets."""
    return c.t("lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), "l_quantity").rollup("flag", "status").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
