"""Texts made fit to show: descriptions cleaned to a fixpoint, drafts judged by rules, cards of pages, candidates matched to a person's books; with the SQL that checks each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import hygiene as hy
from tessera.functions.text import fold_accents
from tessera.operators import cards, rules, similarity
from tessera.operators.relational import spread
from tessera.operators.resolve import stored
from tessera.plans.registry import query
from tessera.sources.mapping import Catalogue, over, pick


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# ---- descriptions ----

#: SQL for both engines: id, title, text. Beginnings, sentences and ends of descriptions, clean and damaged, in all combinations.
_BEGIN = ["", "* Great fun * Bold * New York Times bestseller * ", "'A triumph' - The Guardian ", "“Loved it” Sunday Times ", "For use in schools and libraries only. ", "This 25th Anniversary Edition includes a foreword. ", "**PULITZER PRIZE WINNER** ", "Book 2. ", "Second edition, ", "TITLE is ", "*** ", "Instant WSJ bestseller. ", "* One bullet that ends. And prose begins * ", "'Fun' 'Wild' ", "No description available ", "* ", "'Dark' This 3rd Anniversary Edition is new. * Award * "]
_BODY = ["This is the story of a river and of those who live beside it.", "When the ice breaks, a captain must choose between a crew and a course.", "Ann Lee.Set against the stars, it asks what we owe.", "The TempletonWhat and ThreeBody prizes went to others.", "Why ?so ?many ?odd marks appear here nobody knows.", "An iPhone and a YouTube channel start it all.", "A NEW DAWN FOR THE WORLD begins with an introduction by a friend.", "", "Set in a harbor town, three sisters keep one secret.", "lower case begins this one and goes on."]
_END = ["", " Praise for The Author: wonderful, a delight.", " Continue The Trilogy with the next volume of stone.", " *** and more", " The edition includes maps.", "  ", " It was a New York Times bestseller."]
_DESCRIBED = (
    f"SELECT id, title, CASE WHEN id % 97 = 0 THEN NULL WHEN id % 89 = 0 THEN '   ' ELSE replace({pick('id * 3 + k', _BEGIN)}, 'TITLE', title) || repeat({pick('id + k * 3', _BODY)} || ' ', CAST(1 + (id + k) % 4 AS INT)) || {pick('id * 5 + k', _END)} END AS text "
    "FROM (SELECT id, title, CAST((id - id % 13) / 13 AS BIGINT) AS k FROM items) q"
)


def _hygiene_sql() -> str:
    one = lambda c, pattern, to="", flags="": f"regexp_replace({c}, {_sql(pattern)}, {_sql(to)}{flags})"

    def strips(c: str) -> str:
        c = one(one(c, hy.SCHOOLS), hy.BANNER)
        c = one(c, f"{hy.BLURB}({hy.PROSE})\\b", "\\1")
        c = one(c, hy.ANNIVERSARY)
        chunks = f"list_filter(list_slice(string_split_regex(c, '\\s*\\*\\s*'), 2, 100000), lambda x: NOT regexp_full_match(x, '\\s*'))"
        c = f"(SELECT CASE WHEN regexp_matches(c, '^\\s*\\*') AND len({chunks}) > 0 AND len(list_filter({chunks}, lambda x: length(x) >= 200 OR regexp_matches(x, {_sql(hy.RESTART)}))) = 0 THEN '' ELSE c END FROM (SELECT {c} AS c))"
        c = one(one(c, hy.STAR_BLOB, " ", ", 'g'"), hy.PRAISE_TAIL)
        c = one(one(c, hy.CONTINUE_TAIL), "^[\\s*]+")
        return f"trim({one(c, '\\s+', ' ', ', ' + _sql('g'))})"

    passes = ", ".join([f"p{n} AS MATERIALIZED (SELECT * EXCLUDE (c), {strips("z.c")} AS c, z.c AS c{n - 1} FROM p{n - 1} z)" for n in range(1, hy.PASSES + 1)])
    tests = dict(hy.TAGS)
    match = {t: f"regexp_matches(t, {_sql(p)})" for t, p in tests.items()}
    match["nyt_bestseller_noisy"] += f" AND ({match['asterisk_bullet_run']} OR {match['leading_asterisks']} OR {match['award_marketing_wsj']})"
    match["mojibake_question_marks"] = "len(regexp_extract_all(t, '\\?[A-Za-z]')) >= 3"
    match["mashed_words"] = f"len(list_filter(regexp_extract_all(t, {_sql(hy.MASHED)}), lambda w: lower(w) NOT IN ({', '.join(map(_sql, hy.MASHED_KNOWN))}))) >= 2"
    match["leading_title_repetition"] = "trim(title) <> '' AND starts_with(lower(ltrim(t)), lower(trim(title))) AND regexp_matches(substr(ltrim(t), length(trim(title)) + 1), '(?i)^\\s+(?:is\\s+|,\\s+|:|by\\s+)')"
    tags = "CASE WHEN regexp_full_match(t, '\\s*') THEN 'empty_description' ELSE concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{tag}' END" for tag, c in match.items()) + ") END"
    changed = " + ".join(f"(c{n} <> {'c' if n == hy.PASSES - 1 else f'c{n + 1}'})::INT" for n in range(hy.PASSES))
    has = lambda names: " OR ".join(f"list_contains(string_split(tags, ','), '{n}')" for n in names)
    return f""", d AS ({_DESCRIBED}),
p0 AS (SELECT id, title, text, coalesce(text, '') AS t, coalesce(text, '') AS c FROM d), {passes},
g AS (SELECT *, {tags} AS tags, {changed} AS passes FROM p{hy.PASSES}),
e AS (SELECT *, tags = '' AS fine, tags = 'empty_description' OR {has(hy.UNFIXABLE)} OR c = trim(t) OR c = t OR length(c) < 100 OR ({has(['placeholder_text'])} AND regexp_matches(c, {_sql(hy.PLACEHOLDER)})) OR regexp_matches(c, '\\?[A-Za-z]') OR regexp_matches(c, '[a-z]\\.[A-Z][a-z]') OR regexp_matches(c, {_sql(hy.LEFTOVER)}) AS look FROM g)
SELECT id, tags, CASE WHEN fine THEN 'skip' WHEN look THEN 'needs_manual_review' ELSE 'would_clean' END AS action, CASE WHEN fine THEN '' WHEN look THEN 'low' WHEN ({has(hy.SURE)}) AND length(c) >= 200 THEN 'high' ELSE 'medium' END AS confidence, passes, md5(c) AS clean FROM e"""


@query(over("items", _hygiene_sql()))
def description_hygiene(c: Catalogue) -> DataFrame:
    """Every description with what is wrong with it, its form after the safe strips have been repeated until nothing changes, and whether that may replace it."""
    rows = c.spark.sql(_DESCRIBED.replace("FROM items)", "FROM {items})"), items=spread(c.items.select("id", "title"), "id"))
    rows = rows.withColumns({"t": F.coalesce("text", F.lit("")), "c": hy.cleaned(F.col("text"))}).withColumn("tags", hy.problems(F.col("t"), F.col("title")))
    rows = rows.withColumn("e", hy.evaluated(F.col("t"), F.col("c.text"), F.col("tags")))
    return rows.select("id", F.array_join("tags", ",").alias("tags"), "e.action", "e.confidence", F.col("c.passes").alias("passes"), F.md5("c.text").alias("clean"))


@query("""SELECT doc_id, trim(regexp_replace(lower(strip_accents(substr(text, 1, 60))), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM documents""")
def folded_slugs(c: Catalogue) -> DataFrame:
    """Slugs of the documents' first 60 characters, letters with marks as the letters they are made of."""
    flat = F.lower(fold_accents(F.substring("text", 1, 60)))
    return c.t("documents").select("doc_id", F.trim(F.regexp_replace(flat, "[^a-z0-9]+", "-"), F.lit("-")).alias("slug"))


# ---- drafts ----

#: What a draft must have, what makes it specific, what its warnings hold. (rule, role, dimension, kind, field, pattern, low, high, weight)
RULES = [
    ("summary_length_out_of_range", "require", None, "words", "editorial_summary", None, 55.0, 110.0, None), ("quick_verdict_too_long", "require", None, "words", "quick_verdict", None, None, 55.0, None),
    ("best_for_bad_list", "require", None, "items", "best_for", None, 3.0, 4.0, None), ("not_for_bad_list", "require", None, "items", "not_for", None, 3.0, 4.0, None), ("vibe_tags_bad_list", "require", None, "items", "vibe_tags", None, 5.0, 8.0, None),
    ("vibe_tag_missing_pace", "require", None, "items_like", "vibe_tags", "^(slow-burn|fast-but-dense|idea-dense|patience-demanding|quick-but-heavy|dense-read|light-but-sharp|one-sitting|high-friction)$", 1.0, None, None),
    ("says when to read", "signal", "reader_fit_specificity", "phrases", "quick_verdict", "read when|skip if|read if|good if|useful if|best when", 1.0, None, None),
    ("speaks to the reader", "signal", "reader_fit_specificity", "phrases", "best_for", "you are|you want|you need|you have|you enjoy|you prefer", 1.0, None, None),
    ("names a limit", "signal", "reader_fit_specificity", "phrases", "editorial_summary", "useful part|annoying|limitation|tradeoff|weakest|strongest|bounce|dnf", 1.0, None, None),
    ("names a role", "signal", "reader_fit_specificity", "phrases", "best_for+quick_verdict", "founder|product manager|teacher|parent|student|manager|strategist|engineer|designer|leader|clinician|therapist|analyst|entrepreneur|investor|coach|executive|researcher", 1.0, None, None),
    ("names a mismatch", "signal", "reader_fit_specificity", "phrases", "not_for+editorial_summary", "allergic to|not a manual|not a playbook|not a how-to|light on practical steps|mental irritant|dense case study|slow read|no step-by-step", 1.0, None, None),
    ("names a field", "signal", "reader_fit_specificity", "phrases", "best_for+quick_verdict+editorial_summary", "startup|corporate|parenting|classroom|product|strategy|product thinking|silicon valley|enterprise", 1.0, None, None),
    ("best_for_too_generic", "penalty", "reader_fit_specificity", "phrases", "best_for", "people who|readers of|those interested in|anyone who", 2.0, None, 2.0), ("verdict too short", "penalty", "reader_fit_specificity", "chars", "quick_verdict", None, None, 19.0, 1.5),
    ("says where it is put down", "signal", "dnf_warning_quality", "phrases", "not_for", "you'll likely put it down|you'll likely lose interest|you'll likely lose patience|you'll likely abandon|you'll likely drop|you'll likely bounce|you'll put it down|you'll lose interest|you'll lose patience|you'll abandon|you'll bounce|put it down when|put it down once|put it down around|drop the book|likely dnf|bounce off|dnf point|may stop reading|may quit|hard to finish", 1.0, None, None),
    ("says at which chapter", "signal", "dnf_warning_quality", "matches", "not_for", r"\b(chapter|chapters|the first|the second|the third|the fourth|the fifth|around the|front half|back half|first third|last third|midway|near the end)\b", 1.0, None, None),
    ("warnings too brief", "penalty", "dnf_warning_quality", "chars", "not_for", None, None, 39.0, 1.0),
]
LEVELS = [("reader_fit_specificity", n, s) for n, s in ((0, 1.5), (1, 2.5), (2, 3.5), (3, 4.5), (4, 4.8))] + [("dnf_warning_quality", n, s) for n, s in ((0, 1.5), (1, 3.5), (2, 5.0))]
_VERDICT = ["Read when your startup stalls and the founder in you wants a plan.", "Skip if you want recipes.", "A fine book.", "Short.", "", "Useful if a manager must choose between two bad roads, and best when read in one sitting by a patient student of strategy who does not mind that the book takes a long while to come to its point, wanders off, comes back, wanders off again, and then stops without so much as a word of farewell to anybody."]
_SUMMARY = ["The strongest part is the middle, and its limitation is the end.", "It is not a manual but a dense case study of one enterprise.", "A quiet book about rain.", "The useful part hides behind an annoying frame of product thinking."]
_FOR = ["you are a founder|you need a plan|you enjoy slow books", "people who read|readers of novels|anyone who sleeps", "you want peace|teachers of the young|parents| ", "you prefer maps|you have time", "engineers|analysts|coaches|researchers", "readers of rain|you are an investor|you need sleep|you want tea|you have none"]
_NOT = ["you'll likely put it down around chapter three|you want recipes|you dislike maps", "hard to finish for most|no step-by-step plan|you are allergic to jargon", "short|list|here", "it drags near the end|you need pictures|you want a summary|you read on trains", "you'll lose patience midway|it is a slow read"]
_VIBES = ["slow-burn|warm|wise|wry|wet", "Dense-Read|dark|deep|dry|dim|dull", "warm|wise|wry|wet|wild", "one-sitting|kind|keen", "high-friction |a|b|c|d|e|f|g", "light-but-sharp|x|y|z|w|v|u|t|s"]
_DRAFTS = f"SELECT id, {pick('id', _VERDICT)} AS quick_verdict, repeat({pick('id * 3 + k', _SUMMARY)} || ' ', CAST((id + k) % 12 AS INT)) AS editorial_summary, {pick('id + k * 5', _FOR)} AS best_for, {pick('id * 7 + k', _NOT)} AS not_for, {pick('id * 5 + k', _VIBES)} AS vibe_tags FROM (SELECT id, CAST((id - id % 6) / 6 AS BIGINT) AS k FROM items) q"


def _rules_sql() -> str:
    """Drafts laid out as (id, field, text, items) rows, joined with the rules as a table."""
    cell = lambda x: "NULL" if x is None else _sql(x) if isinstance(x, str) else str(x)
    return f""", d AS ({_DRAFTS}), r AS (SELECT row_number() OVER () AS no, * FROM (VALUES {', '.join('(' + ', '.join(map(cell, row)) + ')' for row in RULES)}) v(rule, role, dimension, kind, field, pattern, low, high, weight)),
l AS (SELECT * FROM (VALUES {', '.join(f"('{d}', {n}, {s})" for d, n, s in LEVELS)}) v(dimension, signals, score)),
f AS (SELECT id, 'quick_verdict' AS field, lower(coalesce(quick_verdict, '')) AS text, quick_verdict AS raw FROM d UNION ALL SELECT id, 'editorial_summary', lower(editorial_summary), editorial_summary FROM d UNION ALL SELECT id, 'best_for', lower(replace(best_for, '|', ' ')), best_for FROM d
  UNION ALL SELECT id, 'not_for', lower(replace(not_for, '|', ' ')), not_for FROM d UNION ALL SELECT id, 'vibe_tags', lower(replace(vibe_tags, '|', ' ')), vibe_tags FROM d),
t AS (SELECT id, no, string_agg(text, ' ' ORDER BY list_position(string_split(r.field, '+'), f.field)) AS text, any_value(raw) AS raw FROM r JOIN f ON list_contains(string_split(r.field, '+'), f.field) GROUP BY id, no),
m AS (SELECT id, r.*, CASE kind WHEN 'words' THEN len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) WHEN 'chars' THEN length(text) WHEN 'items' THEN len(list_filter(string_split(raw, '|'), lambda x: trim(x) <> ''))
  WHEN 'items_like' THEN len(list_filter(string_split(raw, '|'), lambda x: regexp_matches(lower(trim(x)), pattern))) WHEN 'matches' THEN len(regexp_extract_all(text, pattern)) ELSE len(list_filter(string_split(pattern, '|'), lambda p: contains(text, p))) END AS n FROM t JOIN r USING (no)),
h AS (SELECT *, coalesce(n >= low, true) AND coalesce(n <= high, true) AS ok FROM m),
why AS (SELECT id, coalesce(string_agg(rule, ',' ORDER BY no) FILTER (WHERE role = 'require' AND NOT ok), '') AS reasons FROM h GROUP BY id),
k AS (SELECT id, dimension, count(*) FILTER (WHERE role = 'signal' AND ok) AS signals, list(weight ORDER BY no) FILTER (WHERE role = 'penalty' AND ok) AS taken FROM h WHERE dimension IS NOT NULL GROUP BY id, dimension),
s AS (SELECT id, k.dimension, list_reduce(list_concat([arg_max(l.score, l.signals)::DOUBLE], coalesce(any_value(taken), [])), lambda a, b: greatest(1, a - b)) AS score FROM k JOIN l ON l.dimension = k.dimension AND l.signals <= k.signals GROUP BY id, k.dimension)
SELECT id, reasons, max(score) FILTER (WHERE dimension = 'reader_fit_specificity') AS fit, max(score) FILTER (WHERE dimension = 'dnf_warning_quality') AS warning, round(avg(score), 2) AS overall,
  CASE WHEN round(avg(score), 2) >= 4.7 THEN 'accept_candidate' WHEN round(avg(score), 2) >= 4.3 THEN 'keep_pending' WHEN round(avg(score), 2) >= 4.0 THEN 'needs_retry' ELSE 'reject' END AS action FROM s JOIN why USING (id) GROUP BY id, reasons"""


@query(over("items", _rules_sql()))
def draft_rules(c: Catalogue) -> DataFrame:
    """Every draft with the requirements it misses, its scores by dimension and what follows from their mean."""
    rows = c.spark.sql(_DRAFTS.replace("FROM items)", "FROM {items})"), items=c.items.select("id"))
    rows = rows.withColumns({f: F.split(f, r"\|") for f in ("best_for", "not_for", "vibe_tags")})
    out = rules.judged(rows, rules.table(c.spark, RULES), rules.table(c.spark, LEVELS, rules.LEVELS))
    return out.select("id", F.array_join("reasons", ",").alias("reasons"), F.col("scores")["reader_fit_specificity"].alias("fit"), F.col("scores")["dnf_warning_quality"].alias("warning"), "overall", "action")


# ---- cards ----

CARD_TITLE, CARD_AUTHOR, CARD_SOURCE = r'<a href="/[^"]*">([^<]*)</a>', r"<p>([^<]*)</p>", r"<footer>&copy; ([^ ]+) &middot; ([^<]*)</footer>"
CARD_HOLDS = ["la", "th", "ie"]


def _cards_sql() -> str:
    plain = lambda c: f"trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace({c}, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))"
    label = "regexp_extract(w, '" + CARD_SOURCE + "', 2)"
    return f"""WITH t AS (SELECT page_id, html, unnest(string_split_regex(html, '{CARD_TITLE}')) AS part, unnest(regexp_extract_all(html, '{CARD_TITLE}')) AS match, generate_subscripts(string_split_regex(html, '{CARD_TITLE}'), 1) AS no FROM pages WHERE html IS NOT NULL),
e AS (SELECT page_id, html, match, no, sum(length(part) + coalesce(length(match), 0)) OVER (PARTITION BY page_id ORDER BY no) AS stop FROM t),
w AS (SELECT page_id, no, {plain(f"regexp_extract(match, '{CARD_TITLE}', 1)")} AS title, substr(html, stop::BIGINT + 1, {cards.AUTHOR_WITHIN}) AS a, substr(html, stop::BIGINT + 1, {cards.SOURCE_WITHIN}) AS w FROM e WHERE match IS NOT NULL)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY no) AS no, title, CASE WHEN regexp_matches(a, '{CARD_AUTHOR}') THEN {plain(f"regexp_extract(a, '{CARD_AUTHOR}', 1)")} END AS author,
  CASE WHEN regexp_matches(lower({label}), 'la|th|ie') THEN regexp_extract(w, '{CARD_SOURCE}', 1) END AS source, CASE WHEN regexp_matches(lower({label}), 'la|th|ie') THEN {label} END AS label FROM w WHERE title <> ''"""


@query(_cards_sql())
def page_cards(c: Catalogue) -> DataFrame:
    """The links of each page's navigation as titles, with the first plain paragraph and the footer's host if they stand near enough behind."""
    return cards.cards(c.t("pages"), "page_id", "html", CARD_TITLE, CARD_AUTHOR, CARD_SOURCE, CARD_HOLDS)


# ---- candidates ----

#: What people hold and what is found, as SQL for both engines: titles and names spelled in other ways.
_WANT = (
    "SELECT person * 10000000000 + item AS cid, person, CASE (item + person) % 8 WHEN 0 THEN upper(title) WHEN 1 THEN replace(title, ' ', '  ') || '!' WHEN 2 THEN title || ' Again' WHEN 3 THEN substr(title, 5) WHEN 4 THEN '' WHEN 5 THEN title || ' (Novel)' ELSE title END AS title, "
    "CASE (item + person * 3) % 5 WHEN 0 THEN upper(author) WHEN 1 THEN 'X. ' || author WHEN 2 THEN replace(author, '.', '') WHEN 3 THEN 'Nobody Else' ELSE author END AS author FROM held WHERE (person + item) % 3 <> 0"
)
_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[''‘’“”\"`]', '', 'g'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


def _matched_sql() -> str:
    n = lambda c: _NORM.format(c=c)
    side = lambda t, i: f"SELECT {i} AS id, person, lower(trim(coalesce(title, ''))) AS lt, lower(trim(coalesce(author, ''))) AS la, {n('title')} AS t, {n('author')} AS a FROM {t}"
    toks = lambda c: f"list_distinct(list_filter(string_split({c}, ' '), lambda x: x <> ''))"
    return f""", held AS (SELECT person, item, title, author FROM shelves JOIN editions ON item = id), want AS ({_WANT}), w AS ({side('want', 'cid')}), h AS ({side('held', 'item')}),
p AS (SELECT w.id, h.id AS item, w.lt <> '' AND w.lt = h.lt AND w.la = h.la AS e, w.lt <> '' AND w.t = h.t AND w.a = h.a AS n, len(string_split(w.t, ' ')) > {similarity.GENERIC_WORDS} AS long, w.t = h.t AND string_split(w.a, ' ')[-1] <> '' AND string_split(w.a, ' ')[-1] = string_split(h.a, ' ')[-1] AS s,
  {toks('w.t')} AS x, {toks('h.t')} AS y, len(list_intersect({toks('w.a')}, {toks('h.a')})) > 0 AS by_, coalesce(string_split(w.a, ' ')[-1], '') AS wl FROM w JOIN h USING (person)),
q AS (SELECT *, CASE WHEN len(x) > 0 AND len(y) > 0 THEN len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) ELSE 0 END AS j FROM p),
v AS (SELECT id, item, 0 AS tier, 'exact_title_author' AS status, 1.0 AS score FROM q WHERE e UNION ALL SELECT id, item, 1, 'normalized_title_author', 0.97 FROM q WHERE n UNION ALL SELECT id, item, 2, 'title_author_surname', 0.9 FROM q WHERE long AND s UNION ALL SELECT id, item, 3, 'fuzzy', j FROM q WHERE long AND j >= {similarity.LIKE} AND by_),
b AS (SELECT id, tier, count(*) AS n, min(item) AS item, min(status) AS status, max(score) AS score FROM v GROUP BY id, tier QUALIFY tier = min(tier) OVER (PARTITION BY id))
SELECT w.id AS cid, CASE WHEN n = 1 THEN item END AS match, CASE WHEN n IS NULL THEN 'unmatched' WHEN n = 1 THEN status ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN score ELSE 0 END::DOUBLE AS score FROM w LEFT JOIN b ON b.id = w.id"""


@query(over("shelves editions", _matched_sql()))
def scoped_matches(c: Catalogue) -> DataFrame:
    """Which book of the same person's shelf a found title and name mean: four tiers, and refusal where several fit."""
    held = stored(c.shelves.join(c.edition_texts.select(F.col("id").alias("item"), "title", "author"), "item").select("person", "item", "title", "author"))
    want = c.spark.sql(_WANT.replace("FROM held", "FROM {held}"), held=held)
    return similarity.matched(want, held)
