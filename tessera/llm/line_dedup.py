"""Line deduplication by a segment-partition edit join, in DataFrame functions only.

Lines within EDITS = k edits of each other, directly or through others, are one class; of a class only the first line (by
document, then place) stays. Distinct lines are cut into k + 1 segments. Of two lines within k edits one segment of the
shorter is in the longer unchanged, moved by no more than the edits before and after it allow, so each line is listed
under its segments and probes the places where a segment of a line up to k shorter may stand. Lists up to LIST rows give
their pairs. A longer list is linked to its first line; if some of its lines are too far from that one, all are cut into
twice as many segments, of which all but k must be equal together, where what was equal before still is, and so on down to
segments of SHORT characters. Pairs are verified by Spark's banded edit distance.
"""

from __future__ import annotations

import json
from itertools import combinations, product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import components, drop, sent, table, written

EDITS = 2
#: Shorter lines (in characters) are only compared for equality.
LEAST = 20
#: Rows of a list up to which its pairs are compared (by parities of letters first); also those of a longer one once its segments
#: have SHORT characters or fewer.
LIST = 128
SHORT = 4


def _class(n: Column) -> Column:
    """Lengths that are cut at the same places: the length rounded down, more coarsely for longer lines."""
    step = F.when(n < 64, 4).when(n < 256, 16).otherwise(32)
    return (n - F.pmod(n, step)).cast("int")


def _segments(lines: DataFrame, edits: int) -> DataFrame:
    """id, n, key, base: every line under its segments and at the places where a segment of a shorter line may stand.

    Cuts are the same for lines of one length class, so that one row serves several lengths; the first segment is taken from the
    line's begin, the last from its end. base: a segment at its own place; a pair needs one such row."""
    n, b, parts = F.col("n"), F.col("class"), edits + 1
    rows = lines.select("id", "line", F.char_length("line").alias("n"))
    rows = rows.withColumn("class", F.explode(F.array_distinct(F.array(*[_class(n - d) for d in range(parts)]))))
    cut = lambda i: F.floor(b * i / parts).cast("int")
    own = _class(n) == b
    places = []
    for i in range(parts):
        start, size = cut(i), cut(i + 1) - cut(i)
        if i == edits:
            places.append((i, own, F.substr("line", n - size + 1, size)))
            continue
        for t in range(-min(i, edits - i), i + 1):
            places.append((i, own if t == 0 else F.lit(False), F.substr("line", start + t + 1, size)))
    keys = [F.struct(F.xxhash64("class", F.lit(i), text).alias("key"), base.alias("base")) for i, base, text in places]
    return rows.select("id", "n", F.explode(F.array(*keys)).alias("x")).select("id", "n", "x.key", "x.base")


def _layouts(edits: int, parts: int) -> list[tuple[int, int, tuple]]:
    """How a line that is `more` characters longer may hold all but `edits` of `parts` segments: (which are left out, more,
    for each stretch of segments between: first, end, shift).

    Edits that are fewer than the segments left out leave room for a neighbour, so neighbours left out together move what
    follows by no more than they are many."""
    found = set()
    for k, out in enumerate(combinations(range(parts), edits)):
        edge = [-1, *out, parts]
        for more in range(edits + 1):
            for moved in product(range(-edits, edits + 1), repeat=edits - 1):
                stretches = tuple((i + 1, j, s) for i, j, s in zip(edge[:-1], edge[1:], [0, *moved, more], strict=True))
                # the first and the last one count even if they are empty: a line's ends are where they are
                fixed = [(n, s) for n, (i, j, s) in enumerate(stretches) if j > i or n in (0, edits)]
                if all(abs(s - t) <= m - n for (n, s), (m, t) in zip(fixed, fixed[1:])) and sum(abs(s - t) for (_, s), (_, t) in zip(fixed, fixed[1:])) <= edits:
                    found.add((k, more, tuple((i, j, s if j > i else 0) for i, j, s in stretches)))
    return sorted(found)


def _finer(edits: int, parts: int) -> list[tuple]:
    """(layout of half as many segments, layout, more, *stretches): which layouts of `parts` segments refine which. The layouts of
    the coarsest cut refine the layout 0. A layout's number is its place in _layouts."""
    layouts = _layouts(edits, parts)
    if parts == 2 * (edits + 1):
        return [(0, n, more, *(x for s in stretches for x in s)) for n, (_, more, stretches) in enumerate(layouts)]
    outs, of = list(combinations(range(parts), edits)), {}
    for n, (k, more, stretches) in enumerate(layouts):
        of.setdefault((outs[k], more), []).append((n, stretches))
    coarse, found = list(combinations(range(parts // 2), edits)), []
    for parent, (k, more, wide) in enumerate(_layouts(edits, parts // 2)):
        for out in combinations([y for x in coarse[k] for y in (2 * x, 2 * x + 1)], edits):
            for n, stretches in of[out, more]:
                # a stretch of the coarse cut lies in one of the finer, and must stand where that one stands
                if all(s == next(t for x, y, t in stretches if x <= 2 * i and 2 * j <= y) for i, j, s in wide if j > i):
                    found.append((parent, n, more, *(x for s in stretches for x in s)))
    return found


def _stretches(lines: DataFrame, open_: DataFrame, edits: int, parts: int) -> DataFrame:
    """id, n, key, base, as above, for all but `edits` of `parts` segments together, of lines on lists that are too long.
    open_: id, layout (of half as many segments) of those lists. Adds layout."""
    names = ["layout", "finer", "more", *[f"{c}{i}" for i in range(edits + 1) for c in "ijs"]]
    finer = F.lit(json.dumps([dict(zip(names, x, strict=True)) for x in _finer(edits, parts)]))
    table_ = lines.sparkSession.range(1).select(F.inline(F.from_json(finer, f"array<struct<{', '.join(f'{c}:int' for c in names)}>>")))  # of a size that `parts` fixes
    own = lines.select("id", "line", F.char_length("line").alias("n"))
    rows = open_.join(own, "id").join(F.broadcast(table_), "layout").drop("layout").withColumnRenamed("finer", "layout")
    size = F.col("n") - F.col("more")
    cut = lambda i: F.floor(size * F.col(i) / parts).cast("int")
    texts = [F.substr("line", cut(f"i{i}") + F.col(f"s{i}") + 1, cut(f"j{i}") - cut(f"i{i}")) for i in range(edits + 1)]
    still = F.col("more") == 0
    for i in range(edits + 1):
        still = still & (F.col(f"s{i}") == 0)
    where = [F.col(f"{c}{i}") for i in range(edits + 1) for c in "ij"]
    return rows.select("id", "n", F.xxhash64(F.lit(parts), size, *where, *texts).alias("key"), still.alias("base"), "layout").distinct()


def _parities(lines: DataFrame) -> DataFrame:
    """id, sig: whether each letter and digit stands in the line an odd number of times. An edit changes two of them at most."""
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    odd = [F.shiftleft(((F.char_length("line") - F.char_length(F.replace("line", F.lit(c)))) % 2).cast("bigint"), i) for i, c in enumerate(letters)]
    return lines.select("id", sum(odd[1:], odd[0]).alias("sig"))


def _of(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """The lines with one of the ids, before any of the others is shuffled."""
    return lines.select("id", "line").join(sent(written(ids.distinct())), "id", "left_semi")


def _close(lines: DataFrame, pairs: DataFrame, edits: int) -> DataFrame:
    """The pairs (a, b) that are within `edits`."""
    texts = _of(lines, pairs.select(F.col("a").alias("id")).union(pairs.select("b")))
    both = pairs.join(texts.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
    return both.where(F.levenshtein("x", "y", edits) >= 0).select("a", "b")


def edit_links(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """(a, b): links between lines (id, line; distinct, LEAST characters or more) within `edits`, not all, but enough that two
    such lines are connected. `edits` is 1 or more."""
    parts, links = edits + 1, None
    rows = _segments(lines, edits).withColumn("layout", F.lit(0))
    while True:
        rows = written(rows, "lz4")
        lists = rows.groupBy("key").agg(F.count("*").alias("len"), F.count_if("base").alias("bases"), F.min_by("id", F.when(F.col("base"), F.col("id"))).alias("head"), F.min("n").alias("least")).where("len > 1 and bases > 0")
        lists = written(lists.select("key", "len", "head", ((F.col("len") <= LIST) | (F.col("least") <= SHORT * parts)).alias("ready")))
        cut = written(rows.join(sent(lists), "key"))
        drop(rows)
        short = cut.where("ready").select("key", "id", "n", "base")
        parities = written(_parities(_of(lines, short.select("id"))))
        short = short.join(sent(parities), "id")
        long_ = cut.where("not ready").select("key", "len", "id", "layout", F.greatest("id", "head").alias("a"), F.least("id", "head").alias("b"))
        left, right = (short.select("key", F.col("id").alias(c), *[F.col(x).alias(f"{x}{c}") for x in ("n", "base", "sig")]) for c in "ab")
        near = f"a > b and (basea or baseb) and abs(na - nb) <= {edits} and bit_count(siga ^ sigb) <= {2 * edits}"
        pairs = left.join(right, "key").where(near).select("a", "b")
        pairs = written(pairs.union(long_.where("a != b").select("a", "b")).distinct())
        found = written(_close(lines, pairs, edits))
        drop(pairs, parities)
        links = found if links is None else links.union(found)
        # a long list whose lines are all linked to its first one has nothing more to tell
        linked = long_.join(sent(found.select("a", "b", F.lit(True).alias("linked"))), ["a", "b"], "left").where("linked or a = b")
        settled = linked.groupBy("key").agg(F.count("*").alias("n__"), F.first("len").alias("len")).where("n__ = len").select("key")
        open_ = written(long_.join(settled, "key", "left_anti").select("id", "layout").distinct())
        drop(cut)
        if not open_.limit(1).count():
            return links
        parts *= 2
        rows = _stretches(_of(lines, open_.select("id")), open_, edits, parts)


def _lines(docs: DataFrame) -> DataFrame:
    """d, h, at (from 0), line: every line with a character that is not white space."""
    return docs.select("d", "h", F.posexplode(F.split("text", "\n")).alias("at", "line")).where(r"line rlike '[^ \\t\\r\\x0B\\f]'")


def repeated_lines(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """d, h, gone (array of places of lines that go). docs: d and h (which name a row), text."""
    lines = _lines(docs)
    distinct = lines.groupBy("line").agg(F.min(F.struct("d", "h", "at")).alias("first"), F.count("*").alias("copies"))
    distinct = written(distinct.withColumn("id", F.monotonically_increasing_id()))
    comps = components(edit_links(distinct.where(F.char_length("line") >= LEAST).select("id", "line"), edits))
    linked = comps.select(F.col("a").alias("id"), F.col("b").alias("class")).union(comps.select("b", "b").distinct())
    # lines without copies or links stay and need no look-up
    some = distinct.join(linked, "id", "left").where("copies > 1 or class is not null").select(F.coalesce("class", "id").alias("class"), "first", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    some = written(some)
    drop(distinct)
    firsts = some.groupBy("class").agg(F.min("first").alias("stays"))
    keys = written(some.join(firsts, "class").select("h1", "h2", "stays"))
    places = lines.select("d", "h", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))
    return places.join(keys, ["h1", "h2"]).where("struct(d, h, at) != stays").groupBy("d", "h").agg(F.collect_set("at").alias("gone"))


def deduplicated(docs: DataFrame, edits: int = EDITS) -> DataFrame:
    """doc_id, text (without the lines that go), n_lines (not blank), n_removed of every row.

    Blank lines stay; null texts stay null, with 0 lines. Rows of one doc_id with different texts are documents of their own, the
    one with the smaller hash of its text first; rows equal in doc_id and text are one document and keep the same lines. Rows
    without a doc_id come first. Other columns are ignored."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("d"), F.xxhash64("text").alias("h"), "text")
    gone = repeated_lines(docs.where("text is not null"), edits)
    out = docs.select("doc_id", "d", "h", F.split("text", "\n").alias("parts")).join(gone, ["d", "h"], "left")
    # places that stay, by a set difference: linear in a document's lines
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("parts") - 1), "gone"), lambda i: F.get("parts", i))
    text = F.when(F.col("gone").isNull(), F.array_join("parts", "\n")).otherwise(F.array_join(kept, "\n"))
    n = F.size(F.filter("parts", lambda x: x.rlike(r"[^ \t\r\x0B\f]")))
    return out.select("doc_id", text.alias("text"), F.when(F.col("parts").isNull(), 0).otherwise(n).alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias("n_removed"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_chars, kept_md5 for every document."""
    out = deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_lines").cast("bigint").alias("n_lines"), F.col("n_removed").cast("bigint").alias("n_removed"), F.coalesce(F.char_length("text"), F.lit(0)).cast("bigint").alias("kept_chars"), F.md5(F.coalesce("text", F.lit(""))).alias("kept_md5"))


#: Candidates: a third of the shorter line stands in the longer, moved as the edits on both sides of it allow.
ORACLE_SQL = f"""
WITH RECURSIVE lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents WHERE text IS NOT NULL),
solid AS (SELECT * FROM lines WHERE regexp_matches(line, '[^ \\t\\r\\x0B\\f]')),
uniq AS (SELECT line, length(line) AS n, row_number() OVER (ORDER BY line) AS id FROM (SELECT DISTINCT line FROM solid)),
longs AS (SELECT * FROM uniq WHERE n >= {LEAST}),
moves AS (SELECT i, more, t FROM (SELECT unnest(range({EDITS + 1})) AS i), (SELECT unnest(range({EDITS + 1})) AS more), (SELECT unnest(range(-{EDITS}, {EDITS + 1})) AS t) WHERE abs(t) <= i AND abs(t - more) <= {EDITS} - i),
listed AS (SELECT id, n, i, substring(line, n * i // {EDITS + 1} + 1, n * (i + 1) // {EDITS + 1} - n * i // {EDITS + 1}) AS seg FROM longs, (SELECT unnest(range({EDITS + 1})) AS i)),
probes AS (SELECT id, n - more AS n, i, substring(line, (n - more) * i // {EDITS + 1} + t + 1, (n - more) * (i + 1) // {EDITS + 1} - (n - more) * i // {EDITS + 1}) AS seg FROM longs, moves),
cand AS (SELECT DISTINCT x.id AS a, y.id AS b FROM listed x JOIN probes y USING (n, i, seg) WHERE x.id <> y.id),
near AS (SELECT a, b FROM cand JOIN longs x ON a = x.id JOIN longs y ON b = y.id WHERE levenshtein(x.line, y.line) <= {EDITS}),
link AS (SELECT a, b FROM near UNION SELECT b, a FROM near),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
class AS (SELECT u.line, coalesce(least(u.id, min(r.b)), u.id) AS class FROM uniq u LEFT JOIN reach r ON u.id = r.a GROUP BY u.line, u.id),
ranked AS (SELECT s.doc_id, s.pos, row_number() OVER (PARTITION BY class ORDER BY s.doc_id, s.pos) AS k FROM solid s JOIN class USING (line)),
gone AS (SELECT doc_id, pos FROM ranked WHERE k > 1),
per AS (
  SELECT l.doc_id, count(*) FILTER (WHERE regexp_matches(line, '[^ \\t\\r\\x0B\\f]')) AS n_lines, count(g.pos) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL), '') AS kept
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(length(kept), 0) AS kept_chars, md5(coalesce(kept, '')) AS kept_md5
FROM documents d LEFT JOIN per USING (doc_id)
"""
