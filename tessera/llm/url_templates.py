"""URL filters: a tree of path templates per host, in DataFrame functions only.

Per host, path segments that look generated become wildcards at once; then, level by level from the root down to the
longest path, sibling branches merge into wildcards. Branches with FLOOR labelled pages or more are compared with each
other: they stand in BINS classes of their share of bad pages, and two neighbouring classes are one unless their shares
differ by more than chance; each such group of several branches is one wildcard, a branch alone in its group stays literal.
Branches with fewer labels say nothing of their own and make one wildcard apart. A template is rejected if its smoothed
share of bad labelled pages is too high. Rules by host and path prefix come before templates; the longest that fits wins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import sent, table, written

#: (host and path prefix, verdict)
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Levels of the tree in the SQL, which has to spell them out (the operator goes as deep as the paths).
LEVELS = 8
#: Labelled pages from which a branch is compared, classes of bad shares, and standard errors that two classes may differ and still merge.
FLOOR, BINS, ALIKE = 5, 10, 2.0
#: Weight (in pages) of the host's share of bad pages, and of the whole table's in the host's, in a smoothed share; and from which share a template is rejected.
PRIOR, IMPURE = 8.0, 0.5
#: Segments that look generated: two digits in a row, eight hex digits, an escape, or 40 characters.
GENERATED = r"[0-9]{2}|[0-9a-fA-F]{8}|%[0-9a-fA-F]{2}|^.{40}"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fitting(rules: tuple, host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits host (or a domain above it) and path, and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, _, prefix = text.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith("/" + prefix)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def segments(path: Column) -> Column:
    """The path's non-empty segments, generated ones as wildcards (with their extension)."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike(GENERATED), F.concat(F.lit("*"), F.regexp_extract(s, r"(\.[A-Za-z]{1,5})$", 1))).otherwise(s))


def _groups(child: DataFrame) -> DataFrame:
    """host, template, bin, name (of the wildcard of that class of branches; null if its group has one branch): BINS + 1 rows of a node at most."""
    share = child.where(_compared()).withColumn("bin", F.expr(f"({BINS} * bad) div seen"))
    share = share.groupBy("host", "template", "bin").agg(F.count("*").alias("kids"), F.sum("seen").cast("double").alias("n2"), F.sum("bad").cast("double").alias("b2"))
    node = Window.partitionBy("host", "template").orderBy("bin")
    share = share.withColumns({"n1": F.lag("n2").over(node), "b1": F.lag("b2").over(node)})
    differ = F.expr(f"(b1 * n2 - b2 * n1) * (b1 * n2 - b2 * n1) * (n1 + n2) > {ALIKE * ALIKE} * (b1 + b2) * (n1 + n2 - b1 - b2) * n1 * n2")
    share = share.withColumn("group", F.sum(F.coalesce(differ, F.lit(False)).cast("int")).over(node))
    members = F.sum("kids").over(Window.partitionBy("host", "template", "group"))
    name = F.when(members > 1, F.concat(F.lit("*"), F.when(F.col("group") > 0, F.col("group").cast("string")).otherwise("")))
    return share.select("host", "template", "bin", name.alias("name"))


def _compared() -> Column:
    return (F.col("seen") >= FLOOR) & ~F.col("seg").startswith("*")


def templates(pages: DataFrame) -> DataFrame:
    """host, parts, template, labelled, bad, impurity, verdict. pages: host, parts, label (1 bad, 0 good, null unknown).

    All steps run on counts for each distinct (host, parts), however many pages share them."""
    tree = pages.groupBy("host", "parts").agg(F.count("label").alias("seen"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad"))
    tree, done, d = written(tree.withColumn("template", F.lit(""))), [], 1
    while True:
        done.append(tree.where(F.size("parts") < d))
        tree = tree.where(F.size("parts") >= d)
        if not tree.limit(1).count():
            break
        tree = tree.withColumn("seg", F.get("parts", F.lit(d - 1)))
        child = written(tree.groupBy("host", "template", "seg").agg(F.count("*").alias("paths"), F.sum("seen").alias("seen"), F.sum("bad").alias("bad")))
        groups = written(_groups(child))
        node = child.groupBy("host", "template").agg(F.count("*").alias("kids"), F.sum("paths").alias("all"))
        node = written(node.join(groups.where("name is not null").select("host", "template", F.lit(True).alias("merged")).distinct(), ["host", "template"], "left"))
        keyed = child.withColumn("bin", F.when(_compared(), F.expr(f"({BINS} * bad) div seen")))
        keyed = keyed.join(sent(node), ["host", "template"]).join(sent(groups), ["host", "template", "bin"], "left")
        to = F.when(F.col("seg").startswith("*") | (F.col("kids") == 1), F.col("seg")).when(F.col("bin").isNotNull(), F.coalesce("name", "seg")).when(F.col("merged"), F.lit("*?")).otherwise("*")
        child = keyed.select("host", "template", "seg", to.alias("to"), (F.col("all") == 1).alias("alone"))
        # a path that is alone in its node has no siblings further down: its other segments stay as they are
        to = F.when(F.col("alone"), F.array_join(F.slice("parts", d, F.size("parts")), "/")).otherwise(F.col("to"))
        tree = tree.join(child, ["host", "template", "seg"]).withColumn("template", F.concat("template", F.lit("/"), to))
        tree = written(tree.drop("seg", "to"))
        done.append(tree.where("alone").drop("alone"))
        tree, d = tree.where("not alone").drop("alone"), d + 1
    tree = reduce(DataFrame.unionByName, done)
    whole = tree.agg(F.coalesce(F.try_divide(F.sum("bad"), F.sum("seen")), F.lit(0.0))).first()[0]
    hosts = tree.groupBy("host").agg(F.sum("bad").alias("host_bad"), F.sum("seen").alias("host_seen"))
    share = tree.groupBy("host", "template").agg(F.sum("seen").alias("labelled"), F.sum("bad").alias("bad_pages")).join(hosts, "host")
    prior = (F.col("host_bad") + PRIOR * F.lit(whole)) / (F.col("host_seen") + PRIOR)
    impurity = (F.col("bad_pages") + PRIOR * prior) / (F.col("labelled") + PRIOR)
    share = share.select("host", "template", "labelled", F.col("bad_pages").alias("bad"), impurity.alias("impurity"))
    return tree.select("host", "parts", "template").join(share, ["host", "template"]).withColumn("verdict", F.when(F.col("impurity") >= IMPURE, F.lit("block")).otherwise(F.lit("allow")))


def judged(pages: DataFrame, labels: DataFrame | None = None, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, impurity of every page (page_id, url).

    labels: page_id, label (1 bad, 0 good; of several for one page the larger counts, null ones and those of a null page do not).
    Pages without :// or with a null url have empty host, path and template. Rows that repeat a page_id are each judged, and each
    carries the page's label into the counts once."""
    host, path = host_path(F.col("url"))
    rows = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("parts", segments(F.col("path")))
    known = rows.join(labels.where("label is not null").groupBy("page_id").agg(F.max("label").alias("label")), "page_id", "left") if labels is not None else rows.withColumn("label", F.lit(None).cast("int"))
    rule, says = fitting(rules, F.col("host"), F.col("path"))
    out = rows.join(templates(written(known.select("host", "parts", "label"))), ["host", "parts"])
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(says, F.col("verdict")).alias("verdict"), "template", F.round("impurity", 9).alias("impurity"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document whose id ends its path: bad if toxic or of low quality."""
    pages, labels = table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")
    _, path = host_path(F.col("url"))
    doc = pages.select("page_id", F.expr("url")).select("page_id", F.regexp_extract(path, r"/([0-9]{1,18})[^/0-9]*/?$", 1).alias("id")).where("id != ''").select("page_id", F.col("id").cast("bigint").alias("doc_id"))
    bad = labels.groupBy("doc_id").agg(F.max(((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).cast("int")).alias("label"))
    return judged(pages, doc.join(bad, "doc_id").select("page_id", "label")).drop("impurity")


def _sql() -> str:
    host = f"translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}')"
    rule = verdict = "NULL"
    for text, says in sorted(RULES, key=lambda r: (len(r[0]), r[0])):
        domain, _, prefix = text.partition("/")
        fits = f"((host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '/{prefix}'))"
        rule, verdict = f"CASE WHEN {fits} THEN '{text}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{says}' ELSE {verdict} END"
    generated = GENERATED.replace("'", "''")
    steps = []
    differ = f"(b1 * n2 - b2 * n1) * (b1 * n2 - b2 * n1) * (n1 + n2) > {ALIKE * ALIKE} * (b1 + b2) * (n1 + n2 - b1 - b2) * n1 * n2"
    for d in range(1, LEVELS + 1):
        steps.append(f"""
s{d} AS (SELECT *, CASE WHEN len(parts) >= {d} THEN parts[{d}] END AS seg FROM t{d - 1}),
c{d} AS (SELECT host, template, seg, sum(seen)::BIGINT seen, sum(bad)::BIGINT bad FROM s{d} WHERE seg IS NOT NULL GROUP BY ALL),
b{d} AS (SELECT *, CASE WHEN seen >= {FLOOR} AND NOT starts_with(seg, '*') THEN ({BINS} * bad) // seen END AS bin FROM c{d}),
j{d} AS (SELECT host, template, bin, count(*) kids, sum(seen)::DOUBLE n2, sum(bad)::DOUBLE b2 FROM b{d} WHERE bin IS NOT NULL GROUP BY ALL),
l{d} AS (SELECT *, lag(n2) OVER w n1, lag(b2) OVER w b1 FROM j{d} WINDOW w AS (PARTITION BY host, template ORDER BY bin)),
g{d} AS (SELECT *, sum(CASE WHEN {differ} THEN 1 ELSE 0 END) OVER (PARTITION BY host, template ORDER BY bin) AS grp FROM l{d}),
m{d} AS (SELECT host, template, bin, CASE WHEN sum(kids) OVER (PARTITION BY host, template, grp) > 1 THEN '*' || CASE WHEN grp > 0 THEN grp::BIGINT::VARCHAR ELSE '' END END AS name FROM g{d}),
n{d} AS (SELECT host, template, count(*) AS kids FROM c{d} GROUP BY ALL),
x{d} AS (SELECT DISTINCT host, template, true AS merged FROM m{d} WHERE name IS NOT NULL),
k{d} AS (SELECT b.host, b.template, seg, CASE WHEN starts_with(seg, '*') OR kids = 1 THEN seg WHEN b.bin IS NOT NULL THEN coalesce(name, seg) WHEN merged THEN '*?' ELSE '*' END AS to_
   FROM b{d} b JOIN n{d} n ON b.host = n.host AND b.template = n.template LEFT JOIN m{d} m ON b.host = m.host AND b.template = m.template AND b.bin = m.bin LEFT JOIN x{d} x ON b.host = x.host AND b.template = x.template),
t{d} AS (SELECT s.host, s.parts, s.seen, s.bad, CASE WHEN k.to_ IS NOT NULL THEN s.template || '/' || k.to_ ELSE s.template END AS template
   FROM s{d} s LEFT JOIN k{d} k ON s.host = k.host AND s.template = k.template AND s.seg = k.seg)""")
    return f"""
WITH r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substring(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, coalesce({host}, '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r),
q AS (SELECT *, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: CASE WHEN regexp_matches(s, '{generated}') THEN '*' || regexp_extract(s, '(\\.[A-Za-z]{{1,5}})$', 1) ELSE s END) AS p0,
  try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})[^/0-9]*/?$', 1), '') AS BIGINT) AS doc_id FROM h),
g AS (SELECT doc_id, max(CASE WHEN coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0 THEN 1 ELSE 0 END) AS label FROM labels GROUP BY doc_id),
p AS (SELECT page_id, host, path, p0 AS parts, label FROM q LEFT JOIN g ON q.doc_id = g.doc_id),
t0 AS (SELECT host, parts, count(label) seen, coalesce(sum(label), 0) bad, '' AS template FROM p GROUP BY host, parts),{",".join(steps)},
w AS (SELECT coalesce(sum(bad)::DOUBLE / nullif(sum(seen), 0), 0) AS whole FROM t{LEVELS}),
o AS (SELECT host, sum(bad)::DOUBLE hb, sum(seen)::DOUBLE hs FROM t{LEVELS} GROUP BY host),
e AS (SELECT host, template, sum(seen)::DOUBLE labelled, sum(bad)::DOUBLE b FROM t{LEVELS} GROUP BY ALL),
i AS (SELECT e.host, e.template, (b + {PRIOR} * ((hb + {PRIOR} * whole) / (hs + {PRIOR}))) / (labelled + {PRIOR}) AS impurity FROM e JOIN o USING (host), w),
v AS (SELECT t.host, t.parts, t.template, i.impurity, CASE WHEN impurity >= {IMPURE} THEN 'block' ELSE 'allow' END AS says FROM t{LEVELS} t JOIN i ON t.host = i.host AND t.template = i.template)
SELECT page_id, p.host, path, {rule.replace("host", "p.host")} AS rule, coalesce({verdict.replace("host", "p.host")}, says) AS verdict, template
FROM p JOIN v ON p.host = v.host AND p.parts = v.parts"""


ORACLE_SQL = _sql()
