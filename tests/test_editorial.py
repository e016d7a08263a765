"""Hygiene, rules, cards and set joins against loops and brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import hygiene as hy
from tessera.operators import cards, rules, similarity
from tessera.plans import editorial_plans as plans

SF = "/root/testdata/sf0.001"


def strip_once(s):
    """One pass, with Python's own expressions."""
    s = re.sub(hy.SCHOOLS, "", s, count=1)
    s = re.sub(hy.BANNER, "", s, count=1)
    s = re.sub(rf"{hy.BLURB}(?={hy.PROSE}\b)", "", s, count=1)
    s = re.sub(hy.ANNIVERSARY, "", s, count=1)
    if re.match(r"\s*\*", s):
        chunks = [c for c in re.split(r"\s*\*\s*", s)[1:] if c.strip()]
        if chunks and all(len(c) < 200 and not re.search(hy.RESTART, c) for c in chunks):
            s = ""
    s = re.sub(hy.STAR_BLOB, " ", s)
    s = re.sub(hy.PRAISE_TAIL, "", s, count=1)
    s = re.sub(hy.CONTINUE_TAIL, "", s, count=1)
    return re.sub(r"\s+", " ", re.sub(r"^[\s*]+", "", s)).strip()


def loop(s):
    passes = 0
    for _ in range(hy.PASSES):
        new = strip_once(s)
        if new == s:
            break
        s, passes = new, passes + 1
    return s, passes


def test_cleaning_reaches_a_fixpoint(spark):
    rng = random.Random(1)
    texts = ["".join((rng.choice(plans._BEGIN), rng.choice(plans._BEGIN), rng.choice(plans._BEGIN), rng.choice(plans._BODY) * rng.randrange(1, 4), rng.choice(plans._END))) for _ in range(300)] + ["", "   ", "***", "'One' 'Two' 'Three' When it ends.", "* a * b * " + "c" * 250]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    once = df.select("i", hy.cleaned(F.col("t")).alias("c")).orderBy("i").collect()
    for r, t in zip(once, texts, strict=True):
        assert (r.c.text, r.c.passes) == loop(t) and len(r.c.trace) == r.c.passes, t
    again = spark.createDataFrame([(r.i, r.c.text) for r in once if r.c.passes < hy.PASSES], "i int, t string").select("t", hy.cleaned(F.col("t")).alias("c")).collect()
    assert all(r.c.text == r.t and r.c.passes == 0 for r in again)
    assert spark.range(1).select(hy.cleaned(F.lit(None).cast("string"))["text"]).first()[0] == ""


def test_problem_tags(spark):
    cases = {
        None: ["empty_description"], " \n": ["empty_description"], "A plain text.": [], "No description available": ["placeholder_text"], "* one thing * two things": ["leading_asterisks", "asterisk_bullet_run"], "New York Times bestseller": [],
        "* New York Times #1 bestseller * more of it": ["leading_asterisks", "asterisk_bullet_run", "nyt_bestseller_noisy"], "Instant WSJ bestseller": ["award_marketing_wsj"], "a *** b": ["inline_asterisk_blob"], "The 5th Anniversary Edition": ["anniversary_edition_metadata"],
        "The edition includes maps": ["edition_includes_metadata"], "with an introduction by Ann": ["intro_metadata"], "Praise for Ann: good": ["trailing_praise_block"], "Continue The Trilogy now.": ["trailing_trilogy_continue"], "?a ?b": [], "?a ?b ?c": ["mojibake_question_marks"],
        "end.Next": ["missing_space_after_period"], "ThreeBody": [], "ThreeBody FourBody YouTube": ["mashed_words"], "ThreeBody YouTube iPhone": [], "Book 2. And": ["leading_catalog_book_n"], "Second edition, and": ["leading_second_edition"], "  River is wide": ["leading_title_repetition"], "Riverside is wide": [],
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", hy.problems(F.col("t"), F.lit("River")).alias("p"))
    assert {r.t: r.p for r in df.collect()} == cases


def test_what_may_replace(spark):
    long, mid = "Prose begins here. " * 12, "Prose begins here. " * 6
    cases = [(long, long, [], "skip", ""), ("** " + long, long.strip(), ["leading_asterisks"], "would_clean", "high"), ("** " + mid, mid.strip(), ["leading_asterisks"], "would_clean", "medium"), ("** x", "x", ["leading_asterisks"], "needs_manual_review", "low"), (long + "ThreeBody", long, ["mashed_words"], "needs_manual_review", "low"), ("** low " + long, "low " + long, ["leading_asterisks"], "needs_manual_review", "low"), ("", "", ["empty_description"], "needs_manual_review", "low"), (long, long, ["intro_metadata"], "needs_manual_review", "low")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, c string, p array<string>, a string, b string")
    for r in df.withColumn("e", hy.evaluated(F.col("t"), F.col("c"), F.col("p"))).collect():
        assert (r.e.action, r.e.confidence) == (r.a, r.b), r


def test_adding_a_rule_is_adding_a_row(spark):
    df = spark.createDataFrame([(1, "one two three", ["a", "b"]), (2, None, None)], "id int, text string, parts array<string>")
    base = [("long enough", "require", None, "words", "text", None, 3.0, None, None), ("two parts", "require", None, "items", "parts", None, 2.0, 2.0, None), ("says one", "signal", "d", "phrases", "text", "one|uno", 1.0, None, None)]
    levels = rules.table(spark, [("d", 0, 4.0), ("d", 1, 5.0)], rules.LEVELS)
    run = lambda rows: {r.id: (r.reasons, r.overall, r.action) for r in rules.judged(df, rules.table(spark, rows), levels).collect()}
    assert run(base) == {1: ([], 5.0, "accept_candidate"), 2: (["long enough", "two parts"], 4.0, "needs_retry")}
    more = [*base, ("no b", "require", None, "items_like", "parts", "^b$", None, 0.0, None), ("three", "penalty", "d", "matches", "text", "three", 1.0, None, 4.5)]
    assert run(more) == {1: (["no b"], 1.0, "reject"), 2: (["long enough", "two parts"], 4.0, "needs_retry")}
    with pytest.raises(ValueError, match="no kind"):
        run([("x", "require", None, "colour", "text", None, None, None, None)])


def walk(html, title, author, source, holds):
    """Cards by a sequential walk with windows cut from the page."""
    plain = lambda x: re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", x).replace("&amp;", "&")).strip()
    out = []
    for m in re.finditer(title, html):
        if not plain(m.group(1)):
            continue
        a = re.search(author, html[m.end() : m.end() + cards.AUTHOR_WITHIN])
        s = next((s for s in re.finditer(source, html[m.end() : m.end() + cards.SOURCE_WITHIN]) if any(h in s.group(2).lower() for h in holds)), None)
        out.append((len(out) + 1, plain(m.group(1)), plain(a.group(1)) if a else None, s and s.group(1), s and s.group(2)))
    return out


def test_cards_equal_a_walk(spark):
    rng = random.Random(2)
    T, A, S = r"<h3>(.*?)</h3>", r"by <i>(.*?)</i>", r'<a href="(https?://[^"]+)">(\([^)]+\))</a>'
    piece = lambda: rng.choice(["<h3>Deep &amp; <b>Wide</b></h3>", "<h3> </h3>", "<h3>Ünïcode 日本</h3>", "by <i>Ann</i>", 'x<a href="https://a.test/1">(Source)</a>', '<a href="https://b.test">(Buy)</a>', "." * rng.choice([3, 200, 390, 400, 1200, 2490])])
    pages = [(i, "".join(piece() for _ in range(rng.randrange(25)))) for i in range(60)] + [(100, None), (101, ""), (102, "<h3>Alone</h3>")]
    pages += [(200 + n, "<h3>T</h3>" + "." * (cards.AUTHOR_WITHIN - 13 + n) + "by <i>Ann</i>") for n in (-1, 0, 1)]
    df = spark.createDataFrame(pages, "page_id int, html string").withColumns({c: F.lit(1) for c in ("at", "no", "title")})
    got = {}
    for r in cards.cards(df.select("page_id", "html"), "page_id", "html", T, A, S, ["source"]).orderBy("page_id", "no").collect():
        got.setdefault(r.page_id, []).append((r.no, r.title, r.author, r.source, r.label))
    want = {i: w for i, h in pages if h and (w := walk(h, T, A, S, ["source"]))}
    assert got == want and [got[200 + n][0][2] for n in (-1, 0, 1)] == ["Ann", "Ann", None]


def test_cards_of_the_given_pages(spark):
    rows = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html").collect()
    got = {}
    for r in plans.cards.cards(spark.read.parquet(f"{SF}/pages.parquet"), "page_id", "html", plans.CARD_TITLE, plans.CARD_AUTHOR, plans.CARD_SOURCE, plans.CARD_HOLDS).orderBy("page_id", "no").collect():
        got.setdefault(r.page_id, []).append((r.no, r.title, r.author, r.source, r.label))
    want = {r.page_id: w for r in rows if (w := walk(r.html, plans.CARD_TITLE, plans.CARD_AUTHOR, plans.CARD_SOURCE, plans.CARD_HOLDS))}
    assert {k: [(n, *(x and x.replace("&amp;", "&") for x in rest)) for n, *rest in v] for k, v in got.items()} == {k: [(n, *(x and x.replace("&amp;", "&") for x in rest)) for n, *rest in v] for k, v in want.items()}


def sets(rng, n, first):
    return [(first + i, rng.sample([f"w{k}" for k in range(40)], rng.randrange(1, 9)) + ["common"] * rng.randrange(2), rng.randrange(3)) for i in range(n)]


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.82, 0.85, 1.0])
def test_set_join_by_brute_force(spark, threshold):
    rng = random.Random(int(threshold * 100))
    a, b = sets(rng, 120, 0), sets(rng, 150, 1000) + [(5000, [], 0)]
    b += [(2000 + i, t, s) for i, t, s in a[:40]] + [(3000 + i, t[1:] or ["x"], s) for i, t, s in a[:40]]
    schema = "id bigint, tokens array<string>, scope int"
    left, right = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
    got = {(r.lid, r.rid): round(r.score, 9) for r in similarity.set_join(left, right, threshold, ["scope"]).collect()}
    want = {(i, j): round(len(set(x) & set(y)) / len(set(x) | set(y)), 9) for i, x, s in a for j, y, t in b if s == t and y and len(set(x) & set(y)) >= threshold * len(set(x) | set(y)) - 1e-12}
    assert got == want


def test_set_join_brings_few_candidates(spark):
    """A word that every set has makes all pairs if tokens are joined as they are; the prefix leaves it out."""
    a = [(i, ["common", f"a{i}", f"b{i}", f"c{i}"]) for i in range(200)]
    df = spark.createDataFrame(a, "id bigint, tokens array<string>")
    assert similarity.candidates(df, df, 0.85).count() == 200
    by_any = df.select("id", F.explode("tokens").alias("w"))
    assert by_any.join(by_any.select(F.col("id").alias("o"), "w"), "w").select("id", "o").distinct().count() == 40_000


def test_ladder_refuses_ties(spark):
    held = [(1, 10, "The Deep Green River Bends", "Ann Lee"), (1, 11, "the deep green river bends", "ANN LEE"), (1, 12, "A Long Way Down the Hill", "Bo Chan"), (2, 12, "A Long Way Down the Hill", "Bo Chan"), (1, 13, "Sand", "Cy Dee"), (1, 14, "Six Old Maps of the Lost North Sea", "Ann Lee")]
    want = [(1, 1, "The Deep Green River Bends", "Ann Lee"), (2, 1, "A long way down the hill!", "Bo Chan"), (3, 1, "A Long Way Down the Hill", "B. Chan"), (4, 1, "Sand", "X Dee"), (5, 1, "", "Ann Lee"), (6, 1, "Six Old Maps of Lost North Sea", "Ann Q. Lee"), (7, 1, "Six Old Maps of Lost North Sea", "Nobody"), (8, 3, "Sand", "Cy Dee"), (9, 2, "A Long Way Down the Hill", "Bo Chan")]
    got = {r.cid: (r.match, r.status) for r in similarity.matched(spark.createDataFrame(want, "cid bigint, person bigint, title string, author string"), spark.createDataFrame(held, "person bigint, item bigint, title string, author string")).collect()}
    assert got == {1: (None, "ambiguous"), 2: (12, "normalized_title_author"), 3: (12, "title_author_surname"), 4: (None, "unmatched"), 5: (None, "unmatched"), 6: (14, "fuzzy"), 7: (None, "unmatched"), 8: (None, "unmatched"), 9: (12, "exact_title_author")}
