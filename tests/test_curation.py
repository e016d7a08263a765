"""Literal cases of the curation rules and jobs."""

import math

from pyspark.sql import functions as F

from tessera.functions import curation as cu
from tessera.operators import curation as op


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first().x


def test_categories(spark):
    c = F.col("c")
    for raw, want in [
        ("ManagementLeadership", ["Management", "Leadership"]), ("Science FictionFantasy", ["Science Fiction", "Fantasy"]), ("self help, Biz", ["Self-Help", "Business"]), ("Comics.Fiction", ["Comics", "Fiction"]),
        ("RomanceLGBTQAdult", ["Romance", "LGBTQ", "Adult"]), ("History, history•HISTORY", ["History"]), ("a, ,7", []), ("PersonalDevelopmentTrue Crime", ["Personal Development", "True Crime"]), ("", []),
    ]:
        assert one(spark, cu.categories(c), c=raw) == want, raw
    assert one(spark, cu.categories(c.cast("string")), c=None) is None
    assert [one(spark, cu.parent_of(c), c=x) for x in ("Science Fiction", "Business", "Adult", "Chess")] == ["Fiction", "Nonfiction", "Cross-cut", "Other"]


def test_candidate_scores(spark):
    def score(t, a, u, b, isbn=False):
        r = one(spark, cu.candidate_score(F.col("t"), F.col("a"), F.col("u"), F.col("b"), F.lit(isbn)), t=t, a=a, u=u, b=b)
        return r.score, r.method

    assert score("Deep Work", "Cal Newport", "x", "y", True) == (1.0, "isbn")
    assert score("Deep Work", "Cal Newport", "deep work!", "CAL NEWPORT") == (0.97, "full+author")
    assert score("Deep Work: Rules", "Cal Newport", "Deep Work", "Cal Newport") == (0.93, "core+author")
    assert score("Deep Work", "Cal Newport", "Deep Work", "C. Newport") == (0.9, "full+last")
    assert score("Deep Work", "Cal Newport", "Deep Work (2016)", "C. Newport") == (0.87, "core+last")
    assert score("Deep Work", "Cal Newport", "Deep Work", "") == (0.65, "full")
    assert score("Deep Work", "Cal Newport", "Deep Work", "Someone Else") == (0.4, "core+mismatch")
    assert score("Deep Work", "Cal Newport", "More Deep Work", "A Newport") == (0.55, "part+last")
    assert score("Deep Work", "Cal Newport", "More Deep Work", "") == (0.3, "part")
    assert score("Deep Work", "Cal Newport", "Other", "Nobody") == (0.15, "fuzzy")


def test_descriptions(spark):
    c = F.col("c")
    states = {None: ("empty", "null"), "  ": ("empty", "blank"), '"Great." - The Times': ("junk", "quote_attribution,too_short"), '"' + "x" * 90 + '"': ("junk", "blurb_only"), "y" * 80: ("decent", ""), "A must-read " + "z" * 80: ("junk", "recommendation")}
    for text, want in states.items():
        got = one(spark, cu.description_state(c.cast("string")), c=text)
        assert (got.state, got.why) == want, text
    assert one(spark, cu.description_flags(c), c="* see www.x.test <b>") == "too_short,address,markup,asterisks" and one(spark, cu.description_flags(c), c="ok " * 50) == ""
    assert one(spark, cu.description_action(F.lit(0.9), F.lit(""), F.lit("junk"))) == "would_backfill" and one(spark, cu.description_action(F.lit(0.8), F.lit(""), F.lit("junk"))) == "manual_review"
    assert one(spark, cu.artifacts_replaced(c), c="a &amp; b , c.. d<br>e") == "a & b, c. d e"


def test_numbers_sources_names(spark):
    c = F.col("c")
    assert [one(spark, cu.display_rating(c), c=x) for x in (0.9, 1.0, 3.25, 4.95, 5.1)] == [None, 1.0, 3.3, 5.0, None]
    assert [one(spark, cu.display_confidence(c), c=x) for x in (0.0, 0.005, 1.0, 1.4, 80.5, 101.0)] == [None, "1%", "100%", "1%", "81%", None]
    own = lambda u, h: one(spark, cu.own_source(F.col("u").cast("string"), F.col("h").cast("string")), u=u, h=h)
    assert [own(None, "a"), own("https://x.com/b/status/1", "@A"), own("https://x.com/a/status/1", "@A"), own("https://x.com/b/status/1", None), own("https://x.com/b/status/1 | https://a.test", "A")] == [False, False, True, True, True]
    same = lambda p, o: one(spark, cu.same_person(F.col("p"), F.col("o")), p=p, o=o)
    assert same("Balaji Srinivasan", "Balaji S. Srinivasan") and same("J.K. Rowling", "JK Rowling") and not same("Smith", "John Smith") and not same("Balaji S. Srinivasan", "Balaji Srinivasan") and not same("", "")
    leak = lambda t, n: one(spark, cu.name_leak(F.col("t"), F.col("n")), t=t, n=n)
    assert leak("As Gates said", "Bill Gates") and not leak("the gateway", "Bill Gates") and not leak("a reading list", "Reading List (7 Books)")
    assert [one(spark, cu.licence_ok(c), c=x) for x in ("CC BY 4.0", "CC BY-NC 4.0", "CC0", "Public domain", "fair use", "unknown")] == [True, False, True, True, False, False]
    assert one(spark, cu.photo_credit(F.lit(" "), F.lit("CC0"))) == "Photo: unknown author (CC0)"
    assert one(spark, cu.thumbnail(c, 120), c="https://upload.wikimedia.org/wikipedia/commons/a/ab/Me.jpg") == "https://upload.wikimedia.org/wikipedia/commons/thumb/a/ab/Me.jpg/120px-Me.jpg"
    assert one(spark, cu.slug_with_and(c), c="Tom & Jerry's  Day") == "tom-and-jerrys-day"
    d = one(spark, cu.lens_distance(F.lit(1.0), F.lit(1.0), F.lit(math.pi / 2)))
    assert abs(d - 0.8079455) < 1e-5


def test_jobs(spark):
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    first, second = df([(1, 5, 1)], "k int, id int, place int"), df([(1, 5, 1), (1, 6, 2), (1, 7, 3), (2, 8, 1)], "k int, id int, place int")
    assert sorted(map(tuple, op.top_up(first, second, "k", "id", 2).collect())) == [(1, 5, 1, False), (1, 6, 2, True), (2, 8, 1, True)]
    plan = df([(1, 1), (1, 1), (1, 2), (9, 1)], "item int, person int")
    done = op.staged_insert(plan, df([(1,)], "item int"), df([(1, 1), (1, 3), (4, 4)], "item int, person int"), "item", "person")
    assert [tuple(r) for r in done["entities"].collect()] == [(9,)] and sorted(map(tuple, done["links"].collect())) == [(1, 2), (9, 1)]
    assert sorted(map(tuple, done["counts"].collect())) == [(1, 2, 1, 3), (9, 0, 1, 1)]
    again = op.staged_insert(plan, df([(1,), (9,)], "item int"), df([(1, 1), (1, 2), (9, 1)], "item int, person int"), "item", "person")
    assert not again["links"].count() and not again["entities"].count()  # running it twice adds nothing
    assert op.discover(df([], "name string, created_at string, id int")) == {"columns": "name,created_at,id", "order": "id"} and op.discover(df([], "a int, b_key int"))["order"] == "b_key"
    assert op.summary(df([("b", 2), ("a", 1), ("a", 5)], "k string, v int"), "k", {"n": F.count("*"), "top": F.max("v")}).first().summary == '{"a":{"n":2,"top":5},"b":{"n":1,"top":2}}'
