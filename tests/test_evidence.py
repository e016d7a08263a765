"""Evidence and editorial functions and operators on literal cases."""

from pyspark.sql import functions as F

from tessera.functions import editorial, evidence
from tessera.operators import evidence as ev


def values(spark, f, cases):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("c"))).collect()]


def test_display_safety(spark):
    q = "@a @b this book changed how I think about almost everything, -"
    rows = [
        ("https://e.org/x", q, 80.0, "Ann Lee", None, "proof"), ("https://e.org/x", q, 60.0, "Ann Lee", None, "link"), ("https://e.org/x", q[:40], 80.0, "Ann Lee", None, "link"), ("https://e.org/x | https://f.org/y", q, 80.0, "Ann Lee", None, "none"),
        ("https://amazon.com/dp/1", q, 80.0, "Ann Lee", None, "none"), ("https://x.com/other/status/1", q, 80.0, "Ann Lee", "@ann", "none"), ("https://x.com/ann/status/1", q, 80.0, "Ann Lee", "ann", "proof"), (None, q, 80.0, "Ann Lee", None, "none"), ("https://e.org/x", "a | " + q, 80.0, "Ann Lee", None, "link"), ("https://e.org/x", q, None, "Ann Lee", None, "link"),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, s string, q string, c double, n string, h string, want string")
    got = df.orderBy("i").select(evidence.display_safety(*map(F.col, "sqcnh")).alias("d"), "want").collect()
    assert [r.d["cue"] for r in got] == [r.want for r in got]
    assert got[0].d["text"] == "This book changed how I think about almost everything" and got[1].d["text"] is None


def test_quotes(spark):
    assert values(spark, evidence.clean_quote, ["RT @a: @b hello  there -", "Plain.", None, "@a"]) == ["Hello there", "Plain.", "", "@a"]
    both = spark.createDataFrame([("we read it ... and loved every page", "Yes, we read it last year and loved every page of it"), ("we read it ... and hated all of it", "we read it and loved it"), ("too short", "too short")], "q string, t string")
    assert [r[0] for r in both.select(evidence.quote_in(F.col("q"), F.col("t"))).collect()] == [True, False, False]
    named = spark.createDataFrame([("Dune Messiah", "Frank Herbert", "I read Dune Messiah."), ("The Long Dark Road", "A. Poe", "poe wrote of a long road, dark"), ("It", "S. King", "it is fine")], "a string, b string, t string")
    assert [r[0] for r in named.select(evidence.named_in(F.col("a"), F.col("b"), F.col("t"))).collect()] == [True, True, False]
    assert values(spark, evidence.is_hedged, ["I haven't read it", "great", None]) == [True, False, False]
    assert values(spark, lambda c: evidence.third_person(c, F.lit("Ann Marlowe")), ["She liked it", "Marlowe liked it", "I liked it"]) == [True, True, False]
    assert values(spark, evidence.segments, [" a | |b", None]) == [["a", "b"], []]
    assert values(spark, evidence.repair_mojibake, ["cafÃ©", "café", "plain", "Ã"]) == ["café", "café", "plain", "Ã"]


def test_editorial(spark):
    cases = ["a long item here | another long item | a long ITEM here", '["json item one", "json item two"]', "- bullet one long\n2) number two long\nCEO\nshort", "first part here; second part here", "one; two", "", None, "[broken json array"]
    assert values(spark, editorial.editorial_list, cases) == [["a long item here", "another long item"], ["json item one", "json item two"], ["bullet one long", "number two long", "CEO"], ["first part here", "second part here"], ["one; two"], [], [], ["[broken json array"]]
    assert values(spark, editorial.title_case, ["Good To Great", "bell hooks on Love", "The Way: Of The Ceo And On", "1984", None]) == ["Good to Great", "bell hooks on Love", "The Way: Of the CEO and On", "1984", ""]
    assert values(spark, editorial.display_title, ["a-b-books", "A - b", None]) == ["A B Books", "A - b", ""]
    assert values(spark, editorial.list_kind, ["best-x", "most-recommended-books", "x-books-in-order", "art", None]) == ["topic", "meta", "other", "category", "other"]
    assert values(spark, editorial.missing_cover, ["https://a.b/c.jpg", "c.jpg", "https://a.b/no-cover.png", None]) == [False, True, True, True]
    assert values(spark, editorial.mashed_tokens, ["ParentingFamily McDonald iPhone ok"]) == [["ParentingFamily"]]
    assert values(spark, editorial.weak_theme, ["courage", "this book is about courage", "trailing..."]) == [False, True, True]
    assert values(spark, editorial.difficulty, ["A dense academic study", "an easy read", "a book"]) == ["hard", "easy", "medium"]


def test_attribution(spark):
    urls = spark.createDataFrame([(["https://annlee.com", "https://x.org/ann-b-lee"], "ann-lee", "Ann Lee"), (["https://e.org/lee"], "ann-lee", "Ann Lee")], "u array<string>, s string, n string")
    assert [r[0] for r in urls.select(evidence.attributable(*map(F.col, "usn"))).collect()] == [["https://annlee.com", "https://x.org/ann-b-lee"], []]
    owners = spark.createDataFrame([("e.org", "one"), ("e.org/a/b", "two")], "prefix string, owner string")
    df = spark.createDataFrame([("e.org/a/b/c",), ("e.org/a/bc",), ("f.org",), (None,)], "a string")
    assert {r.a: r.owner for r in ev.longest_prefix(df, "a", owners).collect()} == {"e.org/a/b/c": "two", "e.org/a/bc": "one", "f.org": None, None: None}
    names = spark.createDataFrame([("Ann Lee", "ann"), ("Lee", "lee"), ("Bo Xi", "bo"), ("Bo-Xi", "other")], "name string, owner string")
    texts = spark.createDataFrame([(1, "/interview-ann-lee/"), (2, "/bo-xi"), (3, "/nobody"), (4, "/a-lee-b")], "id int, t string")
    assert {r.id: (r.owner, r.outcome) for r in ev.token_run(texts, "id", F.col("t"), names).collect()} == {1: ("ann", "owned"), 2: (None, "ambiguous"), 4: ("lee", "owned")}


def test_years_slugs_merges_and_covers(spark):
    y = spark.createDataFrame([("a", 1950), ("a", 1990), ("a", 1991), ("b", 2000), ("c", None)], "k string, y int")
    assert {r.k: r.year for r in ev.corroborated(y, "k", "y").collect()} == {"a": 1990, "b": None}
    s = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "x-2")], "id int, slug string")
    slugs = [r.unique_slug for r in ev.unique_slugs(s, "slug", [F.asc("id")]).orderBy("id").collect()]
    assert slugs == ["x", "x--2", "x-3", "x-2"] and len(set(slugs)) == 4
    links = spark.createDataFrame([(1, "p"), (2, "p"), (2, "q"), (3, "q"), (9, "p")], "item int, person string")
    merge = spark.createDataFrame([(2, 1), (3, 1)], "dup int, canon int")
    assert sorted((r.item, r.person, r.action) for r in ev.merge_links(links, merge, "item", "person").collect()) == [(1, "p", "dropped"), (1, "p", "kept"), (1, "q", "dropped"), (1, "q", "moved"), (9, "p", "kept")]
    c = spark.createDataFrame([(1, 1, "a", 1), (1, 1, "b", 2), (2, 2, "a", 1), (2, 2, "c", 2), (2, 2, "d", 3)], "list bigint, place int, cover string, rank int")
    assert {r.list: r.covers for r in ev.greedy_covers(c, covers=2).collect()} == {1: ["a", "b"], 2: ["c", "d"]}
    assert ev.page_numbers(6, 20) == [1, None, 4, 5, 6, 7, 8, None, 20] and ev.page_numbers(1, 1) == [1] and ev.page_numbers(1, 0) == []


def test_common_and_fuzzy(spark):
    d = spark.createDataFrame([("g", 1, "x"), ("g", 2, "x"), ("g", 2, "y"), ("h", 1, "z"), ("h", 1, "z")], "g string, m int, v string")
    assert {tuple(r) for r in ev.common_to_all(d, "g", "m", "v").collect()} == {("g", "x"), ("h", "z")}
    a = spark.createDataFrame([(1, "Ann B Lee"), (2, "Bo Xi"), (3, "Cy"), (4, None)], "id int, t string")
    b = spark.createDataFrame([(10, "lee, ann b"), (20, "Xi Bo"), (21, "bo xi"), (30, "Cy Y")], "id int, t string")
    assert {r.id: (r.match, r.outcome) for r in ev.fuzzy_unique(a, b, "t").collect()} == {1: (10, "match"), 2: (None, "ambiguous"), 3: (None, "none"), 4: (None, "none")}


def test_every_name_of_a_person_has_the_same_owner(spark):
    names = spark.createDataFrame([("Ann Lee", 1), ("Bo Chan", 2), ("Cy Dee", 3), ("", 9)], "name string, owner int")
    pairs = spark.createDataFrame([("ann  LEE", "A. Pen"), ("A Pen", "Nom"), ("Nom", "Other Nom"), ("Bo Chan", "Shared"), ("Shared", "Cy Dee"), ("Loose", "Ends"), ("", "Ann Lee")], "a string, b string")
    got = {}
    for r in ev.aliased(names, pairs).collect():
        got.setdefault(r.name, set()).add(r.owner)
    assert got == {"ann lee": {1}, "a pen": {1}, "nom": {1}, "other nom": {1}, "bo chan": {2, 3}, "shared": {2, 3}, "cy dee": {2, 3}}
    lines = spark.createDataFrame([(1, "by Ann Lee."), (2, "by A. PEN"), (3, "other nom!"), (4, "Shared"), (5, "Loose")], "id int, t string")
    found = {r.id: (r.owner, r.outcome) for r in ev.token_run(lines, "id", F.col("t"), ev.aliased(names, pairs)).collect()}
    assert found == {1: (1, "owned"), 2: (1, "owned"), 3: (1, "owned"), 4: (None, "ambiguous")}


def test_equal_texts_and_names_of_many_owners_are_listed_once(spark):
    names = spark.range(3000).selectExpr("concat('red ring ', id % 3) AS name", "id AS owner").union(spark.createDataFrame([("blue rod", 7), ("blue rod", 7)], "name string, owner bigint"))
    texts = spark.range(600).selectExpr("id", "concat('a Red-Ring ', id % 3, '!') AS t").union(spark.createDataFrame([(1000, "the blue  rod"), (1001, "blue"), (1000, "rod")], "id bigint, t string"))
    found = ev.token_run(texts, "id", F.col("t"), names)
    assert {r.id: (r.owner, r.outcome) for r in found.collect()} == {**{i: (None, "ambiguous") for i in range(600)}, 1000: (7, "owned")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # texts are exploded once, and what is exploded are distinct ones; owners are added up before they meet them
    assert plan.count("Generate explode") == 1 and plan[plan.index("Generate explode") :].count("Aggregate") >= 1


def test_names_of_very_many_owners_stay_few_rows(spark):
    names = spark.range(500).selectExpr("'Ann Lee' AS name", "id AS owner").union(spark.createDataFrame([("Cy Dee", 900)], "name string, owner bigint"))
    pairs = spark.range(500).selectExpr("'Ann Lee' AS a", "concat('pen ', id) AS b").union(spark.createDataFrame([("Cy Dee", "Nom")], "a string, b string"))
    few = ev.aliased(names, pairs, every_owner=False)
    assert few.count() == 2 * 501 + 2
    lines = spark.createDataFrame([(1, "Ann Lee"), (2, "by pen 77"), (3, "a nom"), (4, "none")], "id int, t string")
    assert {r.id: (r.owner, r.outcome) for r in ev.token_run(lines, "id", F.col("t"), few).collect()} == {1: (None, "ambiguous"), 2: (None, "ambiguous"), 3: (900, "owned")}
