"""Column functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import html, match, text, urls


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def values(spark, f, cases, kind="string"):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, c {kind}")
    return [r[0] for r in df.orderBy("i").select(f(F.col("c"))).collect()]


ROLES = [
    ("Founder of a bank; writer", "founders"), ("Novelist and founder", "writers"), ("Venture capitalist", "investors"), ("Hedge fund manager and donor", "investors"),
    ("Former prime minister", "politics"), ("44th president of the united states", "politics"), ("President of a club", "founders"), ("Professor of psychology", "scientists"),
    ("Radio presenter", "media"), ("Head of an authority on ghost towns", "other"), ("Philanthropist", "other"), ("(born 1966)", None), ("", None), (None, None),
]


def test_roles(spark):
    assert values(spark, text.classify_role, [r for r, _ in ROLES]) == [b for _, b in ROLES]
    assert values(spark, text.clean_role, ["  Author (born 1950) "]) == ["Author"]


def test_slugs_and_titles(spark):
    assert values(spark, text.slugify, ["  Hello,  World -- again! ", "É", None]) == ["hello-world-again", "", None]
    assert values(spark, text.core_title, ["The Art of War: a guide", "Dune (1965)", "A – B"]) == ["artofwar", "dune", "a"]
    assert values(spark, text.surname, ["Ann Lee Jr.", "A. Bee and C. Dee", ""]) == ["lee", "bee", ""]
    assert values(spark, text.repair_numeric_title, ["1984.0", "1984", "x"]) == ["1984", "1984", "x"]
    assert values(spark, text.is_numeric_title, ["1984.0", "1984 b"]) == [True, False]
    assert values(spark, text.repair_encoding, ["it_x0092_s  a_x00A0_b"]) == ["it’s a b"]
    same = spark.createDataFrame([("Zero to One", "zero to one: notes"), ("It", "Italy"), ("", ""), (None, "a")], "a string, b string")
    assert [r[0] for r in same.select(text.same_work(F.col("a"), F.col("b"))).collect()] == [True, False, False, False]


def test_english_and_quality(spark):
    good = "This is a long enough text about the life of a man who was in the war and came home to write about it."
    assert values(spark, text.likely_english, [good, "kurz", "", None, "la historia de " + good, "zzz qqq " * 20]) == [True, True, False, False, False, False]
    assert values(spark, text.useful_description, [good, good[:70], "Coming soon " + good, None]) == [True, False, True, False]
    assert values(spark, text.useful_bio, ["A writer from the north", "n/a", "TBD", None]) == [True, False, False, False]
    assert values(spark, text.clamp, ["abc", "word " * 200]) == ["abc", ("word " * 140).strip() + "…"]
    assert "shouting" in values(spark, text.problem_tags, ["WHAT!! IS THIS"])[0]


def test_fnv_and_ratings(spark):
    def fnv(s):
        h = 2166136261
        for c in s:
            h = ((h ^ ord(c)) * 16777619) & 0xFFFFFFFF
        return h

    assert values(spark, text.fnv1a, ["", "a", "hello-world"]) == [fnv(""), fnv("a"), fnv("hello-world")]
    assert [tuple(r) for r in values(spark, text.parse_rating, ["3.8 (1,369)", "9 (1)", "x", None])] == [(3.8, 1369), (None, 1), (None, None), (None, None)]


def test_urls(spark):
    assert values(spark, urls.host_of, ["HTTPS://www.Example.org:80/a", "example.org", None]) == ["example.org", None, None]
    assert values(spark, urls.clean_url, ["https://E.org/a/?utm_source=x&b=1#top", "http://e.org/?ref=x", "http://e.org/a?ref=1&utm_id=2&c=3"]) == ["https://e.org/a/?b=1", "http://e.org", "http://e.org/a?c=3"]
    assert values(spark, urls.product_id, ["https://amazon.com/dp/0307743667444aa9cd52d5", "https://amazon.com/dp/B00ABCDEF1?x", "https://amazon.com/dp/12"]) == ["0307743667", "B00ABCDEF1", None]
    assert values(spark, urls.is_store, ["https://smile.amazon.co.uk/x", "https://amzn.to/1", "https://notamazon.com/", None]) == [True, True, False, False]
    assert values(spark, urls.split_urls, ["https:/a.b/x | https://c.d/y,https://a.b/xhttps://e.f/", "https://web.archive.org/web/1/http://x.y/", None, "junk"]) == [["https://a.b/x", "https://c.d/y", "https://e.f/"], ["https://web.archive.org/web/1/http://x.y/"], [], []]
    assert values(spark, urls.snowflake_year, ["https://x.com/a/status/1700000000000000000", "https://e.org/2019/01/x", "https://e.org"]) == [2023, 2019, None]
    assert values(spark, urls.outbound_rel, ["https://amazon.com/dp/1", "https://x.com/a", "https://e.org"]) == ["nofollow sponsored", "nofollow", ""]


@pytest.mark.parametrize(
    ("url", "kind", "own"),
    [
        ("https://twitter.com/ann_lee/status/123", "tweet", True), ("https://x.com/other/status/1", "tweet", False), ("https://annlee.com/books", "own_site", True),
        ("https://www.youtube.com/watch?v=abc", "youtube", False), ("https://e.org/podcast/9", "podcast", False), ("https://en.wikipedia.org/wiki/Ann", "other", False), ("https://e.org/interview", "article", False), ("nonsense", "other", False),
    ],
)
def test_source_kind(spark, url, kind, own):
    (k,) = one(spark, urls.source_kind(F.lit(url), F.lit("ann-lee"), F.lit("Ann Lee"), F.lit(None).cast("string")))
    assert (k["kind"], k["own"]) == (kind, own)


def test_html(spark):
    page = '<html><head><title> A &amp; b </title><meta content="d" name="description"></head><body><nav>n</nav><h1>H</h1><script>x</script><p>t &lt;1<!-- c --></p><a class="k" href="/u">l</a></body></html>'
    assert one(spark, html.tag_text(F.lit(page), "title"), html.meta(F.lit(page), "description"), html.visible_text(F.lit(page)), html.hrefs(F.lit(page)), html.tag_count(F.lit(page), "h1")) == ("A &amp; b", "d", "A & b H t <1 l", ["/u"], 1)


def test_isbn_and_similarity(spark):
    assert values(spark, match.isbn13_valid, ["9780306406157", "9780306406158", "x", None]) == [True, False, False, False]
    assert values(spark, match.isbn10_valid, ["0306406152", "080442957X", "0306406153"]) == [True, True, False]
    assert values(spark, match.isbn10_to_13, ["0306406152", "0306406153"]) == ["9780306406157", None]
    from difflib import SequenceMatcher

    pairs = [("abcd", "bcde"), ("", ""), ("x", None), ("night train", "the night train")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(match.sequence_ratio("a", "b")).collect()]
    assert got == [SequenceMatcher(None, a or "", b or "", autojunk=False).ratio() for a, b in pairs]
    conflicts = spark.createDataFrame([("Dune", "Dune workbook"), ("Vol 1", "Vol 2"), ("A: red sea", "A: blue sky"), ("Dune", "dune")], "a string, b string")
    assert [r[0] for r in conflicts.select(match.title_conflict(F.col("a"), F.col("b"))).collect()] == ["marker", "number", "subtitle", None]
