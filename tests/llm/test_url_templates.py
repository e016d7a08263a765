import pytest

from tessera.llm import url_templates as u

CASES = [
    ("http://A.Example.NET/en/12?x#y", "a.example.net", "/en/12", "example.net/en/", "allow"), ("https://a.example.net/fr/1", "a.example.net", "/fr/1", "net/", "block"),
    ("http://example.net", "example.net", "", None, "allow"), ("http://www.example.com/de/", "www.example.com", "/de/", "example.com/de/", "block"), ("http://notexample.com/de/1", "notexample.com", "/de/1", None, "allow"),
    ("ftp://x.org/fr/2", "x.org", "/fr/2", "org/fr/", "allow"), ("no scheme", "", "", None, "allow"), (None, "", "", None, "allow"), ("://?q", "", "", None, "allow"), ("http://É.com/ü//b", "É.com", "/ü//b", None, "allow"),
]


def test_rules(spark, clash):
    df = clash(spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "page_id bigint, url string").withColumnRenamed("x", "y"))
    got = [(r.host, r.path, r.rule, r.verdict) for r in u.judged(df).orderBy("page_id").collect()]
    assert got == [c[1:] for c in CASES]


def test_templates_reject_by_purity(spark):
    pages = [(i, f"http://shop.test/{'promo' if i % 2 else 'read'}/item-{1000 + i}.html") for i in range(200)] + [(500 + i, f"http://shop.test/read/{'abcdefgh'[i % 8]}") for i in range(40)] + [(900, "http://shop.test/promo/item-99999.html")]
    labels = [(i, i % 2) for i in range(0, 120)]
    df, lab = spark.createDataFrame(pages, "page_id bigint, url string"), spark.createDataFrame(labels, "page_id bigint, label int")
    got = {r.page_id: r for r in u.judged(df, lab, rules=()).collect()}
    assert got[900].verdict == "block" and got[900].template == "/promo/*.html" and got[199].verdict == "block"
    assert got[198].verdict == "allow" and got[198].template == "/read/*.html"
    assert {got[500 + i].template for i in range(40)} == {"/read/*"}  # siblings without labels are alike


def test_many_children_become_a_wildcard(spark):
    names = ["w" + "".join(chr(97 + int(c)) for c in str(i)) for i in range(60)]
    df = spark.createDataFrame([(i, f"http://h.test/{n}/x") for i, n in enumerate(names)], "page_id bigint, url string")
    assert {r.template for r in u.judged(df).collect()} == {"/*/x"}


@pytest.mark.parametrize("url", ["http://deep.test/" + "a/" * 40, "http://h.test/" + "x" * 100_000])
def test_long(spark, url):
    assert u.judged(spark.createDataFrame([(1, url), (1, url)], "page_id bigint, url string")).count() == 2


def test_empty(spark):
    assert u.judged(spark.createDataFrame([], "page_id bigint, url string")).count() == 0
