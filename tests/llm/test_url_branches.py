from tessera.llm import url_templates as u


def verdicts(spark, rows):
    """rows: (page_id, url, label)"""
    df = spark.createDataFrame(rows, "page_id bigint, url string, label int")
    return {r.page_id: r for r in u.judged(df.select("page_id", "url"), df.where("label is not null").select("page_id", "label"), rules=()).collect()}


def test_a_bad_section_among_many_is_blocked(spark):
    names = [chr(97 + i // 6) + chr(103 + i % 6) for i in range(30)]
    rows = [(100 * i + k, f"http://h.test/{n}/item-{1000 + k}", int(i == 7)) for i, n in enumerate(names) for k in range(40)]
    got = verdicts(spark, rows)
    assert {i // 100 for i, r in got.items() if r.verdict == "block"} == {7}
    assert {r.template for r in got.values()} == {f"/{names[7]}/*", "/*/*"}


def test_deep_branches_are_told_apart(spark):
    rows = [(k, f"http://h.test/a/b/c/d/{'spam' if k % 2 else 'good'}/x/item-{1000 + k}", k % 2) for k in range(80)]
    got = verdicts(spark, rows)
    assert {(k % 2, r.verdict, r.template) for k, r in got.items()} == {(0, "allow", "/a/b/c/d/good/x/*"), (1, "block", "/a/b/c/d/spam/x/*")}


def test_a_path_alone_keeps_its_segments(spark):
    got = verdicts(spark, [(1, "http://h.test/a/b/c/d/e/f", None), (2, "http://h.test/a/b", None)])
    assert {k: r.template for k, r in got.items()} == {1: "/a/b/c/d/e/f", 2: "/a/b"}
