"""The whole query, in Spark and SQL, on pages with bad sections planted in them."""

import random

import duckdb

from tessera.llm import url_templates as u


def planted(spark, folder):
    """Per host 12 sections of 30 pages, of which two are bad nine times in ten and the others once in ten; thin sections beside them."""
    rng = random.Random(4)
    pages, labels, bad_sections = [], [], set()
    for h in range(4):
        bad = set(rng.sample(range(12), 2))
        for s in range(12):
            name = f"{'abcdefghijkl'[s]}part"
            if s in bad:
                bad_sections.add((f"h{h}.test", name))
            for k in range(30):
                doc = len(pages)
                pages.append((doc, f"http://H{h}.test/x/{name}/{'en' if k % 2 else 'de'}/{10_000 + doc}.html?q"))
                if k % 3:
                    labels.append((10_000 + doc, int(rng.random() >= (0.9 if s in bad else 0.1)), 0))
        for k in range(20):  # sections without labels
            pages.append((len(pages), f"http://h{h}.test/x/{'mnopqrstuvwxyzabcdef'[k]}thin{'gh'[k % 2]}/en/1"))
    pages += [(90_000, None), (90_001, "nothing"), (90_001, "nothing"), (90_002, "http://other.test")]
    spark.createDataFrame(pages, "page_id bigint, url string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return pages, bad_sections


def test_query_and_sql_block_planted_sections(spark, tmp_path):
    pages, bad = planted(spark, tmp_path)
    got = u.query(spark, str(tmp_path)).collect()
    assert len(got) == len(pages)
    for r in got:
        section = r.path.split("/")[2] if r.path.count("/") > 2 else None
        assert r.verdict == ("block" if (r.host, section) in bad else "allow"), r
    # bad and good sections are wildcards of their own, and so are those without labels
    of = {(r.host, r.template.split("/")[2]) for r in got if r.host.startswith("h")}
    assert of == {(f"h{h}.test", x) for h in range(4) for x in ("*", "*1", "*?")}
    con = duckdb.connect()
    for name in ("pages", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.sql(f"SELECT page_id, host, path, rule, verdict, template FROM ({u.ORACLE_SQL})").fetchall()
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.host, r.path, r.rule, r.verdict, r.template)) for r in got)


def test_repeated_pages_and_labels(spark):
    pages = [(1, "http://h.test/a/b")] * 3 + [(2, "http://h.test/a/c"), (None, "http://h.test/a/d")]
    labels = [(1, 0), (1, 1), (1, None), (None, 1)]
    got = u.judged(spark.createDataFrame(pages, "page_id bigint, url string"), spark.createDataFrame(labels, "page_id bigint, label int"), rules=()).collect()
    assert len(got) == 5
    # three labelled pages, all bad: the host's share is (3 + 8) / (3 + 8)
    assert {r.impurity for r in got} == {1.0} and {r.verdict for r in got} == {"block"}
