"""Tables on which the work of a query once grew faster than its input, and keys beyond those of the small tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
PART = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def part_of(spark, folder, rows):
    rows.write.mode("overwrite").parquet(f"{folder}/part.parquet")
    return str(folder)


def same_as_sql(spark, folder, name, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    cur = con.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    got = QUERIES[name](spark, folder).select(*columns).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, cur.fetchall())) and got


@pytest.fixture(scope="module")
def odd_parts(spark, tmp_path_factory):
    """Sizes in runs and apart, several authors, nulls."""
    rows = [(i, ["red ring", "red rod", None][i % 3], ["Brand#4", "Brand#5", None][i // 3 % 3], ["PROMO", "SMALL"][i // 9 % 2], [1, 2, 5, 9, 13, 14, 30, None][i * 7 % 8], 900.0) for i in range(300)]
    return part_of(spark, tmp_path_factory.mktemp("odd"), spark.createDataFrame(rows, PART))


@pytest.fixture(scope="module")
def equal_parts(spark, tmp_path_factory):
    """200,000 rows of one title and author: 20 billion pairs."""
    rows = spark.range(200_000).select(F.col("id").alias("p_partkey"), F.lit("red ring").alias("p_name"), F.lit("Brand#5").alias("p_brand"), F.lit("PROMO").alias("p_type"), F.lit(5).alias("p_size"), F.lit(900.0).alias("p_retailprice"))
    return part_of(spark, tmp_path_factory.mktemp("equal"), rows)


def test_verdicts_of_equal_rows_are_counted_without_their_pairs(spark, odd_parts, equal_parts):
    same_as_sql(spark, odd_parts, "dedupe_verdicts", ["part"])
    assert [tuple(r) for r in QUERIES["dedupe_verdicts"](spark, equal_parts).collect()] == [("SAME", 200_000 * 199_999 // 2, 0)]


def test_clusters_on_a_line_need_no_pairs(spark, odd_parts, equal_parts):
    same_as_sql(spark, odd_parts, "duplicate_clusters", ["part"])
    assert QUERIES["duplicate_clusters"](spark, equal_parts).where("cluster = 0").count() == 200_000


def test_found_titles_have_ids_of_their_own_for_large_keys(spark, tmp_path):
    """Items up to 199,000 of people with neighbouring keys."""
    far = {"part": "p_partkey", "lineitem": "l_partkey"}
    for t in ("part", "lineitem", "orders", "customer"):
        rows = spark.read.parquet(f"{SF}/{t}.parquet")
        (rows.withColumn(far[t], F.col(far[t]).cast("bigint") * 1000) if t in far else rows).write.parquet(f"{tmp_path}/{t}.parquet")
    got = QUERIES["scoped_matches"](spark, str(tmp_path)).select("cid")
    assert got.count() == got.distinct().count()
    same_as_sql(spark, str(tmp_path), "scoped_matches", ["part", "lineitem", "orders", "customer"])


def test_roles_are_classified_once_each(spark, tmp_path):
    """The classification comes after people of one role are counted together."""
    rows = spark.read.parquet(f"{SF}/customer.parquet")
    rows.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 7 != 0, F.col("c_mktsegment"))).write.parquet(f"{tmp_path}/customer.parquet")
    found = QUERIES["role_breakdown"](spark, str(tmp_path))
    assert found._jdf.queryExecution().optimizedPlan().toString().split("Aggregate [")[-1].startswith(("role#", "c_mktsegment#"))  # what rows are grouped by first
    assert sum(r.n for r in found.collect()) == rows.count()
    same_as_sql(spark, str(tmp_path), "role_breakdown", ["customer"])


def test_costly_rows_are_dealt_to_tasks_by_their_number(spark, monkeypatch):
    """Small files are few tasks; texts and addresses are judged in as many as there are rows for."""
    from tessera.operators import relational

    monkeypatch.setattr(relational, "TASK_ROWS", 40)
    rows = relational.spread(spark.read.parquet(f"{SF}/customer.parquet"), "c_custkey")
    assert rows.rdd.getNumPartitions() == -(-rows.count() // 40) > 1
    for name in ("source_kinds", "description_hygiene"):
        assert "REPARTITION_BY_NUM" in QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_tags_that_are_not_asked_for_are_not_looked_for(spark):
    from tessera.functions import text

    rows = spark.createDataFrame([("AB cd <b>x x x</b>!!",), ("",), ("ABCd",), (None,)], "c string")
    got = rows.select(text.problem_tags(F.col("c")).alias("t"), text.problem_tags(F.col("c"), without=["markup", "repeated_word"]).alias("u")).collect()
    assert [r.u for r in got] == [[x for x in r.t if x not in ("markup", "repeated_word")] for r in got]
    assert "shouting" in got[2].t and "shouting" not in got[0].t and "not_english" not in str(QUERIES["problem_tags"](spark, SF)._jdf.queryExecution().optimizedPlan())


def test_lists_of_one_nation_are_filled_without_their_pairs(spark, tmp_path):
    """20,000 lists of one nation: 400 million pairs."""
    spark.range(20_000).select(F.col("id").alias("s_suppkey"), F.lit("s").alias("s_name"), F.lit(1).alias("s_nationkey"), F.lit(1.0).alias("s_acctbal")).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.read.parquet(f"{SF}/lineitem.parquet").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert QUERIES["related_lists_filled"](spark, str(tmp_path)).count() == 20_000 * 6


def test_topics_of_people_may_have_their_ids(spark, tmp_path):
    """Lists travel to a person's items as one array; a list with the id of the person is a list like any other."""
    from tessera.operators import overlap

    shelves, lists = spark.createDataFrame([(1, 7), (1, 8), (2, 8)], "person bigint, item bigint"), spark.createDataFrame([(1, 7), (1, 8), (2, 8)], "person bigint, item bigint")
    got = overlap.beside(shelves, "person", "item", others=lists, itself=True)
    assert sorted(map(tuple, got.collect())) == [(1, 1, 2), (1, 2, 1), (2, 1, 1), (2, 2, 1)]
    assert "collect_list" in QUERIES["person_topics"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("copies", [1, 3])
def test_only_pairs_that_may_be_least_alike_are_compared(spark, tmp_path, copies, monkeypatch):
    """Shelves that share one item at most but for the longest two of it; with more copies of rows, nothing else."""
    from tessera.operators import overlap

    far = {"orders": "o_custkey", "lineitem": "l_partkey"}
    for t in ("part", "lineitem", "orders", "customer"):
        rows = spark.read.parquet(f"{SF}/{t}.parquet")
        (rows.withColumn(far[t], F.pmod(F.col(far[t]) * F.col(far[t]), F.lit(61 * copies)) + 1) if t in far else rows).write.parquet(f"{tmp_path}/{t}.parquet")
    asked, kept = [], overlap.shared_of
    monkeypatch.setattr(overlap, "shared_of", lambda pairs, *more: asked.append(pairs) or kept(pairs, *more))
    same_as_sql(spark, str(tmp_path), "unlikely_pair", ["part", "lineitem", "orders", "customer"])
    assert len(asked) <= 2 and all(p.count() for p in asked)


def test_topics_may_be_long_lists(spark, tmp_path):
    """A list of 3,500 items is a topic of people who have most of it, like any other."""
    for t, key in (("lineitem", "l_partkey"), ("orders", None), ("supplier", None), ("customer", None)):
        rows = spark.read.parquet(f"{SF}/{t}.parquet")
        if key:
            long = spark.range(3_500).select((F.col("id") + 1).alias(key), F.lit(1).cast("bigint").alias("l_suppkey"))
            one = rows.limit(1).drop(key, "l_suppkey").crossJoin(long).select(*rows.columns)
            rows = rows.unionByName(one.select([F.col(f.name).cast(f.dataType) for f in rows.schema]))
        rows.write.parquet(f"{tmp_path}/{t}.parquet")
    (spark.read.parquet(f"{SF}/supplier.parquet").withColumn("s_acctbal", F.lit(1.0))).write.mode("overwrite").parquet(f"{tmp_path}/supplier.parquet")
    same_as_sql(spark, str(tmp_path), "person_topics", ["lineitem", "orders", "supplier", "customer"])
    assert QUERIES["person_topics"](spark, str(tmp_path)).agg(F.max("items")).first()[0] >= 3_500


@pytest.mark.parametrize("goes", [1, 3])
def test_books_of_people_are_matched_where_the_people_are(spark, goes, monkeypatch):
    """Rows travel once, by person; with more rows, people are matched in goes."""
    from tessera.operators import similarity

    monkeypatch.setattr(similarity, "GO_ROWS", 10**9 if goes == 1 else 4_000)
    got = QUERIES["scoped_matches"](spark, SF)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == (1 if goes == 1 else 0) and (goes == 1 or len(got.inputFiles()) >= goes)
    con = duckdb.connect()
    for t in ("part", "lineitem", "orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    assert sorted(map(str, map(tuple, got.select("cid", "match", "status", "score").collect()))) == sorted(map(str, con.execute(f"SELECT cid, match, status, score FROM ({ORACLES['scoped_matches']})").fetchall()))


def test_what_a_stored_table_shuffled_is_deleted(spark):
    import glob

    from tessera.operators.resolve import stored, together

    dirs = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())
    files = lambda: {f for d in dirs for f in glob.glob(f"{d}/*/shuffle_*.data")}
    before, rows = files(), spark.range(100_000).repartition(7, "id")
    rows.write.format("noop").mode("overwrite").save()
    left, before = files() - before, files()
    parts = [stored(rows.where(f"id % 2 = {i}")) for i in range(2)]
    assert left and files() <= before and together(parts).count() == 100_000
