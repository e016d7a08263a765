"""The catalogue's entities over the star schema: people, items, recommendations, lists, series.

customer -> people, part -> items, orders with lineitem -> recommendations, supplier -> curated lists, brand -> series,
nation -> communities. SQL holds the same definitions for the checks in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import slugify
from tessera.sources.tables import parquet


def pick(number: str, words: list[str | None]) -> str:
    """SQL: the word at number modulo their count."""
    return f"CASE ({number}) % {len(words)} " + " ".join(f"WHEN {i} THEN " + ("NULL" if w is None else "'" + w.replace("'", "''") + "'") for i, w in enumerate(words)) + " END"


def _editions() -> str:
    """SQL over items (id) for Spark and DuckDB alike: what editions of works say of themselves, in varied spellings. Eight neighbouring ids are editions of one work."""
    k, j = "k", "j"
    base = f"{pick(k, ['The Silent', 'Red', 'A Lost', 'Golden', 'Hidden', 'Broken', 'Iron', 'Quiet', 'The Last', 'First', 'Deep', 'Wild'])} || ' ' || {pick(f'CAST((k - k % 12) / 12 AS BIGINT)', ['River', 'Garden', 'Mirror', 'Engine', 'Café', 'Winter', 'Letter', 'Harbor', 'Orchard', 'Signal', 'Ladder'])} || {pick(f'CAST((k - k % 132) / 132 AS BIGINT)', ['', ' of Stone', ' of Glass', ' of Sand', ' of Salt', ' & Ash', ' at Dawn', ' in Spring', ' by Night', ' and Fire', ' and Rain', ' of Naïveté', ' in Two'])}"
    surnames = ["Smithson", "Rowling", "Fuhrman", "King", "Akenine-Moller", "Twain", "Strugatskiy", "Orwell", "Montgomery", "Tolstoy", "Knapp", "Mattis", "Núñez", "O’Brien"]
    typos = ["Smithsen", "Galbraith", "Furhman", "Bachman", "Moller", "Clemens", "Strugatsky", "Blair", "Montgomerie", "Tolstoi", "Knap", "Matis", "Nunez", "OBrien"]
    given, other = ["John", "Anna", "Robert", "Mary Ann", "Fyodor", "William Daniel"], ["Jon", "Hannah", "Bob", "Ann", "Theodore", "Daniel"]
    s, t, g, o = pick("k * 5 + 1", surnames), pick("k * 5 + 1", typos), pick("k", given), pick("k", other)
    author = f"CASE (k + j * j) % 13 WHEN 0 THEN {g} || ' ' || {s} WHEN 1 THEN substr({g}, 1, 1) || '. ' || {s} WHEN 2 THEN 'Dr. ' || {g} || ' ' || {s} || ', Ph.D.' WHEN 3 THEN {s} WHEN 4 THEN {g} || ' ' || {t} WHEN 5 THEN {o} || ' ' || {s} WHEN 6 THEN {g} || ' ' || {s} || ' & Ann Lee' WHEN 7 THEN {s} || ' ' || {g} WHEN 8 THEN CASE j WHEN 2 THEN NULL ELSE '' END WHEN 9 THEN 'J. R. ' || {s} WHEN 10 THEN upper({g} || ' ' || {s}) WHEN 11 THEN 'Ann Lee' ELSE {g} || ' ' || {s} || CASE WHEN k % 5 = 0 THEN ' Kids' ELSE '' END END"
    subtitle = pick("k * 3 + j * 5", [None, "", "A Novel", "Book 2", "Volume II", "How to Bend Iron and Time", "How to Bend Iron", "A History of Small Things", "Revised Edition", "The Smith Saga, Book 3", "The Smith Saga, Book 4", "A Workbook", "A Novel (Paperback)", "", None, "How to Bend Iron and Time", ""])
    title = f"CASE WHEN k % 29 = 0 THEN 'Volume ' || (k % 3) WHEN k % 31 = 0 THEN {s} ELSE CASE j WHEN 2 THEN upper(base) WHEN 3 THEN base || ': How to Bend Iron and Time' WHEN 5 THEN replace(base, 'a', 'á') ELSE base END END"
    code = "lpad(CAST(k * 10 + CAST((j - j % 3) / 3 AS BIGINT) AS STRING), 8, '0')"
    return (
        f"SELECT id, {title} AS title, {subtitle} AS subtitle, {author} AS author, CASE WHEN (k + j) % 3 = 0 THEN NULL ELSE 'https://shop.example/dp/B0' || {code} || '?ref=' || j END AS url, CASE WHEN (k + j) % 4 = 1 THEN '97800' || {code} WHEN (k + j) % 4 = 2 THEN '' END AS isbn, "
        "CASE WHEN (k * 7 + j) % 9 <> 0 THEN CAST(1950 + k % 60 + CASE WHEN (k + j * 3) % 11 = 0 THEN 6 ELSE j % 3 END AS BIGINT) END AS year, (k + j * 5) % 4 = 0 AS published, CASE WHEN (k + j) % 3 = 1 THEN 'https://covers.example/' || id WHEN (k + j) % 3 = 2 THEN 'none' END AS cover, "
        "repeat('word ', CAST((k * 3 + j * 7) % 33 AS INT)) AS description, CASE WHEN (k + j) % 5 = 0 THEN 'Summary.' ELSE '' END AS editorial, CASE WHEN (k + j) % 8 <> 0 THEN (id * 7919) % 5000 END AS created "
        f"FROM (SELECT id, k, j, {base} AS base FROM (SELECT id, CAST((id - id % 8) / 8 AS BIGINT) AS k, id % 8 AS j FROM items) w) v"
    )


#: id, title, subtitle, author, url, isbn, year, published, cover, description, editorial, created
EDITIONS = _editions()


class Catalogue:
    """Lazily defined entity frames over one folder of tables; nothing is cached."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def t(self, name: str) -> DataFrame:
        return parquet(self.spark, self.sf_dir, name)

    @property
    def people(self) -> DataFrame:
        """id, slug, name, role, quality, nation, published"""
        return self.t("customer").select(F.col("c_custkey").alias("id"), slugify(F.col("c_name")).alias("slug"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("role"), F.col("c_acctbal").alias("quality"), F.col("c_nationkey").alias("nation"), (F.col("c_acctbal") > 0).alias("published"))

    @property
    def items(self) -> DataFrame:
        """id, title, author, rating, price, size, kind, series"""
        author = F.when((F.col("p_brand") == "Brand#4") & (F.col("p_size") % 2 == 0), F.upper("p_brand")).otherwise(F.col("p_brand"))
        return self.t("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), author.alias("author"), (F.col("p_size") / 10).alias("rating"), F.col("p_retailprice").alias("price"), F.col("p_size").alias("size"), F.col("p_type").alias("kind"), F.col("p_brand").alias("series"))

    @property
    def recs(self) -> DataFrame:
        """rec_id, person, item, confidence, source, at: one row for each recommendation, pairs may repeat"""
        o = self.t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("person"), F.col("o_orderdate").alias("at"))
        li = self.t("lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rec_id"), F.col("l_partkey").alias("item"), (F.col("l_quantity") * 2).alias("confidence"), F.col("l_suppkey").alias("source"))
        return li.join(o, "k").select("rec_id", "person", "item", "confidence", "source", "at")

    @property
    def shelves(self) -> DataFrame:
        """person, item: distinct edges"""
        return self.recs.select("person", "item").distinct()

    @property
    def item_recs(self) -> DataFrame:
        """item, recs: distinct recommenders"""
        return self.shelves.groupBy("item").agg(F.count("*").alias("recs"))

    @property
    def counted_items(self) -> DataFrame:
        """items with recs (0 without any)"""
        return self.items.join(self.item_recs.withColumnRenamed("item", "id"), "id", "left").withColumn("recs", F.coalesce("recs", F.lit(0)))

    @property
    def edition_texts(self) -> DataFrame:
        """Columns of EDITIONS"""
        return self.spark.sql(EDITIONS.replace("FROM items)", "FROM {items})"), items=self.items.select("id"))

    @property
    def editions(self) -> DataFrame:
        """Columns of EDITIONS, recs, shown (public, or recommended by a public person who is certain)"""
        text = self.edition_texts
        sure = self.recs.where("confidence >= 98").join(self.people.where("published").select(F.col("id").alias("person")), "person", "left_semi").select(F.col("item").alias("id")).distinct().withColumn("sure", F.lit(True))
        per = self.item_recs.withColumnRenamed("item", "id")
        return text.join(per, "id", "left").join(sure, "id", "left").select(*text.columns, F.coalesce("recs", F.lit(0)).alias("recs"), (F.col("published") | F.col("sure").isNotNull()).alias("shown"))

    @property
    def list_members(self) -> DataFrame:
        """list, item: distinct"""
        return self.t("lineitem").select(F.col("l_suppkey").alias("list"), F.col("l_partkey").alias("item")).distinct()

    @property
    def lists(self) -> DataFrame:
        """id, title, quality, nation, n (members)"""
        n = self.list_members.groupBy("list").agg(F.count("*").alias("n"))
        s = self.t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.col("s_acctbal").alias("quality"), F.col("s_nationkey").alias("nation"))
        return s.join(n.withColumnRenamed("list", "id"), "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))

    @property
    def ranked_members(self) -> DataFrame:
        """list, item, rank: members of a list by price, dearest first"""
        w = Window.partitionBy("list").orderBy(F.desc_nulls_last("price"), "item")
        return self.list_members.join(self.items.select(F.col("id").alias("item"), "price"), "item").select("list", "item", F.row_number().over(w).alias("rank"))


#: The same, as common table expressions.
SQL = {
    "people": "SELECT c_custkey AS id, trim(regexp_replace(regexp_replace(lower(trim(c_name)), '[^a-z0-9\\s-]', '', 'g'), '[\\s-]+', '-', 'g'), '-') AS slug, c_name AS name, c_mktsegment AS role, c_acctbal AS quality, c_nationkey AS nation, c_acctbal > 0 AS published FROM customer",
    "items": "SELECT p_partkey AS id, p_name AS title, CASE WHEN p_brand = 'Brand#4' AND p_size % 2 = 0 THEN upper(p_brand) ELSE p_brand END AS author, p_size / 10 AS rating, p_retailprice AS price, p_size AS size, p_type AS kind, p_brand AS series FROM part",
    "recs_": "SELECT l_orderkey * 10 + l_linenumber AS rec_id, o_custkey AS person, l_partkey AS item, l_quantity * 2 AS confidence, l_suppkey AS source, o_orderdate AS at_ FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "shelves": "SELECT DISTINCT person, item FROM recs_",
    "item_recs": "SELECT item, count(*) AS recs FROM shelves GROUP BY item",
    "counted": "SELECT items.*, coalesce(recs, 0) AS recs FROM items LEFT JOIN item_recs ON id = item",
    "editions": f"SELECT e.*, coalesce(recs, 0) AS recs, e.published OR e.id IN (SELECT item FROM recs_ JOIN people ON person = people.id WHERE confidence >= 98 AND people.published) AS shown FROM ({EDITIONS}) e LEFT JOIN item_recs ON e.id = item",
    "list_members": "SELECT DISTINCT l_suppkey AS list, l_partkey AS item FROM lineitem",
    "lists": "SELECT s_suppkey AS id, s_name AS title, s_acctbal AS quality, s_nationkey AS nation, coalesce(n, 0) AS n FROM supplier LEFT JOIN (SELECT list, count(*) AS n FROM list_members GROUP BY list) ON list = s_suppkey",
    "ranked_members": "SELECT list, item, row_number() OVER (PARTITION BY list ORDER BY price DESC NULLS LAST, item) AS rank FROM list_members JOIN items ON item = id",
}
_NEEDS = {"shelves": ["recs_"], "item_recs": ["recs_", "shelves"], "counted": ["items", "recs_", "shelves", "item_recs"], "editions": ["items", "people", "recs_", "shelves", "item_recs"], "lists": ["list_members"], "ranked_members": ["items", "list_members"]}


def over(names: str, body: str, more: str = "", recursive: bool = False) -> str:
    """A query over the entities named, and further common table expressions."""
    wanted: list[str] = []
    for n in names.split():
        wanted += [x for x in [*_NEEDS.get(n, []), n] if x not in wanted]
    parts = [f"{n} AS ({SQL[n]})" for n in wanted] + ([more] if more else [])
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body
