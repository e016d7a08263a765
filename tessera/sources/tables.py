"""Scans: Parquet tables with declared schemas, CSV, JSON lines, sitemaps, stored objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """RFC 4180: a header, quotes doubled inside quotes, line breaks inside quotes."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def sitemap_urls(spark: SparkSession, path: str) -> DataFrame:
    """url: every <loc> of the XML files under path."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.regexp_extract_all("value", F.lit(r"<loc>\s*([^<]+?)\s*</loc>"), F.lit(1))).alias("url"))


def objects(spark: SparkSession, path: str) -> DataFrame:
    """path, name, size, modified of every file below a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def first_filled(*names: str):
    """The first of several columns that is not blank (a header may call a field by several names)."""
    return F.coalesce(*[F.nullif(F.trim(F.col(n)), F.lit("")) for n in names])
