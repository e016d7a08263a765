"""Event-time extensions: the same windowed aggregate over a table and, with a watermark, over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def _timed(events: DataFrame) -> DataFrame:
    """With ts as a timestamp; one that is a timestamp already keeps its watermark."""
    return events if dict(events.dtypes)["ts"] == "timestamp" else events.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(events: DataFrame, length: str = "1 hour") -> DataFrame:
    """event_type, hour, n, total of each tumbling window."""
    out = _timed(events).groupBy("event_type", F.window("ts", length).alias("w"))
    return out.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("event_type", F.col("w.start").alias("hour"), "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, begin, end, n of each run of events without a longer gap."""
    out = _timed(events).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return out.agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "n")


def hourly_stream(spark: SparkSession, path: str, schema, late: str = "2 hours") -> DataFrame:
    """hourly() over files that arrive in a folder; windows close once the watermark has passed them."""
    return hourly(_timed(spark.readStream.schema(schema).parquet(path)).withWatermark("ts", late))


def to_table(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Closed windows appended to Parquet, each once, whatever restarts."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
