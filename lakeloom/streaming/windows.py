"""Windows over event time, for a batch or a stream: the same transformation runs in both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, time: str, length: str, keys: list[str], late: str, slide: str | None = None) -> DataFrame:
    """Counts by keys and window (start, end, n). Rows later than ``late`` behind the newest are dropped by a stream."""
    span = F.window(time, length, slide) if slide else F.window(time, length)
    out = events.withWatermark(time, late).groupBy(*keys, span.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], late: str) -> DataFrame:
    """Counts by keys and session: rows less than ``gap`` apart."""
    out = events.withWatermark(time, late).groupBy(*keys, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def read_folder(spark: SparkSession, folder: str, schema: str, files: int = 100) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
