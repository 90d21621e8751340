"""Structured Streaming over dated observations and events: an extension of the batch operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def observations(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], observed: str, lateness: str = "7 days") -> DataFrame:
    """A stream of CSV observations, each (keys, observed) once within the lateness."""
    rows = spark.readStream.schema(schema).option("header", True).csv(path)
    return rows.withWatermark(observed, lateness).dropDuplicatesWithinWatermark([*keys, observed])


def latest_per_key(stream: DataFrame, keys: Sequence[str], observed: str, values: Sequence[str]) -> DataFrame:
    """The latest values per key so far, for update or complete mode."""
    return stream.groupBy(*keys).agg(F.max(F.struct(observed, *values)).alias("_m")).select(*keys, "_m.*")


def windowed(stream: DataFrame, ts: str, keys: Sequence[str], value: str, size: str, slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Count and sum per time window and key; late rows beyond the watermark are dropped."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    sums = stream.withWatermark(ts, lateness).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return sums.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total")


def sessions(stream: DataFrame, ts: str, keys: Sequence[str], gap: str = "30 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Sessions per key that end after ``gap`` without rows."""
    found = stream.withWatermark(ts, lateness).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")
