"""Streaming ingestion of captured responses, beyond the batch operators: each id once, late rows within a watermark, counts per window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_captures(spark: SparkSession, path: str, schema: T.StructType, most_files: int = 1) -> DataFrame:
    """Parquet files of captures as a stream, a few files per trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", most_files).parquet(path)


def each_once(captures: DataFrame, key: str, at: str, late: str = "2 hours") -> DataFrame:
    """The first row of each id; ids are remembered until the watermark passes them."""
    return captures.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(captures: DataFrame, at: str, kind: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, kind, n): captures per window and kind, final once the watermark has passed the window."""
    rows = captures.withWatermark(at, late).groupBy(F.window(at, window), kind).agg(F.count("*").alias("n"))
    return rows.select(F.col("window.start").alias("start"), kind, "n")
