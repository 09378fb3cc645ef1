"""Streams of page documents: scoring, repeated addresses within a watermark, counts per window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagesieve.operators.url_features import url_features


def read(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 100) -> DataFrame:
    """A file-source stream of Parquet documents."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def score(stream: DataFrame, suffixes: list[str]) -> DataFrame:
    """Lexical features of every document; the same expressions as in batch."""
    return url_features(stream.withColumns({"_final": F.coalesce("metadata.final_url", "url"), "_requested": F.col("url")}), "_final", "_requested", suffixes).drop("_final", "_requested")


def first_seen(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """Documents whose address was not seen within the watermark; state is bounded by it."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def counts(stream: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Documents per window and key; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")
