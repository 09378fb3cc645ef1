"""Writers, and the rendering of small results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    """Compact JSON lines without null fields, times as ISO text."""
    df.write.mode(mode).option("ignoreNullFields", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").json(path)


def csv(df: DataFrame, path: str, columns: list[str], mode: str = "error") -> None:
    """Columns in a fixed order; what is missing is empty."""
    picked = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in df.columns else F.lit("").alias(c) for c in columns]
    df.select(*picked).write.mode(mode).option("header", True).option("emptyValue", "").option("escape", '"').csv(path)


def arff(df: DataFrame, path: str, relation: str, mode: str = "error") -> None:
    """All columns numeric; the header is the first part of the first file."""
    head = "\n".join([f"@relation {relation}", *[f"@attribute {c} numeric" for c in df.columns], "@data"])
    spark = df.sparkSession
    rows = df.select(F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in df.columns]).alias("value"))
    spark.createDataFrame([(head,)], "value string").coalesce(1).unionAll(rows).write.mode(mode).text(path)


def splits(df: DataFrame, path: str, split: str = "split", mode: str = "error") -> DataFrame:
    """A folder per split, and a summary of their sizes."""
    df.write.mode(mode).partitionBy(split).parquet(path)
    return df.sparkSession.read.parquet(path).groupBy(split).agg(F.count("*").alias("rows"))


def markdown(df: DataFrame, most: int = 100) -> str:
    """A table of the first rows; the rows are limited before they reach the driver."""
    rows = df.limit(most).collect()
    if not rows:
        return "_No rows._"
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]])


def upsert(df: DataFrame, changes: DataFrame, key: str, column: str) -> DataFrame:
    """One field replaced where there is a change; write the result to a new path."""
    c = changes.groupBy(key).agg(F.first(column).alias("_new"))
    return df.join(c, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")
