"""A store of documents by key: every change appends a row, the latest row of a key counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, at bigint, deleted boolean, document string"


class Store:
    """Documents (JSON text) in a folder of Parquet files that all executors reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        spark.createDataFrame([], SCHEMA).write.mode("append").parquet(self.path)

    def _append(self, rows: DataFrame, deleted: bool) -> None:
        at = (self._rows().agg(F.max("at")).first()[0] or 0) + 1
        rows.select(F.col("id").cast("string"), F.lit(at).cast("bigint").alias("at"), F.lit(deleted).alias("deleted"), F.col("document").cast("string")).write.mode("append").parquet(self.path)

    def _rows(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def put(self, rows: DataFrame) -> None:
        """Create or replace the documents of ``rows`` (id, document)."""
        self._append(rows, False)

    def delete(self, ids: DataFrame) -> None:
        self._append(ids.select("id", F.lit(None).cast("string").alias("document")), True)

    def all(self) -> DataFrame:
        """(id, at, document) of what is there; ``at`` numbers the changes."""
        last = self._rows().groupBy("id").agg(F.max_by(F.struct("deleted", "document"), "at").alias("s"), F.max("at").alias("at"))
        return last.where(~F.col("s.deleted")).select("id", "at", "s.document")

    def newest(self, n: int) -> DataFrame:
        return self.all().orderBy(F.col("at").desc(), "id").limit(n)

    def get(self, ident: str) -> DataFrame:
        return self.all().where(F.col("id") == ident)
