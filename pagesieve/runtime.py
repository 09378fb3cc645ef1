"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach.

    It is the one the cluster names in ``spark.checkpoint.dir``. Only where that
    setting is absent (tests, a laptop) a temporary folder takes its place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("a cluster has to name a shared folder in spark.checkpoint.dir")
    global _own_dir
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="pagesieve-")
        atexit.register(shutil.rmtree, _own_dir, True)
    return f"file://{_own_dir}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already; the folder is scratch space
        pass


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder.

    The table survives the loss of executors and is read back with column
    pruning; it is removed when the process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/pagesieve/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def latest(df: DataFrame, key: str, order: list[str], columns: dict[str, Column]) -> DataFrame:
    """One row per key: the row that comes last by ``order``; equal ones by a hash of the row.

    Works as a partial aggregation, so a hot key is reduced before the shuffle.
    """
    aliases, names = list(columns), [f"_c{i}" for i in range(len(columns))]
    keyed = df.select(F.col(key).alias("_k"), F.struct(*order).alias("_o"), *[c.alias(n) for c, n in zip(columns.values(), names)])
    payload = F.struct(*names)
    hashed = F.xxhash64(F.to_json(payload)) if "map<" in keyed.schema.simpleString() else F.xxhash64(*names)
    picked = keyed.groupBy("_k").agg(F.max_by(payload, F.struct(F.col("_o"), hashed.alias("h"))).alias("_p"))
    return picked.select(F.col("_k").alias(key), *[F.col(f"_p.{n}").alias(a) for n, a in zip(names, aliases)])


def running_sums(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """``df`` with ``<column>_upto`` and ``<column>_all``: sums over the rows of the same keys up to this one in ``order`` (unique within the keys), and over all of them.

    Rows are dealt to tasks by range, summed within each range, and the sums of the ranges before are added: no task has all rows of a key,
    and only a row a range and key is summed in one place.
    """
    ranged = materialize(df.repartitionByRange(*keys, order).withColumn("_range", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("_range", *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    totals = ranged.groupBy("_range", *keys).agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    by_key = Window.partitionBy(*keys)
    before = by_key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    offsets = totals.select("_range", *keys, *[x for c in columns for x in (F.coalesce(F.sum(f"_{c}").over(before), zero).alias(f"{c}_before"), F.sum(f"_{c}").over(by_key).alias(f"{c}_all"))])
    both = ranged.withColumns({f"{c}_own": F.sum(c).over(within) for c in columns}).join(offsets, ["_range", *keys])
    return both.withColumns({f"{c}_upto": F.col(f"{c}_before") + F.col(f"{c}_own") for c in columns}).drop("_range", *[f"{c}_{x}" for c in columns for x in ("before", "own")])


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt over all cores, where they come in fewer than half as many partitions (a few small files).

    For work that costs far more than moving the rows. A scan of a large table has more partitions than that and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores / 2 else df
