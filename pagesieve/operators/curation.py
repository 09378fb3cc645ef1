"""Seeded ranks, caps, samples and splits of labelled records.

Order comes from a hash of seed and id. Ranks within a key are counted per (key, hash prefix) and
offset by what lies before, so a key that holds a third of all rows is ranked by many tasks, not one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(ident: str, seed: int = 42) -> Column:
    return F.md5(F.concat(F.col(ident).cast("string"), F.lit(f":{seed}")))


def hash_rank(df: DataFrame, keys: list[str], ident: str, seed: int = 42, digits: int = 3, name: str = "rank") -> DataFrame:
    """Rank (from 1) of each row within its keys by hash of ident; ident is unique within the keys."""
    h = df.withColumn("_h", seeded(ident, seed)).withColumn("_p", F.substring("_h", 1, digits))
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    # at most 16 ** digits counts a key
    counts = h.groupBy(*keys, "_p").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    joined = h.join(counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_p").alias("_q"), "_before"), [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_p") == F.col("_q")])
    within = F.row_number().over(Window.partitionBy(*keys, "_p").orderBy("_h", ident))
    return joined.withColumn(name, (within + F.col("_before")).cast("bigint")).drop("_h", "_p", "_q", "_before", *[f"_k{i}" for i in range(len(keys))])


def counts_of(df: DataFrame, keys: list[str], name: str = "_n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def cap_per_key(df: DataFrame, key: str, ident: str, most: int, seed: int = 42) -> DataFrame:
    """At most ``most`` rows per key, in seeded order."""
    return hash_rank(df, [key], ident, seed, name="_r").where(F.col("_r") <= most).drop("_r")


def balance(df: DataFrame, label: str, ident: str, seed: int = 42) -> DataFrame:
    """Every class cut to the size of the smallest."""
    least = counts_of(df, [label]).agg(F.min("_n").alias("_least"))
    return hash_rank(df, [label], ident, seed, name="_r").crossJoin(F.broadcast(least)).where(F.col("_r") <= F.col("_least")).drop("_r", "_least")


def oversample(df: DataFrame, where: Column, times: int) -> DataFrame:
    """Rows that meet a condition ``times`` times, the rest once."""
    return df.withColumn("copy", F.explode(F.when(where, F.sequence(F.lit(1), F.lit(times))).otherwise(F.array(F.lit(1)))))


def stratified(df: DataFrame, label: str, ident: str, test: float, seed: int = 42, name: str = "split") -> DataFrame:
    """Test share per label: rounded half to even, at least 1, at most all but one."""
    n = counts_of(df, [label]).select(F.col(label).alias("_l"), F.least(F.greatest(F.lit(1), F.bround(F.col("_n") * test)), F.col("_n") - 1).alias("_k"))
    ranked = hash_rank(df, [label], ident, seed, name="_r")
    return ranked.join(F.broadcast(n), F.col(label).eqNullSafe(F.col("_l"))).withColumn(name, F.when(F.col("_r") <= F.col("_k"), "test").otherwise("train")).drop("_r", "_k", "_l")


def three_way(df: DataFrame, label: str, ident: str, test: float, val: float, seed: int = 42) -> DataFrame:
    """Test first, then validation as a share of what is left."""
    n = counts_of(df, [label]).select(F.col(label).alias("_l"), F.col("_n"), F.least(F.greatest(F.lit(1), F.bround(F.col("_n") * test)), F.col("_n") - 1).alias("_k"))
    n = n.withColumn("_v", F.least(F.greatest(F.lit(1), F.bround((F.col("_n") - F.col("_k")) * (val / (1 - test)))), F.col("_n") - F.col("_k") - 1))
    ranked = hash_rank(df, [label], ident, seed, name="_r").join(F.broadcast(n), F.col(label).eqNullSafe(F.col("_l")))
    return ranked.withColumn("split", F.when(F.col("_r") <= F.col("_k"), "test").when(F.col("_r") <= F.col("_k") + F.col("_v"), "val").otherwise("train")).drop("_r", "_k", "_v", "_n", "_l")


def floor_split(df: DataFrame, label: str, ident: str, seed: int = 42) -> DataFrame:
    """80 / 10 / 10 per label by floors, with one row at least in test and validation where there are three."""
    n = counts_of(df, [label]).select(F.col(label).alias("_l"), F.col("_n"), F.when(F.col("_n") >= 3, F.greatest(F.lit(1), F.floor(F.col("_n") * 0.1))).otherwise(0).alias("_k"))
    ranked = hash_rank(df, [label], ident, seed, name="_r").join(F.broadcast(n), F.col(label).eqNullSafe(F.col("_l")))
    return ranked.withColumn("split", F.when(F.col("_r") <= F.col("_k"), "test").when(F.col("_r") <= 2 * F.col("_k"), "val").otherwise("train")).drop("_r", "_k", "_n", "_l")


def greedy_domains(df: DataFrame, label: str, domain: str, test: float, val: float, seed: int = 42) -> DataFrame:
    """(label, domain, rows, split): domains in seeded order fill test, then validation, by the rows before them; per label."""
    d = counts_of(df.where(F.col(domain).isNotNull() & F.col(label).isNotNull()), [label, domain], "rows").withColumn("_h", seeded(domain, seed)).withColumn("_p", F.substring("_h", 1, 3))
    # rows before a domain: of the prefixes before its own, and within its prefix
    sums = d.groupBy(label, "_p").agg(F.sum("rows").alias("_n")).withColumn("_off", F.coalesce(F.sum("_n").over(Window.partitionBy(label).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums = sums.withColumn("_all", F.sum("_n").over(Window.partitionBy(label))).drop("_n")
    inner = F.coalesce(F.sum("rows").over(Window.partitionBy(label, "_p").orderBy("_h", domain).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    d = d.join(sums, [label, "_p"]).withColumn("_before", inner + F.col("_off"))
    t, v = F.bround(F.col("_all") * test), F.bround(F.col("_all") * val)
    # test is full at the first domain with at least t rows before it; validation counts from there
    full = F.min(F.when(F.col("_before") >= t, F.col("_before"))).over(Window.partitionBy(label))
    d = d.withColumn("_full", F.coalesce(full, F.col("_all")))
    split = F.when(F.col("_before") < t, "test").when(F.col("_before") - F.col("_full") < v, "val").otherwise("train")
    return d.select(label, domain, "rows", split.alias("split"))


def overlap_counts(df: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that two splits share, for each pair of splits (0 where disjoint)."""
    splits = df.where(F.col(key).isNotNull() & F.col(split).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set(split)).alias("s"))
    pairs = splits.select(F.explode("s").alias("a"), "s").select("a", F.explode(F.filter("s", lambda x: x > F.col("a"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))
