"""Limit each contributor to a number of records, keeping its best.

Cutoffs are found by parallel bisection. Every contributor over the cap has bounds on its
cutoff score; in one pass all its undecided records are counted above each of
``MIDPOINTS - 1`` midpoints between the bounds, the interval in which the cap is reached becomes
the new bounds, and only the records within it stay undecided. When the bounds of a contributor meet,
its boundary is a tie; ties are narrowed in the same way along the identifier (six bytes at a time), until one record is
left of each boundary.

No contributor's records are ever sorted or gathered in one task: a pass is a partial
aggregation to at most ``MIDPOINTS`` counts a contributor, however many of the rows it holds. Bounds and cutoffs are brought to
the records by broadcast if there are at most ``BROADCAST`` of them (they are counted), else by a join over salted keys.

Defined results: records whose contributor is null or '' belong to nobody and are kept; null and
NaN scores rank last; equal scores are kept by smaller identifier; identifiers are taken as unique
(repeated ones count as one record, by their best score); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesieve.runtime import materialize

MIDPOINTS = 1024
#: Contributors whose bounds or cutoffs are broadcast; salts of a key beyond that.
BROADCAST, SALTS = 100_000, 32
_BOUND = 1e300


def _beside(records: DataFrame, few: DataFrame, small: bool, how: str = "inner") -> DataFrame:
    """``records`` with the row of ``few`` (one a key) beside each, without a task for a hot key; ``small``: the keys were counted and are at most ``BROADCAST``."""
    if small:
        return records.join(F.broadcast(few), "key", how)
    salted = records.withColumn("_salt", F.pmod(F.xxhash64("ident"), F.lit(SALTS)).cast("int"))
    return salted.join(few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["key", "_salt"], how).drop("_salt")


def _narrow(und: DataFrame, value: Column, small: bool) -> DataFrame:
    """One round: keep the records of the interval in which the need of their contributor is reached."""
    v = und.withColumn("_v", value)
    # bounds are those of the undecided records themselves, so that an interval always shrinks
    bounds = v.groupBy("key").agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    slot = F.when(F.col("_v").isNull(), F.lit(-1)).when(width <= 0, F.lit(0)).otherwise(F.least(F.floor((F.col("_v") - F.col("_lo")) / width * MIDPOINTS), F.lit(MIDPOINTS - 1))).cast("int")
    slotted = _beside(v, bounds, small).withColumn("_slot", slot)
    counts = slotted.groupBy("key", "_slot").agg(F.count("*").alias("_n"), F.first("need").alias("_need"))
    above = Window.partitionBy("key").orderBy(F.col("_slot").desc())
    reached = counts.withColumn("_cum", F.sum("_n").over(above)).where((F.col("_cum") >= F.col("_need")) & (F.col("_cum") - F.col("_n") < F.col("_need")))
    reached = reached.select("key", "_slot", (F.col("_need") - (F.col("_cum") - F.col("_n"))).alias("_left"))
    inside = _beside(slotted, reached.withColumnRenamed("_slot", "_at"), small).where(F.col("_slot") == F.col("_at"))
    return inside.select("key", "ident", "score", F.col("_left").alias("need"))


def _widest(und: DataFrame, value: Column) -> tuple[int, int]:
    """Largest number of undecided records of a contributor, of all and of those whose bounds have not met."""
    by_key = und.groupBy("key").agg(F.count("*").alias("n"), (F.max(value) > F.min(value)).alias("open"), (F.count(value) < F.count("*")).alias("nulls"), (F.count(value) > 0).alias("some"))
    row = by_key.agg(F.max("n").alias("n"), F.max(F.when(F.col("open") | (F.col("nulls") & F.col("some")), F.col("n"))).alias("open")).first()
    return row["n"] or 0, row["open"] or 0


def _ident_part(k: int) -> Column:
    """The k-th six bytes of the identifier as a number that falls as the identifier grows."""
    part = F.rpad(F.substring(F.hex(F.encode(F.col("ident"), "UTF-8")), 12 * k + 1, 12), 12, "0")
    return -F.conv(part, 16, 10).cast("double")


def cutoffs(records: DataFrame, cap: int) -> tuple[DataFrame, bool]:
    """(key, cut_score, cut_ident): the last record that each contributor over the cap keeps; and whether these are few enough to broadcast.

    ``records`` has key, ident and score, one row per identifier, and should be materialized.
    """
    over = records.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > cap).select("key")
    over = materialize(over, "cap")
    small = over.limit(BROADCAST + 1).count() <= BROADCAST  # only these keys have bounds and cutoffs
    und = materialize(_beside(records, over, small).withColumn("need", F.lit(cap).cast("long")), "cap")
    score, k = F.col("score"), -1
    while True:
        most, wide = _widest(und, score)
        if most <= 1:
            break
        if wide <= 1:  # bounds have met: the rest are ties
            k += 1
            # contributors whose boundary is not a tie keep their record
            part = _ident_part(k)
            tied = und.groupBy("key").agg((F.count("*") > 1).alias("_tied"))
            marked = _beside(und, tied, small)
            ties, rest = marked.where("_tied").drop("_tied"), marked.where("not _tied").drop("_tied")
            while True:
                ties = materialize(_narrow(ties, part, small), "cap")
                if _widest(ties, part)[1] <= 1:
                    break
            und = materialize(rest.unionByName(ties), "cap")
            continue
        und = materialize(_narrow(und, score, small), "cap")
    return und.select("key", F.col("score").alias("cut_score"), F.col("ident").alias("cut_ident")), small


def cap_contributors(records: DataFrame, key: str, ident: str, score: str, max_count: int | None = None, share: float | None = None, least: int = 1) -> DataFrame:
    """(key, ident, score, kept) of all records.

    ``max_count`` is the cap; or ``share`` of the number of identifiers, rounded down, ``least`` at the smallest.
    """
    s = F.col(score).cast("double")
    s = F.when(s.isNotNull() & ~F.isnan(s), F.greatest(F.least(s, F.lit(_BOUND)), F.lit(-_BOUND)))
    one = records.select(F.nullif(F.col(key), F.lit("")).alias("key"), F.col(ident).alias("ident"), s.alias("score")).where(F.col("ident").isNotNull())
    one = materialize(one.groupBy("ident").agg(F.max_by(F.struct("key", "score"), F.struct(F.col("score"), F.col("key"))).alias("b")).select("b.key", "ident", "b.score"), "cap")
    cap = max_count if max_count is not None else max(least, int(one.count() * share))
    cut, small = cutoffs(one.where(F.col("key").isNotNull()), cap)
    after = (F.col("score") < F.col("cut_score")) | (F.col("score").isNull() & F.col("cut_score").isNotNull()) | (F.col("score").eqNullSafe(F.col("cut_score")) & (F.col("ident") > F.col("cut_ident")))
    return _beside(one, cut, small, "left").select("key", "ident", "score", F.when(F.col("cut_ident").isNull(), True).otherwise(~F.coalesce(after, F.lit(False))).alias("kept"))
