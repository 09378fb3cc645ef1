"""Audit of labelled records: entropy, mutual information, purity, shortcuts, redundancy, inventories.

Everything is a partial aggregation to counts per (item, label) and arithmetic on those counts; records are never gathered.
Ties between labels go to the smaller one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagesieve.runtime import running_sums

# Thresholds of purity and information, and the quantiles that are tried as thresholds.
HIGH_PURITY, MEDIUM_PURITY, HIGH_NMI, MEDIUM_NMI = 0.95, 0.85, 0.25, 0.10
QUANTILES = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95)


def plogp(n: Column, total: Column) -> Column:
    """-p log2 p of a count."""
    p = n.cast("double") / total
    return F.when((n > 0) & (total > 0), -p * F.log2(p)).otherwise(F.lit(0.0))


def label_counts(df: DataFrame, column: str) -> DataFrame:
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def crosstab(df: DataFrame, rows: str, label: str, values: list[str]) -> DataFrame:
    """Contingency of two columns; null rows are '<missing>'."""
    return df.groupBy(F.coalesce(rows, F.lit("<missing>")).alias(rows)).agg(*[F.sum((F.col(label) == v).cast("int")).alias(v) for v in values], F.count("*").alias("total"))


def association(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: entropies of x and y, their mutual information, and it normalized by H(y) and by the mean of both."""
    xy = df.groupBy(x, y).agg(F.count("*").alias("n"))
    w = lambda *k: F.sum("n").over(Window.partitionBy(*k))
    # counts of pairs are few however many the records
    xy = xy.select(x, y, "n", w(x).alias("nx"), w(y).alias("ny"), w().alias("t"))
    mi = F.sum(F.col("n") / F.col("t") * F.log2(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny"))))
    # each x has its count repeated for each y: weighted back by n / nx
    h = lambda k: F.sum(plogp(F.col(k), F.col("t")) * F.col("n") / F.col(k))
    one = xy.agg(h("nx").alias("hx"), h("ny").alias("hy"), mi.alias("mi"))
    r = lambda c: F.round(c, 6)
    return one.select(r("hx").alias("entropy_x"), r("hy").alias("entropy_y"), r("mi").alias("mi"), r(F.coalesce(F.col("mi") / F.nullif("hy", F.lit(0.0)), F.lit(0.0))).alias("nmi"), r(F.coalesce(2 * F.col("mi") / F.nullif(F.col("hx") + F.col("hy"), F.lit(0.0)), F.lit(0.0))).alias("nmi_mean"))


def _mi_of_item(items: DataFrame, totals: DataFrame, target: str) -> DataFrame:
    """(item, support, mi, nmi, top, purity, entropy_present) of items against a target, from counts alone.

    ``items``: item, target, n (records with the item); ``totals``: target, all.
    """
    base = totals.agg(F.sum("all").alias("total")).crossJoin(totals.agg(F.collect_list(F.struct(F.col(target).alias("k"), F.col("all").alias("v"))).alias("_all")))  # one row: the labels are few
    per = items.groupBy("item").agg(F.sum("n").alias("support"), F.map_from_entries(F.collect_list(F.struct(target, "n"))).alias("_m"), F.max(F.struct(F.col("n"), F.lit(0))).alias("_x"))
    top = items.groupBy("item").agg(F.min(F.struct((-F.col("n")).alias("k"), F.col(target).alias("label"))).alias("_t"))
    j = per.join(top, "item").crossJoin(F.broadcast(base))
    total, support = F.col("total"), F.col("support")
    ent = lambda get, whole: F.aggregate("_all", F.lit(0.0), lambda a, e: a + plogp(get(e), whole))
    present = lambda e: F.coalesce(F.try_element_at("_m", e["k"]), F.lit(0))
    j = j.withColumns({"_h": ent(lambda e: e["v"], total), "_hp": ent(present, support), "_ha": ent(lambda e: e["v"] - present(e), total - support)})
    mi = F.when((support <= 0) | (support >= total), 0.0).otherwise(F.col("_h") - support / total * F.col("_hp") - (total - support) / total * F.col("_ha"))
    return j.select("item", "support", "total", mi.alias("mi"), F.coalesce(mi / F.nullif("_h", F.lit(0.0)), F.lit(0.0)).alias("nmi"), F.col("_t.label").alias("top"), (-F.col("_t.k") / support).alias("purity"), F.col("_hp").alias("entropy_present"))


def risk(purity: Column, nmi: Column, source_nmi: Column) -> Column:
    return F.when((purity >= HIGH_PURITY) | (nmi >= HIGH_NMI), "high").when((purity >= MEDIUM_PURITY) | (nmi >= MEDIUM_NMI) | (source_nmi >= MEDIUM_NMI), "medium").otherwise("low")


def item_rows(records: DataFrame, items: DataFrame, min_count: int = 20, source: str | None = "source") -> DataFrame:
    """Audit row of every item (a feature id, a term, a host suffix): support, purity, information about label and source, risk.

    ``records``: id, label, source; ``items``: id, item, each once.
    """
    marked = items.join(records, "id")
    n = F.count("*").alias("n")
    by_label = _mi_of_item(marked.groupBy("item", "label").agg(n), records.groupBy("label").agg(F.count("*").alias("all")), "label").where(F.col("support") >= min_count)
    if source:
        by_source = _mi_of_item(marked.groupBy("item", source).agg(n), records.groupBy(source).agg(F.count("*").alias("all")), source).select("item", F.col("nmi").alias("source_nmi"))
        by_label = by_label.join(by_source, "item")
    else:
        by_label = by_label.withColumn("source_nmi", F.lit(0.0))
    varied = records.agg(F.countDistinct("label").alias("_labels"))
    r = lambda c: F.round(c, 6)
    return by_label.crossJoin(F.broadcast(varied)).select(
        "item", "support", r(F.col("support") / F.col("total")).alias("support_ratio"), F.col("top").alias("top_label"), r("purity").alias("purity"), r("entropy_present").alias("entropy_present"), r("mi").alias("mi"), r("nmi").alias("label_nmi"), r("source_nmi").alias("source_nmi"),
        F.when(F.col("_labels") < 2, "inconclusive").otherwise(risk(r("purity"), r("nmi"), r("source_nmi"))).alias("risk"),
    )


def source_purity(df: DataFrame, source: str, label: str) -> DataFrame:
    c = df.groupBy(source, label).agg(F.count("*").alias("n"))
    out = c.groupBy(source).agg(F.sum("n").alias("records"), F.min(F.struct((-F.col("n")).alias("k"), F.col(label).alias("label"))).alias("t"))
    return out.select(source, "records", F.col("t.label").alias("top_label"), F.round(-F.col("t.k") / F.col("records"), 6).alias("purity"))


def measure_splits(df: DataFrame, label: str, measures: list[str]) -> DataFrame:
    """Best threshold of every measure by information about the label (then purity, support, smaller threshold).

    Candidates are all values of a measure if there are 20 or fewer, else 11 quantiles of its distinct values. The values are first
    counted per label, so that candidates meet distinct values and not records.
    """
    long = df.where(F.col(label).isNotNull()).select(label, *[F.col(m).cast("double").alias(m) for m in measures]).unpivot(label, measures, "measure", "value").where(F.col("value").isNotNull())
    counts = long.groupBy("measure", "value", label).agg(F.count("*").alias("n"))
    # running counts per label over the distinct values: what lies at or above a value
    labels = F.map_from_entries(F.collect_list(F.struct(label, "n")))
    values = counts.groupBy("measure", "value").agg(labels.alias("m"))
    at = running_sums(values.withColumn("one", F.lit(1)), ["measure"], "value", ["one"]).withColumnsRenamed({"one_upto": "rank", "one_all": "distinct"})
    picks = F.array(*[F.floor(F.lit(q) * (F.col("distinct") - 1)).cast("int") for q in QUANTILES])
    candidates = at.where((F.col("distinct") <= 20) | F.array_contains(picks, (F.col("rank") - 1).cast("int"))).select("measure", F.col("value").alias("threshold"))
    # at most 20 thresholds a measure
    sums = counts.join(F.broadcast(candidates), "measure").groupBy("measure", "threshold", label).agg(F.sum("n").alias("all"), F.sum(F.when(F.col("value") >= F.col("threshold"), F.col("n")).otherwise(0)).alias("ge"))
    total = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("rows"))
    grid = sums.join(F.broadcast(total), label).withColumn("lt", F.col("all") - F.col("ge"))
    agg = grid.groupBy("measure", "threshold").agg(F.collect_list(F.struct(F.col(label).alias("label"), "rows", "ge", "lt")).alias("l"), F.sum("ge").alias("n_ge"), F.sum("lt").alias("n_lt"), F.sum("rows").alias("total"))
    ent = lambda get, whole: F.aggregate("l", F.lit(0.0), lambda a, e: a + plogp(get(e), whole))
    g, t = F.col("n_ge"), F.col("total")
    h = ent(lambda e: e["rows"], t)
    mi = F.when((g <= 0) | (g >= t), 0.0).otherwise(h - g / t * ent(lambda e: e["ge"], g) - (t - g) / t * ent(lambda e: e["rows"] - e["ge"], t - g))
    best = lambda c: F.array_min(F.transform("l", lambda e: F.struct((-e[c]).alias("k"), e["label"].alias("label"))))
    agg = agg.withColumns({"mi": mi, "nmi": F.coalesce(mi / F.nullif(h, F.lit(0.0)), F.lit(0.0)), "bg": best("ge"), "bl": best("lt")})
    pg, pl = F.coalesce(-F.col("bg.k") / F.nullif("n_ge", F.lit(0)), F.lit(0.0)), F.coalesce(-F.col("bl.k") / F.nullif("n_lt", F.lit(0)), F.lit(0.0))
    ge = pg >= pl
    rows = agg.select("measure", "threshold", F.when(ge, ">=").otherwise("<").alias("operator"), F.when(ge, F.col("n_ge")).otherwise(F.col("n_lt")).alias("support"), F.when(ge, F.col("bg.label")).otherwise(F.col("bl.label")).alias("label"), F.round(F.greatest(pg, pl), 6).alias("purity"), F.round("mi", 6).alias("mi"), F.round("nmi", 6).alias("nmi"))
    order = Window.partitionBy("measure").orderBy(F.col("nmi").desc(), F.col("purity").desc(), F.col("support").desc(), "threshold")
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def measure_summary(df: DataFrame, label: str, measures: list[str]) -> DataFrame:
    """Count, mean, median and lower 90th percentile per label and measure."""
    long = df.where(F.col(label).isNotNull()).select(label, *[F.col(m).cast("double").alias(m) for m in measures]).unpivot(label, measures, "measure", "value").where(F.col("value").isNotNull())
    high = nearest_percentiles(long, ["measure", label], "value", {"p90": 0.9}, lower=True).select("measure", label, "p90")
    rest = long.groupBy("measure", label).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    middle = quantiles(long, ["measure", label], "value", {"median": 0.5}).withColumn("median", F.round("median", 6))
    return rest.join(middle, ["measure", label]).join(high, ["measure", label])


def quantiles(df: DataFrame, keys: list[str], column: str, wanted: dict[str, float]) -> DataFrame:
    """Quantiles between the nearest ranks, in proportion, per group, over counted values: no buffer holds all values of a group."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("n"))
    counts = running_sums(counts, keys, column, ["n"])
    first = F.col("n_upto") - F.col("n")  # ranks of a value: from first on, before n_upto

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= first) & (rank < F.col("n_upto")), F.col(column)))

    place = {k: F.lit(q) * (F.col("n_all") - 1) for k, q in wanted.items()}
    ends = [x for k, p in place.items() for x in (at(F.floor(p)).alias(f"{k}_low"), at(F.ceil(p)).alias(f"{k}_high"), F.max(p - F.floor(p)).alias(f"{k}_part"))]
    found = counts.groupBy(*keys).agg(*ends)
    return found.select(*keys, *[(F.col(f"{k}_low") + F.col(f"{k}_part") * (F.col(f"{k}_high") - F.col(f"{k}_low"))).alias(k) for k in wanted])


def nearest_percentiles(df: DataFrame, keys: list[str], column: str, quantiles: dict[str, float], lower: bool = False) -> DataFrame:
    """Nearest-rank percentiles (place rounded half to even, or down) per group, by ranks over counted values: no group is gathered."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("n"))
    counts = running_sums(counts, keys, column, ["n"]).withColumnsRenamed({"n_upto": "upto", "n_all": "total"})
    place = lambda q: (F.floor if lower else F.bround)(F.lit(q) * (F.col("total") - 1))
    at = lambda q: F.max(F.when((place(q) < F.col("upto")) & (place(q) >= F.col("upto") - F.col("n")), F.col(column)))
    return counts.groupBy(*keys).agg(F.sum("n").alias("count"), F.min(column).alias("least"), *[at(q).alias(k) for k, q in quantiles.items()], F.max(column).alias("most"), F.round(F.sum(F.col(column) * F.col("n")) / F.sum("n"), 6).alias("mean"))


def item_pairs(items: DataFrame, min_jaccard: float = 0.6, min_conditional: float = 0.9) -> DataFrame:
    """Items that go together: co-occurrence, Jaccard and conditional shares. ``items``: id, item, each once.

    The items of a record are paired within the record, so the cost is records times the square of items a record.
    """
    lists = items.groupBy("id").agg(F.sort_array(F.collect_set("item")).alias("s"))
    pairs = lists.select(F.explode("s").alias("a"), "s").select("a", F.explode(F.filter("s", lambda x: x > F.col("a"))).alias("b")).groupBy("a", "b").agg(F.count("*").alias("both"))
    n = items.groupBy("item").agg(F.count("*").alias("n"))
    j = pairs.join(n.select(F.col("item").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("item").alias("b"), F.col("n").alias("nb")), "b")
    r = lambda x, y: F.round(x / y, 6)
    j = j.select("a", "b", "both", r(F.col("both"), F.col("na") + F.col("nb") - F.col("both")).alias("jaccard"), r(F.col("both"), F.col("na")).alias("b_given_a"), r(F.col("both"), F.col("nb")).alias("a_given_b"))
    return j.where((F.col("jaccard") >= min_jaccard) | (F.greatest("b_given_a", "a_given_b") >= min_conditional))


def inventory(df: DataFrame, features: list[str]) -> DataFrame:
    """Kind, fire rate, missing share, mean, sample deviation, range and suggested action of numeric features."""
    whole = {c for c, t in df.dtypes if t in ("int", "bigint", "smallint", "tinyint")}
    long = df.select(*[F.col(f).cast("double").alias(f) for f in features]).withColumn("_", F.lit(0)).unpivot("_", features, "feature", "value")
    a = long.groupBy("feature").agg(
        F.count("*").alias("rows"), F.sum((F.coalesce("value", F.lit(0.0)) != 0).cast("int")).alias("fired"), F.sum(F.col("value").isNull().cast("int")).alias("missing"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("least"), F.max("value").alias("most"), F.coalesce(F.bool_and(F.col("value").isin(0.0, 1.0)), F.lit(True)).alias("zero_one"),
    )
    counts = F.col("feature").isin(*whole) if whole else F.lit(False)
    kind = F.when(F.col("zero_one"), "binary").when(counts, "count").when((F.col("least") >= 0) & (F.col("most") <= 1), "ratio").otherwise("continuous")
    fire = F.round(100 * F.col("fired") / F.col("rows"), 2)
    a = a.withColumns({"kind": kind, "fire_rate": fire})
    action = F.when(F.col("fire_rate") < 1, "drop (low fire rate)").when((F.col("fire_rate") > 99) & (F.col("kind") == "binary"), "drop (near-constant)").otherwise("keep")
    return a.select("feature", "kind", "fire_rate", F.round(100 * F.col("missing") / F.col("rows"), 2).alias("missing"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "least", "most", action.alias("action"))


def lift(df: DataFrame, label: str, features: list[str], positive: str, negative: str) -> DataFrame:
    """Fire rates and means of two classes, and their ratio (null where the second never fires)."""
    long = df.select(label, *[F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f) for f in features]).unpivot(label, features, "feature", "value")
    rate = lambda v: 100 * F.sum(((F.col(label) == v) & (F.col("value") != 0)).cast("int")) / F.sum((F.col(label) == v).cast("int"))
    mean = lambda v: F.avg(F.when(F.col(label) == v, F.col("value")))
    a = long.groupBy("feature").agg(rate(positive).alias("p"), rate(negative).alias("n"), mean(positive).alias("mp"), mean(negative).alias("mn"))
    return a.select("feature", F.round("p", 2).alias("fire_positive"), F.round("n", 2).alias("fire_negative"), F.round("mp", 6).alias("mean_positive"), F.round("mn", 6).alias("mean_negative"), F.round(F.col("p") / F.nullif("n", F.lit(0.0)), 2).alias("lift"), F.when(F.col("p") > F.col("n"), positive).otherwise(negative).alias("direction"))


def class_profiles(df: DataFrame, label: str, features: list[str], positive: str, negative: str) -> DataFrame:
    """Statistics of two classes per feature: means, medians, quartiles, effect size, threshold and the side on which the first lies."""
    long = df.where(F.col(label).isin(positive, negative)).select(label, *[F.col(f).cast("double").alias(f) for f in features]).unpivot(label, features, "feature", "value")
    of = lambda v: F.when(F.col(label) == v, F.col("value"))
    a = long.groupBy("feature").agg(F.avg(of(positive)).alias("pm"), F.avg(of(negative)).alias("nm"), F.stddev_pop("value").alias("sd"))
    q = quantiles(long, ["feature", label], "value", {"q1": 0.25, "md": 0.5, "q3": 0.75})
    by_class = q.groupBy("feature").agg(*[F.max(F.when(F.col(label) == v, F.col(c))).alias(n) for v, names in ((positive, ("p1", "pd", "p3")), (negative, ("n1", "nd", "n3"))) for c, n in zip(("q1", "md", "q3"), names)])
    a = a.join(by_class, "feature")
    effect = (F.col("pm") - F.col("nm")) / F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    equal = F.abs(F.col("pd") - F.col("nd")) < 1e-9
    a = a.withColumn("effect", effect).where(~((F.abs(F.col("effect")) < 0.03) & equal))
    threshold = F.when(equal, (F.col("pm") + F.col("nm")) / 2).otherwise((F.col("pd") + F.col("nd")) / 2)
    r = lambda c: F.round(c, 6)
    return a.select("feature", F.when(F.col("pm") >= F.col("nm"), "high").otherwise("low").alias("suspicious_when"), r(threshold).alias("threshold"), r("effect").alias("effect"), r("pm").alias("positive_mean"), r("nm").alias("negative_mean"), r("pd").alias("positive_median"), r("nd").alias("negative_median"), r("p1").alias("positive_q25"), r("p3").alias("positive_q75"), r("n1").alias("negative_q25"), r("n3").alias("negative_q75"))


def class_weights(df: DataFrame, label: str, cap: float = 20.0) -> DataFrame:
    """total / (classes x count), at most ``cap``."""
    c = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    w = Window.partitionBy()
    return c.select(label, "n", F.round(F.least(F.sum("n").over(w) / (F.count("*").over(w) * F.col("n")), F.lit(cap)), 6).alias("weight"))


def majority(df: DataFrame, key: str, label: str) -> DataFrame:
    """Most frequent label of each key, ties to the smaller."""
    c = df.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key, label).agg(F.count("*").alias("n"))
    return c.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("k"), F.col(label).alias("label"))).alias("t"), F.sum("n").alias("records")).select(key, F.col("t.label").alias("majority"), "records")


def binned_information(df: DataFrame, label: str, features: list[str], bins: int = 10) -> DataFrame:
    """Mutual information of equal-frequency bins of each feature with the label."""
    cuts = df.select(*[F.percentile_approx(F.col(f).cast("double"), [i / bins for i in range(1, bins)], 100_000).alias(f) for f in features]).first()
    binned = df.where(F.col(label).isNotNull())
    out = None
    for f in features:
        edges = sorted({x for x in (cuts[f] or [])})
        b = sum([(F.col(f).cast("double") >= e).cast("int") for e in edges], F.lit(0)) if edges else F.lit(0)
        one = association(binned.select(F.coalesce(b, F.lit(-1)).alias("b"), label), "b", label).select(F.lit(f).alias("feature"), "mi", "nmi")
        out = one if out is None else out.unionByName(one)
    return out
