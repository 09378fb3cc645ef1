"""Train, validation and test splits in which related records stay together.

Records that share an author, source or entity (here: registered domains) form a component; components
are found by label propagation with pointer jumping over the links between group keys. Their weights are then
balanced by largest differencing: the extreme weights are combined again and again into ``BINS`` equal bins, and whole bins go to
the splits by target proportion. More components than one task takes (``BLOCK``) are first
combined, by the same differencing within blocks, to pieces of equal weight, a twentieth to a hundredth as many (a component that is heavier is a piece by
itself); pieces take the place of components until ``BLOCK`` or fewer are left for the last differencing.

Nothing that grows with the data comes to the driver or is broadcast: blocks and pieces are rows of tables, and
only the ``BINS`` sums of the last level are collected. Pieces make the bins less even than one differencing over all weights by at most a piece;
a test holds them within two percent of each other with and without pieces.

Records may carry a split already. The keys whose records lie in several of these are reported beside the new split (``before``).

Defined results: records without a group key form a component of their own each, by their identifier; an empty table gives an empty result;
a component heavier than a bin fills a bin alone and shows in the reported shares; repeated records count each.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesieve.runtime import materialize

BINS = 100
#: Components balanced in one task.
BLOCK = 20_000
#: Begins the key of a record that has none; no address holds it.
ALONE = "\x00"
#: Tasks over which the records of a key with many are dealt.
SALTS = 64


def balance(weights: list[float], bins: int) -> list[int]:
    """Bin of each weight by largest differencing: of the tuples of ``bins`` sums the two with the largest spread are combined, heavy with light, until one is left."""
    n = len(weights)
    behind = np.full(n, -1)  # members of a sum are a chain
    heap = [(-w, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    tuples: dict[int, tuple] = {}

    def take() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        _, i = heapq.heappop(heap)
        if i in tuples:
            return tuples.pop(i)
        alone = np.zeros(bins), np.full(bins, -1), np.full(bins, -1)
        for column, v in zip(alone, (weights[i], i, i)):
            column[0] = v
        return alone

    made = n
    while len(heap) > 1:
        (wa, first_a, last_a), (wb, first_b, last_b) = take(), take()
        w, first_b, last_b = wa + wb[::-1], first_b[::-1], last_b[::-1]
        both = (last_a >= 0) & (first_b >= 0)
        behind[last_a[both]] = first_b[both]
        first, last = np.where(first_a >= 0, first_a, first_b), np.where(last_b >= 0, last_b, last_a)
        order = np.argsort(-w, kind="stable")
        w = w[order]
        tuples[made] = w, first[order], last[order]
        heapq.heappush(heap, (w[-1] - w[0], made))
        made += 1
    out = [0] * n
    if n:
        for k, i in enumerate(take()[1].tolist()):
            while i >= 0:
                out[i] = k
                i = int(behind[i])
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes of undirected links (a, b); the component is its smallest node.

    Each round takes the smallest label among the neighbours and then the label of that label, so the
    number of rounds grows with the logarithm of the diameter.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a is not null and b is not null and a <> b").distinct()
    edges = materialize(both, "components")
    labels = materialize(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")), "components")
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", "component", F.least("component", "near").alias("low"))
        up = labels.select(F.col("node").alias("_n"), F.col("component").alias("_c"))
        step = materialize(step.join(up, F.col("low") == F.col("_n"), "left").select("node", F.col("component").alias("before"), F.coalesce("_c", "low").alias("component")), "components")
        changed = step.where(F.col("before") != F.col("component")).limit(1).count()
        labels = step.select("node", "component")
        if not changed:
            return labels


def _block_bins(bins: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "component"], ascending=[False, True], ignore_index=True)
        return pd.DataFrame({"block": pdf["block"], "component": pdf["component"], "weight": pdf["weight"], "bin": balance(pdf["weight"].tolist(), bins)})

    return run


def balanced_bins(weights: DataFrame, bins: int = BINS, block: int | None = None) -> DataFrame:
    """(component, weight, bin) of the components in ``weights`` (component, weight)."""
    block = block or BLOCK
    weights = left = materialize(weights.select("component", F.col("weight").cast("double").alias("weight")), "bins")
    n, levels = left.count(), []
    schema = "block int, component string, weight double, bin int"
    while n > block:
        blocks = -(-n // block)
        pieces = max(block // 100, min(block // 20, block // blocks), 1)
        placed = left.withColumn("block", F.pmod(F.xxhash64("component"), F.lit(blocks)).cast("int")).groupBy("block").applyInPandas(_block_bins(pieces), schema)
        placed = materialize(placed.select("component", "weight", F.concat_ws(":", F.lit(len(levels)), "block", "bin").alias("piece")), "bins")
        levels.append(placed.select("component", "piece"))
        left = materialize(placed.groupBy("piece").agg(F.sum("weight").alias("weight")).withColumnRenamed("piece", "component"), "bins")
        n = left.count()
    placed = left.withColumn("block", F.lit(0)).groupBy("block").applyInPandas(_block_bins(bins), schema).select("component", "bin")
    for level in reversed(levels):
        placed = materialize(level.join(placed.withColumnRenamed("component", "piece"), "piece").select("component", "bin"), "bins")
    return weights.join(placed, "component")


def bins_to_splits(weights: list[float], targets: dict[str, float]) -> list[str]:
    """Split of each bin: bins by falling weight, each to the split that is furthest below its target."""
    total, given = sum(weights), dict.fromkeys(targets, 0.0)
    out = [""] * len(weights)
    for i in sorted(range(len(weights)), key=lambda i: (-weights[i], i)):
        s = max(targets, key=lambda s: (targets[s] * total - given[s], targets[s], s))
        given[s] += weights[i]
        out[i] = s
    return out


def grouped_splits(records: DataFrame, key: str, targets: dict[str, float], links: DataFrame | None = None, bins: int = BINS, ident: str | None = None, before: str | None = None) -> DataFrame:
    """(key, component, split, n) of the distinct keys of ``records``; ``links`` (a, b) ties keys together.

    Records without a key are keys of their own (``ALONE`` and the value of ``ident``), or left out where no ``ident`` is named. With ``before``, a column of
    splits given already, a column ``before`` has those in which the records of the key lie.
    """
    node = F.nullif(F.col(key), F.lit(""))
    if ident:
        node = F.coalesce(node, F.concat(F.lit(ALONE), F.col(ident).cast("string")))
    given = [F.array_sort(F.collect_set(before)).alias("before")] if before else []
    counted = records.select(node.alias("node"), *([before] if before else [])).where(F.col("node").isNotNull()).groupBy("node").agg(F.count("*").alias("n"), *given)
    if links is not None:
        counted = counted.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    else:
        counted = counted.withColumn("component", F.col("node"))
    counted = materialize(counted, "split")
    placed = materialize(balanced_bins(counted.groupBy("component").agg(F.sum("n").alias("weight")), bins), "split")
    sums = {r["bin"]: r["w"] for r in placed.groupBy("bin").agg(F.sum("weight").alias("w")).collect()}  # one row a bin
    order = sorted(sums)
    chosen = dict(zip(order, bins_to_splits([sums[b] for b in order], targets)))
    names = F.create_map(*[x for b, s in chosen.items() for x in (F.lit(b), F.lit(s))]) if chosen else F.create_map(F.lit(-1), F.lit(""))
    out = counted.join(placed.select("component", F.try_element_at(names, F.col("bin")).alias("split")), "component")
    return out.select(F.col("node").alias(key), "component", "split", "n", *(["before"] if before else []))


def assigned_records(records: DataFrame, key: str, ident: str, splits: DataFrame) -> DataFrame:
    """``records`` with the split of their key. A hot key's records are dealt over ``SALTS`` tasks."""
    node = F.coalesce(F.nullif(F.col(key), F.lit("")), F.concat(F.lit(ALONE), F.col(ident).cast("string")))
    salted = records.withColumn("_node", node).withColumn("_salt", F.pmod(F.xxhash64(ident), F.lit(SALTS)).cast("int"))
    copies = splits.select(F.col(key).alias("_node"), F.col("split").alias("_split"), F.explode(F.when(F.col("n") > SALTS, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(-1)))).alias("_salt"))
    hot = F.col("_salt") >= 0
    many, few = copies.where(hot), copies.where(~hot).drop("_salt")
    # keys with more records than salts meet them by key and salt, the others by key alone
    by_salt = salted.join(many, ["_node", "_salt"], "left").withColumnRenamed("_split", "_many")
    rest = by_salt.where(F.col("_many").isNull()).join(few, "_node")
    kept = [c for c in records.columns if c != "split"]  # a split given before gives way
    return by_salt.where(F.col("_many").isNotNull()).select(*kept, F.col("_many").alias("split")).unionByName(rest.select(*kept, F.col("_split").alias("split")))


def reached_shares(splits: DataFrame, targets: dict[str, float]) -> DataFrame:
    """Records and keys of each split, the share reached and the one wanted."""
    wanted = F.create_map(*[x for s, t in targets.items() for x in (F.lit(s), F.lit(float(t)))])
    by = splits.groupBy("split").agg(F.sum("n").alias("records"), F.count("*").alias("keys"))
    total = by.agg(F.sum("records").alias("_all"))
    return by.crossJoin(total).select("split", "keys", "records", F.round(F.col("records") / F.col("_all"), 6).alias("share"), F.try_element_at(wanted, F.col("split")).alias("target_share"))  # one row beside one row a split


def split_conflicts(splits: DataFrame, key: str) -> DataFrame:
    """The keys of ``grouped_splits`` whose records lie in more than one of the splits given before."""
    return splits.where((F.size("before") > 1) & ~F.startswith(F.col(key), F.lit(ALONE)))
