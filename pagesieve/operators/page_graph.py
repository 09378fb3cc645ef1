"""Heterogeneous page graph: links of a page to domain and resource objects, and the scores they spread.

Every object has a base score from its relations (foreign and null +1, relative +1/4, local -1, over their number). Scores
are spread as s = 0.6 base + 0.4 mean(s). The bases lie in [-1, 1], so the mean stays that of the bases and the
second step changes nothing: the fixed point has a closed form and two aggregations take the place of the iteration.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.functions.urls import host, registered_domain_of_host

SPREAD = 0.4


def relation(ref: Column, base_domain: Column, suffixes: list[str]) -> Column:
    """(relation, key) of a reference."""
    low = F.lower(F.trim(F.coalesce(ref, F.lit(""))))
    null = low.isin("", "#", "/", "about:blank") | low.rlike("^(javascript:|mailto:|tel:)")
    absolute = low.rlike("^(https?:)?//")
    domain = F.coalesce(registered_domain_of_host(host(low), suffixes), F.lit(""))
    kind = F.when(null, "null").when(~absolute, "relative").when(domain == base_domain, "local").otherwise("foreign")
    key = F.when(null, "<null>").when(~absolute, "<relative>").otherwise(domain)
    return F.struct(kind.alias("relation"), key.alias("key"))


def edges(pages: DataFrame, suffixes: list[str]) -> DataFrame:
    """(id, kind, relation, key) from pages with id, base, domain_refs and resource_refs."""
    base = F.coalesce(registered_domain_of_host(host(F.col("base")), suffixes), F.lit(""))
    none = F.array().cast("array<string>")
    refs = F.concat(*[F.transform(F.coalesce(c, none), lambda r: F.struct(F.lit(k).alias("kind"), r.alias("ref"))) for k, c in (("domain", "domain_refs"), ("resource", "resource_refs"))])
    e = pages.select("id", base.alias("base_domain"), F.explode(refs).alias("e")).select("id", "base_domain", "e.kind", "e.ref")
    e = e.withColumn("r", relation(F.col("ref"), F.col("base_domain"), suffixes))
    return e.select("id", "kind", "r.relation", "r.key")


def graph_scores(pages: DataFrame, suffixes: list[str]) -> DataFrame:
    """The numeric columns of the graph, a row for every page; pages without links have zeros."""
    n = lambda v: F.sum((F.col("relation") == v).cast("int"))
    nodes = edges(pages, suffixes).groupBy("id", "kind", "key").agg(n("local").alias("l"), n("foreign").alias("f"), n("null").alias("n"), n("relative").alias("r"))
    nodes = nodes.withColumn("b", (F.col("f") + F.col("n") + 0.25 * F.col("r") - F.col("l")) / (F.col("l") + F.col("f") + F.col("n") + F.col("r")))
    of = lambda k, c: F.when(F.col("kind") == k, F.col(c))
    total = lambda k, c: F.coalesce(F.sum(of(k, c)), F.lit(0))
    g = nodes.groupBy("id").agg(
        F.avg("b").alias("m"), F.var_pop("b").alias("v"), F.max("b").alias("hi"), F.min("b").alias("lo"), *[total(k, c).alias(f"{p}_{w}_link") for k, p in (("domain", "dom"), ("resource", "res")) for c, w in (("l", "local"), ("f", "foreign"), ("n", "null"), ("r", "relative"))],
        *[x for k, p in (("domain", "dom"), ("resource", "resource")) for x in (F.avg(of(k, "b")).alias(f"m_{p}"), F.var_pop(of(k, "b")).alias(f"v_{p}"), F.count(of(k, "b")).alias(f"n_{p}"))],
    )
    own = 1 - SPREAD
    r = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    g = pages.select("id").distinct().join(g, "id", "left")
    moves = SPREAD * F.greatest(F.col("hi") - F.col("m"), F.col("m") - F.col("lo"))
    links = [F.coalesce(F.col(f"{p}_{w}_link"), F.lit(0)).alias(f"{p}_{w}_link") for p in ("dom", "res") for w in ("local", "foreign", "null", "relative")]
    mean = lambda p: F.when(F.col(f"n_{p}") > 0, own * F.col(f"m_{p}") + SPREAD * F.col("m"))
    var = lambda p: own * own * F.col(f"v_{p}")
    return g.select("id", r(F.col("m")).alias("score"), F.when(F.coalesce(moves, F.lit(0.0)) < 1e-5, 1).otherwise(2).alias("iters"), *links, r(mean("dom")).alias("dom_mean"), r(var("dom")).alias("dom_var"), r(F.col("m")).alias("mean"), r(own * own * F.col("v")).alias("var"), F.coalesce("n_dom", F.lit(0)).alias("domain_object_count"), F.coalesce("n_resource", F.lit(0)).alias("resource_object_count"), r(mean("resource")).alias("resource_mean"), r(var("resource")).alias("resource_var"))
