"""Names of organizations in texts and hosts. Every list is a parameter: rows of (brand, alias) and of (brand, domain)."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shortest skeleton that is looked for, that may be embedded, and that is compared by similarity; most letters of difference, least similarity.
LEAST, EMBEDDED, SIMILAR, DELTA, RATIO = 5, 6, 7, 2, 0.88


def belongs(domain: Column, known: list[str]) -> Column:
    """Whether a domain is one of a list or lies under one."""
    found = F.lit(False)
    for k in known:
        found = found | (domain == k) | F.endswith(domain, F.lit("." + k))
    return F.coalesce((domain != "") & found, F.lit(False))


def relationship(source: Column, target: Column, source_domain: Column, target_domain: Column, providers: list[tuple[str, list[str]]], brands: dict[str, list[str]]) -> Column:
    """How a host stands to another: the first that holds of unknown, the same registered domain, a kind of known provider (in the order given), the same brand, unrelated."""
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    s, t, sd, td = low(source), low(target), low(source_domain), low(target_domain)
    out = F.when((s == "") | (t == ""), "unknown").when((sd != "") & (sd == td), "same_registrable_domain")
    for kind, known in providers:
        out = out.when(belongs(t, known) | belongs(td, known), kind)
    together = F.lit(False)
    for domains in brands.values():
        together = together | (belongs(sd, domains) & belongs(td, domains))
    return out.when(together, "same_organization_or_alias").otherwise("unrelated_third_party")


def claims(text: Column, aliases: dict[str, list[str]], generic: list[str]) -> Column:
    """(brand, matched) of every brand that a text names, each by the longest of its aliases that occurs; none in generic titles."""
    low = F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))
    found = []
    for brand, names in aliases.items():
        hit = F.lit(None).cast("string")
        for name in sorted(names, key=len):  # the longest is asked first
            hit = F.when(low.rlike(r"\b" + r"\s+".join(re.escape(w) for w in name.split()) + r"\b"), F.lit(name)).otherwise(hit)
        found.append(F.when(hit.isNotNull(), F.struct(F.lit(brand).alias("brand"), hit.alias("matched"))))
    return F.when(low.isin(generic), F.array().cast("array<struct<brand:string,matched:string>>")).otherwise(F.array_compact(F.array(*found)))


def skeleton(label: Column, look: str, like: str) -> Column:
    """A label as the eye reads it: look-alikes replaced, other characters dropped, rn and vv read as m and w."""
    s = F.regexp_replace(F.translate(F.lower(label), look, like), "[^a-z0-9]+", "")
    return F.replace(F.replace(s, F.lit("rn"), F.lit("m")), F.lit("vv"), F.lit("w"))


def label_parts(host: Column, domain: Column, generic: list[str]) -> Column:
    """Labels of a host without generic ones, that of its registered domain first, and their parts between hyphens."""
    labels = F.filter(F.split(host, r"\."), lambda x: (x != "") & ~x.isin(generic))
    whole = F.concat(F.array(F.substring_index(domain, ".", 1)), labels)
    return F.array_distinct(F.concat(whole, F.flatten(F.transform(whole, lambda x: F.split(x, "[-_]+")))))


def nearest_alias(parts: Column, aliases: list[tuple[str, str, str]]) -> Column:
    """(brand, alias, label, kind, similarity) of the first skeleton that equals, embeds or resembles that of an alias; ``aliases`` are (brand, alias, skeleton) in their order.

    Meant for distinct hosts: the similarity of skeletons has no built-in.
    """
    known = [a for a in aliases if len(a[2]) >= LEAST]

    def one(labels) -> tuple | None:
        for x in labels if labels is not None else ():
            if len(x) < LEAST:
                continue
            for brand, alias, s in known:
                if s == x:
                    return brand, alias, x, "exact", 1.0
                if len(s) >= EMBEDDED and s in x:
                    return brand, alias, x, "embedded", None
                if len(s) >= SIMILAR and abs(len(s) - len(x)) <= DELTA and (r := SequenceMatcher(None, x, s).ratio()) >= RATIO:
                    return brand, alias, x, "similar", round(r, 4)
        return None

    def run(column):
        return pd.DataFrame([one(v) or (None,) * 5 for v in column], columns=["brand", "alias", "label", "kind", "similarity"])

    run.__annotations__ = {"column": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(run, "brand string, alias string, label string, kind string, similarity double")(parts)
