"""Fits the weights of ``mainbody`` on labelled pages.

    python -m pagesieve.llm.train_mainbody TABLES OUT.json

A page is labelled if ``grad_rows`` has its cleaned text: the blocks that make up the text, one after the other, are
body. Texts are cut at ``CUT`` characters (the last word dropped); blocks behind a cut are unknown and left out, so pages of
short texts, which are known to their end, come first. At most ``TRAIN_PAGES`` pages are used.

One site in ``HELD_OUT`` (a registered domain, by its hash) is kept out of the fit; the accuracy on its pages, and on all pages of
the sites of other tables that the fit has not seen, is what the README reports.

    python -m pagesieve.llm.train_mainbody TABLES OUT.json [MORE_TABLES]
"""

from __future__ import annotations

import copy
import json
import sys
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesieve.functions.urls import registered_domain, suffix_list
from pagesieve.llm import mainbody
from pagesieve.runtime import table

CUT, HELD_OUT = 400, 5


def labelled_pages(spark: SparkSession, tables: str, most: int = mainbody.TRAIN_PAGES) -> DataFrame:
    """(html, clean, site, held) of at most ``most`` pages for the fit and a quarter as many that are held out, chosen by a hash; two fifths of them with texts that are not cut."""
    clean = F.regexp_extract("clean_text", r"Visible text: (.*)\n", 1)
    rows = table(spark, tables, "grad_rows").groupBy("id").agg(F.min("clean_text").alias("clean_text")).select("id", clean.alias("clean")).where("clean <> ''")
    suffixes = suffix_list(table(spark, tables, "suffixes"))
    pages = table(spark, tables, "page_docs").where("length(html) > 0").groupBy("id").agg(F.min(F.struct("html", "url")).alias("p"))
    pages = pages.select("id", "p.html", F.coalesce(registered_domain(F.col("p.url"), suffixes), F.lit("")).alias("site"))
    both = pages.join(rows, "id").withColumn("order", F.xxhash64("id")).withColumn("held", F.pmod(F.xxhash64("site"), F.lit(HELD_OUT)) == 0)
    parts = []
    for held, n in ((False, most), (True, most // 4)):
        mine = both.where(F.col("held") == held)
        parts.append(mine.where(F.length("clean") < CUT - 50).orderBy("order").limit(n * 2 // 5))
        parts.append(mine.where(F.length("clean") >= CUT - 50).orderBy("order").limit(n - n * 2 // 5))
    return reduce(DataFrame.unionByName, parts).select("html", "clean", "site", "held")


def known_blocks(rows: list[tuple[str, str]]) -> tuple[mainbody.Blocks, np.ndarray]:
    """Blocks whose label is known, with features of their whole pages, and the labels."""
    pages = [mainbody.parse(h) for h, _ in rows]
    labels = [mainbody.aligned_labels(p, c, CUT)[0] for p, (_, c) in zip(pages, rows)]
    whole = mainbody.Blocks(pages)
    keep, y = np.zeros(len(whole.bids), bool), np.zeros(len(whole.bids), np.int64)
    for s, known in zip(np.cumsum(whole.count) - whole.count, labels):
        keep[s : s + len(known)], y[s : s + len(known)] = True, known
    cut, place = copy.copy(whole), np.cumsum(keep) - 1
    ok = keep[whole.rows]
    cut.rows, cut.ids = place[whole.rows[ok]], whole.ids[ok]
    for name in ("step", "page", "bids", "empty"):
        setattr(cut, name, getattr(whole, name)[keep])
    cut.count = np.bincount(cut.page, minlength=len(whole.count))
    return cut, y[keep]


def tested(model: dict, rows: list[tuple[str, str]]) -> dict[str, int]:
    """Blocks of known label, and how many of them the model gets wrong."""
    pages = [mainbody.parse(h) for h, _ in rows]
    whole = mainbody.Blocks(pages)
    flags = mainbody.body_flags(whole, (model["weights"], np.array(model["transitions"])))
    blocks = missed = false = 0
    for start, p, (_, clean) in zip(np.cumsum(whole.count) - whole.count, pages, rows):
        known = np.array(mainbody.aligned_labels(p, clean, CUT)[0], bool)
        mine = flags[start : start + len(known)]
        blocks, missed, false = blocks + len(known), missed + int((known & ~mine).sum()), false + int((~known & mine).sum())
    return {"pages": len(rows), "blocks": blocks, "missed": missed, "false": false}


def main(tables: str, out: str, more: str = "") -> None:
    spark = SparkSession.builder.getOrCreate()
    rows = labelled_pages(spark, tables).collect()
    seen = [r for r in rows if not r["held"]]
    blocks, labels = known_blocks([(r["html"], r["clean"]) for r in seen])
    sites = np.unique([r["site"] for r in seen], return_inverse=True)[1]
    model = mainbody.fit(blocks, labels, sites)
    with open(out, "w") as f:
        json.dump(model, f, ensure_ascii=False, indent=0)
    print(len(seen), "pages of", sites.max() + 1, "sites; held-out sites:", tested(model, [(r["html"], r["clean"]) for r in rows if r["held"]]))
    if more:
        known = {r["site"] for r in seen}
        other = [r for r in labelled_pages(spark, more).collect() if r["site"] not in known]
        print("sites of other tables:", tested(model, [(r["html"], r["clean"]) for r in other]))


if __name__ == "__main__":
    main(*sys.argv[1:4])
