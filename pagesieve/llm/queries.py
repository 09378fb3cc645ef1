"""Queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesieve.functions.urls import registered_domain, suffix_list
from pagesieve.llm import cap, groupsplit, leak, lookalike, mainbody, mix, overlap, residue, textstats
from pagesieve.runtime import latest, table

#: A registered domain may hold a fiftieth of the records, three at least.
SHARE, LEAST = 1 / 50, 3
TARGETS = {"train": 0.8, "val": 0.1, "test": 0.1}


def _latest_inputs(spark: SparkSession, sf_dir: str, fields: list[str], extra: list[str] = ()) -> DataFrame:
    seen = table(spark, sf_dir, "observations")
    columns = {f: F.col(f"input.{f}") for f in fields} | {c: F.col(c) for c in extra}
    return latest(seen, "id", ["captured_at", "ingested_at"], columns)


def _suffixes(spark: SparkSession, sf_dir: str) -> list[str]:
    return suffix_list(table(spark, sf_dir, "suffixes"))


def _capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _latest_inputs(spark, sf_dir, ["final_url", "url"], ["capture_score"])
    records = seen.select("id", "capture_score", registered_domain(F.coalesce("final_url", "url"), _suffixes(spark, sf_dir)).alias("domain"))
    return cap.cap_contributors(records, "domain", "id", "capture_score", share=SHARE, least=LEAST)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _capped(spark, sf_dir).where(~F.col("kept")).select(F.col("ident").alias("id"))


def p1_contributors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records kept and left out per registered domain over the cap."""
    out = _capped(spark, sf_dir).where(F.col("key").isNotNull()).groupBy(F.col("key").alias("registered_domain"))
    return out.agg(F.sum(F.col("kept").cast("int")).alias("kept"), F.sum((~F.col("kept")).cast("int")).alias("left_out")).where(F.col("left_out") > 0)


def _residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "observations").select("id", F.col("input.title").alias("title"), F.col("input.visible_text").alias("visible_text"), "captured_at", "ingested_at")
    return residue.template_residue(seen, "id", "title", "visible_text", ["captured_at", "ingested_at"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _residue(spark, sf_dir).select("id")


def p2_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _residue(spark, sf_dir).select("id", F.array_join("kinds", ",").alias("kinds"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = _latest_inputs(spark, sf_dir, ["title", "final_url"])
    return lookalike.lookalike_pairs(seen, "id", {"title": "title", "final_url": "final_url"})


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title and final address of every observation in their common form."""
    return lookalike.consistent_text(_latest_inputs(spark, sf_dir, ["title", "final_url"]), ["title", "final_url"])


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    # rows of an id have one content: parsed where they lie, then one kept, so that no html is shuffled
    return mainbody.page_bodies(table(spark, sf_dir, "page_docs"), "id", "html")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _bodies(spark, sf_dir).select("id", "bids").groupBy("id").agg(F.max("bids").alias("bids"))
    return one.select("id", F.explode("bids").alias("bid"))


def p4_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body text of every page, a block a line."""
    text = F.array_join("texts", "\n")
    return _bodies(spark, sf_dir).select("id", text.alias("body")).groupBy("id").agg(F.max("body").alias("body"))


def p4_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body of the visible text of every observation, a block a line."""
    seen = _latest_inputs(spark, sf_dir, ["visible_text"])
    return mainbody.visible_bodies(table(spark, sf_dir, "page_docs"), "id", "html", seen, "id", "visible_text")


def _overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.split_overlaps(table(spark, sf_dir, "grad_rows"), "id", "split", "url", "clean_text", "source")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overlaps(spark, sf_dir).select(F.least("train_id", "eval_id").alias("id_a"), F.greatest("train_id", "eval_id").alias("id_b")).distinct()


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlap_report(_overlaps(spark, sf_dir))


def _grad_domains(spark: SparkSession, sf_dir: str, suffixes: list[str]) -> DataFrame:
    """Rows of grad_rows with the registered domain of their address and the one they name."""
    named = F.nullif(registered_domain(F.col("registered_domain"), suffixes), F.lit(""))
    rows = table(spark, sf_dir, "grad_rows").select("id", "split", F.nullif(registered_domain(F.col("url"), suffixes), F.lit("")).alias("of_url"), named.alias("named"))
    return rows.select("id", "split", F.coalesce("of_url", "named").alias("domain"), F.coalesce("named", "of_url").alias("named"), "of_url")


def _links(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("domain") != F.col("named")).select(F.col("domain").alias("a"), F.col("named").alias("b")).distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit that the new splits come with: registered domains (by address) whose rows lay in several splits before."""
    rows = _grad_domains(spark, sf_dir, _suffixes(spark, sf_dir)).withColumn("given", F.when(F.col("of_url").isNotNull(), F.col("split")))
    splits = groupsplit.grouped_splits(rows, "domain", TARGETS, _links(rows), ident="id", before="given")
    return groupsplit.split_conflicts(splits, "domain").select(F.col("domain").alias("registered_domain"))


def _all_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Records of both tables (record, id, domain), and the links between domains."""
    suffixes = _suffixes(spark, sf_dir)
    seen = _latest_inputs(spark, sf_dir, ["final_url", "url"]).select(F.lit("observation").alias("record"), "id", registered_domain(F.coalesce("final_url", "url"), suffixes).alias("domain"))
    rows = _grad_domains(spark, sf_dir, suffixes)
    grad = rows.select(F.lit("grad_row").alias("record"), "id", "domain").distinct()
    return seen.unionByName(grad), _links(rows)


def _splits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    records, links = _all_records(spark, sf_dir)
    return records, groupsplit.grouped_splits(records, "domain", TARGETS, links, ident="id")


def p6_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Split of every registered domain of observations and training rows; a row's domains by address and by field stay together."""
    return _splits(spark, sf_dir)[1].select(F.when(~F.startswith(F.col("domain"), F.lit(groupsplit.ALONE)), F.col("domain")).alias("registered_domain"), "component", "split", "n")


def p6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of both tables with its split."""
    records, splits = _splits(spark, sf_dir)
    return groupsplit.assigned_records(records, "domain", "id", splits).select("record", "id", F.col("domain").alias("registered_domain"), "split")


def p6_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groupsplit.reached_shares(_splits(spark, sf_dir)[1], TARGETS)


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak.leaked_passages(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that leaked, with the number of documents and the longest passage."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("words").alias("longest_passage"))


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without leaked passages."""
    return leak.without_leaks(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id", _leaks(spark, sf_dir))


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mix.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def p9_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textstats.text_kinds(table(spark, sf_dir, "documents"), "doc_id", "text").where(F.col("kind") != "prose").select("doc_id", "kind")


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textstats.text_statistics(table(spark, sf_dir, "documents"), "doc_id", "text")


QUERIES = {q.__name__: q for q in (p1_found, p1_contributors, p2_found, p2_kinds, p3_found, p3_forms, p4_found, p4_bodies, p4_visible, p5_found, p5_report, p6_found, p6_splits, p6_records, p6_shares, p8_found, p8_items, p8_clean, p9_mix, p9_report, p10_found, p10_statistics)}


def _domain_sql(address: str) -> str:
    """Registered domain of an address, with the listed suffixes; independent of the operators' code."""
    s = rf"lower(regexp_replace({address}, '^[\s\p{{Z}}\p{{Cf}}]+|[\s\p{{Z}}\p{{Cf}}]+$', '', 'g'))"
    a = rf"regexp_replace(CASE WHEN regexp_matches({s}, '^([a-z][a-z0-9+.\-]*:)?//') THEN regexp_extract({s}, '^(?:[a-z][a-z0-9+.\-]*:)?//([^/?#\\]*)', 1) ELSE regexp_extract({s}, '^([^/?#\\]*)', 1) END, '^.*@', '')"
    h = rf"CASE WHEN {a} LIKE '[%' THEN regexp_extract({a}, '^(\[[^\]]*\]?)', 1) ELSE regexp_replace(regexp_replace({a}, ':[0-9]*$', ''), '\.+$', '') END"
    return h


def _registered_sql(table_sql: str, address: str, keep: str) -> str:
    return rf"""
    hosts AS (SELECT {keep}, {_domain_sql(address)} AS h FROM {table_sql}),
    cut AS (SELECT {keep}, h, string_split(h, '.') AS l, regexp_extract(h, '([^.]*\.)?[^.]*$', 0) AS last2, regexp_extract(h, '([^.]*\.){{0,2}}[^.]*$', 0) AS last3 FROM hosts),
    named AS (SELECT {keep}, CASE WHEN h IS NULL OR h = '' THEN NULL WHEN h LIKE '[%' OR regexp_matches(h, '^[0-9]{{1,3}}(\.[0-9]{{1,3}}){{3}}$') THEN h
        WHEN len(l) > 2 AND last2 IN (SELECT lower(suffix) FROM suffixes) THEN last3 ELSE last2 END AS registered_domain FROM cut)"""


_LATEST = "latest AS (SELECT id, input, capture_score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY captured_at DESC, ingested_at DESC) AS r FROM observations) WHERE r = 1)"
_CAPPED = (
    "WITH "
    + _LATEST
    + ", addresses AS (SELECT id, capture_score, coalesce(input.final_url, input.url) AS address FROM latest),"
    + _registered_sql("addresses", "address", "id, capture_score")
    + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY registered_domain ORDER BY capture_score DESC NULLS LAST, id) AS r,
      (SELECT greatest(3, floor(count(*) / 50)) FROM latest) AS cap FROM named WHERE registered_domain IS NOT NULL)"""
)
SQL = {
    "p1_found": _CAPPED + " SELECT id FROM ranked WHERE r > cap",
    "p1_contributors": _CAPPED + " SELECT registered_domain, count(*) FILTER (r <= cap) AS kept, count(*) FILTER (r > cap) AS left_out FROM ranked GROUP BY ALL HAVING left_out > 0",
    "p6_found": "WITH " + _registered_sql("grad_rows", "url", "split") + " SELECT registered_domain FROM named WHERE registered_domain IS NOT NULL AND split IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1",
}
