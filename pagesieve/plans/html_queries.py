"""Queries on page markup, with SQL where markup can be counted by patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesieve.operators import html_features as HF
from pagesieve.plans.url_queries import suffixes
from pagesieve.runtime import spread, table


def _all(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "page_docs").where("length(html) > 0").select("id", "html", "title", F.coalesce("metadata.final_url", "url").alias("base"))
    # rows of an id have one content: numbers are taken where the page lies, then one row kept
    return HF.html_features(spread(p), "id", "html", "title", "base", suffixes(spark, sf_dir)).dropDuplicates(["id"])


def html_dom_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir)


def html_classical_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return HF.classical_features(_all(spark, sf_dir), "id")


_FLAT = {"html_paragraph_count": "p", "html_div_count": "div", "html_span_count": "span", "html_table_count": "table", "html_meta_tag_count": "meta", "html_form_count": "form", "html_input_count": "input", "html_h1_count": "h1", "html_h2_count": "h2", "html_h3_count": "h3", "html_button_count": "button", "html_tr_count": "tr"}


def html_flat_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _all(spark, sf_dir).select("id", "html_length", *_FLAT, "html_footer_present", "html_navigation_present", "html_eval_call_count", "html_atob_call_count", "html_document_write_count", "html_onmouseover_handler_count")


def html_feature_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, deviation, range and non-zero share of some features over all pages, a row each."""
    f = _all(spark, sf_dir).select("id", *[F.col(c).cast("double") for c in _FLAT])
    long = f.unpivot("id", list(_FLAT), "feature", "value")
    return long.groupBy("feature").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("std"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg((F.col("value") != 0).cast("double")), 6).alias("non_zero"), F.countDistinct("value").alias("distinct_values"))


QUERIES = {q.__name__: q for q in (html_dom_features, html_classical_features, html_flat_counts, html_feature_summary)}

_CLEAN = "pages AS (SELECT id, any_value(html) AS html FROM page_docs WHERE length(html) > 0 GROUP BY id), clean AS (SELECT id, html, regexp_replace(html, '(?is)<!--.*?(-->|$)|(<script[^>]*>).*?(</script|$)|(<style[^>]*>).*?(</style|$)|(<noscript[^>]*>).*?(</noscript|$)', ' ', 'g') AS h FROM pages)"
_TAG = lambda t: f"len(regexp_extract_all(h, '(?i)<{t}[\\s/>]'))"
SQL = {
    "html_flat_counts": f"WITH {_CLEAN} SELECT id, length(html) AS html_length, " + ", ".join(f"{_TAG(t)} AS {c}" for c, t in _FLAT.items()) + f", ({_TAG('footer')} > 0)::INT AS html_footer_present, ({_TAG('nav')} > 0)::INT AS html_navigation_present, "
    r"len(regexp_extract_all(html, '(?i)\beval\s*\(')) AS html_eval_call_count, len(regexp_extract_all(html, '(?i)\batob\s*\(')) AS html_atob_call_count, len(regexp_extract_all(html, '(?i)document\.write(ln)?\s*\(')) AS html_document_write_count, len(regexp_extract_all(html, '(?i)\bonmouseover\b')) AS html_onmouseover_handler_count FROM clean",
    "html_feature_summary": f"WITH {_CLEAN}, f AS (SELECT id, " + ", ".join(f"{_TAG(t)}::DOUBLE AS {c}" for c, t in _FLAT.items()) + " FROM clean), l AS (UNPIVOT f ON " + ", ".join(_FLAT) + " INTO NAME feature VALUE value) SELECT feature, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS least, max(value) AS most, round(avg((value <> 0)::INT), 6) AS non_zero, count(DISTINCT value) AS distinct_values FROM l GROUP BY feature",
}
