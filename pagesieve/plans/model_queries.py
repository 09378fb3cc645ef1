"""Queries that fit models, and those on raw lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagesieve.operators import curation as C
from pagesieve.operators import models as M
from pagesieve.plans.audit_queries import MEASURES, records
from pagesieve.sources import readers
from pagesieve.runtime import materialize, table


def _labelled(spark, sf_dir):
    r = records(spark, sf_dir).where("label in ('phishing', 'benign')").fillna(0, MEASURES).withColumn("y", (F.col("label") == "phishing").cast("double"))
    return C.stratified(r, "label", "id", 0.25)


def ml_rf(spark, sf_dir):
    """Importances of a forest on the measures."""
    return M.forest(_labelled(spark, sf_dir).where("split = 'train'"), MEASURES, "y", trees=20, depth=6)[1]


def ml_perm_importance(spark, sf_dir):
    d = materialize(_labelled(spark, sf_dir), "models")
    model, _ = M.forest(d.where("split = 'train'"), MEASURES, "y", trees=20, depth=6)
    return M.permutation_importance(model, d.where("split = 'test'"), MEASURES, "y", "id")


def ml_paper_models(spark, sf_dir):
    d = _labelled(spark, sf_dir)
    return M.compare(d.where("split = 'train'"), d.where("split = 'test'"), MEASURES, "y")


def ml_lofo(spark, sf_dir):
    d = _labelled(spark, sf_dir)
    return M.leave_one_out(d.where("split = 'train'"), d.where("split = 'test'"), MEASURES, "y")


def ml_feature_frame(spark, sf_dir):
    r = records(spark, sf_dir).select("id", "source", "forms", "score")
    return M.feature_frame(r, ["forms", "score"], {"source": ["phishing_feed", "popular_benign", "urlscan_live"]})


def src_raw_lines(spark, sf_dir):
    """State of the raw lines: readable, encoded twice, or cut."""
    v = F.try_parse_json("payload")
    kind = F.when(v.isNull(), "cut").when(F.schema_of_variant(v) == "STRING", "twice").otherwise("readable")
    return table(spark, sf_dir, "raw_records").groupBy(kind.alias("state")).agg(F.count("*").alias("n"))


def src_count_by_label(spark, sf_dir):
    return table(spark, sf_dir, "observations").groupBy(F.lower(F.trim("label")).alias("label"), "source").agg(F.count("*").alias("n"))


def src_html_filter(spark, sf_dir):
    return readers.html_filter(table(spark, sf_dir, "page_docs").select("id", "html")).select("id").distinct()


def src_jsonl_capped(spark, sf_dir):
    r = records(spark, sf_dir).where("label is not null").select("id", "label")
    return readers.capped(r, "label", "id", 50)


def src_sample_before_filter(spark, sf_dir):
    p = records(spark, sf_dir).select("id", "label")
    return readers.sample_before(p, "id", 200, F.col("label") == "phishing")


def src_sample_after_filter(spark, sf_dir):
    p = records(spark, sf_dir).select("id", "label")
    return readers.sample_after(p, "id", 100, F.col("label") == "phishing")


def src_point_lookup(spark, sf_dir):
    """Page documents that hold an address in any of their address fields."""
    p = table(spark, sf_dir, "page_docs")
    wanted = p.agg(F.min("metadata.final_url")).first()[0] or ""
    return readers.point_lookup(p, wanted, ["id", "url", "metadata.url", "metadata.final_url"]).select("id").distinct()


def src_collection_select(spark, sf_dir):
    """Documents and observations as one collection, by source."""
    both = readers.collections({"documents": table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.length("text").alias("chars")), "observations": table(spark, sf_dir, "observations").select("id")})
    return both.groupBy("source").agg(F.count("*").alias("n"), F.count("chars").alias("with_chars"))


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and k.startswith(("ml_", "src_"))}
_H = "md5(id || ':42')"
_O = "o AS (SELECT id, lower(trim(label)) AS label, source, capture_score, input FROM observations QUALIFY row_number() OVER (PARTITION BY id ORDER BY captured_at DESC, ingested_at DESC) = 1)"
SQL = {
    "ml_feature_frame": f"WITH {_O} SELECT id, coalesce(len(input.forms.items), 0)::DOUBLE AS forms, coalesce(capture_score, 0) AS score, " + ", ".join(f"(coalesce(nullif(source, ''), '<missing>') = '{v}')::INT::DOUBLE AS \"source={v}\"" for v in ("phishing_feed", "popular_benign", "urlscan_live", "<missing>")) + " FROM o",
    "src_raw_lines": "SELECT CASE WHEN NOT json_valid(payload) THEN 'cut' WHEN json_type(CASE WHEN json_valid(payload) THEN payload END) = 'VARCHAR' THEN 'twice' ELSE 'readable' END AS state, count(*) AS n FROM raw_records GROUP BY 1",
    "src_count_by_label": "SELECT lower(trim(label)) AS label, source, count(*) AS n FROM observations GROUP BY ALL",
    "src_html_filter": "SELECT DISTINCT id FROM page_docs WHERE html IS NOT NULL AND html <> ''",
    "src_jsonl_capped": f"WITH {_O} SELECT id, label FROM o WHERE label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY label ORDER BY {_H}, id) <= 50",
    "src_sample_before_filter": f"WITH {_O}, s AS (SELECT id, label FROM o ORDER BY {_H} LIMIT 200) SELECT * FROM s WHERE label = 'phishing'",
    "src_sample_after_filter": f"WITH {_O} SELECT id, label FROM o WHERE label = 'phishing' ORDER BY {_H} LIMIT 100",
    "src_point_lookup": "WITH w AS (SELECT min(metadata.final_url) AS w FROM page_docs) SELECT DISTINCT id FROM page_docs, w WHERE w IN (id, url, metadata.url, metadata.final_url)",
    "src_collection_select": "SELECT 'documents' AS source, count(*) AS n, count(length(text)) AS with_chars FROM documents UNION ALL SELECT 'observations', count(*), 0 FROM observations",
}
