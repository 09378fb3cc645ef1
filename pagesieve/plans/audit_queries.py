"""Audit queries over observations, training rows, documents and predictions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesieve.operators import audit as A
from pagesieve.plans.url_queries import host_sql
from pagesieve.runtime import latest, table

MEASURES = ["forms", "anchors", "hops", "text_length", "title_length", "score"]


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations in their latest state: id, label in one spelling, source, and some measures."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    seen = latest(table(spark, sf_dir, "observations"), "id", ["captured_at", "ingested_at"], {
        "label": F.lower(F.trim("label")), "source": F.col("source"), "score": F.col("capture_score"), "captured": F.col("captured_at"), "forms": size(F.col("input.forms.items")), "anchors": size(F.col("input.anchors.items")),
        "hops": size(F.col("input.redirects")), "text_length": F.length(F.coalesce("input.visible_text", F.lit(""))), "title_length": F.length("input.title"),
    })
    fix = lambda c: F.when(F.col(c) < 0, 0).otherwise(F.col(c)).alias(c)
    return seen.select("id", "label", "source", "score", "captured", fix("forms"), fix("anchors"), fix("hops"), "text_length", "title_length")


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows without exact repetitions."""
    return table(spark, sf_dir, "grad_rows").distinct()


def target_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature ids listed in the target of a training row, each once."""
    ids = F.regexp_extract_all("target", F.lit(r"(?m)^- ([a-z]+\.[a-z_]+)$"), F.lit(1))
    return rows(spark, sf_dir).select("id", F.explode(F.array_distinct(ids)).alias("item")).distinct()


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows(spark, sf_dir).select("id", F.lower("label").alias("label"), "source").where("label is not null and source is not null").distinct()


def agg_label_counts(spark, sf_dir):
    return A.label_counts(records(spark, sf_dir), "label")


def agg_source_label_crosstab(spark, sf_dir):
    return A.crosstab(records(spark, sf_dir), "source", "label", ["phishing", "benign"])


def agg_source_label_nmi(spark, sf_dir):
    return A.association(records(spark, sf_dir).where("label is not null and source is not null"), "source", "label")


def agg_source_purity(spark, sf_dir):
    return A.source_purity(records(spark, sf_dir).where("label is not null"), "source", "label")


def agg_feature_rows(spark, sf_dir):
    return A.item_rows(_labelled(spark, sf_dir), target_items(spark, sf_dir), min_count=20)


def agg_host_suffix(spark, sf_dir):
    """Audit rows keyed by the last two labels of the host, with no source information."""
    host = F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    labels = F.split(F.lower(host), r"\.")
    suffix = F.concat(F.lit("host_suffix="), F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."))
    items = rows(spark, sf_dir).where("url is not null").select("id", suffix.alias("item")).distinct()
    return A.item_rows(_labelled(spark, sf_dir), items, min_count=20, source=None)


def agg_measure_split(spark, sf_dir):
    return A.measure_splits(records(spark, sf_dir), "label", MEASURES)


def agg_measure_summary(spark, sf_dir):
    return A.measure_summary(records(spark, sf_dir), "label", MEASURES)


def agg_pair_counts(spark, sf_dir):
    return A.item_pairs(target_items(spark, sf_dir), 0.05, 0.3)


def agg_inventory(spark, sf_dir):
    return A.inventory(records(spark, sf_dir), MEASURES)


def agg_lift(spark, sf_dir):
    return A.lift(records(spark, sf_dir), "label", MEASURES, "phishing", "benign")


def agg_evidence_profiles(spark, sf_dir):
    return A.class_profiles(records(spark, sf_dir).fillna(0, MEASURES), "label", MEASURES, "phishing", "benign")


def agg_numeric_profile(spark, sf_dir):
    """Text lengths of documents by language and overall (a rollup), nearest-rank percentiles."""
    d = table(spark, sf_dir, "documents").select(F.coalesce(F.lower("lang"), F.lit("?")).alias("lang"), F.length("text").alias("chars"))
    both = d.select(F.explode(F.array("lang", F.lit("*"))).alias("lang"), "chars")
    return A.nearest_percentiles(both, ["lang"], "chars", {"p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99})


def agg_crawl_coverage(spark, sf_dir):
    r = records(spark, sf_dir)
    return r.groupBy("label").agg(F.date_format(F.min("captured"), "yyyy-MM-dd HH:mm:ss").alias("first"), F.date_format(F.max("captured"), "yyyy-MM-dd HH:mm:ss").alias("last"), F.floor((F.unix_timestamp(F.max("captured").cast("timestamp")) - F.unix_timestamp(F.min("captured").cast("timestamp"))) / 86400).cast("bigint").alias("days"), F.round(F.count("captured") / F.count("*"), 6).alias("dated"))


def agg_zero_variance(spark, sf_dir):
    r = records(spark, sf_dir)
    long = r.select(*[F.col(m).cast("double").alias(m) for m in MEASURES], F.lit(1.0).alias("constant")).withColumn("_", F.lit(0)).unpivot("_", [*MEASURES, "constant"], "feature", "value")
    return long.groupBy("feature").agg(F.countDistinct("value").alias("distinct_values")).where("distinct_values <= 1")


def agg_class_weights(spark, sf_dir):
    return A.class_weights(rows(spark, sf_dir).withColumn("source", F.col("source")), "source")


def agg_mode_udaf(spark, sf_dir):
    return A.majority(rows(spark, sf_dir).withColumn("label", F.lower("label")), "registered_domain", "label")


def agg_group_conf(spark, sf_dir):
    return records(spark, sf_dir).where("label is not null").groupBy("label").agg(F.round(F.avg("score"), 6).alias("mean_score"), F.count("score").alias("scored"))


def agg_fe_usage(spark, sf_dir):
    """Cited feature ids of predictions by verdict: 25 most frequent."""
    p = table(spark, sf_dir, "predictions").select(F.coalesce(F.lower("predicted_verdict"), F.lit("none")).alias("verdict"), F.explode("cited_features").alias("feature"))
    c = p.groupBy("feature").agg(F.count("*").alias("citations"), F.sum((F.col("verdict") == "phishing").cast("int")).alias("phishing"), F.sum((F.col("verdict") == "benign").cast("int")).alias("benign"))
    return c.orderBy(F.col("citations").desc(), "feature").limit(25)


def agg_supervision(spark, sf_dir):
    """Feature instances per group of ids (the part before the dot)."""
    i = target_items(spark, sf_dir)
    return i.groupBy(F.element_at(F.split("item", r"\."), 1).alias("kind")).agg(F.count("*").alias("instances"), F.countDistinct("item").alias("ids"))


def agg_domain_errors(spark, sf_dir):
    p = table(spark, sf_dir, "predictions").where("registered_domain is not null")
    wrong = F.coalesce(F.lower("predicted_verdict") != F.lower("label"), F.lit(True)).cast("int")
    return p.groupBy("registered_domain").agg(F.count("*").alias("n"), F.sum(wrong).alias("errors"), F.round(F.avg(wrong), 6).alias("error_rate"))


def agg_ip_stats(spark, sf_dir):
    """Outcome counters of final hosts: name, address, or none."""
    from pagesieve.functions.urls import host, is_ip_host

    h = table(spark, sf_dir, "page_docs").select(host(F.col("metadata.final_url")).alias("h"))
    return h.select(F.when(F.col("h").isNull() | (F.col("h") == ""), "none").when(is_ip_host(F.col("h")), "address").otherwise("name").alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


def agg_mi_audit(spark, sf_dir):
    return A.binned_information(records(spark, sf_dir), "label", MEASURES)


QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("agg_")}

_SIZE = lambda c: f"coalesce(len({c}), 0)"
REC = f"""rec AS (SELECT id, lower(trim(label)) AS label, source, capture_score AS score, captured_at AS captured, {_SIZE('input.forms.items')} AS forms, {_SIZE('input.anchors.items')} AS anchors, {_SIZE('input.redirects')} AS hops,
 length(coalesce(input.visible_text, '')) AS text_length, length(input.title) AS title_length FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY captured_at DESC, ingested_at DESC) AS r FROM observations) WHERE r = 1)"""
_ROWS = "g AS (SELECT DISTINCT * FROM grad_rows)"
_ITEMS = f"{_ROWS}, lab AS (SELECT DISTINCT id, lower(label) AS label, source FROM g WHERE label IS NOT NULL AND source IS NOT NULL), it AS (SELECT DISTINCT id, unnest(regexp_extract_all(target, '(?m)^- ([a-z]+\\.[a-z_]+)$', 1)) AS item FROM g)"
_LONG = "l AS (" + " UNION ALL ".join(f"SELECT label, '{m}' AS measure, {m}::DOUBLE AS value FROM rec" for m in MEASURES) + ")"


def _h(counts: str, total: str) -> str:
    return f"CASE WHEN ({counts}) > 0 AND ({total}) > 0 THEN -(({counts}) / ({total})::DOUBLE) * log2(({counts}) / ({total})::DOUBLE) ELSE 0 END"


def _info(target: str) -> str:
    """CTEs x_<target>: item, support, mi, nmi, purity, top, entropy."""
    t = target
    return f"""tot_{t} AS (SELECT {t} AS k, count(*) AS a FROM lab GROUP BY 1), n_{t} AS (SELECT sum(a) AS total FROM tot_{t}), cnt_{t} AS (SELECT item, {t} AS k, count(*) AS n FROM it JOIN lab USING (id) GROUP BY 1, 2),
 sup_{t} AS (SELECT item, sum(n) AS s FROM cnt_{t} GROUP BY 1), grid_{t} AS (SELECT s.item, s.s, x.k, x.a, coalesce(c.n, 0) AS n, total FROM sup_{t} s CROSS JOIN tot_{t} x CROSS JOIN n_{t} LEFT JOIN cnt_{t} c ON c.item = s.item AND c.k = x.k),
 h_{t} AS (SELECT item, s, total, sum({_h('a', 'total')}) AS h, sum({_h('n', 's')}) AS hp, sum({_h('a - n', 'total - s')}) AS ha, max(n) / s AS purity, min(k) FILTER (n = mx) AS top FROM (SELECT *, max(n) OVER (PARTITION BY item) AS mx FROM grid_{t}) GROUP BY item, s, total),
 x_{t} AS (SELECT item, s, total, top, purity, hp, CASE WHEN s >= total THEN 0 ELSE h - s / total * hp - (total - s) / total * ha END AS mi, coalesce(CASE WHEN s >= total THEN 0 ELSE h - s / total * hp - (total - s) / total * ha END / nullif(h, 0), 0) AS nmi FROM h_{t})"""


_RISK = "CASE WHEN round(purity, 6) >= 0.95 OR round(nmi, 6) >= 0.25 THEN 'high' WHEN round(purity, 6) >= 0.85 OR round(nmi, 6) >= 0.1 OR {s} >= 0.1 THEN 'medium' ELSE 'low' END"
_ROW = "SELECT l.item, l.s AS support, round(l.s / l.total, 6) AS support_ratio, l.top AS top_label, round(l.purity, 6) AS purity, round(l.hp, 6) AS entropy_present, round(l.mi, 6) AS mi, round(l.nmi, 6) AS label_nmi, round({s}, 6) AS source_nmi, {risk} AS risk"
_PCT = lambda q: f"list_sort(list(chars))[round_even({q} * (count(*) - 1), 0)::INT + 1]"
_CAND = f"""{_LONG}, v AS (SELECT * FROM l WHERE value IS NOT NULL AND label IS NOT NULL), dv AS (SELECT measure, value, row_number() OVER (PARTITION BY measure ORDER BY value) AS r, count(*) OVER (PARTITION BY measure) AS d FROM (SELECT DISTINCT measure, value FROM v)),
 cand AS (SELECT measure, value AS threshold FROM dv WHERE d <= 20 OR (r - 1) IN ({', '.join(f'floor({q} * (d - 1))' for q in A.QUANTILES)}))"""
SQL = {
    "agg_label_counts": f"WITH {REC} SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM rec GROUP BY label",
    "agg_source_label_crosstab": f"WITH {REC} SELECT coalesce(source, '<missing>') AS source, count(*) FILTER (label = 'phishing') AS phishing, count(*) FILTER (label = 'benign') AS benign, count(*) AS total FROM rec GROUP BY 1",
    "agg_source_label_nmi": f"""WITH {REC}, f AS (SELECT * FROM rec WHERE label IS NOT NULL AND source IS NOT NULL), xy AS (SELECT source, label, count(*) AS n FROM f GROUP BY ALL), t AS (SELECT count(*) AS t FROM f), x AS (SELECT source, count(*) AS n FROM f GROUP BY 1), y AS (SELECT label, count(*) AS n FROM f GROUP BY 1),
 m AS (SELECT sum(xy.n / t * log2(xy.n * t / (x.n * y.n))) AS mi FROM xy JOIN x USING (source) JOIN y USING (label), t), hx AS (SELECT sum(-n / t * log2(n / t)) AS h FROM x, t), hy AS (SELECT sum(-n / t * log2(n / t)) AS h FROM y, t)
 SELECT round(hx.h, 6) AS entropy_x, round(hy.h, 6) AS entropy_y, round(mi, 6) AS mi, round(mi / hy.h, 6) AS nmi, round(2 * mi / (hx.h + hy.h), 6) AS nmi_mean FROM m, hx, hy""",
    "agg_source_purity": f"WITH {REC}, c AS (SELECT source, label, count(*) AS n FROM rec WHERE label IS NOT NULL GROUP BY ALL) SELECT source, sum(n)::BIGINT AS records, (list(label ORDER BY n DESC, label))[1] AS top_label, round(max(n) / sum(n), 6) AS purity FROM c GROUP BY source",
    "agg_feature_rows": f"WITH {_ITEMS}, {_info('label')}, {_info('source')} " + _ROW.format(s="s.nmi", risk=_RISK.format(s="round(s.nmi, 6)").replace("purity", "l.purity").replace("nmi,", "nmi,").replace("round(nmi", "round(l.nmi")) + " FROM x_label l JOIN x_source s USING (item) WHERE l.s >= 20",
    "agg_host_suffix": f"WITH {_ROWS}, lab AS (SELECT DISTINCT id, lower(label) AS label, source FROM g WHERE label IS NOT NULL AND source IS NOT NULL), "
    "it AS (SELECT DISTINCT id, 'host_suffix=' || list_aggregate(string_split(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '.')[-2:], 'string_agg', '.') AS item FROM g WHERE url IS NOT NULL), "
    + _info("label") + " " + _ROW.format(s="0.0", risk=_RISK.format(s="0").replace("purity", "l.purity").replace("round(nmi", "round(l.nmi")) + " FROM x_label l WHERE l.s >= 20",
    "agg_measure_split": f"""WITH {REC}, {_CAND}, tot AS (SELECT label, count(*) AS a FROM rec WHERE label IS NOT NULL GROUP BY 1), n AS (SELECT sum(a) AS total FROM tot),
 c AS (SELECT measure, threshold, label, count(*) FILTER (value >= threshold) AS ge, count(*) FILTER (value < threshold) AS lt FROM cand JOIN v USING (measure) GROUP BY ALL), g AS (SELECT c.*, a, total, sum(ge) OVER w AS sg, sum(lt) OVER w AS sl, max(ge) OVER w AS mg, max(lt) OVER w AS ml FROM c JOIN tot USING (label), n WINDOW w AS (PARTITION BY measure, threshold)),
 e AS (SELECT measure, threshold, sg, sl, total, mg / nullif(sg, 0) AS pg, ml / nullif(sl, 0) AS pl, min(label) FILTER (ge = mg) AS bg, min(label) FILTER (lt = ml) AS bl, sum({_h('a', 'total')}) AS h, sum({_h('ge', 'sg')}) AS hp, sum({_h('a - ge', 'total - sg')}) AS ha FROM g GROUP BY ALL),
 m AS (SELECT *, coalesce(pg, 0) >= coalesce(pl, 0) AS up, CASE WHEN sg <= 0 OR sg >= total THEN 0 ELSE h - sg / total * hp - (total - sg) / total * ha END AS mi FROM e),
 z AS (SELECT measure, threshold, CASE WHEN up THEN '>=' ELSE '<' END AS operator, CASE WHEN up THEN sg ELSE sl END::BIGINT AS support, CASE WHEN up THEN bg ELSE bl END AS label, round(greatest(coalesce(pg, 0), coalesce(pl, 0)), 6) AS purity, round(mi, 6) AS mi, round(coalesce(mi / nullif(h, 0), 0), 6) AS nmi FROM m)
 SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY measure ORDER BY nmi DESC, purity DESC, support DESC, threshold) = 1""",
    "agg_measure_summary": f"WITH {REC}, {_LONG} SELECT measure, label, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, list_sort(list(value))[floor(0.9 * (count(*) - 1))::INT + 1] AS p90 FROM l WHERE value IS NOT NULL AND label IS NOT NULL GROUP BY 1, 2",
    "agg_pair_counts": f"WITH {_ITEMS}, n AS (SELECT item, count(*) AS n FROM it GROUP BY 1), p AS (SELECT x.item AS a, y.item AS b, count(*) AS k FROM it x JOIN it y ON x.id = y.id AND x.item < y.item GROUP BY 1, 2), j AS (SELECT a, b, k AS \"both\", round(k / (na.n + nb.n - k), 6) AS jaccard, round(k / na.n, 6) AS b_given_a, round(k / nb.n, 6) AS a_given_b FROM p JOIN n na ON na.item = a JOIN n nb ON nb.item = b) SELECT * FROM j WHERE jaccard >= 0.05 OR greatest(b_given_a, a_given_b) >= 0.3",
    "agg_inventory": f"""WITH {REC}, {_LONG}, a AS (SELECT measure AS feature, 100 * count(*) FILTER (coalesce(value, 0) <> 0) / count(*) AS fire, 100 * count(*) FILTER (value IS NULL) / count(*) AS miss, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS least, max(value) AS most, coalesce(bool_and(value IN (0, 1)), true) AS zo FROM l GROUP BY 1),
 b AS (SELECT feature, CASE WHEN zo THEN 'binary' WHEN feature <> 'score' THEN 'count' WHEN least >= 0 AND most <= 1 THEN 'ratio' ELSE 'continuous' END AS kind, round(fire, 2) AS fire_rate, round(miss, 2) AS missing, round(mean, 6) AS mean, round(std, 6) AS std, least, most FROM a)
 SELECT *, CASE WHEN fire_rate < 1 THEN 'drop (low fire rate)' WHEN fire_rate > 99 AND kind = 'binary' THEN 'drop (near-constant)' ELSE 'keep' END AS action FROM b""",
    "agg_lift": f"""WITH {REC}, {_LONG}, a AS (SELECT measure AS feature, 100 * count(*) FILTER (label = 'phishing' AND value <> 0) / count(*) FILTER (label = 'phishing') AS p, 100 * count(*) FILTER (label = 'benign' AND value <> 0) / count(*) FILTER (label = 'benign') AS n,
 avg(coalesce(value, 0)) FILTER (label = 'phishing') AS mp, avg(coalesce(value, 0)) FILTER (label = 'benign') AS mn FROM l GROUP BY 1) SELECT feature, round(p, 2) AS fire_positive, round(n, 2) AS fire_negative, round(mp, 6) AS mean_positive, round(mn, 6) AS mean_negative, round(p / nullif(n, 0), 2) AS lift, CASE WHEN p > n THEN 'phishing' ELSE 'benign' END AS direction FROM a""",
    "agg_evidence_profiles": f"""WITH {REC}, {_LONG}, f AS (SELECT label, measure, coalesce(value, 0) AS v FROM l WHERE label IN ('phishing', 'benign')), a AS (SELECT measure AS feature, avg(v) FILTER (label = 'phishing') AS pm, avg(v) FILTER (label = 'benign') AS nm, quantile_cont(v, 0.5) FILTER (label = 'phishing') AS pd, quantile_cont(v, 0.5) FILTER (label = 'benign') AS nd,
 quantile_cont(v, 0.25) FILTER (label = 'phishing') AS p1, quantile_cont(v, 0.75) FILTER (label = 'phishing') AS p3, quantile_cont(v, 0.25) FILTER (label = 'benign') AS n1, quantile_cont(v, 0.75) FILTER (label = 'benign') AS n3, stddev_pop(v) AS sd FROM f GROUP BY 1), b AS (SELECT *, (pm - nm) / CASE WHEN sd > 0 THEN sd ELSE 1 END AS e, abs(pd - nd) < 1e-9 AS eq FROM a)
 SELECT feature, CASE WHEN pm >= nm THEN 'high' ELSE 'low' END AS suspicious_when, round(CASE WHEN eq THEN (pm + nm) / 2 ELSE (pd + nd) / 2 END, 6) AS threshold, round(e, 6) AS effect, round(pm, 6) AS positive_mean, round(nm, 6) AS negative_mean, round(pd, 6) AS positive_median, round(nd, 6) AS negative_median, round(p1, 6) AS positive_q25, round(p3, 6) AS positive_q75, round(n1, 6) AS negative_q25, round(n3, 6) AS negative_q75 FROM b WHERE NOT (abs(e) < 0.03 AND eq)""",
    "agg_numeric_profile": f"WITH d AS (SELECT unnest([coalesce(lower(lang), '?'), '*']) AS lang, length(text) AS chars FROM documents) SELECT lang, count(*) AS count, min(chars) AS least, {_PCT(0.5)} AS p50, {_PCT(0.75)} AS p75, {_PCT(0.9)} AS p90, {_PCT(0.95)} AS p95, {_PCT(0.99)} AS p99, max(chars) AS most, round(avg(chars), 6) AS mean FROM d WHERE chars IS NOT NULL GROUP BY lang",
    "agg_crawl_coverage": f"WITH {REC} SELECT label, strftime(min(captured), '%Y-%m-%d %H:%M:%S') AS first, strftime(max(captured), '%Y-%m-%d %H:%M:%S') AS last, floor((floor(epoch(max(captured))) - floor(epoch(min(captured)))) / 86400)::BIGINT AS days, round(count(captured) / count(*), 6) AS dated FROM rec GROUP BY label",
    "agg_zero_variance": f"WITH {REC}, {_LONG} SELECT feature, distinct_values FROM (SELECT measure AS feature, count(DISTINCT value) AS distinct_values FROM l GROUP BY 1 UNION ALL SELECT 'constant', 1) WHERE distinct_values <= 1",
    "agg_class_weights": f"WITH {_ROWS}, c AS (SELECT source, count(*) AS n FROM g WHERE source IS NOT NULL GROUP BY 1) SELECT source, n, round(least(sum(n) OVER () / (count(*) OVER () * n), 20), 6) AS weight FROM c",
    "agg_mode_udaf": f"WITH {_ROWS}, c AS (SELECT registered_domain, lower(label) AS label, count(*) AS n FROM g WHERE registered_domain IS NOT NULL AND label IS NOT NULL GROUP BY 1, 2) SELECT registered_domain, (list(label ORDER BY n DESC, label))[1] AS majority, sum(n)::BIGINT AS records FROM c GROUP BY 1",
    "agg_group_conf": f"WITH {REC} SELECT label, round(avg(score), 6) AS mean_score, count(score) AS scored FROM rec WHERE label IS NOT NULL GROUP BY label",
    "agg_fe_usage": "WITH p AS (SELECT coalesce(lower(predicted_verdict), 'none') AS verdict, unnest(cited_features) AS feature FROM predictions) SELECT feature, count(*) AS citations, count(*) FILTER (verdict = 'phishing') AS phishing, count(*) FILTER (verdict = 'benign') AS benign FROM p GROUP BY 1 ORDER BY citations DESC, feature LIMIT 25",
    "agg_supervision": f"WITH {_ITEMS} SELECT split_part(item, '.', 1) AS kind, count(*) AS instances, count(DISTINCT item) AS ids FROM it GROUP BY 1",
    "agg_domain_errors": "SELECT registered_domain, count(*) AS n, sum(w)::BIGINT AS errors, round(avg(w), 6) AS error_rate FROM (SELECT registered_domain, coalesce(lower(predicted_verdict) <> lower(label), true)::INT AS w FROM predictions WHERE registered_domain IS NOT NULL) GROUP BY 1",
}
SQL["agg_ip_stats"] = rf"""WITH h AS (SELECT {host_sql('metadata.final_url')} AS h FROM page_docs) SELECT CASE WHEN h IS NULL OR h = '' THEN 'none' WHEN h LIKE '[%' OR regexp_matches(h, '^[0-9]{{1,3}}(\.[0-9]{{1,3}}){{3}}$') THEN 'address' ELSE 'name' END AS outcome, count(*) AS n FROM h GROUP BY 1"""
