"""Curation and evaluation queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagesieve.operators import curation as C
from pagesieve.operators import evaluation as E
from pagesieve.plans.audit_queries import rows
from pagesieve.runtime import table

CLASSES = ["phishing", "benign"]


def _g(spark, sf_dir):
    return rows(spark, sf_dir).select("id", F.lower("label").alias("label"), "source", "split", "url", "registered_domain", "built_at")


def win_cap_per_key(spark, sf_dir):
    return C.cap_per_key(_g(spark, sf_dir).where("registered_domain <> ''"), "registered_domain", "id", 3).select("id", "registered_domain")


def sample_balance(spark, sf_dir):
    return C.balance(_g(spark, sf_dir).where("label is not null"), "label", "id").select("id", "label")


def sample_oversample(spark, sf_dir):
    return C.oversample(_g(spark, sf_dir).select("id", "source"), F.col("source") == "phishing_feed", 3)


def sample_quota(spark, sf_dir):
    """A seeded sample of 40 rows per label, by source."""
    r = C.hash_rank(_g(spark, sf_dir).where("label is not null"), ["label"], "id").where("rank <= 40")
    return r.groupBy("label", "source").agg(F.count("*").alias("n"))


def split_stratified(spark, sf_dir):
    return C.stratified(_g(spark, sf_dir).where("source is not null"), "source", "id", 0.2).select("id", F.col("split"))


def split_three_way(spark, sf_dir):
    return C.three_way(_g(spark, sf_dir).where("label is not null").drop("split"), "label", "id", 0.2, 0.1).select("id", "label", "split")


def split_80_10_10(spark, sf_dir):
    return C.floor_split(_g(spark, sf_dir).where("label is not null").drop("split"), "label", "id").select("id", "label", "split")


def win_domain_greedy_split(spark, sf_dir):
    return C.greedy_domains(_g(spark, sf_dir).where("registered_domain <> ''"), "label", "registered_domain", 0.15, 0.15)


def split_domain_stratified(spark, sf_dir):
    """Domains split by their majority label."""
    from pagesieve.operators.audit import majority

    m = majority(_g(spark, sf_dir).where("registered_domain <> ''"), "registered_domain", "label")
    return C.stratified(m.drop("split"), "majority", "registered_domain", 0.2).select("registered_domain", "majority", "split")


def split_can_stratify(spark, sf_dir):
    c = _g(spark, sf_dir).where("label is not null").groupBy("label").agg(F.count("*").alias("n"))
    return c.agg(F.count("*").alias("classes"), F.min("n").alias("least"), F.sum("n").alias("rows")).select("classes", "least", ((F.col("least") >= 2) & (F.floor(F.col("rows") * 0.2) >= F.col("classes"))).alias("can_stratify"))


def overlap_check(spark, sf_dir):
    return C.overlap_counts(_g(spark, sf_dir), "registered_domain", "split")


def anti_leaked_domains(spark, sf_dir):
    """Validation and test rows whose domain is not in train."""
    g = _g(spark, sf_dir).where("registered_domain is not null")
    return g.where("split in ('val', 'test')").join(g.where("split = 'train'").select("registered_domain").distinct(), "registered_domain", "left_anti").select("id", "split")


def join_label_content(spark, sf_dir):
    """Documents with their hand labels; labels without a document are counted by the next query."""
    return table(spark, sf_dir, "doc_labels").join(table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("chars")), "doc_id").select("doc_id", "kind", "annotator", "source", "chars")


def join_unmatched(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.join(table(spark, sf_dir, "doc_labels").select("doc_id").distinct(), "doc_id", "left_anti").groupBy("source").agg(F.count("*").alias("unlabelled"))


def join_lookup_loop(spark, sf_dir):
    """First page document (by capture) for the final address of each training row."""
    from pyspark.sql import Window

    p = table(spark, sf_dir, "page_docs").where("metadata.final_url is not null").select(F.col("metadata.final_url").alias("url"), F.col("id").alias("page_id"), "captured_at")
    first = p.groupBy("url").agg(F.min(F.struct("captured_at", "page_id")).alias("f")).select("url", "f.page_id")
    return _g(spark, sf_dir).where("url is not null").select("id", "url").join(first, "url", "left").select("id", "page_id")


def join_grounding(spark, sf_dir):
    """Predictions with the gold feature ids of their rows: set precision, recall and F1."""
    ids = F.array_distinct(F.regexp_extract_all("target", F.lit(r"(?m)^- ([a-z]+\.[a-z_]+)$"), F.lit(1)))
    gold = rows(spark, sf_dir).select("id", ids.alias("gold")).distinct()
    s = E.set_scores(F.col("cited_features"), F.col("gold"))
    return table(spark, sf_dir, "predictions").join(gold, "id").select("eval_idx", *[c.alias(k) for k, c in s.items()])


def join_left_fill(spark, sf_dir):
    """Citations per prediction, 0 where there are none."""
    p = table(spark, sf_dir, "predictions")
    n = p.select("eval_idx", F.explode("cited_features").alias("f")).groupBy("eval_idx").agg(F.countDistinct("f").alias("cited"))
    return p.select("eval_idx").join(n, "eval_idx", "left").na.fill(0, ["cited"])


def join_domain_delta(spark, sf_dir):
    """Error rate of domains in two halves of the predictions, where both have three rows at least."""
    p = table(spark, sf_dir, "predictions").where("registered_domain is not null").withColumn("wrong", F.coalesce(F.lower("predicted_verdict") != F.lower("label"), F.lit(True)).cast("int"))
    side = lambda k, name: p.where(F.pmod("eval_idx", F.lit(2)) == k).groupBy("registered_domain").agg(F.count("*").alias(f"n_{name}"), F.avg("wrong").alias(name))
    j = side(0, "a").join(side(1, "b"), "registered_domain").where("n_a >= 3 and n_b >= 3")
    return j.select("registered_domain", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round(F.col("b") - F.col("a"), 6).alias("delta"))


def join_shared_domains(spark, sf_dir):
    g = _g(spark, sf_dir).where("registered_domain <> ''").groupBy("registered_domain").agg(F.sum((F.col("label") == "phishing").cast("int")).alias("phishing"), F.sum((F.col("label") == "benign").cast("int")).alias("benign"))
    return g.where("phishing > 0 and benign > 0")


def join_model_compare(spark, sf_dir):
    """Stated verdict against the one inferred from the text: where they differ, and who is right."""
    p = table(spark, sf_dir, "predictions").select("eval_idx", F.lower("label").alias("label"), F.lower("predicted_verdict").alias("stated"), E.infer_verdict(F.col("generated_text")).alias("inferred"))
    kind = F.when(F.col("stated").eqNullSafe(F.col("inferred")), "same").when(F.coalesce(F.col("inferred") == F.col("label"), F.lit(False)), "fixed").when(F.coalesce(F.col("stated") == F.col("label"), F.lit(False)), "broke").otherwise("differ")
    return p.groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"))


def label_by_id_map(spark, sf_dir):
    """Missing labels of observations filled from the training rows."""
    from pagesieve.plans.audit_queries import records

    gold = _g(spark, sf_dir).where("label is not null").groupBy("id").agg(F.min("label").alias("gold"))
    return records(spark, sf_dir).select("id", "label").join(gold, "id", "left").select("id", F.coalesce("label", "gold").alias("label"))


def membership_suffix(spark, sf_dir):
    """Rows whose host is a listed host or below it."""
    from pagesieve.functions.urls import host
    from pagesieve.plans.document_queries import _frequent_domains

    listed = F.array(*[F.lit(d) for d in _frequent_domains(spark, sf_dir)] or [F.lit(None).cast("string")])
    g = _g(spark, sf_dir).where("url is not null").select("id", host(F.col("url")).alias("h"))
    return g.where(F.exists(listed, lambda d: (F.col("h") == d) | F.endswith(F.col("h"), F.concat(F.lit("."), d)))).select("id")


def set_operations(spark, sf_dir):
    """Ids of observations and training rows: in both, in one only, and in all rows together."""
    a, b = table(spark, sf_dir, "observations").select("id").distinct(), table(spark, sf_dir, "grad_rows").select("id").distinct()
    n = lambda d, k: d.agg(F.count("*").alias("n")).select(F.lit(k).alias("set"), "n")
    return n(a.intersect(b), "both").unionByName(n(a.exceptAll(b), "observations only")).unionByName(n(b.exceptAll(a), "rows only")).unionByName(n(a.unionByName(b), "all"))


def dedup_rows(spark, sf_dir):
    """One document per text: the one with the smallest id."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.groupBy(F.md5("text").alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def dup_counts(spark, sf_dir):
    g = table(spark, sf_dir, "grad_rows")
    return g.agg((F.count("*") - F.countDistinct("id")).alias("repeated_ids"), (F.count("url") - F.countDistinct("url")).alias("repeated_urls"), F.sum(F.coalesce(F.col("registered_domain") == "", F.lit(True)).cast("int")).alias("without_domain"))


def dedup_redirects(spark, sf_dir):
    """Redirect hops of a page, each (status, address) once and in order."""
    p = table(spark, sf_dir, "page_docs").where("metadata.redirect_history is not null").select("id", F.array_distinct("metadata.redirect_history").alias("h")).groupBy("id").agg(F.first("h").alias("h"))
    return p.select("id", F.posexplode("h").alias("pos", "hop")).select("id", "pos", F.coalesce("hop.status_code", F.lit(-1)).alias("status_code"), F.col("hop.url").alias("url"))


def topk_sort(spark, sf_dir):
    """The 20 longest documents, ties by id."""
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("chars")).orderBy(F.col("chars").desc(), "doc_id").limit(20)


def topk_gold(spark, sf_dir):
    """A seeded sample of 25 predictions for review."""
    return table(spark, sf_dir, "predictions").select("eval_idx", "id").orderBy(C.seeded("eval_idx"), "eval_idx").limit(25)


def win_rank_audit(spark, sf_dir):
    """Cited features ranked by citations and by distinct domains, ties averaged."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "predictions").select("registered_domain", F.explode("cited_features").alias("feature")).where("feature is not null").groupBy("feature").agg(F.count("*").alias("a"), F.countDistinct("registered_domain").alias("b"))
    avg = lambda k: F.rank().over(Window.orderBy(F.col(k).desc())) + (F.count("*").over(Window.partitionBy(k)) - 1) / 2
    return c.select("feature", avg("a").alias("rank_a"), avg("b").alias("rank_b")).select("feature", "rank_a", "rank_b", F.round(1 / F.col("rank_a") + 1 / F.col("rank_b"), 6).alias("fused"))


def _p(spark, sf_dir):
    return table(spark, sf_dir, "predictions").select("eval_idx", "id", F.lower("label").alias("label"), F.lower("predicted_verdict").alias("verdict"), "cited_features", "generated_text", "registered_domain")


def ev_confusion(spark, sf_dir):
    return E.confusion(_p(spark, sf_dir), "label", "verdict", CLASSES)


def ev_prf(spark, sf_dir):
    return E.scores(_p(spark, sf_dir), "label", "verdict", CLASSES)


def ev_summary(spark, sf_dir):
    return E.summary(_p(spark, sf_dir), "label", "verdict", CLASSES)


def ev_parse_fail(spark, sf_dir):
    """Scores with unparsed answers counted as the wrong class."""
    p = _p(spark, sf_dir).withColumn("verdict", E.opposite_if_unparsed(F.col("label"), F.col("verdict"), ("phishing", "benign")))
    return E.scores(p, "label", "verdict", CLASSES)


def ev_auc(spark, sf_dir):
    """Capture scores as a predictor of the label: about a half, for they are none."""
    from pagesieve.plans.audit_queries import records

    return E.auc(records(spark, sf_dir).where("label is not null"), F.col("label") == "phishing", "score")


def ev_four_way(spark, sf_dir):
    """Verdict right or wrong against explanation right (F1 of a half or more) or wrong, per class."""
    g = join_grounding(spark, sf_dir).select("eval_idx", (F.col("f1") >= 0.5).alias("grounded"))
    p = _p(spark, sf_dir).join(g, "eval_idx").withColumn("right", F.coalesce(F.col("verdict") == F.col("label"), F.lit(False)))
    n = lambda a, b: F.sum((a & b).cast("int"))
    r, e = F.col("right"), F.col("grounded")
    return p.groupBy("label").agg(n(r, e).alias("cc"), n(r, ~e).alias("cw"), n(~r, e).alias("wc"), n(~r, ~e).alias("ww"))


def ev_faithfulness(spark, sf_dir):
    return _p(spark, sf_dir).select("eval_idx", E.faithfulness(F.col("cited_features"), F.col("generated_text")).alias("faithfulness"))


def ev_format_rate(spark, sf_dir):
    """Share of answers with every section."""
    t = F.lower(F.coalesce("generated_text", F.lit("")))
    has = lambda s: F.contains(t, F.lit(s))
    return _p(spark, sf_dir).agg(F.round(F.avg((has("phishing risk factors") & has("benign mitigating factors") & has("reasoning") & has("verdict")).cast("int")), 6).alias("format_rate"), F.count("*").alias("answers"))


def ev_text_overlap(spark, sf_dir):
    """Generated answer against the row's target: ROUGE-L and BLEU."""
    t = rows(spark, sf_dir).select("id", "target").distinct()
    return E.text_overlap(_p(spark, sf_dir).join(t, "id").select("eval_idx", "generated_text", "target"), "generated_text", "target").select("eval_idx", "rouge_l", "bleu")


def ml_majority_vote(spark, sf_dir):
    return E.majority_vote(_p(spark, sf_dir).where("registered_domain is not null"), "registered_domain", "verdict", ("phishing", "benign"))


def fn_parse_output(spark, sf_dir):
    """Parsed answers: verdict and numbers of risk and mitigating factors."""
    t = E.without_thoughts(F.col("generated_text"))
    return _p(spark, sf_dir).select("eval_idx", E.infer_verdict(t).alias("verdict"), F.size(E.section_items(t, "phishing risk factors")).alias("risks"), F.size(E.section_items(t, "benign mitigating factors")).alias("mitigations"))


def emb_pool(spark, sf_dir):
    """Mean vector of each label and its length."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("k", "x"))
    m = e.groupBy("label", "k").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return m.groupBy("label").agg(F.count("*").alias("dimensions"), F.round(F.sqrt(F.sum(F.col("m") * F.col("m"))), 5).alias("norm"))


def enrich_memo(spark, sf_dir):
    """Enrichment of distinct keys: how often a lookup by user would have been answered from memory."""
    e = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("lookups"), F.countDistinct("user_id").alias("misses"))
    return e.select("event_type", "lookups", "misses", (F.col("lookups") - F.col("misses")).alias("hits"))


_NOT = {"rows", "table"}
QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and k.split("_")[0] in ("win", "sample", "split", "overlap", "anti", "join", "label", "membership", "set", "dedup", "dup", "topk", "ev", "ml", "fn", "emb", "enrich") and getattr(v, "__module__", "") == __name__}

_G = "g AS (SELECT DISTINCT id, lower(label) AS label, source, split, url, registered_domain, built_at, target FROM (SELECT DISTINCT * FROM grad_rows))"
_P = "p AS (SELECT eval_idx, id, lower(label) AS label, lower(predicted_verdict) AS verdict, cited_features, generated_text, registered_domain FROM predictions)"
_H = lambda c: f"md5({c}::VARCHAR || ':42')"
_RN = lambda k, i: f"row_number() OVER (PARTITION BY {k} ORDER BY {_H(i)}, {i})"
_BR = lambda x: f"round_even({x}, 0)"
_VERDICT = r"""CASE WHEN v IN ('phishing', 'malicious', 'suspicious') THEN 'phishing' WHEN v IN ('benign', 'legitimate', 'safe') THEN 'benign' WHEN v = 'uncertain' THEN 'uncertain' END"""
_LASTV = r"regexp_extract_all(lower(coalesce({t}, '')), 'verdict\W{{0,6}}(phishing|benign|legitimate|safe|malicious|suspicious|uncertain)', 1)[-1]"
_GOLD = "gold AS (SELECT DISTINCT id, list_sort(list_distinct(regexp_extract_all(target, '(?m)^- ([a-z]+\\.[a-z_]+)$', 1))) AS gold FROM g)"
_SETS = """s AS (SELECT eval_idx, list_distinct(coalesce(cited_features, [])) AS c, gold, len(list_filter(list_distinct(coalesce(cited_features, [])), lambda x: x IS NULL)) AS nulls FROM predictions JOIN gold USING (id)), m AS (SELECT *, len(list_intersect(c, gold)) AS matched FROM s),
 q AS (SELECT *, coalesce(matched / nullif(len(c), 0), 0) AS p, coalesce(matched / nullif(len(gold), 0), 0) AS r FROM m)"""
_PRF = lambda v: " UNION ALL ".join(f"SELECT '{c}' AS class, round(coalesce(tp / nullif(p, 0), 0), 6) AS precision, round(coalesce(tp / nullif(n, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(p + n, 0), 0), 6) AS f1, n AS support FROM (SELECT count(*) FILTER (label = '{c}' AND {v} = '{c}') AS tp, count(*) FILTER ({v} = '{c}') AS p, count(*) FILTER (label = '{c}') AS n FROM p)" for c in CLASSES)
SQL = {
    "win_cap_per_key": f"WITH {_G} SELECT id, registered_domain FROM g WHERE registered_domain <> '' QUALIFY {_RN('registered_domain', 'id')} <= 3",
    "sample_balance": f"WITH {_G}, r AS (SELECT id, label, {_RN('label', 'id')} AS r FROM g WHERE label IS NOT NULL) SELECT id, label FROM r WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM r GROUP BY label))",
    "sample_oversample": f"WITH {_G} SELECT id, source, unnest(CASE WHEN source = 'phishing_feed' THEN [1, 2, 3] ELSE [1] END) AS copy FROM g",
    "sample_quota": f"WITH {_G}, r AS (SELECT label, source, {_RN('label', 'id')} AS r FROM g WHERE label IS NOT NULL) SELECT label, source, count(*) AS n FROM r WHERE r <= 40 GROUP BY ALL",
    "split_stratified": f"WITH {_G}, r AS (SELECT id, {_RN('source', 'id')} AS r, count(*) OVER (PARTITION BY source) AS n FROM g WHERE source IS NOT NULL) SELECT id, CASE WHEN r <= least(greatest(1, {_BR('n * 0.2')}), n - 1) THEN 'test' ELSE 'train' END AS split FROM r",
    "split_three_way": f"WITH {_G}, r AS (SELECT id, label, {_RN('label', 'id')} AS r, count(*) OVER (PARTITION BY label) AS n FROM g WHERE label IS NOT NULL), k AS (SELECT *, least(greatest(1, {_BR('n * 0.2')}), n - 1) AS k FROM r), v AS (SELECT *, least(greatest(1, {_BR('(n - k) * (0.1 / 0.8)')}), n - k - 1) AS v FROM k) SELECT id, label, CASE WHEN r <= k THEN 'test' WHEN r <= k + v THEN 'val' ELSE 'train' END AS split FROM v",
    "split_80_10_10": f"WITH {_G}, r AS (SELECT id, label, {_RN('label', 'id')} AS r, count(*) OVER (PARTITION BY label) AS n FROM g WHERE label IS NOT NULL), k AS (SELECT *, CASE WHEN n >= 3 THEN greatest(1, floor(n * 0.1)) ELSE 0 END AS k FROM r) SELECT id, label, CASE WHEN r <= k THEN 'test' WHEN r <= 2 * k THEN 'val' ELSE 'train' END AS split FROM k",
    "win_domain_greedy_split": f"""WITH {_G}, d AS (SELECT label, registered_domain, count(*) AS "rows" FROM g WHERE registered_domain <> '' AND label IS NOT NULL GROUP BY 1, 2),
 o AS (SELECT *, coalesce(sum("rows") OVER (PARTITION BY label ORDER BY {_H('registered_domain')}, registered_domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum("rows") OVER (PARTITION BY label) AS n FROM d),
 f AS (SELECT *, coalesce(min(b) FILTER (b >= {_BR('n * 0.15')}) OVER (PARTITION BY label), n) AS full_at FROM o)
 SELECT label, registered_domain, "rows", CASE WHEN b < {_BR('n * 0.15')} THEN 'test' WHEN b - full_at < {_BR('n * 0.15')} THEN 'val' ELSE 'train' END AS split FROM f""",
    "split_domain_stratified": f"WITH {_G}, c AS (SELECT registered_domain, label, count(*) AS n FROM g WHERE registered_domain <> '' AND label IS NOT NULL GROUP BY 1, 2), m AS (SELECT registered_domain, (list(label ORDER BY n DESC, label))[1] AS majority FROM c GROUP BY 1), r AS (SELECT *, {_RN('majority', 'registered_domain')} AS r, count(*) OVER (PARTITION BY majority) AS n FROM m) SELECT registered_domain, majority, CASE WHEN r <= least(greatest(1, {_BR('n * 0.2')}), n - 1) THEN 'test' ELSE 'train' END AS split FROM r",
    "split_can_stratify": f"WITH {_G}, c AS (SELECT label, count(*) AS n FROM g WHERE label IS NOT NULL GROUP BY 1) SELECT count(*) AS classes, min(n) AS least, min(n) >= 2 AND floor(sum(n) * 0.2) >= count(*) AS can_stratify FROM c",
    "overlap_check": f"WITH {_G}, s AS (SELECT DISTINCT registered_domain, split FROM g WHERE registered_domain IS NOT NULL AND split IS NOT NULL) SELECT x.split AS a, y.split AS b, count(*) AS shared FROM s x JOIN s y ON x.registered_domain = y.registered_domain AND x.split < y.split GROUP BY 1, 2",
    "anti_leaked_domains": f"WITH {_G} SELECT id, split FROM g WHERE registered_domain IS NOT NULL AND split IN ('val', 'test') AND registered_domain NOT IN (SELECT registered_domain FROM g WHERE split = 'train' AND registered_domain IS NOT NULL)",
    "join_label_content": "SELECT doc_id, kind, annotator, source, length(text) AS chars FROM doc_labels JOIN documents USING (doc_id)",
    "join_unmatched": "SELECT source, count(*) AS unlabelled FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM doc_labels) GROUP BY source",
    "join_lookup_loop": f"WITH {_G}, f AS (SELECT metadata.final_url AS url, arg_min(id, (captured_at, id)) AS page_id FROM page_docs WHERE metadata.final_url IS NOT NULL GROUP BY 1) SELECT g.id, page_id FROM g LEFT JOIN f USING (url) WHERE url IS NOT NULL",
    "join_grounding": f"WITH {_G}, {_GOLD}, {_SETS} SELECT eval_idx, matched, len(gold) - matched AS missed, len(c) - matched AS extra, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM q",
    "join_left_fill": "SELECT eval_idx, coalesce(len(list_distinct(cited_features)), 0) AS cited FROM predictions",
    "join_domain_delta": "WITH p AS (SELECT *, coalesce(lower(predicted_verdict) <> lower(label), true)::INT AS w FROM predictions WHERE registered_domain IS NOT NULL), a AS (SELECT registered_domain, count(*) AS n, avg(w) AS r FROM p WHERE eval_idx % 2 = 0 GROUP BY 1), b AS (SELECT registered_domain, count(*) AS n, avg(w) AS r FROM p WHERE eval_idx % 2 = 1 GROUP BY 1) SELECT registered_domain, round(a.r, 6) AS a, round(b.r, 6) AS b, round(b.r - a.r, 6) AS delta FROM a JOIN b USING (registered_domain) WHERE a.n >= 3 AND b.n >= 3",
    "join_shared_domains": f"WITH {_G} SELECT registered_domain, count(*) FILTER (label = 'phishing') AS phishing, count(*) FILTER (label = 'benign') AS benign FROM g WHERE registered_domain <> '' GROUP BY 1 HAVING phishing > 0 AND benign > 0",
    "join_model_compare": f"WITH {_P}, l AS (SELECT label, verdict, {_LASTV.format(t='generated_text')} AS v FROM p), x AS (SELECT label, verdict, {_VERDICT} AS i FROM l) SELECT CASE WHEN verdict IS NOT DISTINCT FROM i THEN 'same' WHEN i = label THEN 'fixed' WHEN verdict = label THEN 'broke' ELSE 'differ' END AS outcome, count(*) AS n FROM x GROUP BY 1",
    "label_by_id_map": f"WITH {_G}, gold AS (SELECT id, min(label) AS gold FROM g WHERE label IS NOT NULL GROUP BY 1), o AS (SELECT id, lower(trim(label)) AS label FROM observations QUALIFY row_number() OVER (PARTITION BY id ORDER BY captured_at DESC, ingested_at DESC) = 1) SELECT id, coalesce(label, gold) AS label FROM o LEFT JOIN gold USING (id)",
    "membership_suffix": f"WITH {_G}, h AS (SELECT id, lower(regexp_replace(regexp_extract(trim(url), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://)?([^/?#]*)', 1), '^.*@', '')) AS h FROM g WHERE url IS NOT NULL), k AS (SELECT id, regexp_replace(h, '\\.*(:[0-9]*)?$', '') AS h FROM h) SELECT id FROM k WHERE EXISTS (SELECT 1 FROM (SELECT lower(registered_domain) AS d FROM grad_rows WHERE registered_domain <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5) WHERE h = d OR h LIKE '%.' || d)",
    "set_operations": "WITH a AS (SELECT DISTINCT id FROM observations), b AS (SELECT DISTINCT id FROM grad_rows) SELECT 'both' AS \"set\", count(*) AS n FROM a WHERE id IN (SELECT id FROM b) UNION ALL SELECT 'observations only', count(*) FROM a WHERE id NOT IN (SELECT id FROM b) UNION ALL SELECT 'rows only', count(*) FROM b WHERE id NOT IN (SELECT id FROM a) UNION ALL SELECT 'all', (SELECT count(*) FROM a) + (SELECT count(*) FROM b)",
    "dedup_rows": "SELECT md5(text) AS h, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "dup_counts": "SELECT count(*) - count(DISTINCT id) AS repeated_ids, count(url) - count(DISTINCT url) AS repeated_urls, sum(coalesce(registered_domain = '', true)::INT)::BIGINT AS without_domain FROM grad_rows",
    "dedup_redirects": "WITH p AS (SELECT id, any_value(metadata.redirect_history) AS h FROM page_docs WHERE metadata.redirect_history IS NOT NULL GROUP BY id), x AS (SELECT id, unnest(h) AS hop, generate_subscripts(h, 1) AS k FROM p), d AS (SELECT id, hop, min(k) AS k FROM x GROUP BY id, hop) SELECT id, row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS pos, coalesce(hop.status_code, -1) AS status_code, hop.url AS url FROM d",
    "topk_sort": "SELECT doc_id, length(text) AS chars FROM documents ORDER BY chars DESC, doc_id LIMIT 20",
    "topk_gold": f"SELECT eval_idx, id FROM predictions ORDER BY {_H('eval_idx')}, eval_idx LIMIT 25",
    "win_rank_audit": "WITH c AS (SELECT feature, count(*) AS a, count(DISTINCT registered_domain) AS b FROM (SELECT registered_domain, unnest(cited_features) AS feature FROM predictions) WHERE feature IS NOT NULL GROUP BY 1), r AS (SELECT feature, rank() OVER (ORDER BY a DESC) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS rank_a, rank() OVER (ORDER BY b DESC) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rank_b FROM c) SELECT *, round(1 / rank_a + 1 / rank_b, 6) AS fused FROM r",
    "ev_confusion": f"WITH {_P} SELECT label, count(*) FILTER (verdict = 'phishing') AS said_phishing, count(*) FILTER (verdict = 'benign') AS said_benign, count(*) FILTER (verdict IS NULL OR verdict NOT IN ('phishing', 'benign')) AS said_other FROM p GROUP BY 1",
    "ev_summary": """WITH p AS (SELECT lower(label) AS label, lower(predicted_verdict) AS v FROM predictions WHERE lower(label) IN ('phishing', 'benign')), c AS (SELECT label AS k, count(*) AS n, count(*) FILTER (v = label) AS tp FROM p GROUP BY 1),
      s AS (SELECT k, n, tp, (SELECT count(*) FROM p WHERE v = k) AS said FROM c), f AS (SELECT round(tp / n, 6) AS r, round(coalesce(2 * (tp / nullif(said, 0)) * (tp / n) / nullif(tp / nullif(said, 0) + tp / n, 0), 0), 6) AS f1 FROM s)
      SELECT (SELECT count(*) FROM p) AS rows, (SELECT round(avg(CASE WHEN v = label THEN 1 ELSE 0 END), 6) FROM p) AS accuracy, round(avg(r), 4) AS balanced_accuracy, round(avg(f1), 4) AS macro_f1 FROM f""",
    "ev_prf": f"WITH {_P} {_PRF('verdict')}",
    "ev_parse_fail": f"WITH q AS (SELECT lower(label) AS label, lower(predicted_verdict) AS v FROM predictions), p AS (SELECT label, CASE WHEN v IN ('phishing', 'benign') THEN v WHEN label = 'phishing' THEN 'benign' ELSE 'phishing' END AS verdict FROM q) {_PRF('verdict')}",
    "ev_auc": """WITH o AS (SELECT lower(trim(label)) = 'phishing' AS y, capture_score AS s FROM observations QUALIFY row_number() OVER (PARTITION BY id ORDER BY captured_at DESC, ingested_at DESC) = 1), f AS (SELECT * FROM o WHERE y IS NOT NULL AND s IS NOT NULL), c AS (SELECT s, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS n FROM f GROUP BY s),
 w AS (SELECT *, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(p) OVER (ORDER BY s DESC) AS tp, sum(p + n) OVER (ORDER BY s DESC) AS al FROM c) SELECT round(sum(p * (below + n / 2)) / (sum(p) * sum(n)), 6) AS roc_auc, round(sum(p * tp / al) / sum(p), 6) AS average_precision, sum(p)::BIGINT AS positives, sum(n)::BIGINT AS negatives FROM w""",
    "ev_four_way": f"WITH {_G}, {_GOLD}, {_SETS}, f AS (SELECT eval_idx, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) >= 0.5 AS e FROM q), z AS (SELECT lower(label) AS label, coalesce(lower(predicted_verdict) = lower(label), false) AS r, e FROM predictions JOIN f USING (eval_idx)) SELECT label, count(*) FILTER (r AND e) AS cc, count(*) FILTER (r AND NOT e) AS cw, count(*) FILTER (NOT r AND e) AS wc, count(*) FILTER (NOT r AND NOT e) AS ww FROM z GROUP BY 1",
    "ev_faithfulness": f"WITH {_P}, t AS (SELECT eval_idx, coalesce(cited_features, []) AS c, lower(coalesce(generated_text, '')) AS t FROM p) SELECT eval_idx, CASE WHEN len(c) = 0 THEN 1.0 ELSE round(len(list_filter(c, lambda f: contains(t, lower(f)) OR contains(t, regexp_replace(lower(f), '[._]', ' ', 'g')) OR len(list_filter(string_split_regex(lower(f), '[._]'), lambda x: length(x) >= 5 AND contains(t, x))) > 0)) / len(c), 6) END AS faithfulness FROM t",
    "ev_format_rate": "SELECT round(avg((contains(t, 'phishing risk factors') AND contains(t, 'benign mitigating factors') AND contains(t, 'reasoning') AND contains(t, 'verdict'))::INT), 6) AS format_rate, count(*) AS answers FROM (SELECT lower(coalesce(generated_text, '')) AS t FROM predictions)",
    "ml_majority_vote": f"WITH {_P}, v AS (SELECT registered_domain, count(*) FILTER (verdict = 'phishing') AS a, count(*) FILTER (verdict = 'benign') AS b FROM p WHERE registered_domain IS NOT NULL GROUP BY 1) SELECT registered_domain, CASE WHEN a > b THEN 'phishing' WHEN b > a THEN 'benign' ELSE 'unknown' END AS verdict, a, b FROM v",
    "emb_pool": "WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings), m AS (SELECT label, k, avg(x) AS m FROM e GROUP BY ALL) SELECT label, count(*) AS dimensions, round(sqrt(sum(m * m)), 5) AS norm FROM m GROUP BY label",
    "enrich_memo": "SELECT event_type, count(*) AS lookups, count(DISTINCT user_id) AS misses, count(*) - count(DISTINCT user_id) AS hits FROM events GROUP BY 1",
}
