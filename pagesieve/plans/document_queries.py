"""Queries on document shapes and labels (small inline cases, stated in SQL as well) and on words of addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagesieve.operators import documents as D
from pagesieve.operators import evaluation as E
from pagesieve.operators.url_features import with_parts
from pagesieve.plans.audit_queries import rows
from pagesieve.plans.curation_queries import SQL as _CURATION_SQL
from pagesieve.plans.url_queries import PARTS, pages, suffixes
from pagesieve.runtime import latest, table

_SCAN = "struct<virustotal:struct<malicious_engine_count:int,suspicious_engine_count:int>,google_safe_browsing:struct<matched:boolean,status:string>>"
#: malicious engines, suspicious engines, list hit, list status of the first and of the later scan
_CASES = [
    (1, (0, 0), (False, "clean"), (6, 0), (False, "clean")), (2, (3, 0), (False, ""), None, None), (3, (0, 0), (True, ""), (None, None), (True, "")), (4, (6, 1), None, (None, None), (None, "")), (5, None, None, None, (None, "malicious")), (6, (5, 0), (False, "clean"), None, None), (7, None, None, None, None), (8, (0, 2), (False, "ok"), (0, 0), (False, "ok")),
]


def _scans(spark):
    data = [(i, None if v0 is None and g0 is None else (v0, g0), None if v7 is None and g7 is None else (v7, g7)) for i, v0, g0, v7, g7 in _CASES]
    return spark.createDataFrame(data, f"case int, t0 {_SCAN}, t7 {_SCAN}")


def label_latest_scan(spark, sf_dir):
    return _scans(spark).select("case", D.latest_scan_label(F.col("t0"), F.col("t7")).alias("label"))


def label_vt_threshold(spark, sf_dir):
    return _scans(spark).select("case", D.threshold_label(F.col("t0"), F.col("t7")).alias("label"))


def normalize_document(spark, sf_dir):
    """Page documents in canonical form, as if the shape were unknown."""
    p = table(spark, sf_dir, "page_docs").select("id", "url", "title", F.nullif("html", F.lit("")).alias("html"), "metadata").withColumns({"task": F.struct(F.col("url").alias("url")), "page": F.struct(F.col("url").alias("url"), F.col("title").alias("title"), F.col("metadata.status_code").alias("status")), "dom": F.struct(F.lit(None).cast("binary").alias("data"))})
    d = D.normalize_document(p)
    return d.select("id", "url", "final_url", "status_code", F.length("title").alias("title_length"), F.length("html").alias("html_length")).na.fill(-1).distinct()


def sensitive_paths(spark, sf_dir):
    """Fields of observations that name a label: a walk over the schema."""
    found = D.schema_paths(table(spark, sf_dir, "observations").schema)
    return spark.createDataFrame([(p,) for p in found], "path string")


def banned_paths(spark, sf_dir):
    """Paths of keys in raw lines that speak of registration data or reputation, with the number of lines."""
    found = D.json_paths(F.col("payload"), D.BANNED, exact=False, entries=None)
    r = table(spark, sf_dir, "raw_records").select(F.explode(F.array_distinct(F.transform(found, lambda p: F.regexp_replace(p, r"\[\d+\]", "[]")))).alias("path"))
    return r.groupBy("path").agg(F.count("*").alias("n"))


def prune_input(spark, sf_dir):
    """Observations as a model may see them."""
    seen = latest(table(spark, sf_dir, "observations"), "id", ["captured_at", "ingested_at"], {"input": F.col("input")})
    return seen.select("id", D.prune("input").alias("observation"))


def taxonomy_filter(spark, sf_dir):
    """Cited ids that belong to a list, per prediction."""
    known = F.array(*[F.lit(k) for k in ("url.long_url", "url.ip_host", "html.password_form", "redirect.domain_change")])
    return table(spark, sf_dir, "predictions").select("eval_idx", F.array_join(F.array_sort(F.array_intersect(F.coalesce("cited_features", F.array().cast("array<string>")), known)), ",").alias("known"))


def url_words(spark, sf_dir):
    p = with_parts(pages(spark, sf_dir).withColumn("_u", F.coalesce("final", F.lit(""))), "_u", suffixes(spark, sf_dir))
    f = D.word_features(F.col("_u"), F.col("_host"), F.col("_path"))
    return p.select("id", *[c.alias(k) for k, c in sorted(f.items())])


def ev_contradiction(spark, sf_dir):
    """Verdicts against their own evidence: phishing without a risk, benign with more risks than mitigations plus one."""
    t = E.without_thoughts(F.col("generated_text"))
    p = table(spark, sf_dir, "predictions").select("eval_idx", F.lower("predicted_verdict").alias("v"), F.size(E.section_items(t, "phishing risk factors")).alias("risks"), F.size(E.section_items(t, "benign mitigating factors")).alias("mitigations"))
    flag = ((F.col("v") == "phishing") & (F.col("risks") == 0) & (F.col("mitigations") >= 1)) | ((F.col("v") == "benign") & (F.col("risks") > F.col("mitigations") + 1))
    return p.select("eval_idx", "risks", "mitigations", F.coalesce(flag, F.lit(False)).alias("contradiction"))


def ev_weighted_consistency(spark, sf_dir):
    """Verdicts against weighted evidence (password forms weigh three, everything else one)."""
    t = E.without_thoughts(F.col("generated_text"))
    weight = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.when(x == "html.password_form", 3).otherwise(1))
    p = table(spark, sf_dir, "predictions").select("eval_idx", F.lower("predicted_verdict").alias("v"), weight(E.section_items(t, "phishing risk factors")).alias("risk"), weight(E.section_items(t, "benign mitigating factors")).alias("benign"))
    wrong = ((F.col("v") == "phishing") & (F.col("risk") == 0) & (F.col("benign") > 0)) | ((F.col("v") == "benign") & (F.col("risk") >= F.col("benign") + 3))
    return p.agg(F.round(F.avg((~F.coalesce(wrong, F.lit(False))).cast("int")), 6).alias("consistent"), F.count("*").alias("answers"))


def ev_resolve(spark, sf_dir):
    """A verdict for every prediction: stated, else inferred from its text, else benign."""
    return table(spark, sf_dir, "predictions").select("eval_idx", F.coalesce(F.when(F.lower("predicted_verdict").isin("phishing", "benign"), F.lower("predicted_verdict")), E.infer_verdict(F.col("generated_text")), F.lit("benign")).alias("verdict"))


def ev_diversity(spark, sf_dir):
    """Mean pairwise Jaccard similarity of letter 4-grams of the first 50 answers (a report on 50 by definition), and the share with a near copy among them."""
    p = table(spark, sf_dir, "predictions").where("generated_text is not null").orderBy("eval_idx").limit(50).select("eval_idx", F.lower("generated_text").alias("t")).where("length(t) >= 4")
    g = p.select("eval_idx", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("t") - 3), lambda i: F.substring(F.col("t"), i, 4)))).alias("g"))
    n = g.groupBy("eval_idx").agg(F.count("*").alias("n"))
    both = g.alias("x").join(g.alias("y"), (F.col("x.g") == F.col("y.g")) & (F.col("x.eval_idx") < F.col("y.eval_idx"))).groupBy(F.col("x.eval_idx").alias("a"), F.col("y.eval_idx").alias("b")).agg(F.count("*").alias("k"))
    j = both.join(n.select(F.col("eval_idx").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("eval_idx").alias("b"), F.col("n").alias("nb")), "b").select("a", "b", (F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))).alias("s"))
    total = n.agg(F.count("*").alias("c"))
    near = j.where("s > 0.8").select(F.explode(F.array("a", "b")).alias("e")).agg(F.countDistinct("e").alias("t"))
    return j.agg(F.sum("s").alias("s")).crossJoin(total).crossJoin(near).select(F.round(F.col("s") / (F.col("c") * (F.col("c") - 1) / 2), 6).alias("mean_similarity"), F.round(F.col("t") / F.col("c"), 6).alias("template_rate"))


def fn_extract_json(spark, sf_dir):
    """Raw lines: length of the first JSON object in each."""
    return table(spark, sf_dir, "raw_records").select("line_no", F.coalesce(F.length(D.first_json(F.col("payload"))), F.lit(-1)).alias("chars"))


def _frequent_domains(spark, sf_dir, most: int = 5) -> list[str]:
    """The most frequent registered domains of the training rows stand for a list of well-known ones."""
    d = table(spark, sf_dir, "grad_rows").where("registered_domain <> ''").select(F.lower("registered_domain").alias("d"))
    return [r["d"] for r in d.groupBy("d").count().orderBy(F.col("count").desc(), "d").limit(most).collect()]


def fn_similar_hosts(spark, sf_dir):
    """Registered domains whose first label is within one edit of a well-known one's."""
    known = F.array(*[F.lit(k.split(".")[0]) for k in _frequent_domains(spark, sf_dir)] or [F.lit(None).cast("string")])
    d = rows(spark, sf_dir).where("registered_domain <> ''").select(F.lower("registered_domain").alias("d")).distinct()
    return d.select("d", F.element_at(F.split("d", r"\."), 1).alias("name")).where(F.exists(known, lambda k: F.levenshtein(F.col("name"), k) < 2)).select(F.col("d").alias("domain"))


def aggregate_metrics(spark, sf_dir):
    """Means of the set scores of all predictions."""
    from pagesieve.plans.curation_queries import join_grounding

    g = join_grounding(spark, sf_dir)
    return g.agg(*[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1", "missed", "extra")])


QUERIES = {k: v for k, v in list(globals().items()) if callable(v) and getattr(v, "__module__", "") == __name__ and not k.startswith("_")}


def _case_sql() -> str:
    def scan(v, g):
        if v is None and g is None:
            return "NULL, NULL, NULL, NULL, false"
        q = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else f"'{x}'" if isinstance(x, str) else str(x)
        return ", ".join(map(q, (*(v or (None, None)), *(g or (None, None))))) + ", true"

    return "c(case_no, m0, s0, h0, u0, p0, m7, s7, h7, u7, p7) AS (VALUES " + ", ".join(f"({i}, {scan(v0, g0)}, {scan(v7, g7)})" for i, v0, g0, v7, g7 in _CASES) + ")"


def _label_of(k: int) -> str:
    return f"CASE WHEN (m{k} IS NOT NULL OR s{k} IS NOT NULL) AND (h{k} IS NOT NULL OR coalesce(u{k}, '') <> '') THEN CASE WHEN coalesce(m{k}, 0) + coalesce(s{k}, 0) > 0 OR coalesce(h{k}::BOOLEAN, false) OR lower(coalesce(u{k}, '')) = 'malicious' THEN 'phishing' ELSE 'benign' END END"


_ITEMS = lambda h: f"list_filter(list_transform(string_split(regexp_extract(coalesce(generated_text, ''), '(?is){h}\\s*:?\\s*\\n((?:\\s*[-*•][^\\n]*\\n?)*)', 1), chr(10)), lambda x: trim(regexp_replace(x, '^\\s*[-*•]\\s*', ''))), lambda x: x <> '' AND lower(x) <> 'none')"
_W = lambda c: f"list_filter(string_split_regex(lower({c}), '[-./?=@&%:_]'), lambda w: w <> '')"
_N = lambda s, c: f"((length({s}) - length(replace({s}, '{c}', ''))) // {len(c)})"


def _words_sql() -> str:
    cols: dict[str, str] = {}
    for name, c in (("url", "host || path"), ("host", "host"), ("path", "path")):
        n = f"list_transform({_W(c)}, lambda x: length(x))"
        cols |= {f"words_{name}": f"len({_W(c)})", f"shortest_word_{name}": f"coalesce(list_min({n}), 0)", f"longest_word_{name}": f"coalesce(list_max({n}), 0)", f"average_word_{name}": f"round(coalesce(list_avg({n}), 0), 6)"}
    w = _W("host || path")
    rep = lambda k: f"coalesce(list_sum(list_transform({w}, lambda x: len(list_filter(range(1, length(x) - {k} + 2), lambda i: substring(x, i, {k}) = repeat(substring(x, i, 1), {k}))))), 0)"
    cols |= {
        "char_repeat": f"({rep(2)} + {rep(3)} + {rep(4)} + {rep(5)})::INT", "count_www": f"len(list_filter({w}, lambda x: contains(x, 'www')))", "count_com": f"len(list_filter({w}, lambda x: contains(x, 'com')))", "ratio_digits_host": "round(len(regexp_extract_all(host, '[0-9]')) / greatest(1, length(host)), 6)",
        "ratio_digits_url": "round(len(regexp_extract_all(u, '[0-9]')) / greatest(1, length(u)), 6)", "abnormal_subdomain": r"regexp_matches(u, '(https?://(ww?|\d))(w?(\d|-))')::INT", "prefix_suffix": r"regexp_matches(u, 'https?://[^\-]+-[^\-]+/')::INT", "http_in_path": _N("path", "http"), "path_is_text": "ends_with(path, '.txt')::INT",
        "subdomain_grade": f"least(greatest({_N('u', '.')}, 1), 3)", "comma_count": _N("u", ","), "dollar_count": _N("u", "$"), "semicolon_count": _N("u", ";"), "space_count": "len(regexp_extract_all(u, ' |%20'))", "colon_count": _N("u", ":"), "or_count": _N("u", "|"), "exclamation_count": _N("u", "!"),
    }
    return f"WITH {PARTS} SELECT id, " + ", ".join(f"{v} AS {k}" for k, v in sorted(cols.items())) + " FROM e"


SQL = {
    "label_latest_scan": f"WITH {_case_sql()} SELECT case_no AS \"case\", coalesce({_label_of(7)}, {_label_of(0)}) AS label FROM c",
    "label_vt_threshold": f"WITH {_case_sql()}, x AS (SELECT case_no, CASE WHEN p7 THEN m7 ELSE m0 END AS m, CASE WHEN p7 THEN h7::BOOLEAN ELSE h0::BOOLEAN END AS h, CASE WHEN p7 THEN u7 ELSE u0 END AS u FROM c) SELECT case_no AS \"case\", CASE WHEN m > 5 THEN 'phishing' WHEN m IS NOT NULL THEN 'benign' WHEN coalesce(h, false) OR lower(coalesce(u, '')) = 'malicious' THEN 'phishing' END AS label FROM x",
    "normalize_document": "WITH p AS (SELECT id, url, title, nullif(html, '') AS html, metadata, rtrim(substring(trim(regexp_replace(coalesce(title, ''), '[\\s\\p{Z}]+', ' ', 'g')), 1, 300)) AS t FROM page_docs) SELECT DISTINCT id, CASE WHEN html IS NOT NULL THEN coalesce(CASE WHEN trim(metadata.url) <> '' THEN metadata.url END, CASE WHEN trim(url) <> '' THEN url END) ELSE CASE WHEN trim(url) <> '' THEN url END END AS url, CASE WHEN html IS NOT NULL THEN coalesce(CASE WHEN trim(metadata.final_url) <> '' THEN metadata.final_url END, CASE WHEN trim(url) <> '' THEN url END) ELSE CASE WHEN trim(url) <> '' THEN url END END AS final_url, coalesce(metadata.status_code, -1) AS status_code, length(t) AS title_length, coalesce(length(html), -1) AS html_length FROM p",
    "taxonomy_filter": "SELECT eval_idx, coalesce(list_aggregate(list_sort(list_distinct(list_filter(cited_features, lambda x: x IN ('url.long_url', 'url.ip_host', 'html.password_form', 'redirect.domain_change')))), 'string_agg', ','), '') AS known FROM predictions",
    "url_words": _words_sql(),
    "ev_contradiction": f"WITH p AS (SELECT eval_idx, lower(predicted_verdict) AS v, len({_ITEMS('phishing risk factors')}) AS risks, len({_ITEMS('benign mitigating factors')}) AS mitigations FROM predictions) SELECT eval_idx, risks, mitigations, coalesce((v = 'phishing' AND risks = 0 AND mitigations >= 1) OR (v = 'benign' AND risks > mitigations + 1), false) AS contradiction FROM p",
    "ev_diversity": """WITH p AS (SELECT eval_idx, lower(generated_text) AS t FROM predictions WHERE generated_text IS NOT NULL ORDER BY eval_idx LIMIT 50), g AS (SELECT DISTINCT eval_idx, unnest(list_transform(range(1, length(t) - 2), lambda i: substring(t, i, 4))) AS g FROM p WHERE length(t) >= 4), n AS (SELECT eval_idx, count(*) AS n FROM g GROUP BY 1),
 k AS (SELECT x.eval_idx AS a, y.eval_idx AS b, count(*) AS k FROM g x JOIN g y ON x.g = y.g AND x.eval_idx < y.eval_idx GROUP BY 1, 2), j AS (SELECT a, b, k / (na.n + nb.n - k) AS s FROM k JOIN n na ON na.eval_idx = a JOIN n nb ON nb.eval_idx = b), c AS (SELECT count(*) AS c FROM n)
 SELECT round((SELECT sum(s) FROM j) / (c * (c - 1) / 2), 6) AS mean_similarity, round((SELECT count(DISTINCT e) FROM (SELECT a AS e FROM j WHERE s > 0.8 UNION ALL SELECT b FROM j WHERE s > 0.8)) / c, 6) AS template_rate FROM c""",
    "fn_similar_hosts": """WITH n AS (SELECT lower(registered_domain) AS d, count(*) AS n FROM grad_rows WHERE registered_domain <> '' GROUP BY 1), k AS (SELECT split_part(d, '.', 1) AS k FROM n ORDER BY n DESC, d LIMIT 5)
      SELECT d AS domain FROM n WHERE EXISTS (SELECT 1 FROM k WHERE levenshtein(split_part(d, '.', 1), k) < 2)""",
}
_INFERRED = r"regexp_extract_all(lower(coalesce(generated_text, '')), 'verdict\W{0,6}(phishing|benign|legitimate|safe|malicious|suspicious|uncertain)', 1)[-1]"
_SCORED = _CURATION_SQL["join_grounding"]
SQL |= {
    "sensitive_paths": "SELECT column_name AS path FROM (DESCRIBE observations) WHERE column_name IN ('label', 'target', 'verdict', 'class', 'is_phishing', 'ground_truth', 'y', 'result', 'prediction', 'score', 'malicious', 'phishing', 'benign', 'scan_verdict')",
    "ev_resolve": f"WITH p AS (SELECT eval_idx, lower(predicted_verdict) AS v, {_INFERRED} AS i FROM predictions) SELECT eval_idx, coalesce(CASE WHEN v IN ('phishing', 'benign') THEN v END, CASE WHEN i IN ('phishing', 'malicious', 'suspicious') THEN 'phishing' WHEN i IN ('benign', 'legitimate', 'safe') THEN 'benign' WHEN i = 'uncertain' THEN 'uncertain' END, 'benign') AS verdict FROM p",
    "aggregate_metrics": f"SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, round(avg(missed), 6) AS missed, round(avg(extra), 6) AS extra FROM ({_SCORED})",
    "ev_weighted_consistency": f"WITH p AS (SELECT lower(predicted_verdict) AS v, {_ITEMS('phishing risk factors')} AS a, {_ITEMS('benign mitigating factors')} AS b FROM predictions), w AS (SELECT v, coalesce(list_sum(list_transform(a, lambda x: CASE WHEN x = 'html.password_form' THEN 3 ELSE 1 END)), 0) AS r, coalesce(list_sum(list_transform(b, lambda x: CASE WHEN x = 'html.password_form' THEN 3 ELSE 1 END)), 0) AS g FROM p) SELECT round(avg((NOT coalesce((v = 'phishing' AND r = 0 AND g > 0) OR (v = 'benign' AND r >= g + 3), false))::INT), 6) AS consistent, count(*) AS answers FROM w",
}
