"""Queries on whole observations: graph scores, evidence rules, paper schemas, labels and keep filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagesieve.functions import text as T
from pagesieve.functions.urls import host, is_ip_host, registered_domain
from pagesieve.operators import html_features as HF
from pagesieve.operators import page_graph, rules
from pagesieve.operators import url_features as UF
from pagesieve.plans.schema_queries import SHORTENERS
from pagesieve.plans.url_queries import host_sql, reg_sql, suffixes
from pagesieve.runtime import latest, spread, table


def _seen(spark, sf_dir):
    return latest(table(spark, sf_dir, "observations"), "id", ["captured_at", "ingested_at"], {"input": F.col("input"), "label": F.lower(F.trim("label"))})


def hin_scores(spark, sf_dir):
    """Graph scores of every observation."""
    i = lambda c: F.col(f"input.{c}")
    none = F.array().cast("array<string>")
    refs = lambda c, f: F.coalesce(F.transform(F.filter(i(c), lambda x: x.isNotNull()), lambda x: F.coalesce(x[f], F.lit(""))), none)
    listed = F.concat(*[F.coalesce(i(f"resources.{r}"), none) for r in ("favicon_hrefs", "script_src_sample", "stylesheet_href_sample", "image_src_sample")], refs("iframes.items", "src"))
    pages = _seen(spark, sf_dir).select("id", F.coalesce(i("final_url"), i("url"), F.lit("")).alias("base"), F.concat(refs("anchors.items", "href"), refs("forms.items", "action")).alias("domain_refs"), listed.alias("resource_refs"))
    return page_graph.graph_scores(pages, suffixes(spark, sf_dir))


def _prepared(spark, sf_dir):
    """Measures of every stored state; ``id`` holds the time of the state with it, so that only results are shuffled to pick the latest."""
    state = F.struct("id", "captured_at", "ingested_at")
    return rules.prepare(spread(table(spark, sf_dir, "observations").select(state.alias("id"), "input")), suffixes(spark, sf_dir))


def _last(df, *columns):
    out = F.struct(*columns)
    return df.groupBy(F.col("id.id").alias("id")).agg(F.max_by(out, F.struct("id.captured_at", "id.ingested_at", F.xxhash64(*columns))).alias("_o")).select("id", "_o.*")


def stage_b_rules(spark, sf_dir):
    """Evidence of every observation, a row each."""
    e = _last(rules.evidence(_prepared(spark, sf_dir)), "features")
    return e.select("id", F.explode("features").alias("f")).select("id", F.col("f.id").alias("rule"), "f.direction", "f.severity")


def stage_b_measurements(spark, sf_dir):
    m = rules.measurements(_prepared(spark, sf_dir))
    return _last(m, *[c for c in m.columns if c != "id"])


def topk_evidence(spark, sf_dir):
    """The three gravest pieces of evidence of every observation."""
    e = _last(rules.evidence(_prepared(spark, sf_dir), exclude=["anchors.inventory"], most=3), "features")
    return e.select("id", F.array_join(F.transform("features", lambda f: f["id"]), ",").alias("rules"))


def _paper(spark, sf_dir):
    s = suffixes(spark, sf_dir)
    p = table(spark, sf_dir, "page_docs").where("length(html) > 0").select("id", "html", "title", F.coalesce("metadata.url", "url").alias("requested"), F.coalesce("metadata.final_url", "url").alias("final"), F.col("metadata.status_code").alias("status"), F.size(F.coalesce("metadata.redirect_history", F.array().cast("array<struct<status_code:int,url:string>>"))).alias("hops"))
    numbers = HF.html_features(spread(p), "id", "html", "title", "final", s).dropDuplicates(["id"])
    flat = p.withColumn("mailto", F.contains(F.lower("html"), F.lit("mailto:"))).drop("html", "title").dropDuplicates(["id"])
    label = table(spark, sf_dir, "observations").groupBy("id").agg(F.max_by(F.lower(F.trim("label")), F.struct("captured_at", "ingested_at")).alias("label"))
    return UF.url_features(flat, "final", "requested", s).join(numbers, "id").join(label, "id", "left"), s


def kapan_row(spark, sf_dir):
    """25 columns of addresses and markup and the class."""
    d, s = _paper(spark, sf_dir)
    a, b = F.coalesce(registered_domain(F.col("requested"), s), F.lit("")), F.coalesce(registered_domain(F.col("final"), s), F.lit(""))
    u = lambda c: F.col(f"url_{c}")
    h = lambda c: F.col(f"html_{c}")
    page = F.coalesce("final", "requested", F.lit(""))
    return d.select(
        "id", T.name_similarity(a, b).alias("domain_similarity"), F.length(page).alias("url_length"), u("scheme_is_https").alias("http_protocol"), u("dot_count").alias("num_dot"), u("slash_count").alias("num_slash"), T.count_of(page, "//").alias("num_double_slash"), u("hyphen_count").alias("num_hyphen"),
        u("underscore_count").alias("num_underscore"), u("equals_sign_count").alias("num_equal"), u("parenthesis_count").alias("num_paranthesis"), u("curly_bracket_count").alias("num_curly_bracket"), u("square_bracket_count").alias("num_square_bracket"), u("angle_bracket_count").alias("num_less_and_greater"),
        u("tilde_count").alias("num_tilde"), u("asterisk_count").alias("num_asterisk"), u("plus_sign_count").alias("num_plus"), (u("at_sign_count") > 0).cast("int").alias("url_inc_at"), u("host_is_ip_address").alias("url_inc_ip"), F.coalesce("status", F.lit(0)).alias("response_history"),
        ((F.col("hops") > 0) | (F.coalesce("requested", F.lit("")) != F.coalesce("final", F.lit("")))).cast("int").alias("redirect"), (h("anchors_with_href_count") + h("anchors_missing_href_count")).alias("num_a_href"), h("input_count").alias("num_input"), h("button_count").alias("num_button"), h("link_href_count").alias("num_link_href"), h("iframe_count").alias("num_iframe"),
        (F.col("label") == "phishing").cast("int").alias("class"),
    )


def uci_row(spark, sf_dir):
    """30 columns of -1, 0 and 1 and the result."""
    d, s = _paper(spark, sf_dir)
    u, h = (lambda c: F.col(f"url_{c}")), (lambda c: F.col(f"html_{c}"))
    sign = lambda bad: F.when(bad, -1).otherwise(1)
    bucket = lambda x, lo, hi: F.when(x < lo, 1).when(x <= hi, 0).otherwise(-1)
    domain = F.coalesce(registered_domain(F.col("final"), s), F.lit(""))
    links = F.coalesce(h("external_stylesheet_ratio"), F.lit(0.0))
    return d.select(
        "id", sign(u("host_is_ip_address") > 0).alias("having_IP_Address"), F.when(u("final_url_length") < 54, 1).when(u("final_url_length") <= 75, 0).otherwise(-1).alias("URL_Length"), sign(F.col("final").rlike(SHORTENERS)).alias("Shortining_Service"), sign(u("at_sign_count") > 0).alias("having_At_Symbol"),
        sign(u("extra_double_slash_count") > 0).alias("double_slash_redirecting"), sign(F.contains(F.element_at(F.split(domain, r"\."), 1), F.lit("-"))).alias("Prefix_Suffix"), F.when(u("subdomain_label_count") <= 1, 1).when(u("subdomain_label_count") == 2, 0).otherwise(-1).alias("having_Sub_Domain"),
        sign(u("scheme_is_https") == 0).alias("SSLfinal_State"), F.lit(0).alias("Domain_registeration_length"), sign(h("external_favicon_count") > 0).alias("Favicon"), sign(u("non_default_port_present") > 0).alias("port"), sign((u("https_token_in_hostname") > 0) & (u("scheme_is_https") == 0)).alias("HTTPS_token"),
        bucket(h("external_resource_ratio"), 0.22, 0.61).alias("Request_URL"), bucket(h("external_anchor_ratio"), 0.31, 0.67).alias("URL_of_Anchor"), bucket(links, 0.17, 0.81).alias("Links_in_tags"),
        F.when(h("form_count") == 0, 0).when(h("null_form_action_count") > 0, -1).when(h("external_form_action_count") > 0, 0).otherwise(1).alias("SFH"), sign(F.col("mailto")).alias("Submitting_to_email"),
        sign(F.coalesce(registered_domain(F.col("requested"), s), F.lit("")) != domain).alias("Abnormal_URL"), ((F.col("hops") > 0) | (F.coalesce("requested", F.lit("")) != F.coalesce("final", F.lit("")))).cast("int").alias("Redirect"), sign(h("onmouseover_handler_count") > 0).alias("on_mouseover"),
        sign(h("right_click_disabling_present") > 0).alias("RightClick"), sign(h("alert_or_popup_present") > 0).alias("popUpWidnow"), sign(h("iframe_count") > 0).alias("Iframe"), F.lit(0).alias("age_of_domain"), F.lit(-1).alias("DNSRecord"), F.lit(0).alias("web_traffic"), F.lit(0).alias("Page_Rank"), F.lit(0).alias("Google_Index"),
        F.when(h("internal_anchor_count") > 2, 1).when(h("internal_anchor_count") > 0, 0).otherwise(-1).alias("Links_pointing_to_page"), F.lit(0).alias("Statistical_report"), sign(F.col("label") == "phishing").alias("Result"),
    )


def keep_filter_counts(spark, sf_dir):
    """Why page documents are left out: the first reason that holds, in a fixed order."""
    p = table(spark, sf_dir, "page_docs")
    title = T.collapse_ws(F.lower("title"))
    reason = F.when(F.coalesce(F.col("metadata.status_code") != 200, F.lit(True)), "status").when(F.coalesce(F.trim("html"), F.lit("")) == "", "empty").when(title.isin("404 not found", "403 forbidden", "access denied", "error"), "error title").when(F.length("html") > 5_000_000, "size").otherwise("kept")
    return p.select(reason.alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def skip_doc(spark, sf_dir):
    """The other rule: no error, status missing or below 400."""
    p = table(spark, sf_dir, "page_docs")
    return p.where(F.col("error").isNull() & F.coalesce(F.col("metadata.status_code") < 400, F.lit(True))).select("id").distinct()


def label_normalize(spark, sf_dir):
    low = F.lower(F.trim("label"))
    return table(spark, sf_dir, "observations").groupBy(F.when(low.isin("phish", "malicious", "phishing"), "phishing").when(low.isin("legitimate", "safe", "benign"), "benign").alias("label")).agg(F.count("*").alias("n"))


def clean_rows(spark, sf_dir):
    """Training rows, first of each address, of 10 characters or more and with a domain; how many each step keeps."""
    g = table(spark, sf_dir, "grad_rows").distinct()
    first = g.groupBy("url").agg(F.min(F.struct("built_at", "id", "registered_domain")).alias("f")).select("url", "f.id", "f.registered_domain")
    return first.agg(F.count("*").alias("addresses"), F.sum((F.length("url") >= 10).cast("int")).alias("long_enough"), F.sum(((F.length("url") >= 10) & (F.col("registered_domain") != "")).cast("int")).alias("kept"))


def redact_emails(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.contains("text", F.lit("@"))).select("doc_id", F.md5(T.redact_email(F.col("text"))).alias("redacted"))


def text_windows(spark, sf_dir):
    """Head, and head with tail, of documents under a budget."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return d.select("doc_id", F.md5(F.substring("text", 1, 200)).alias("head"), F.md5(T.truncate_ends(F.col("text"), 200)).alias("ends"))


def char_entropy(spark, sf_dir):
    """Entropy of titles and the longest run of one character."""
    return table(spark, sf_dir, "page_docs").where("title is not null").select("id", "title").distinct().select("id", F.round(T.entropy(F.col("title")), 6).alias("entropy"), T.longest_char_run(F.col("title"), 2).alias("pairs"), T.stable_int(F.col("title")).alias("stable"))


QUERIES = {q.__name__: q for q in (hin_scores, stage_b_rules, stage_b_measurements, topk_evidence, kapan_row, uci_row, keep_filter_counts, skip_doc, label_normalize, clean_rows, redact_emails, text_windows, char_entropy)}

_R = "lower(trim(coalesce(ref, '')))"
_HIN = f"""WITH o AS (SELECT id, input FROM observations QUALIFY row_number() OVER (PARTITION BY id ORDER BY captured_at DESC, ingested_at DESC) = 1), b AS (SELECT id, input, {host_sql("coalesce(input.final_url, input.url, '')")} AS bh FROM o), c AS (SELECT id, input, coalesce({reg_sql('bh')}, '') AS base FROM b),
 l AS (SELECT id, base, 'd' AS kind, unnest(list_transform(list_filter(input.anchors.items, lambda x: x IS NOT NULL), lambda x: coalesce(x.href, ''))) AS ref FROM c UNION ALL SELECT id, base, 'd', unnest(list_transform(list_filter(input.forms.items, lambda x: x IS NOT NULL), lambda x: coalesce(x.action, ''))) FROM c
  UNION ALL SELECT id, base, 'r', unnest(list_transform(list_filter(input.iframes.items, lambda x: x IS NOT NULL), lambda x: coalesce(x.src, ''))) FROM c {''.join(f" UNION ALL SELECT id, base, 'r', unnest(input.resources.{r}) FROM c" for r in ('favicon_hrefs', 'script_src_sample', 'stylesheet_href_sample', 'image_src_sample'))}),
 h AS (SELECT id, base, kind, {_R} AS low, {host_sql(_R)} AS hh FROM l), e AS (SELECT id, base, kind, low, coalesce({reg_sql('hh')}, '') AS d FROM h),
 r AS (SELECT id, kind, CASE WHEN low IN ('', '#', '/', 'about:blank') OR regexp_matches(low, '^(javascript:|mailto:|tel:)') THEN 'null' WHEN NOT regexp_matches(low, '^(https?:)?//') THEN 'relative' WHEN d = base THEN 'local' ELSE 'foreign' END AS rel, d FROM e),
 n AS (SELECT id, kind, CASE rel WHEN 'null' THEN '<null>' WHEN 'relative' THEN '<relative>' ELSE d END AS key, count(*) FILTER (rel = 'local') AS l, count(*) FILTER (rel = 'foreign') AS f, count(*) FILTER (rel = 'null') AS n, count(*) FILTER (rel = 'relative') AS r FROM r GROUP BY ALL),
 s AS (SELECT *, (f + n + 0.25::DOUBLE * r - l) / (l + f + n + r) AS b FROM n),
 g AS (SELECT id, avg(b) AS m, var_pop(b) AS v, 0.4 * greatest(max(b) - avg(b), avg(b) - min(b)) AS mv, {', '.join(f"coalesce(sum({c}) FILTER (kind = '{k}'), 0)::BIGINT AS {p}_{w}_link" for k, p in (('d', 'dom'), ('r', 'res')) for c, w in (('l', 'local'), ('f', 'foreign'), ('n', 'null'), ('r', 'relative')))},
  avg(b) FILTER (kind = 'd') AS md, var_pop(b) FILTER (kind = 'd') AS vd, count(*) FILTER (kind = 'd') AS nd, avg(b) FILTER (kind = 'r') AS mr, var_pop(b) FILTER (kind = 'r') AS vr, count(*) FILTER (kind = 'r') AS nr FROM s GROUP BY id)
 SELECT o.id, round(coalesce(m, 0), 6) AS score, CASE WHEN coalesce(mv, 0) < 1e-5 THEN 1 ELSE 2 END AS iters, {', '.join(f'coalesce({p}_{w}_link, 0) AS {p}_{w}_link' for p in ('dom', 'res') for w in ('local', 'foreign', 'null', 'relative'))}, round(coalesce(0.6 * md + 0.4 * m, 0), 6) AS dom_mean, round(coalesce(0.36 * vd, 0), 6) AS dom_var, round(coalesce(m, 0), 6) AS mean, round(coalesce(0.36 * v, 0), 6) AS var,
  coalesce(nd, 0) AS domain_object_count, coalesce(nr, 0) AS resource_object_count, round(coalesce(0.6 * mr + 0.4 * m, 0), 6) AS resource_mean, round(coalesce(0.36 * vr, 0), 6) AS resource_var FROM o LEFT JOIN g USING (id)"""
SQL = {
    "hin_scores": _HIN,
    "keep_filter_counts": "SELECT CASE WHEN coalesce(metadata.status_code <> 200, true) THEN 'status' WHEN coalesce(trim(html), '') = '' THEN 'empty' WHEN trim(regexp_replace(lower(coalesce(title, '')), '[\\s\\p{Z}]+', ' ', 'g')) IN ('404 not found', '403 forbidden', 'access denied', 'error') THEN 'error title' WHEN length(html) > 5000000 THEN 'size' ELSE 'kept' END AS reason, count(*) AS n FROM page_docs GROUP BY 1",
    "skip_doc": "SELECT DISTINCT id FROM page_docs WHERE error IS NULL AND coalesce(metadata.status_code < 400, true)",
    "label_normalize": "SELECT CASE WHEN lower(trim(label)) IN ('phish', 'malicious', 'phishing') THEN 'phishing' WHEN lower(trim(label)) IN ('legitimate', 'safe', 'benign') THEN 'benign' END AS label, count(*) AS n FROM observations GROUP BY 1",
    "clean_rows": "WITH f AS (SELECT url, arg_min(registered_domain, (built_at, id)) AS d, bool_or(registered_domain <> '') AS any_d FROM (SELECT DISTINCT * FROM grad_rows) GROUP BY url), g AS (SELECT url, registered_domain AS d FROM (SELECT DISTINCT * FROM grad_rows) QUALIFY row_number() OVER (PARTITION BY url ORDER BY built_at, id, registered_domain NULLS FIRST) = 1) SELECT count(*) AS addresses, count(*) FILTER (length(url) >= 10) AS long_enough, count(*) FILTER (length(url) >= 10 AND d <> '') AS kept FROM g",
    "redact_emails": r"SELECT doc_id, md5(regexp_replace(text, '(?i)\b[a-z0-9._%+\-]+@([a-z0-9.\-]+\.[a-z]{2,})', '<email>@\1', 'g')) AS redacted FROM documents WHERE contains(text, '@')",
    "text_windows": "SELECT doc_id, md5(substring(text, 1, 200)) AS head, md5(CASE WHEN length(text) <= 200 THEN text ELSE substring(text, 1, 97) || ' ... ' || right(text, 98) END) AS ends FROM documents WHERE text IS NOT NULL",
    "char_entropy": "SELECT DISTINCT id, round(coalesce(list_entropy(list_filter(string_split(title, ''), lambda x: x <> '')), 0), 6) AS entropy, len(list_filter(range(1, length(title)), lambda i: substring(title, i, 1) = substring(title, i + 1, 1))) AS pairs, ('0x' || substring(sha256(title), 1, 15))::BIGINT AS stable FROM page_docs WHERE title IS NOT NULL",
}
