"""Queries on observed pages, names of organizations, answers of models, scans and the store."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesieve.functions import brands as B
from pagesieve.functions.urls import host, registered_domain, registered_domain_of_host
from pagesieve.operators import answers as A
from pagesieve.operators import registry, stage_a
from pagesieve.plans.url_queries import host_sql, reg_sql, suffixes
from pagesieve.runtime import latest, shared_dir, table
from pagesieve.sources import readers
from pagesieve.sources.store import Store

#: Most frequent registered domains that stand for known organizations: the first for providers of three kinds, all for brands.
KNOWN, KINDS = 20, ("known_payment_or_app_store", "known_identity_provider", "known_infrastructure_provider")
#: Rules that only ask what the visible text speaks of, and the matter of each.
TEXT_RULES = {
    "cookie.notice": "cookie", "disclosure.present": "disclosure", "verification.challenge_language": "verification", "challenge.captcha_or_antibot": "captcha", "security.claim_language": "security", "urgency.language": "urgency",
    "trust.reassurance_language": "trust", "content.download_prompt": "download", "content.installer_prompt": "installer", "content.payment_request_language": "payment", "content.checkout_shipping_cues": "checkout",
    "content.article_editorial": "article", "content.business_service_catalog": "business", "content.profile_organization": "profile", "content.directory_service": "directory", "chat.widget_presence": "chat", "content.comment_social_proof": "comment",
}
GENERIC_LABELS = ["www", "login", "auth", "account", "accounts", "secure", "mail", "app", "cdn", "static"]


def _seen(spark: SparkSession, sf_dir: str, fields: list[str]) -> DataFrame:
    return latest(table(spark, sf_dir, "observations"), "id", ["captured_at", "ingested_at"], {f: F.col(f"input.{f}") for f in fields})


def _known_domains(spark: SparkSession, sf_dir: str) -> list[str]:
    """The ``KNOWN`` most frequent registered domains of the training rows."""
    d = table(spark, sf_dir, "grad_rows").where(F.col("registered_domain").rlike(r"^[a-z0-9.-]+\.[a-z]+$"))
    return [r[0] for r in d.groupBy("registered_domain").count().orderBy(F.col("count").desc(), "registered_domain").limit(KNOWN).collect()]


def _brands(known: list[str]) -> dict[str, list[str]]:
    """Domains of each brand: the letters its first label begins with name it."""
    out: dict[str, list[str]] = {}
    for d in known:
        out.setdefault(d.split(".")[0][:4], []).append(d)
    return out


def stage_a_observations(spark, sf_dir):
    """Observations made from the markup of page documents, as JSON."""
    pages = table(spark, sf_dir, "page_docs").groupBy("id").agg(F.max(F.struct("html", "title")).alias("p")).select("id", "p.html", "p.title")
    seen = stage_a.observations(pages, "id", "html", "title")
    o = F.col("observed")
    return seen.select(
        "id", o["title"].alias("title"), F.length(o["visible_text"]).alias("text_length"), o["forms"]["total_observed"].alias("forms"), o["anchors"]["total_observed"].alias("anchors"), o["iframes"]["total_observed"].alias("iframes"),
        F.size(o["meta"]).alias("meta"), F.size(o["resources"]["script_src_sample"]).alias("scripts"), F.to_json(o).alias("observation"),
    )


def fn_relationship(spark, sf_dir):
    """How the hosts that pages link to stand to the page, by kind of relationship."""
    known, tld = _known_domains(spark, sf_dir), suffixes(spark, sf_dir)
    seen = _seen(spark, sf_dir, ["final_url", "url", "anchors"])
    page = F.coalesce("final_url", "url")
    links = seen.select(page.alias("page"), F.explode("anchors.items").alias("a")).select("page", F.col("a.href").alias("href")).where(F.col("href").rlike("^https?://"))
    pairs = links.select(host(F.col("page")).alias("s"), host(F.col("href")).alias("t")).groupBy("s", "t").agg(F.count("*").alias("n"))
    providers = [(k, [d]) for k, d in zip(KINDS, known)]
    kind = B.relationship(F.col("s"), F.col("t"), registered_domain_of_host(F.col("s"), tld), registered_domain_of_host(F.col("t"), tld), providers, _brands(known[len(KINDS) :]))
    return pairs.groupBy(kind.alias("relationship")).agg(F.sum("n").alias("links"))


def fn_brand_claims(spark, sf_dir):
    """Brands named in titles."""
    names = {d: [_name(d)] for d in _known_domains(spark, sf_dir) if len(_name(d)) >= B.LEAST}
    found = _seen(spark, sf_dir, ["title"]).select("id", F.explode(B.claims(F.col("title"), names, ["", "home", "index", "login"])).alias("c"))
    return found.select("id", "c.brand", "c.matched")


def _name(domain: str) -> str:
    """The name a domain begins with: at most seven letters of its first label."""
    return re.match("[a-z-]*", domain)[0].replace("-", "")[:7]


def _hosts(spark, sf_dir) -> DataFrame:
    """Distinct hosts with the skeletons of their labels."""
    tld = suffixes(spark, sf_dir)
    hosts = _seen(spark, sf_dir, ["final_url", "url"]).select(host(F.coalesce("final_url", "url")).alias("host")).where("host <> ''").distinct()
    parts = B.label_parts(F.col("host"), registered_domain(F.col("host"), tld), GENERIC_LABELS)
    return hosts.select("host", registered_domain(F.col("host"), tld).alias("domain"), F.array_distinct(F.transform(parts, lambda x: B.skeleton(x, "01", "oi"))).alias("parts"))


def _aliases(known: list[str]) -> list[tuple[str, str, str]]:
    return [(d, _name(d), _name(d).replace("rn", "m").replace("vv", "w")) for d in known]


def fn_lookalike(spark, sf_dir):
    """Hosts outside the known domains whose labels equal, embed or resemble the name of one."""
    known = _known_domains(spark, sf_dir)
    hosts = _hosts(spark, sf_dir).where(~F.col("domain").isin(known))
    found = hosts.withColumn("m", B.nearest_alias(F.col("parts"), _aliases(known))).where("m.brand is not null")
    return found.select("host", "m.brand", "m.label", "m.kind", F.round("m.similarity", 4).alias("similarity"))


def alias_cross_join(spark, sf_dir):
    """Labels of hosts against all aliases, the first hit in order: equal, or an alias of six letters within."""
    known = _known_domains(spark, sf_dir)
    labels = _hosts(spark, sf_dir).where(~F.col("domain").isin(known)).select("host", F.posexplode("parts").alias("at", "label")).where("length(label) >= 5")
    aliases = spark.createDataFrame([(k, b, s) for k, (b, _, s) in enumerate(_aliases(known)) if len(s) >= B.LEAST], "k int, brand string, skeleton string")
    hit = (F.col("label") == F.col("skeleton")) | ((F.length("skeleton") >= B.EMBEDDED) & F.contains("label", F.col("skeleton")))
    met = labels.join(F.broadcast(aliases), hit)  # KNOWN rows at most
    return met.groupBy("host").agg(F.min_by(F.struct("brand", "label"), F.struct("at", "k")).alias("m")).select("host", "m.brand", "m.label")


def fn_parse_answer(spark, sf_dir):
    """Answers of models by their parts."""
    p = table(spark, sf_dir, "predictions").select("eval_idx", A.parse_answer(F.col("generated_text")).alias("a"), A.infer_verdict(F.col("generated_text")).alias("inferred"))
    return p.select("eval_idx", "a.verdict", "inferred", F.array_join("a.phishing_factors", "|").alias("phishing_factors"), F.array_join("a.benign_factors", "|").alias("benign_factors"), "a.reasoning")


def fn_infer_verdict(spark, sf_dir):
    return table(spark, sf_dir, "predictions").select("eval_idx", A.infer_verdict(F.col("generated_text")).alias("verdict"))


def fn_clean_html(spark, sf_dir):
    pages = table(spark, sf_dir, "page_docs").groupBy("id").agg(F.max("html").alias("html"))
    return pages.select("id", A.clean_html(F.col("html")).alias("text"))


def fn_humanize_id(spark, sf_dir):
    """Cited ids as sentences."""
    ids = table(spark, sf_dir, "predictions").select(F.explode("cited_features").alias("feature")).where("feature is not null").distinct()
    tokens = {"url": "address", "html": "page", "ip": "IP", "tld": "top-level domain"}
    return ids.select("feature", A.humanized(F.col("feature"), {"url.long_url": "The address is long."}, [(r"^redirect\.(.+)$", "Redirects: $1.")], tokens).alias("sentence"))


def ev_grounding_rules(spark, sf_dir):
    """Status of every cited id of a prediction, by rules over the observation it is about."""
    url = F.coalesce("final_url", "url")
    seen = _seen(spark, sf_dir, ["final_url", "url", "forms", "redirects"])
    facts = seen.select("id", F.length(url).alias("length"), F.lower(url).alias("address"), F.col("forms.total_observed").alias("forms"), F.size("redirects").alias("hops"))
    rules = {"url.long_url": F.col("length") > 75, "url.http_not_https": ~F.startswith(F.col("address"), F.lit("https")), "redirect.multi_hop": F.col("hops") > 1, "form.present": F.col("forms") > 0}
    cited = table(spark, sf_dir, "predictions").select("eval_idx", "id", "cited_features").join(facts, "id", "left")
    rows = cited.select(F.explode(A.grounding(F.col("cited_features"), rules)).alias("g")).select("g.id", "g.status").where("id is not null")
    return rows.groupBy(F.col("id").alias("feature"), "status").agg(F.count("*").alias("n"))


def registry_rules(spark, sf_dir):
    """Rules of the second registry that hold, a row each."""
    from pagesieve.plans.page_queries import _last, _prepared

    e = _last(registry.evidence(_prepared(spark, sf_dir)), "features")
    return e.select("id", F.explode("features").alias("f")).select("id", F.col("f.id").alias("rule"), "f.direction", "f.severity")


def registry_text_rules(spark, sf_dir):
    """How many observations speak of each matter."""
    from pagesieve.plans.page_queries import _last, _prepared

    e = _last(registry.evidence(_prepared(spark, sf_dir), include=list(TEXT_RULES)), "features")
    return e.select(F.explode("features.id").alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def src_keyset_scan(spark, sf_dir):
    """The second page of a hundred training rows by id."""
    rows = table(spark, sf_dir, "grad_rows").select("id", "url").groupBy("id").agg(F.min("url").alias("url"))
    last = readers.keyset_page(rows, "id", None, 100).agg(F.max("id")).first()[0]
    return readers.keyset_page(rows, "id", last, 100) if last is not None else rows


def src_cursor_scan(spark, sf_dir):
    """Page documents without a label: those with markup and without an error, each once."""
    p = readers.html_filter(table(spark, sf_dir, "page_docs")).where("error is null")
    return p.groupBy("id").agg(F.min("url").alias("url"), F.max(F.length("html")).alias("length"))


def src_projection(spark, sf_dir):
    """Only the fields a consumer asks for; the scan reads no others."""
    return _seen(spark, sf_dir, ["title", "final_url"])


def limit_early_stop(spark, sf_dir):
    """The first fifty benign and thirty phishing rows."""
    rows = table(spark, sf_dir, "grad_rows").select("id", F.lower("label").alias("label")).distinct()
    return readers.until_quotas(rows, "label", "id", {"benign": 50, "phishing": 30})


def topk_local_rows(spark, sf_dir):
    """Rows to explain: by falling score, then the least certain, each once, the first twenty."""
    seen = latest(table(spark, sf_dir, "observations"), "id", ["captured_at", "ingested_at"], {"score": F.col("capture_score")}).where("score is not null")
    high = seen.orderBy(F.col("score").desc(), "id").limit(20).select("id", "score", F.lit(0).alias("way"), (-F.col("score")).alias("o"))
    unsure = seen.orderBy(F.abs(F.col("score") - 0.5), "id").limit(20).select("id", "score", F.lit(1).alias("way"), F.abs(F.col("score") - 0.5).alias("o"))
    both = high.unionByName(unsure).groupBy("id", "score").agg(F.min(F.struct("way", "o")).alias("first"))
    return both.orderBy("first.way", "first.o", "id").limit(20).select("id", "score")


def kv_store(spark, sf_dir):
    """Documents made of predictions: created, some replaced, some deleted, then listed."""
    p = table(spark, sf_dir, "predictions").select(F.col("eval_idx").cast("string").alias("id"), F.col("predicted_verdict").alias("document"), "eval_idx")
    store = Store(spark, f"{shared_dir(spark)}/pagesieve/store-{uuid.uuid4().hex}")
    store.put(p)
    store.put(p.where("eval_idx % 3 = 0").withColumn("document", F.lit("reviewed")))
    store.delete(p.where("eval_idx % 5 = 0"))
    return store.all()


QUERIES = {
    q.__name__: q
    for q in (
        stage_a_observations, fn_relationship, fn_brand_claims, fn_lookalike, alias_cross_join, fn_parse_answer, fn_infer_verdict, fn_clean_html, fn_humanize_id, ev_grounding_rules, registry_rules, registry_text_rules,
        src_keyset_scan, src_cursor_scan, src_projection, limit_early_stop, topk_local_rows, kv_store,
    )
}
_LATEST = "o AS (SELECT id, input, capture_score FROM observations QUALIFY row_number() OVER (PARTITION BY id ORDER BY captured_at DESC, ingested_at DESC) = 1)"
_FEATURE = "CASE WHEN f = 'url.long_url' THEN length > 75 WHEN f = 'url.http_not_https' THEN address NOT LIKE 'https%' WHEN f = 'redirect.multi_hop' THEN hops > 1 WHEN f = 'form.present' THEN forms > 0 END"
_KNOWN_SQL = f"""known AS (SELECT registered_domain AS d, regexp_extract(registered_domain, '^[a-z-]*', 0) AS n, row_number() OVER (ORDER BY count(*) DESC, registered_domain) AS k
  FROM grad_rows WHERE regexp_matches(registered_domain, '^[a-z0-9.-]+\\.[a-z]+$') GROUP BY registered_domain QUALIFY k <= {KNOWN}), named AS (SELECT d, k, substr(replace(n, '-', ''), 1, 7) AS name FROM known)"""
_SPEAKS = " UNION ALL ".join(
    f"SELECT '{rule}' AS rule, count(*) AS n FROM v WHERE regexp_matches(t, '(^|[^\\p{{L}}\\p{{N}}_])(?:{'|'.join(w.replace(chr(39), chr(39) * 2).replace(' ', chr(92) + 's+') for w in registry.WORDS[matter])})([^\\p{{L}}\\p{{N}}_]|$)')" for rule, matter in TEXT_RULES.items()
)
_UNDER = "({0} = d OR ends_with({0}, '.' || d) OR {1} = d OR ends_with({1}, '.' || d))"
_KIND_SQL = " ".join(f"WHEN EXISTS (SELECT 1 FROM known WHERE k = {k + 1} AND {_UNDER.format('t', 'td')}) THEN '{kind}'" for k, kind in enumerate(KINDS))
_BRAND_SQL = "EXISTS (SELECT 1 FROM known x JOIN known y ON substr(split_part(x.d, '.', 1), 1, 4) = substr(split_part(y.d, '.', 1), 1, 4) WHERE x.k > 3 AND y.k > 3 AND (sd = x.d OR ends_with(sd, '.' || x.d)) AND (td = y.d OR ends_with(td, '.' || y.d)))"
SQL = {
    "fn_relationship": f"""WITH {_LATEST}, {_KNOWN_SQL}, links AS (SELECT coalesce(input.final_url, input.url) AS page, unnest(input.anchors.items).href AS href FROM o),
      pairs AS (SELECT {host_sql('page')} AS s, {host_sql('href')} AS t FROM links WHERE regexp_matches(href, '^https?://')), doms AS (SELECT s, t, coalesce({reg_sql('s')}, '') AS sd, coalesce({reg_sql('t')}, '') AS td FROM pairs)
      SELECT CASE WHEN coalesce(s, '') = '' OR coalesce(t, '') = '' THEN 'unknown' WHEN sd <> '' AND sd = td THEN 'same_registrable_domain' {_KIND_SQL} WHEN {_BRAND_SQL} THEN 'same_organization_or_alias' ELSE 'unrelated_third_party' END AS relationship, count(*) AS links FROM doms GROUP BY 1""",
    "registry_text_rules": f"WITH {_LATEST}, v AS (SELECT lower(coalesce(input.visible_text, '')) AS t FROM o) SELECT * FROM ({_SPEAKS}) WHERE n > 0",
    "fn_brand_claims": rf"WITH {_LATEST}, {_KNOWN_SQL}, t AS (SELECT id, lower(trim(regexp_replace(coalesce(input.title, ''), '\s+', ' ', 'g'))) AS t FROM o) SELECT id, d AS brand, name AS matched FROM t JOIN named ON length(name) >= {B.LEAST} AND regexp_matches(t, '\b' || name || '\b') WHERE t NOT IN ('', 'home', 'index', 'login')",
    "src_keyset_scan": "SELECT id, min(url) AS url FROM grad_rows GROUP BY id ORDER BY id LIMIT 100 OFFSET 100",
    "src_cursor_scan": "SELECT id, min(url) AS url, max(length(html)) AS length FROM page_docs WHERE html IS NOT NULL AND html <> '' AND error IS NULL GROUP BY id",
    "src_projection": f"WITH {_LATEST} SELECT id, input.title AS title, input.final_url AS final_url FROM o",
    "limit_early_stop": "SELECT id, label FROM (SELECT DISTINCT id, lower(label) AS label FROM grad_rows) QUALIFY row_number() OVER (PARTITION BY label ORDER BY id) <= CASE label WHEN 'benign' THEN 50 WHEN 'phishing' THEN 30 ELSE 0 END",
    "topk_local_rows": f"WITH {_LATEST} SELECT id, capture_score AS score FROM o WHERE capture_score IS NOT NULL ORDER BY capture_score DESC, id LIMIT 20",
    "kv_store": "SELECT CAST(eval_idx AS VARCHAR) AS id, CASE WHEN eval_idx % 3 = 0 THEN 2 ELSE 1 END AS at, CASE WHEN eval_idx % 3 = 0 THEN 'reviewed' ELSE predicted_verdict END AS document FROM predictions WHERE eval_idx % 5 <> 0",
    "ev_grounding_rules": f"""WITH {_LATEST}, facts AS (SELECT id, length(coalesce(input.final_url, input.url)) AS length, lower(coalesce(input.final_url, input.url)) AS address, input.forms.total_observed AS forms, len(input.redirects) AS hops FROM o),
      c AS (SELECT id, unnest(cited_features) AS f FROM predictions), j AS (SELECT c.f, {_FEATURE} AS holds FROM c LEFT JOIN facts USING (id) WHERE f IS NOT NULL)
      SELECT f AS feature, CASE WHEN f NOT IN ('url.long_url', 'url.http_not_https', 'redirect.multi_hop', 'form.present') THEN 'unchecked' WHEN holds IS NULL THEN 'rule_error' WHEN holds THEN 'grounded' ELSE 'ungrounded' END AS status, count(*) AS n FROM j GROUP BY ALL""",
    "fn_infer_verdict": r"""WITH t AS (SELECT eval_idx, lower(trim(coalesce(generated_text, ''))) AS s FROM predictions) SELECT eval_idx, coalesce(
      regexp_extract_all(s, '\bverdict\b[^a-z]{0,20}\b(phishing|benign|uncertain)\b', 1)[-1],
      regexp_extract_all(s, '\b(?:classification|classify|classified|conclusion|final answer|final classification|overall assessment)\b[^.\n]{0,160}\b(phishing|benign|uncertain)\b', 1)[-1],
      regexp_extract_all(s, '\b(?:this|it|page|site|website)\s+(?:is|looks)\s+(phishing|benign|uncertain)\b', 1)[-1],
      regexp_extract_all(right(s, 800), '\b(phishing|benign|uncertain)\b', 1)[-1], 'unparseable') AS verdict FROM t""",
}
