"""Queries on addresses, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesieve.functions import text as T
from pagesieve.functions import urls as U
from pagesieve.operators import url_features as UF
from pagesieve.runtime import table


def suffixes(spark: SparkSession, sf_dir: str) -> list[str]:
    return U.suffix_list(table(spark, sf_dir, "suffixes"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address pair of every page document, each id once."""
    p = table(spark, sf_dir, "page_docs").select("id", F.coalesce("metadata.url", "url").alias("requested"), F.coalesce("metadata.final_url", "url").alias("final"), F.col("metadata.redirect_history").alias("redirects"))
    return p.groupBy("id").agg(F.min(F.struct("requested", "final", "redirects")).alias("p")).select("id", "p.requested", "p.final", "p.redirects")


def url_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return UF.url_features(pages(spark, sf_dir), "final", "requested", suffixes(spark, sf_dir)).drop("requested", "final", "redirects")


def redirect_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return UF.metadata_features(pages(spark, sf_dir), "requested", "final", "redirects", suffixes(spark, sf_dir)).drop("requested", "final", "redirects")


def host_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = UF.with_parts(pages(spark, sf_dir).withColumn("_u", F.coalesce("final", F.lit(""))), "_u", suffixes(spark, sf_dir))
    return p.select("id", *[F.col(f"_{c}").alias(c) for c in ("scheme", "host", "reg", "sub", "path", "query", "fragment")])


def normalized_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested and final address, blanks collapsed, at most 2000 characters."""
    return pages(spark, sf_dir).select("id", T.collapse_ws(F.col("requested"), 2000).alias("requested"), T.collapse_ws(F.col("final"), 2000).alias("final"))


def canonical_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scheme and host in lower case, https and '/' by default, query kept, fragment dropped."""
    p = UF.with_parts(pages(spark, sf_dir).withColumn("_u", U.trimmed(F.coalesce("final", F.lit("")))), "_u", suffixes(spark, sf_dir))
    scheme = F.when(F.col("_scheme") == "", "https").otherwise(F.col("_scheme"))
    path = F.when(F.col("_path") == "", "/").otherwise(F.col("_path"))
    return p.where(F.col("_authority") != "").select("id", F.concat(scheme, F.lit("://"), F.lower("_authority"), path, F.when(F.col("_query") != "", F.concat(F.lit("?"), "_query")).otherwise("")).alias("address"))


def address_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity of a page without one: the first digits of a hash of its parts; and the time in an identifier."""
    p = table(spark, sf_dir, "page_docs").select("id", "url", "title", F.col("metadata.final_url").alias("final")).distinct()
    parts = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in ("url", "final", "title")])
    return p.select("id", F.substring(F.sha2(parts, 256), 1, 24).alias("identity"), F.date_format(T.object_id_time(F.col("id")), "yyyy-MM-dd HH:mm:ss").alias("id_time"))


def hosts_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages per registered domain: count, median, singletons."""
    d = host_parts(spark, sf_dir).where("reg <> ''").groupBy("reg").agg(F.count("*").alias("n"))
    return d.agg(F.max("n").alias("most"), F.round(F.percentile("n", 0.5), 6).alias("median"), F.round(F.avg("n"), 6).alias("mean"), F.sum((F.col("n") == 1).cast("int")).alias("singletons"), F.sum((F.col("n") > 100).cast("int")).alias("over_100"), F.sum((F.col("n") > 1000).cast("int")).alias("over_1000"), F.count("*").alias("domains"))


QUERIES = {q.__name__: q for q in (url_lexical, redirect_metadata, host_parts, normalized_addresses, canonical_address, address_identity, hosts_by_domain)}

# --- SQL -------------------------------------------------------------------------------------------------------------

_RFC = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def _part(u: str, k: int) -> str:
    return rf"regexp_extract({u}, '{_RFC}', {k}, 's')"


PAGES = """p AS (SELECT id, min(coalesce(metadata.url, url)) AS requested, min(coalesce(metadata.final_url, url)) AS final, any_value(metadata.redirect_history) AS redirects FROM page_docs GROUP BY id)"""


def host_sql(u: str) -> str:
    s = rf"lower(regexp_replace({u}, '^[\s\p{{Z}}\p{{Cf}}]+|[\s\p{{Z}}\p{{Cf}}]+$', '', 'g'))"
    a = rf"regexp_replace(CASE WHEN regexp_matches({s}, '^([a-z][a-z0-9+.\-]*:)?//') THEN regexp_extract({s}, '^(?:[a-z][a-z0-9+.\-]*:)?//([^/?#\\]*)', 1) ELSE regexp_extract({s}, '^([^/?#\\]*)', 1) END, '^.*@', '')"
    return rf"CASE WHEN {a} LIKE '[%' THEN regexp_extract({a}, '^(\[[^\]]*\]?)', 1) ELSE regexp_replace({a}, '\.*(:[0-9]*)?$', '') END"


def reg_sql(h: str) -> str:
    """Registered domain of a host column; null for none."""
    return rf"""CASE WHEN {h} IS NULL OR {h} = '' THEN NULL WHEN {h} LIKE '[%' OR regexp_matches({h}, '^[0-9]{{1,3}}(\.[0-9]{{1,3}}){{3}}$') THEN {h}
      WHEN list_aggregate(string_split({h}, '.')[-2:], 'string_agg', '.') IN (SELECT suffix FROM suffixes) THEN list_aggregate(string_split({h}, '.')[-3:], 'string_agg', '.')
      ELSE list_aggregate(string_split({h}, '.')[-2:], 'string_agg', '.') END"""


PARTS = rf"""{PAGES}, a AS (SELECT id, coalesce(requested, '') AS r, coalesce(final, '') AS u FROM p),
 b AS (SELECT *, lower({_part('u', 1)}) AS scheme, {_part('u', 2)} AS authority, {_part('u', 3)} AS path, {_part('u', 4)} AS query, {_part('u', 5)} AS fragment FROM a),
 c AS (SELECT *, CASE WHEN authority = '' THEN '' ELSE {host_sql("'//' || authority")} END AS host FROM b),
 d AS (SELECT *, coalesce({reg_sql('host')}, '') AS reg FROM c),
 e AS (SELECT *, CASE WHEN ends_with(host, '.' || reg) THEN substring(host, 1, length(host) - length(reg) - 1) ELSE '' END AS sub,
        list_filter(string_split_regex(u, '[^A-Za-z0-9]+'), lambda x: x <> '') AS tok FROM d)"""


def _count(s: str, c: str) -> str:
    c2 = c.replace("'", "''")
    return f"((length({s}) - length(replace({s}, '{c2}', ''))) // {len(c)})"


def _url_sql() -> str:
    filled = lambda s, sep: f"len(list_filter(string_split({s}, '{sep}'), lambda x: x <> ''))"
    dec = "lower(url_decode(replace(path || CASE WHEN query <> '' THEN '?' || query ELSE '' END, '+', '%2B')))"
    port = "regexp_extract(authority, ':([0-9]+)$', 1)"
    chars = "list_filter(string_split(u, ''), lambda x: x <> '')"
    cols = {
        "final_url_length": "length(u)", "requested_url_length": "length(r)", "scheme_is_https": "(scheme = 'https')::INT", "hostname_length": "length(host)", "registrable_domain_length": "length(reg)", "subdomain_length": "length(sub)",
        "path_length": "length(path)", "query_length": "length(query)", "fragment_length": "length(fragment)", "path_segment_count": filled("path", "/"), "query_parameter_count": filled("query", "&"), "subdomain_label_count": filled("sub", "."),
        "hostname_dot_count": _count("host", "."), "registrable_domain_hyphen_count": _count("reg", "-"), "extra_double_slash_count": _count("regexp_extract(u, '://(.*)$', 1, 's')", "//"),
        "digit_count": "len(regexp_extract_all(u, '[0-9]'))", "hostname_digit_count": "len(regexp_extract_all(host, '[0-9]'))", "digit_ratio": "round(len(regexp_extract_all(u, '[0-9]')) / greatest(1, length(u)), 6)",
        "special_character_count": "len(regexp_extract_all(u, '[^A-Za-z0-9]'))", "token_count": "len(tok)", "average_token_length": "round(coalesce(list_avg(list_transform(tok, lambda x: length(x))), 0), 6)",
        "longest_token_length": "coalesce(list_max(list_transform(tok, lambda x: length(x))), 0)", "shortest_token_length": "coalesce(list_min(list_transform(tok, lambda x: length(x))), 0)",
        "token_length_stddev": "round(coalesce(list_stddev_pop(list_transform(tok, lambda x: length(x)::DOUBLE)), 0), 6)", "host_is_ip_address": r"(host LIKE '[%' OR regexp_matches(host, '^[0-9]{1,3}(\.[0-9]{1,3}){3}$'))::INT",
        "punycode_present": "(len(list_filter(string_split(host, '.'), lambda x: starts_with(x, 'xn--'))) > 0)::INT", "explicit_port_present": f"({port} <> '')::INT", "non_default_port_present": f"({port} NOT IN ('', '80', '443'))::INT",
        "https_token_in_hostname": "contains(host, 'https')::INT", "has_file_extension": "regexp_matches(string_split(path, '/')[-1], '[.][A-Za-z0-9]{1,12}$')::INT",
        "path_or_query_contains_url": f"regexp_matches({dec}, 'https?://|https?%3a%2f%2f|www[.]')::INT",
        "character_entropy": f"round(coalesce(list_entropy({chars}), 0), 6)",
    }
    cols |= {k: _count("u", c) for k, c in UF.CHARACTERS.items()} | {k: f"({_count('u', c[0])} + {_count('u', c[1])})" for k, c in UF.PAIRS.items()}
    return f"WITH {PARTS} SELECT id, " + ", ".join(f"{v} AS url_{k}" for k, v in sorted(cols.items())) + " FROM e"


_SCHEME = lambda c: f"lower(regexp_extract({c}, '^([^:/?#]+):', 1))"
_CHAIN = f"""WITH {PAGES}, hops AS (SELECT id, requested, final, list_filter(list_transform(coalesce(redirects, []), lambda h: h.url), lambda x: trim(x) <> '') AS h FROM p),
 links AS (SELECT id, unnest(list_filter([requested] || h || [final], lambda x: trim(x) <> '')) AS u, generate_subscripts(list_filter([requested] || h || [final], lambda x: trim(x) <> ''), 1) AS k FROM hops),
 hosts AS (SELECT id, k, {host_sql('u')} AS h FROM links), doms AS (SELECT id, k, {reg_sql('h')} AS d FROM hosts),
 steps AS (SELECT id, d <> lag(d) OVER (PARTITION BY id ORDER BY k) AS change FROM doms WHERE d IS NOT NULL),
 changed AS (SELECT id, count(*) FILTER (change) AS n FROM steps GROUP BY id),
 s AS (SELECT id, coalesce(requested, '') AS r, coalesce(final, '') AS f, len(h) AS hops FROM hops)
 SELECT s.id, hops AS metadata_redirect_count, coalesce(n, 0) AS metadata_redirect_domain_change_count, (r <> '' AND f <> '' AND r <> f)::INT AS metadata_final_url_changed,
  (r <> '' AND f <> '' AND coalesce({host_sql('r')}, '') <> coalesce({host_sql('f')}, ''))::INT AS metadata_final_host_changed, (r <> '' AND f <> '' AND {_SCHEME('r')} <> {_SCHEME('f')})::INT AS metadata_final_scheme_changed
 FROM s LEFT JOIN changed USING (id)"""
_WS = lambda c: f"rtrim(substring(trim(regexp_replace(coalesce({c}, ''), '[\\s\\p{{Z}}]+', ' ', 'g')), 1, 2000))"
SQL = {
    "url_lexical": _url_sql(),
    "redirect_metadata": _CHAIN,
    "host_parts": f"WITH {PARTS} SELECT id, scheme, host, reg, sub, path, query, fragment FROM e",
    "normalized_addresses": f"WITH {PAGES} SELECT id, {_WS('requested')} AS requested, {_WS('final')} AS final FROM p",
    "canonical_address": f"""WITH {PAGES}, a AS (SELECT id, trim(regexp_replace(coalesce(final, ''), '^[\\s\\p{{Z}}\\p{{Cf}}]+|[\\s\\p{{Z}}\\p{{Cf}}]+$', '', 'g')) AS u FROM p),
 b AS (SELECT id, lower({_part('u', 1)}) AS s, {_part('u', 2)} AS a, {_part('u', 3)} AS p, {_part('u', 4)} AS q FROM a)
 SELECT id, CASE WHEN s = '' THEN 'https' ELSE s END || '://' || lower(a) || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS address FROM b WHERE a <> ''""",
    "address_identity": """SELECT DISTINCT id, substring(sha256(coalesce(url, '') || '|' || coalesce(metadata.final_url, '') || '|' || coalesce(title, '')), 1, 24) AS identity,
 CASE WHEN regexp_matches(id, '^[0-9a-fA-F]{24}$') AND ('0x' || substring(id, 1, 8))::BIGINT BETWEEN 1262304000 AND 1893456000 THEN strftime(make_timestamp(('0x' || substring(id, 1, 8))::BIGINT * 1000000), '%Y-%m-%d %H:%M:%S') END AS id_time FROM page_docs""",
    "hosts_by_domain": f"WITH {PARTS}, n AS (SELECT reg, count(*) AS n FROM e WHERE reg <> '' GROUP BY reg) SELECT max(n) AS most, round(quantile_cont(n, 0.5), 6) AS median, round(avg(n), 6) AS mean, count(*) FILTER (n = 1) AS singletons, count(*) FILTER (n > 100) AS over_100, count(*) FILTER (n > 1000) AS over_1000, count(*) AS domains FROM n",
}
