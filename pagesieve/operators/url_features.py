"""Lexical features of addresses and features of redirect chains: expressions only, one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.functions import text as T
from pagesieve.functions import urls as U

_RFC = r"(?s)^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"

#: Counts of single characters in the final address.
CHARACTERS = {
    "dot_count": ".", "hyphen_count": "-", "underscore_count": "_", "slash_count": "/", "question_mark_count": "?", "equals_sign_count": "=", "ampersand_count": "&", "at_sign_count": "@",
    "percent_sign_count": "%", "hash_sign_count": "#", "tilde_count": "~", "plus_sign_count": "+", "asterisk_count": "*",
}
PAIRS = {"parenthesis_count": "()", "square_bracket_count": "[]", "curly_bracket_count": "{}", "angle_bracket_count": "<>"}


def with_parts(df: DataFrame, url: str, suffixes: list[str], prefix: str = "_") -> DataFrame:
    """Columns for the parts of an address; '' where a part is missing."""
    part = lambda k: F.coalesce(F.regexp_extract(F.col(url), _RFC, k), F.lit(""))
    df = df.withColumns({f"{prefix}scheme": F.lower(part(1)), f"{prefix}authority": part(2), f"{prefix}path": part(3), f"{prefix}query": part(4), f"{prefix}fragment": part(5)})
    df = df.withColumn(f"{prefix}host", F.coalesce(U.host(F.when(F.col(f"{prefix}authority") != "", F.concat(F.lit("//"), F.col(f"{prefix}authority")))), F.lit("")))
    df = df.withColumn(f"{prefix}reg", F.coalesce(U.registered_domain_of_host(F.col(f"{prefix}host"), suffixes), F.lit("")))
    sub = F.when(F.endswith(f"{prefix}host", F.concat(F.lit("."), f"{prefix}reg")), F.expr(f"substring({prefix}host, 1, length({prefix}host) - length({prefix}reg) - 1)")).otherwise("")
    return df.withColumn(f"{prefix}sub", sub)


def url_features(df: DataFrame, final: str, requested: str, suffixes: list[str]) -> DataFrame:
    """The lexical features of the final address (``url_...``); null addresses count as ''."""
    keep = df.columns
    df = with_parts(df.withColumns({"_u": F.coalesce(F.col(final), F.lit("")), "_r": F.coalesce(F.col(requested), F.lit(""))}), "_u", suffixes)
    u, host, reg, sub, path, query = (F.col(f"_{c}") for c in ("u", "host", "reg", "sub", "path", "query"))
    filled = lambda a: F.size(F.filter(a, lambda x: x != ""))
    df = df.withColumn("_len", F.transform(T.tokens(u), lambda t: F.length(t)))
    lengths = F.col("_len")
    after = F.regexp_extract(u, r"(?s)://(.*)$", 1)
    decoded = T.unquote(F.concat(path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))
    port = F.regexp_extract("_authority", r":([0-9]+)$", 1)
    last = F.element_at(F.split(path, "/"), -1)
    out: dict[str, Column] = {
        "final_url_length": F.length(u), "requested_url_length": F.length("_r"), "scheme_is_https": (F.col("_scheme") == "https").cast("int"), "hostname_length": F.length(host), "registrable_domain_length": F.length(reg),
        "subdomain_length": F.length(sub), "path_length": F.length(path), "query_length": F.length(query), "fragment_length": F.length("_fragment"), "path_segment_count": filled(F.split(path, "/")),
        "query_parameter_count": filled(F.split(query, "&")), "subdomain_label_count": filled(F.split(sub, "[.]")), "hostname_dot_count": T.count_of(host, "."), "registrable_domain_hyphen_count": T.count_of(reg, "-"),
        "extra_double_slash_count": T.count_of(after, "//"), "digit_count": T.count_regex(u, "[0-9]"), "hostname_digit_count": T.count_regex(host, "[0-9]"), "digit_ratio": F.round(T.ratio(T.count_regex(u, "[0-9]"), F.length(u)), 6),
        "special_character_count": T.count_regex(u, "[^A-Za-z0-9]"), "token_count": F.size(lengths), "average_token_length": F.round(T.mean(lengths), 6), "longest_token_length": F.coalesce(F.array_max(lengths), F.lit(0)),
        "shortest_token_length": F.coalesce(F.array_min(lengths), F.lit(0)), "token_length_stddev": F.round(T.stddev_pop(F.transform(lengths, lambda x: x.cast("double"))), 6), "host_is_ip_address": U.is_ip_host(host).cast("int"),
        "punycode_present": F.exists(F.split(host, "[.]"), lambda x: F.startswith(x, F.lit("xn--"))).cast("int"), "explicit_port_present": (port != "").cast("int"), "non_default_port_present": ((port != "") & ~port.isin("80", "443")).cast("int"),
        "https_token_in_hostname": F.contains(host, F.lit("https")).cast("int"), "has_file_extension": last.rlike(r"[.][A-Za-z0-9]{1,12}\z").cast("int"), "path_or_query_contains_url": decoded.rlike("https?://|https?%3a%2f%2f|www[.]").cast("int"),
        "character_entropy": F.round(T.entropy(u), 6),
    }
    out |= {k: T.count_of(u, c) for k, c in CHARACTERS.items()} | {k: T.count_of(u, c[0]) + T.count_of(u, c[1]) for k, c in PAIRS.items()}
    return df.select(*keep, *[c.alias(f"url_{k}") for k, c in sorted(out.items())])


def chain(requested: Column, redirects: Column, final: Column) -> Column:
    """Requested address, hops and final address, blanks left out."""
    urls = F.concat(F.array(requested), F.transform(F.coalesce(redirects, F.array().cast("array<struct<status_code:int,url:string>>")), lambda h: h["url"]), F.array(final))
    return F.filter(urls, lambda x: F.trim(x) != "")


def metadata_features(df: DataFrame, requested: str, final: str, redirects: str, suffixes: list[str]) -> DataFrame:
    """Features of the redirect chain (``metadata_...``)."""
    ru, fu = F.coalesce(F.col(requested), F.lit("")), F.coalesce(F.col(final), F.lit(""))
    domains = F.transform(chain(F.col(requested), F.col(redirects), F.col(final)), lambda x: F.coalesce(U.registered_domain(x, suffixes), F.lit("")))
    changes = lambda d: F.size(F.filter(F.zip_with(F.slice(d, 1, F.greatest(F.size(d) - 1, F.lit(0))), F.slice(d, 2, F.greatest(F.size(d) - 1, F.lit(0))), lambda a, b: a != b), lambda x: x))
    hops = F.size(F.filter(F.coalesce(F.col(redirects), F.array().cast("array<struct<status_code:int,url:string>>")), lambda h: F.trim(h["url"]) != ""))
    scheme = lambda c: F.lower(F.regexp_extract(c, r"^([^:/?#]+):", 1))
    both = (ru != "") & (fu != "")
    return df.select(
        *df.columns,
        hops.alias("metadata_redirect_count"),
        U.let(F.filter(domains, lambda x: x != ""), changes).alias("metadata_redirect_domain_change_count"),
        (both & (ru != fu)).cast("int").alias("metadata_final_url_changed"),
        (both & (F.coalesce(U.host(ru), F.lit("")) != F.coalesce(U.host(fu), F.lit("")))).cast("int").alias("metadata_final_host_changed"),
        (both & (scheme(ru) != scheme(fu))).cast("int").alias("metadata_final_scheme_changed"),
    )
