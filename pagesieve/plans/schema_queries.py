"""Address columns of the schema of 87 features (56 on addresses), as SQL expressions that Spark and other engines read alike.

Left out: whether the label is a random word (needs a language model) and whether it is a brand's (see ``fn_brand_claims``). Name look-ups are input columns
elsewhere. Where the published extractor takes the path from the first place the suffix occurs at, the path of the address is taken.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pagesieve.operators import url_features as UF
from pagesieve.plans.url_queries import PARTS, pages, suffixes

# Top-level domains, words and hosts that the schema counts as signs.
TLDS = (
    "fit tk gp ga work ml date wang men icu online click country stream download xin racing jetzt ren mom party review trade accountants science ninja xyz faith zip cricket win "
    "accountant realtor top christmas gdn link asia club la ae exposed pe go.id rs k12.pa.us or.kr ce.ke audio gob.pe gov.az website bj mx media sa.gov.au"
).split()
HINTS = "wp login includes admin content site images js alibaba css myaccount dropbox themes plugins signin view".split()
REPORTED = r"at\.ua|usa\.cc|baltazarpresentes\.com\.br|pe\.hu|esy\.es|hol\.es|sweddy\.com|myjino\.ru|96\.lt|ow\.ly"
SHORTENERS = (
    r"bit\.ly|goo\.gl|shorte\.st|go2l\.ink|x\.co|ow\.ly|t\.co|tinyurl|tr\.im|is\.gd|cli\.gs|yfrog\.com|migre\.me|ff\.im|tiny\.cc|url4\.eu|twit\.ac|su\.pr|twurl\.nl|snipurl\.com|short\.to|BudURL\.com|ping\.fm|post\.ly|"
    r"Just\.as|bkite\.com|snipr\.com|fic\.kr|loopt\.us|doiop\.com|short\.ie|kl\.am|wp\.me|rubyurl\.com|om\.ly|to\.ly|bit\.do|lnkd\.in|db\.tt|qr\.ae|adf\.ly|bitly\.com|cur\.lv|ity\.im|q\.gs|po\.st|bc\.vc|twitthis\.com|"
    r"u\.to|j\.mp|buzurl\.com|cutt\.us|u\.bb|yourls\.org|prettylinkpro\.com|scrnch\.me|filoops\.info|vzturl\.com|qr\.net|1url\.com|tweez\.me|v\.gd|link\.zip\.net"
)
#: Signs that are counted in the whole address.
COUNTED = {"dots": ".", "hyphens": "-", "at": "@", "qm": "?", "and": "&", "or": "|", "eq": "=", "underscore": "_", "percent": "%", "slash": "/", "star": "*", "colon": ":", "comma": ",", "semicolumn": ";", "dollar": "$"}


def _count(s: str, c: str) -> str:
    return f"cast((length({s}) - length(replace({s}, '{c}', ''))) / {len(c)} AS int)"


def _flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1 ELSE 0 END"


def _ratio(s: str) -> str:
    return f"round(CASE WHEN length({s}) = 0 THEN 0.0 ELSE cast(length({s}) - length(translate({s}, '0123456789', '')) AS double) / length({s}) END, 6)"


def columns(matches, first_at) -> dict[str, str]:
    """Name and expression of every column over u, host, reg, sub, path, scheme, label, tld and the word lengths; ``matches`` and ``first_at`` are the engine's."""
    out = {"length_url": "length(u)", "length_hostname": "length(host)", "ip": _flag(matches("host", r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"))}
    out |= {f"nb_{n}": _count("u", c) for n, c in COUNTED.items()}
    out |= {
        "nb_tilde": _flag("u LIKE '%~%'"), "nb_space": _count("u", " ") + " + " + _count("u", "%20"), "nb_dslash": _flag(first_at), "http_in_path": _count("path", "http"), "https_token": _flag("scheme <> 'https'"),
        "ratio_digits_url": _ratio("u"), "ratio_digits_host": _ratio("host"), "punycode": _flag("host LIKE 'xn--%'"), "port": _flag(matches("u", r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*:[0-9]+([/?#]|$)")),
        "tld_in_path": _flag("tld <> '' AND contains(lower(path), tld)"), "tld_in_subdomain": _flag("tld <> '' AND contains(sub, tld)"), "abnormal_subdomain": _flag(matches("u", r"(http[s]?://(w[w]?|[0-9]))([w]?([0-9]|-))")),
        "nb_subdomains": f"least(greatest({_count('u', '.')}, 1), 3)", "prefix_suffix": _flag(matches("u", r"https?://[^-]+-[^-]+/")), "shortening_service": _flag(matches("u", SHORTENERS)),
        "path_extension": _flag("path LIKE '%.txt'"), "phish_hints": " + ".join(_count("lower(u)", h) for h in HINTS), "suspecious_tld": _flag("tld IN (" + ", ".join(f"'{t}'" for t in TLDS) + ")"),
        "statistical_report": _flag(matches("u", REPORTED)),
    }
    return out


_WORDS = "[-./?=@&%:_]"


def schema_addresses(spark, sf_dir):
    p = UF.with_parts(pages(spark, sf_dir).withColumn("_u", F.coalesce("final", F.lit(""))), "_u", suffixes(spark, sf_dir))
    p = p.select("id", F.col("_u").alias("u"), *[F.col(f"_{c}").alias(c) for c in ("host", "reg", "sub", "path", "scheme")])
    p = p.withColumns({"label": F.regexp_extract("reg", r"^([^.]*)", 1), "tld": F.regexp_extract("reg", r"^[^.]*\.(.*)$", 1)})
    words = lambda *cs: F.filter(F.split(F.lower(F.concat_ws("/", *cs)), _WORDS), lambda w: w != "")
    p = p.withColumns({"w_raw": words("label", "path", "sub"), "w_host": words("label", "sub"), "w_path": words("path")})
    matches = lambda c, r: f"{c} rlike '{r}'".replace("\\", "\\\\")
    out = columns(matches, "length(u) - locate('//', reverse(u)) - 1 > 6 AND contains(u, '//')")
    lengths = {k: F.transform(f"w_{k}", lambda w: F.length(w)) for k in ("raw", "host", "path")}
    stats = [F.size("w_raw").alias("length_words_raw"), F.size(F.filter("w_raw", lambda w: F.contains(w, F.lit("www")))).alias("nb_www"), F.size(F.filter("w_raw", lambda w: F.contains(w, F.lit("com")))).alias("nb_com")]
    for k, n in lengths.items():
        mean = F.aggregate(n, F.lit(0), lambda a, x: a + x) / F.nullif(F.size(n), F.lit(0))
        stats += [F.coalesce(F.array_min(n), F.lit(0)).alias(f"shortest_word_{k}"), F.coalesce(F.array_max(n), F.lit(0)).alias(f"longest_word_{k}"), F.round(F.coalesce(mean, F.lit(0.0)), 6).alias(f"avg_word_{k}")]
    return p.select("id", *[F.expr(e).alias(n) for n, e in out.items()], *stats)


def _sql() -> str:
    words = lambda *cs: f"list_filter(string_split_regex(lower(concat_ws('/', {', '.join(cs)})), '{_WORDS}'), lambda w: w <> '')"
    out = columns(lambda c, r: f"regexp_matches({c}, '{r}')", "contains(u, '//') AND length(u) - strpos(reverse(u), '//') - 1 > 6")
    stats = ["len(w_raw) AS length_words_raw", "len(list_filter(w_raw, lambda w: contains(w, 'www'))) AS nb_www", "len(list_filter(w_raw, lambda w: contains(w, 'com'))) AS nb_com"]
    for k in ("raw", "host", "path"):
        n = f"list_transform(w_{k}, lambda w: length(w))"
        stats += [f"coalesce(list_min({n}), 0) AS shortest_word_{k}", f"coalesce(list_max({n}), 0) AS longest_word_{k}", f"round(coalesce(list_avg({n}), 0.0), 6) AS avg_word_{k}"]
    return f"""WITH {PARTS}, f AS (SELECT *, regexp_extract(reg, '^([^.]*)', 1) AS label, regexp_extract(reg, '^[^.]*[.](.*)$', 1) AS tld FROM e),
      g AS (SELECT *, {words('label', 'path', 'sub')} AS w_raw, {words('label', 'sub')} AS w_host, {words('path')} AS w_path FROM f)
      SELECT id, {', '.join(f'{e} AS {n}' for n, e in out.items())}, {', '.join(stats)} FROM g"""


QUERIES = {"schema_addresses": schema_addresses}
SQL = {"schema_addresses": _sql()}
