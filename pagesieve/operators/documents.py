"""Documents of several shapes: normalization, scan labels, pruning, sensitive fields, nested searches."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from pagesieve.functions.text import collapse_ws, first_non_empty

# Names of fields that give the label away.
SENSITIVE = ("label", "target", "verdict", "class", "is_phishing", "ground_truth", "y", "result", "prediction", "score", "malicious", "phishing", "benign", "scan_verdict")
# Parts of names of fields that hold registration data or reputation.
BANNED = ("rdap", "whois", "registered_domain", "domain_age", "domain_registration", "domain_reputation", "registrar", "registrant", "creation_date", "expiration_date")


def normalize_document(df: DataFrame) -> DataFrame:
    """Canonical page documents from two shapes: with ``html`` as text, or as a scan with task, page and dom. ``html`` wins where it is text."""
    plain = F.col("html").isNotNull()
    page = F.struct(
        first_non_empty(F.col("metadata.url"), F.col("url")).alias("url"), first_non_empty(F.col("metadata.final_url"), F.col("url")).alias("final_url"), F.col("metadata.status_code").alias("status_code"), collapse_ws(F.col("title"), 300).alias("title"), F.col("html").alias("html")
    )
    scan = F.struct(
        first_non_empty(F.col("task.url"), F.col("page.url")).alias("url"), first_non_empty(F.col("page.url"), F.col("task.url")).alias("final_url"), F.col("page.status").alias("status_code"), collapse_ws(F.col("page.title"), 300).alias("title"), F.decode("dom.data", "UTF-8").alias("html")
    )
    return df.withColumn("_d", F.when(plain, page).otherwise(scan)).select("id", "_d.*")


def _verdicts(scan: Column) -> tuple[Column, Column, Column, Column]:
    """For each engine of a scan: whether it has a verdict and whether it is a hit."""
    vt, gsb = scan["virustotal"], scan["google_safe_browsing"]
    count = F.coalesce(vt["malicious_engine_count"], F.lit(0)) + F.coalesce(vt["suspicious_engine_count"], F.lit(0))
    has_vt = vt["malicious_engine_count"].isNotNull() | vt["suspicious_engine_count"].isNotNull()
    has_gsb = gsb["matched"].isNotNull() | (F.coalesce(gsb["status"], F.lit("")) != "")
    return has_vt, count > 0, has_gsb, F.coalesce(gsb["matched"], F.lit(False)) | (F.lower(F.coalesce(gsb["status"], F.lit(""))) == "malicious")


def latest_scan_label(t0: Column, t7: Column) -> Column:
    """Label of the later scan that has verdicts of both engines; any hit is phishing."""
    def of(scan: Column) -> Column:
        has_vt, vt, has_gsb, gsb = _verdicts(scan)
        return F.when(has_vt & has_gsb, F.when(vt | gsb, "phishing").otherwise("benign"))

    return F.coalesce(of(t7), of(t0))


def threshold_label(t0: Column, t7: Column, most: int = 5) -> Column:
    """Label of the later scan that is there, by more than ``most`` engines, else by the list alone."""
    scan = F.coalesce(t7, t0)
    n = scan["virustotal"]["malicious_engine_count"]
    gsb = scan["google_safe_browsing"]
    return F.when(n > most, "phishing").when(n.isNotNull(), "benign").when(F.coalesce(gsb["matched"], F.lit(False)) | (F.lower(F.coalesce(gsb["status"], F.lit(""))) == "malicious"), "phishing")


def schema_paths(schema: DataType, names: tuple[str, ...] = SENSITIVE, exact: bool = True, prefix: str = "") -> list[str]:
    """Paths of a schema whose last name is listed, or contains a listed name: a walk over types, not data."""
    out: list[str] = []
    if isinstance(schema, StructType):
        for f in schema.fields:
            path = f"{prefix}.{f.name}" if prefix else f.name
            key = re.sub(r"[^a-z0-9]", "", f.name.lower())
            if key in {re.sub(r"[^a-z0-9]", "", n) for n in names} if exact else any(n in key for n in names):
                out.append(path)
            out += schema_paths(f.dataType, names, exact, path)
    elif isinstance(schema, ArrayType):
        out += schema_paths(schema.elementType, names, exact, prefix + "[]")
    elif isinstance(schema, MapType):
        out += schema_paths(schema.valueType, names, exact, prefix + "{}")
    return out


def json_paths(column: Column, names: tuple[str, ...] = SENSITIVE, exact: bool = True, entries: int | None = 100) -> Column:
    """Paths of keys in free JSON texts (also in texts encoded twice) that are listed, or contain a listed name when runs of other signs than letters and digits count as one underline.

    Of each list the first ``entries`` are walked, with None all.
    """
    import pandas as pd

    wanted = set(names)

    def hit(key):
        if exact:
            return key.lower() in wanted
        key = re.sub(r"[^a-z0-9]+", "_", key.lower()).strip("_")
        return any(n in key for n in names)

    def walk(v):
        out, todo = [], [(v, "", False)]
        while todo:
            v, path, found = todo.pop()
            if found:
                out.append(path)
            if isinstance(v, dict):
                todo += [(x, f"{path}.{k}" if path else k, hit(k)) for k, x in reversed(v.items())]
            elif isinstance(v, list):
                todo += [(x, f"{path}[{i}]", False) for i, x in reversed([*enumerate(v[:entries])])]
        return out

    def of(texts):
        rows = []
        for t in texts:
            try:
                v = json.loads(t)
                rows.append(walk(json.loads(v) if isinstance(v, str) else v))
            except (TypeError, ValueError, RecursionError):
                rows.append([])
        return pd.Series(rows)

    of.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(of, "array<string>")(column)


def prune(input_column: str) -> Column:
    """The part of an observation that a model may see, as JSON: every field with its own cap, empty addresses and texts and absent attributes left out.

    Lists keep their null entries. Lists of records and of their inputs end after 20 entries also where the field's own cap is
    higher (anchors), as each nested list does in the reference.
    """
    c = lambda f: F.col(f"{input_column}.{f}")
    text = lambda f, chars: F.nullif(collapse_ws(c(f), chars), F.lit(""))
    first = lambda a, n: F.slice(F.coalesce(a, F.array()), 1, min(n, 20))

    def short(v: Column, chars: int) -> Column:
        return F.when(v.startswith("data:"), F.concat(F.substring(v, 1, 48), F.lit("<data_uri_truncated>"))).when(v.isNotNull(), collapse_ws(v, chars))

    def entries(a: Column, n: int, of) -> Column:
        return F.transform(first(a, n), lambda x: F.when(x.isNotNull(), of(x)))

    def texts(a: Column, n: int, chars: int) -> Column:
        return F.transform(first(a, n), lambda x: short(x, chars))

    def nested(a: Column, chars: int, of) -> Column:
        return F.when(a.isNotNull(), F.transform(first(a, 20), lambda x: of(x, chars)))

    def attributes(m: Column, chars: int) -> Column:
        return F.transform_values(m, lambda _, v: short(v, chars))

    def fields(names: str, chars: int):
        return lambda x: F.struct(*[short(x[n], chars).alias(n) for n in names.split()])

    def form(x: Column) -> Column:
        own = [short(x[n], 240).alias(n) for n in ("method", "action", "name", "id", "text")]
        return F.struct(*own, nested(x["inputs"], 240, attributes).alias("inputs"), nested(x["buttons"], 240, short).alias("buttons"))

    def collection(name: str, n: int, of) -> Column:
        items = c(f"{name}.items")
        total = F.coalesce(c(f"{name}.total_observed"), F.size(F.coalesce(items, F.array())))
        return F.struct(total.alias("total_observed"), entries(items, n, of).alias("items")).alias(name)

    resources = {"favicon_hrefs": (10, 200), "script_src_sample": (20, 200), "stylesheet_href_sample": (20, 200), "image_src_sample": (10, 120)}
    return F.to_json(F.struct(
        text("url", 1000).alias("url"), text("final_url", 1000).alias("final_url"),
        entries(c("redirects"), 10, lambda x: F.struct(x["status_code"].alias("status_code"), short(x["url"], 240).alias("url"))).alias("redirects"),
        text("title", 300).alias("title"), entries(c("meta"), 20, lambda x: attributes(x, 240)).alias("meta"), text("visible_text", 2500).alias("visible_text"),
        collection("forms", 20, form), collection("anchors", 30, fields("text href title aria_label", 200)), collection("iframes", 10, fields("src name id title width height style", 200)),
        F.struct(*[texts(c(f"resources.{f}"), n, chars).alias(f) for f, (n, chars) in resources.items()]).alias("resources"),
    ), {"ignoreNullFields": "true"})


def first_json(column: Column) -> Column:
    """The first balanced JSON object within a text, as text; null if there is none."""
    import pandas as pd

    def find(s):
        if not s:
            return None
        for start in (m.start() for m in re.finditer(r"\{", s)):
            try:
                value, end = json.JSONDecoder().raw_decode(s, start)
            except (ValueError, RecursionError):
                continue
            if isinstance(value, dict):
                return s[start:end]
        return None

    def of(texts):
        return pd.Series([find(t) for t in texts], dtype=object)

    of.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(of, "string")(column)


def word_features(address: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features of the words of an address and of the places of its letters."""
    from pagesieve.functions.text import count_of, count_regex, longest_char_run, mean

    def words(c: Column) -> Column:
        return F.filter(F.split(F.lower(c), r"[-./?=@&%:_]"), lambda w: w != "")

    out: dict[str, Column] = {}
    for name, c in (("url", F.concat(host, path)), ("host", host), ("path", path)):
        w = words(c)
        n = F.transform(w, lambda x: F.length(x))
        out |= {f"words_{name}": F.size(w), f"shortest_word_{name}": F.coalesce(F.array_min(n), F.lit(0)), f"longest_word_{name}": F.coalesce(F.array_max(n), F.lit(0)), f"average_word_{name}": F.round(mean(n), 6)}
    w = words(F.concat(host, path))
    repeats = lambda k: F.aggregate(F.transform(w, lambda x: longest_char_run(x, k)), F.lit(0), lambda a, x: a + x)
    out |= {
        "char_repeat": repeats(2) + repeats(3) + repeats(4) + repeats(5), "count_www": F.size(F.filter(w, lambda x: F.contains(x, F.lit("www")))), "count_com": F.size(F.filter(w, lambda x: F.contains(x, F.lit("com")))), "ratio_digits_host": F.round(count_regex(host, "[0-9]") / F.greatest(F.lit(1), F.length(host)), 6),
        "ratio_digits_url": F.round(count_regex(address, "[0-9]") / F.greatest(F.lit(1), F.length(address)), 6), "abnormal_subdomain": address.rlike(r"(https?://(ww?|\d))(w?(\d|-))").cast("int"), "prefix_suffix": address.rlike(r"https?://[^\-]+-[^\-]+/").cast("int"), "http_in_path": count_of(path, "http"),
        "path_is_text": F.endswith(path, F.lit(".txt")).cast("int"), "subdomain_grade": F.least(F.greatest(count_of(address, "."), F.lit(1)), F.lit(3)), "comma_count": count_of(address, ","), "dollar_count": count_of(address, "$"), "semicolon_count": count_of(address, ";"), "space_count": count_regex(address, " |%20"),
        "colon_count": count_of(address, ":"), "or_count": count_of(address, "|"), "exclamation_count": count_of(address, "!"),
    }
    return out
