"""Text and number functions as Catalyst expressions, with the semantics of the analytics catalogue."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagesieve.functions.urls import let


def collapse_ws(value: Column, limit: int | None = None) -> Column:
    """Runs of any blanks as one space, ends trimmed, cut to ``limit`` characters; null as ''."""
    s = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)\s+", " "))
    return F.rtrim(F.substring(s, 1, limit)) if limit else s


def first_non_empty(*values: Column) -> Column:
    """The first value that is not null and not blank; its text is not trimmed."""
    return F.coalesce(*[F.when(F.trim(F.regexp_replace(v, r"(?U)\s+", " ")) != "", v) for v in values])


def safe_int(value: Column) -> Column:
    """Digits as a number, anything else null."""
    s = F.trim(value.cast("string"))
    return F.when(s.rlike(r"^[0-9]{1,18}$"), s.try_cast("bigint"))


def count_of(s: Column, part: str) -> Column:
    """Occurrences of a piece of text, one after the other."""
    return F.floor((F.length(s) - F.length(F.replace(s, F.lit(part), F.lit("")))) / len(part)).cast("int")


def count_regex(s: Column, pattern: str) -> Column:
    return F.regexp_count(s, F.lit(pattern))


def ratio(a: Column, b: Column) -> Column:
    """a / max(1, b)."""
    return a / F.greatest(F.lit(1), b)


def entropy(s: Column) -> Column:
    """Shannon entropy of the characters in bits; 0 for ''."""
    def of(chars: Column) -> Column:
        n = F.size(chars).cast("double")
        share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
        return F.when(n > 0, -F.aggregate(F.transform(F.array_distinct(chars), lambda c: share(c) * F.log2(share(c))), F.lit(0.0), lambda a, x: a + x)).otherwise(F.lit(0.0))

    return let(F.filter(F.split(F.coalesce(s, F.lit("")), ""), lambda c: c != ""), of)


def tokens(s: Column) -> Column:
    """Runs of ASCII letters and digits."""
    return F.filter(F.split(s, "[^A-Za-z0-9]+"), lambda x: x != "")


def mean(values: Column) -> Column:
    return let(values, lambda v: F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)).otherwise(0.0))


def stddev_pop(values: Column) -> Column:
    """Population standard deviation of an array; 0 for an empty one."""
    return let(values, lambda v: let(mean(v), lambda m: F.sqrt(mean(F.transform(v, lambda x: (x - m) * (x - m))))))


def redact_email(s: Column) -> Column:
    """Local parts of e-mail addresses masked."""
    return F.regexp_replace(s, r"(?i)\b[a-z0-9._%+\-]+@([a-z0-9.\-]+\.[a-z]{2,})", "<email>@$1")


def unquote(s: Column) -> Column:
    """Percent-decoding that leaves '+' and broken escapes alone, in lower case."""
    return F.lower(F.coalesce(F.try_url_decode(F.replace(s, F.lit("+"), F.lit("%2B"))), s))


def truncate_ends(s: Column, limit: int, mark: str = " ... ") -> Column:
    """Head and tail of a text that is too long."""
    head = (limit - len(mark)) // 2
    tail = limit - len(mark) - head
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.substring(s, 1, head), F.lit(mark), F.substring(s, -tail, tail)))


def stable_int(s: Column) -> Column:
    """The first 15 hexadecimal digits of the SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(s, 256), 1, 15), 16, 10).cast("bigint")


def object_id_time(s: Column) -> Column:
    """Time in a 24-digit hexadecimal identifier, if between 2010 and 2030."""
    seconds = F.conv(F.substring(s, 1, 8), 16, 10).cast("bigint")
    return F.when(s.rlike("^[0-9a-fA-F]{24}$") & seconds.between(1262304000, 1893456000), F.timestamp_seconds(seconds))


def parse_date(s: Column) -> Column:
    """ISO date or time, without a zone in UTC; null if it is none."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(s), "Z$", "+00:00"))


def clean_float(x: Column, digits: int = 6) -> Column:
    """Not-a-number and infinities as null, the rest rounded."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(F.round(x, digits))


def matched_terms(s: Column, terms: list[str]) -> Column:
    """The lexicon's terms that occur as whole words, sorted; blanks within a term match any run of blanks."""
    import re

    low = F.lower(s)
    pattern = lambda t: r"(?U)(?<!\w)" + r"\s+".join(re.escape(w) for w in t.lower().split()) + r"(?!\w)"
    return F.array_compact(F.array(*[F.when(low.rlike(pattern(t)), F.lit(t)) for t in sorted(terms)]))


def holds_term(s: Column, terms: list[str]) -> Column:
    """Whether any of the terms occurs as whole words: one scan for all of them."""
    import re

    any_of = "|".join(r"\s+".join(re.escape(w) for w in t.lower().split()) for t in terms)
    return F.lower(s).rlike(rf"(?U)(?<!\w)(?:{any_of})(?!\w)")


def longest_char_run(s: Column, size: int) -> Column:
    """Number of windows of ``size`` equal characters."""
    n = F.length(s) - size + 1
    windows = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(s, i, size))).otherwise(F.array().cast("array<string>"))
    return F.size(F.filter(windows, lambda w: w == F.repeat(F.substring(w, 1, 1), F.lit(size))))


def skeleton(s: Column, confusables: dict[str, str]) -> Column:
    """Comparable form of a name: look-alike characters replaced, signs dropped, rn as m and vv as w."""
    t = F.translate(F.lower(s), "".join(confusables), "".join(confusables.values()))
    t = F.regexp_replace(t, "[^a-z0-9]", "")
    return F.replace(F.replace(t, F.lit("rn"), F.lit("m")), F.lit("vv"), F.lit("w"))


def head_window(s: Column, budget: int) -> Column:
    return F.rtrim(F.substring(s, 1, budget))


def name_similarity(a: Column, b: Column) -> Column:
    """Ratcliff-Obershelp ratio of two names, two digits; equal names need no comparison, and each different pair of a batch is compared once."""
    import pandas as pd

    def ratio(x, y):
        from difflib import SequenceMatcher

        known = {p: round(SequenceMatcher(None, *p).ratio(), 2) for p in set(zip(x, y)) if None not in p}
        return pd.Series([known.get(p) for p in zip(x, y)], dtype=float)

    ratio.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.Series}
    return F.when(a == b, 1.0).otherwise(F.pandas_udf(ratio, "double")(a, b))
