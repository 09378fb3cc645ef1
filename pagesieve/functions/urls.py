"""Address functions as Catalyst expressions.

``try_parse_url`` gives null for hosts with ``_``, for blanks and for input
without a scheme, so addresses are cut with the generic syntax of RFC 3986.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: More public suffixes than this are refused as a literal; the real list has about 10,000.
MAX_SUFFIXES = 20_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trimmed(url: Column) -> Column:
    """Blanks of any kind around the value removed."""
    return F.regexp_replace(url, r"(?U)^[\s\p{Cf}]+|[\s\p{Cf}]+$", "")


def authority(url: Column) -> Column:
    """Authority in lower case; of an address without a scheme, what comes before the first slash."""
    with_scheme, without = r"^(?:[a-z][a-z0-9+.\-]*:)?//([^/?#\\]*)", r"^([^/?#\\]*)"
    return let(F.lower(trimmed(url)), lambda s: F.when(s.rlike(with_scheme), F.regexp_extract(s, with_scheme, 1)).otherwise(F.regexp_extract(s, without, 1)))


def host(url: Column) -> Column:
    """Host in lower case without user part, port and final dot; '' if there is none, null for null."""
    bare = lambda a: F.when(a.startswith("["), F.regexp_extract(a, r"^(\[[^\]]*\]?)", 1)).otherwise(F.regexp_replace(a, r"\.*(?::[0-9]*)?$", ""))
    return let(F.regexp_replace(authority(url), r"^.*@", ""), bare)


def is_ip_host(h: Column) -> Column:
    return h.startswith("[") | h.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")


def suffix_list(suffixes: DataFrame, column: str = "suffix") -> list[str]:
    """The public-suffix snapshot as literals; its size is checked, not assumed."""
    rows = suffixes.select(F.lower(column).alias("s")).where(F.col("s").isNotNull()).distinct().limit(MAX_SUFFIXES + 1).collect()
    if len(rows) > MAX_SUFFIXES:
        raise ValueError(f"more than {MAX_SUFFIXES} public suffixes")
    return sorted(r["s"] for r in rows)


def registered_domain_of_host(h: Column, suffixes: list[str]) -> Column:
    """The longest suffix of the list (of one or two labels) plus one label.

    An IP host stands for itself, as does a host that is a bare suffix; a host under no listed suffix
    is cut to two labels; no host gives null.
    """
    listed = [s for s in suffixes if s.count(".") == 1]

    def cut(h: Column) -> Column:
        last2, last3 = F.regexp_extract(h, r"((?:[^.]*\.)?[^.]*)$", 1), F.regexp_extract(h, r"((?:[^.]*\.){0,2}[^.]*)$", 1)
        return F.when((h == "") | h.isNull(), None).when(is_ip_host(h), h).when(last2.isin(listed) if listed else F.lit(False), last3).otherwise(last2)

    return let(h, cut)


def registered_domain(url: Column, suffixes: list[str]) -> Column:
    return registered_domain_of_host(host(url), suffixes)
