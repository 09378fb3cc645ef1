"""Readers. Every one is a distributed scan; nothing passes through the driver but schemas and small reports."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pagesieve.operators.curation import hash_rank


#: Most attributes in the header of a file.
MOST_ATTRIBUTES = 10_000


def collections(readers: dict[str, DataFrame], name: str = "all") -> DataFrame:
    """One named collection or all of them, with their name as ``source``."""
    if name != "all" and name not in readers:
        raise ValueError(f"unknown collection {name!r}; there are {', '.join(sorted(readers))}")
    out = None
    for k, df in readers.items():
        if name in ("all", k):
            one = df.withColumn("source", F.lit(k))
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def jsonl(spark: SparkSession, path: str, schema: str | StructType, on_error: str = "fail") -> DataFrame:
    """JSON lines by a schema; blank lines are skipped. A bad line fails the read, or is kept in ``_corrupt`` (``on_error="keep"``)."""
    rows = spark.read.text(path).where(F.trim("value") != "")
    if on_error == "fail":
        return rows.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    parsed = rows.select("value", F.from_json("value", schema).alias("r"), F.try_parse_json("value").isNull().alias("bad"))
    return parsed.select("r.*", F.when(F.col("bad"), F.col("value")).alias("_corrupt"))


def capped(df: DataFrame, label: str, ident: str, most: int) -> DataFrame:
    """At most ``most`` rows per label, in seeded order."""
    return hash_rank(df, [label], ident, name="_r").where(F.col("_r") <= most).drop("_r")


def csv(spark: SparkSession, path: str, schema: str, required: list[str] = (), labels: tuple[str, list[str]] | None = None) -> DataFrame:
    """CSV with a header; missing columns and unknown labels are errors."""
    header = spark.read.option("header", True).csv(path).columns
    missing = [c for c in required if c not in header]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    df = spark.read.option("header", True).option("enforceSchema", False).option("multiLine", True).option("escape", '"').schema(schema).csv(path)
    if labels:
        column, known = labels
        # an unknown label stops the job that meets it
        df = df.withColumn(column, F.when(F.col(column).isin(known), F.col(column)).otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(F.col(column).cast("string"), F.lit("null"))))))
    return df


def arff(spark: SparkSession, path: str) -> DataFrame:
    """Attribute-relation file: numeric attributes as double, others as text; ``?`` is null."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where((F.col("v") != "") & ~F.startswith("v", F.lit("%")))
    heads = [r["v"] for r in lines.where(F.lower("v").rlike(r"^@attribute\s")).limit(MOST_ATTRIBUTES + 1).collect()]
    if len(heads) > MOST_ATTRIBUTES:
        raise ValueError(f"more than {MOST_ATTRIBUTES} attributes")
    names = []
    for h in heads:
        rest = h.split(None, 1)[1].strip()
        name, kind = (rest[1:].split(rest[0], 1) if rest[0] in "'\"" else rest.split(None, 1))
        names.append((name, "double" if kind.strip().lower() in ("numeric", "real", "integer") else "string"))
    parts = F.split("v", r"\s*,\s*")
    cell = lambda i, t: F.nullif(F.regexp_replace(F.get(parts, F.lit(i)), "^['\"]|['\"]$", ""), F.lit("?")).try_cast(t)
    return lines.where(~F.startswith("v", F.lit("@"))).select(*[cell(i, t).alias(n) for i, (n, t) in enumerate(names)])


def _decode(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _address(info: str) -> str:
    """The address in an info file: a literal dictionary with ``url``, or the bare address."""
    import ast

    s = info.strip()
    try:
        v = ast.literal_eval(s)
        return str(v.get("url") or "") if isinstance(v, dict) else s
    except (ValueError, SyntaxError):
        return s.splitlines()[0] if s else ""


def zip_pages(spark: SparkSession, path: str) -> DataFrame:
    """(archive, page, url, html) of the ``*/html.txt`` and ``*/info.txt`` in ZIP archives, an archive a task."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = set(z.namelist())
                    rows = [(p, n[: -len("/html.txt")], _address(_decode(z.read(i))) if (i := n[: -len("html.txt")] + "info.txt") in names else "", _decode(z.read(n))) for n in sorted(names) if n.endswith("/html.txt")]
                yield pd.DataFrame(rows, columns=["archive", "page", "url", "html"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content").mapInPandas(read, "archive string, page string, url string, html string")


def dir_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page, url, html) of a directory of sites with ``html.txt`` and ``info.txt`` each."""
    def addresses(texts):
        return texts.map(_address, na_action="ignore")

    addresses.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    address = F.pandas_udf(addresses, "string")
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(path)
    f = f.select(F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("page"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.decode("content", "UTF-8").alias("text"))
    html, info = f.where("file = 'html.txt'").select("page", F.col("text").alias("html")), f.where("file = 'info.txt'").select("page", address("text").alias("url"))
    return html.join(info, "page", "left").select("page", F.coalesce("url", F.lit("")).alias("url"), "html")


def html_filter(df: DataFrame, html: str = "html") -> DataFrame:
    """Rows with markup; the null test reaches the scan."""
    return df.where(F.col(html).isNotNull() & (F.col(html) != ""))


def sample_before(df: DataFrame, ident: str, size: int, condition: Column, seed: int = 42) -> DataFrame:
    """A seeded sample of all rows, then the filter."""
    return df.orderBy(F.md5(F.concat(F.col(ident).cast("string"), F.lit(f":{seed}")))).limit(size).where(condition)


def sample_after(df: DataFrame, ident: str, size: int, condition: Column, seed: int = 42) -> DataFrame:
    """The filter, then a seeded sample of what is left."""
    return df.where(condition).orderBy(F.md5(F.concat(F.col(ident).cast("string"), F.lit(f":{seed}")))).limit(size)


def point_lookup(df: DataFrame, value: str, columns: list[str]) -> DataFrame:
    """Rows that hold a value in any of several fields, nested ones too."""
    condition = F.lit(False)
    for c in columns:
        condition = condition | (F.col(c) == value)
    return df.where(condition)


def gunzip(column: str) -> Column:
    """Text of a binary column, unpacked where it is packed."""
    import gzip

    def read(s):
        return pd.Series([None if b is None else _decode(gzip.decompress(bytes(b)) if bytes(b[:2]) == b"\x1f\x8b" else bytes(b)) for b in s])

    read.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(read, "string")(column)


def keyset_page(df: DataFrame, ident: str, after: str | None, size: int) -> DataFrame:
    """The next ``size`` rows in the order of ``ident`` behind ``after`` (None: from the beginning)."""
    behind = df.where(F.col(ident) > F.lit(after)) if after is not None else df
    return behind.orderBy(ident).limit(size)


def keyset_scan(df: DataFrame, ident: str, size: int) -> Iterator[DataFrame]:
    """All pages one after the other, for a consumer that takes a page at a time; a scan of everything needs no order."""
    after = None
    while True:
        page = keyset_page(df, ident, after, size)
        last = page.agg(F.max(ident)).first()[0]
        if last is None:
            return
        yield page
        after = last


def until_quotas(df: DataFrame, group: str, ident: str, quotas: dict[str, int]) -> DataFrame:
    """The first rows of each group in the order of ``ident``, as many as its quota; other groups give none."""
    most = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    wanted = df.where(F.col(group).isin(list(quotas)))
    # a limit on the rank within the group is applied before the shuffle, too
    return wanted.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(ident))).where(F.col("_n") <= F.try_element_at(most, F.col(group))).drop("_n")
