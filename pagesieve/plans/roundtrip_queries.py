"""Queries on writers and readers (a table written and read again is the table), streams, and small functions."""

from __future__ import annotations

import gzip
import uuid

import pandas as pd
from pyspark.sql import functions as F

from pagesieve.functions import text as T
from pagesieve.plans.url_queries import suffixes
from pagesieve.runtime import latest, shared_dir, table
from pagesieve.sources import readers, sinks
from pagesieve.streaming import pages as streams


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/pagesieve/{name}-{uuid.uuid4().hex}"


def _grad(spark, sf_dir):
    return table(spark, sf_dir, "grad_rows").select("id", "label", "source", "split", "url").distinct()


def _scores(spark, sf_dir):
    return latest(table(spark, sf_dir, "observations"), "id", ["captured_at", "ingested_at"], {"score": F.col("capture_score"), "title": F.col("input.title"), "label": F.col("label")})


def sink_jsonl(spark, sf_dir):
    """Training rows as JSON lines and back."""
    path = _folder(spark, "jsonl")
    sinks.jsonl(_grad(spark, sf_dir), path)
    return readers.jsonl(spark, path, "id string, label string, source string, split string, url string")


def sink_csv(spark, sf_dir):
    """Training rows as CSV and back; what is missing is empty."""
    path, columns = _folder(spark, "csv"), ["id", "label", "source", "split", "url", "absent"]
    sinks.csv(_grad(spark, sf_dir), path, columns)
    rows = readers.csv(spark, path, ", ".join(f"{c} string" for c in columns), required=columns)
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def sink_arff(spark, sf_dir):
    """Numbers as an attribute-relation file and back."""
    path = _folder(spark, "arff")
    numbers = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("chars"), F.col("n_chars").alias("stated"))
    sinks.arff(numbers, path, "documents")
    return readers.arff(spark, path).select(F.col("doc_id").cast("bigint"), F.col("chars").cast("bigint"), F.coalesce(F.col("stated").cast("bigint"), F.lit(-1)).alias("stated"))


def sink_dataset_splits(spark, sf_dir):
    """Rows of every split after they were written to a folder each."""
    rows = table(spark, sf_dir, "grad_rows").where("split is not null").select("id", "split", "url")
    return sinks.splits(rows, _folder(spark, "splits"))


def sink_markdown(spark, sf_dir):
    """Labels and their numbers as a table in text, a line a row."""
    counts = table(spark, sf_dir, "grad_rows").groupBy(F.coalesce(F.lower("label"), F.lit("none")).alias("label")).agg(F.count("*").alias("n")).orderBy("label")
    lines = sinks.markdown(counts).split("\n")
    return spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "no int, line string")


def sink_upsert(spark, sf_dir):
    """Labels of observations replaced by those of the training rows, where there are any."""
    changes = table(spark, sf_dir, "grad_rows").where("label is not null").groupBy("id").agg(F.min(F.lower("label")).alias("label"))
    return sinks.upsert(_scores(spark, sf_dir).select("id", F.lower("label").alias("label")), changes, "id", "label")


def first_non_empty(spark, sf_dir):
    seen = latest(table(spark, sf_dir, "observations"), "id", ["captured_at", "ingested_at"], {c: F.col(f"input.{c}") for c in ("title", "final_url", "url")})
    return seen.select("id", T.first_non_empty(F.col("title"), F.col("final_url"), F.col("url")).alias("first"))


def safe_int(spark, sf_dir):
    """The number at the end of every address, where one stands there."""
    tail = F.regexp_extract("url", r"([^/=]*)$", 1)
    return table(spark, sf_dir, "grad_rows").where("url is not null").select("id", "url").distinct().select("id", "url", F.coalesce(T.safe_int(tail), F.lit(-1)).alias("number"))


def fn_parse_date(spark, sf_dir):
    """Times of observations written as ISO text in three ways, and read."""
    seen = table(spark, sf_dir, "observations").select("id", "captured_at").distinct()
    way = F.pmod(F.crc32("id"), F.lit(3))
    text = F.when(way == 0, F.date_format("captured_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(way == 1, F.date_format("captured_at", "yyyy-MM-dd HH:mm:ss")).otherwise("no date")
    return seen.select("id", "captured_at", text.alias("t")).select("id", (T.parse_date(F.col("t")).isNotNull()).alias("read"), F.when(way == 2, F.lit(True)).otherwise(T.parse_date(F.col("t")).cast("timestamp_ntz") == F.date_trunc("second", "captured_at").cast("timestamp_ntz")).alias("same")).groupBy("read", "same").agg(F.countDistinct("id").alias("n")).where("same")


def fn_clean_float(spark, sf_dir):
    """Scores relative to a half; what is no number is null."""
    s = _scores(spark, sf_dir)
    ratio = F.when(F.col("score") == 0.5, F.lit(float("inf"))).otherwise(0.1 / (F.col("score") - 0.5))
    return s.where("score is not null").select("id", F.coalesce(T.clean_float(ratio, 4), F.lit(-1.0)).alias("ratio"))


def fn_matched_terms(spark, sf_dir):
    terms = ["sign in", "invoice", "parcel", "refunds", "login"]
    return _scores(spark, sf_dir).where("title is not null").select("id", F.array_join(T.matched_terms(F.col("title"), terms), ",").alias("terms")).where("terms <> ''")


def fn_skeleton(spark, sf_dir):
    """Sources and splits as the eye reads them."""
    table_of = {"0": "o", "1": "l", "3": "e"}
    return _grad(spark, sf_dir).where("url is not null").select("id", "url", T.skeleton(F.substring("url", 9, 20), table_of).alias("skeleton"))


def fn_decode_html(spark, sf_dir):
    """Page markup packed and unpacked again."""
    pages = table(spark, sf_dir, "page_docs").where("html is not null").groupBy("id").agg(F.max("html").alias("html"))

    def pack(s):
        return s.map(lambda x: gzip.compress(x.encode()) if len(x) % 2 else x.encode())

    pack.__annotations__ = {"s": pd.Series, "return": pd.Series}
    packed = pages.select("id", F.pandas_udf(pack, "binary")("html").alias("b"))
    return packed.select("id", F.length(readers.gunzip("b")).alias("chars"))


def _streamed(spark, arriving, made, mode: str):
    """What a stream over the files of ``arriving`` has written when it has read them all."""
    source, out, seen = (_folder(spark, x) for x in ("arriving", "stream", "progress"))
    arriving.write.parquet(source)
    stream = made(streams.read(spark, source, arriving.schema))
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", seen).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def stream_first_seen(spark, sf_dir):
    """Addresses of page documents as they arrive, each once within its watermark of a thousand days."""
    pages = table(spark, sf_dir, "page_docs").where("url is not null and ingested_at is not null").select("url", F.col("ingested_at").cast("timestamp").alias("t"))
    return _streamed(spark, pages, lambda p: streams.first_seen(p, "url", "t", "1000 days"), "append").select("url")


def stream_score(spark, sf_dir):
    """Lengths and digits of addresses, scored as they arrive by the expressions of the batch."""
    pages = table(spark, sf_dir, "page_docs").where("url is not null").select("id", "url", F.struct(F.coalesce("metadata.final_url", "url").alias("final_url")).alias("metadata")).distinct()
    return _streamed(spark, pages, lambda p: streams.score(p, suffixes(spark, sf_dir)), "append").select("id", "url", F.col("url_final_url_length").alias("final_url_length")).distinct()


QUERIES = {
    q.__name__: q
    for q in (
        sink_jsonl, sink_csv, sink_arff, sink_dataset_splits, sink_markdown, sink_upsert, first_non_empty, safe_int, fn_parse_date, fn_clean_float, fn_matched_terms, fn_skeleton, fn_decode_html, stream_first_seen, stream_score,
    )
}
_G = "g AS (SELECT DISTINCT id, label, source, split, url FROM grad_rows)"
_O = "o AS (SELECT id, input, capture_score, label FROM observations QUALIFY row_number() OVER (PARTITION BY id ORDER BY captured_at DESC, ingested_at DESC) = 1)"
_TERM = "CASE WHEN regexp_matches(lower(input.title), '\\b{0}\\b') THEN '{1}' END"
SQL = {
    "sink_jsonl": f"WITH {_G} SELECT id, label, source, split, url FROM g",
    "sink_csv": f"WITH {_G} SELECT id, coalesce(label, '') AS label, coalesce(source, '') AS source, coalesce(split, '') AS split, coalesce(url, '') AS url, '' AS absent FROM g",
    "sink_arff": "SELECT doc_id, length(text) AS chars, coalesce(n_chars, -1) AS stated FROM documents",
    "sink_dataset_splits": "SELECT split, count(*) AS rows FROM grad_rows WHERE split IS NOT NULL GROUP BY split",
    "sink_markdown": """WITH c AS (SELECT coalesce(lower(label), 'none') AS label, count(*) AS n FROM grad_rows GROUP BY 1), l AS (SELECT row_number() OVER (ORDER BY label) + 1 AS no, '| ' || label || ' | ' || n || ' |' AS line FROM c)
      SELECT CAST(no AS INTEGER) AS no, line FROM l UNION ALL VALUES (0, '| label | n |'), (1, '| --- | --- |')""",
    "sink_upsert": f"WITH {_O}, c AS (SELECT id, min(lower(label)) AS new FROM grad_rows WHERE label IS NOT NULL GROUP BY id) SELECT o.id, coalesce(new, lower(label)) AS label FROM o LEFT JOIN c USING (id)",
    "first_non_empty": f"WITH {_O} SELECT id, CASE WHEN trim(input.title) <> '' THEN input.title WHEN trim(input.final_url) <> '' THEN input.final_url WHEN trim(input.url) <> '' THEN input.url END AS first FROM o",
    "safe_int": "SELECT DISTINCT id, url, coalesce(CASE WHEN regexp_matches(trim(regexp_extract(url, '([^/=]*)$', 1)), '^[0-9]{1,18}$') THEN CAST(trim(regexp_extract(url, '([^/=]*)$', 1)) AS BIGINT) END, -1) AS number FROM grad_rows WHERE url IS NOT NULL",
    "fn_clean_float": f"WITH {_O} SELECT id, CASE WHEN capture_score = 0.5 THEN -1.0 ELSE round(0.1 / (capture_score - 0.5), 4) END AS ratio FROM o WHERE capture_score IS NOT NULL",
    "fn_matched_terms": f"WITH {_O}, t AS (SELECT id, concat_ws(',', {', '.join(_TERM.format(t.replace(' ', chr(92) + 's+'), t) for t in ('invoice', 'login', 'parcel', 'refunds', 'sign in'))}) AS terms FROM o WHERE input.title IS NOT NULL) SELECT id, terms FROM t WHERE terms <> ''",
    "fn_skeleton": f"WITH {_G} SELECT id, url, replace(replace(regexp_replace(translate(lower(substr(url, 9, 20)), '013', 'ole'), '[^a-z0-9]', '', 'g'), 'rn', 'm'), 'vv', 'w') AS skeleton FROM g WHERE url IS NOT NULL",
    "fn_decode_html": "SELECT id, length(max(html)) AS chars FROM page_docs WHERE html IS NOT NULL GROUP BY id",
    "stream_score": "SELECT DISTINCT id, url, length(coalesce(metadata.final_url, url)) AS final_url_length FROM page_docs WHERE url IS NOT NULL",
    "stream_first_seen": "SELECT DISTINCT url FROM page_docs WHERE url IS NOT NULL AND ingested_at IS NOT NULL",
}
