"""Mix sources to target shares of the total number of tokens.

Tokens of a public tokenizer are counted per document and added up per source. With target shares
``s`` and source sizes ``t`` a mixture of ``T`` tokens uses source i at the rate ``s_i * T / t_i``; ``T`` is the largest
total at which no rate passes its cap (or a smaller one, if given). A document is then emitted ``floor(rate)``
times and once more if a number drawn from a hash of seed and document falls below the fraction, so a run can be
repeated and each document decides for itself.

Defined results: null and empty texts have no tokens; documents of sources without a target are left out; a target without
documents gets nothing, and its share is reported as 0 while the rest keep their proportions; shares need not sum to 1.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesieve.runtime import materialize

#: Where the vocabulary of the public byte-level BPE lies; its licence and format are described beside it.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that cuts text into the pieces of this vocabulary.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
MAX_TARGETS = 10_000


def _encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("mix", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def count_tokens(df: DataFrame, ident: str, text: str, keep: list[str] = (), tokenizer: str = TOKENIZER) -> DataFrame:
    """(ident, keep..., tokens) of every row. The vocabulary is read here and sent out: executors need not have the file, whose size is that of a tokenizer."""
    types = dict(df.dtypes)
    with open(tokenizer, "rb") as f:
        vocabulary = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = None
        for b in batches:
            encoding = encoding or _encoding(vocabulary.value)
            counts = [len(encoding.encode_ordinary(t)) if t else 0 for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (ident, *keep)), pa.array(counts, pa.int64())], names=[ident, *keep, "tokens"])

    schema = ", ".join(f"`{c}` {types[c]}" for c in (ident, *keep)) + ", tokens bigint"
    return df.select(ident, *keep, F.col(text).alias("_text")).mapInArrow(run, schema)


def rates(sizes: dict[str, int], targets: dict[str, tuple[float, float]], total: float | None = None) -> dict[str, float]:
    """How often each source is used: targets are (share, most repeats)."""
    there = {s: v for s, v in targets.items() if sizes.get(s) and v[0] > 0}
    if not there:
        return {}
    whole = sum(v[0] for v in there.values())
    most = min(v[1] * sizes[s] * whole / v[0] for s, v in there.items())
    t = most if total is None else min(total, most)
    return {s: v[0] / whole * t / sizes[s] for s, v in there.items()}


def mix_sources(docs: DataFrame, targets: DataFrame, ident: str = "doc_id", source: str = "source", text: str = "text", seed: int = 17, total: float | None = None, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """The mixture (ident, source, tokens, copies), copies at least 1, and a report per source.

    ``targets`` has source, target_share and max_repeats.
    """
    rows = targets.limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    wanted = {r["source"]: (float(r["target_share"]), float(r["max_repeats"])) for r in rows}
    counted = materialize(count_tokens(docs.where(F.col(source).isin(list(wanted))), ident, text, [source], tokenizer), "mix")
    sizes = {r[source]: r["n"] for r in counted.groupBy(source).agg(F.sum("tokens").alias("n")).collect()}  # one row a target
    rate = rates(sizes, wanted, total)
    per = F.create_map(*[x for s, r in rate.items() for x in (F.lit(s), F.lit(float(r)))]) if rate else F.create_map(F.lit(""), F.lit(0.0))
    r = F.coalesce(F.try_element_at(per, F.col(source)), F.lit(0.0))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(ident)), F.lit(1 << 40)).cast("double") / float(1 << 40)
    copies = (F.floor(r + 1e-9) + (draw < r - F.floor(r + 1e-9)).cast("int")).cast("int")
    mixed = counted.withColumn("copies", copies)
    total_used = mixed.agg(F.sum(F.col("tokens") * F.col("copies"))).first()[0] or 0
    used = mixed.groupBy(F.col(source).alias("_s")).agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.sum("copies").alias("used_documents"))
    spark = docs.sparkSession
    table = spark.createDataFrame([(s, v[0], v[1], float(rate.get(s, 0.0))) for s, v in sorted(wanted.items())], "source string, target_share double, max_repeats double, rate double")
    report = table.join(used, F.col("source") == F.col("_s"), "left").select(
        "source", "target_share", "max_repeats", F.round("rate", 6).alias("rate"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("used_tokens", F.lit(0)).alias("used_tokens"),
        F.coalesce("used_documents", F.lit(0)).alias("used_documents"), F.round(F.coalesce("used_tokens", F.lit(0)) / F.lit(float(max(total_used, 1))), 6).alias("share"),
    )
    return mixed.where(F.col("copies") > 0), report
