"""Exact and near copies of evaluation rows in the training split.

Addresses are compared in a plain form (``address_key``). Texts are compared by class: rows whose
words agree form one class, so copies are compared once however many there are. Word shingles of five words
get a minwise signature of ``BANDS`` x ``ROWS`` values; equal bands bring classes together, and only pairs of which
one side is in the training split and the other in an evaluation split become candidates. Every
candidate is verified exactly: its shingle Jaccard similarity is computed, and the decision is by
the share of words in common in the same order (longest common subsequence), at least ``SHARE``. A text
whose end is cut off is compared with the beginning of the other.

Bands miss pairs with scattered changes and short cut-off texts, so an exact path stands beside them: of
the counted words of the shorter text at most one in five may be missing in the other, or in as much of
its beginning. Counted words are hashed to bitmaps, one for each doubling of ``SHORTEST`` words up to the text's own length, and bits that are
set in the one and not in the other are at most as many as missing words; so no pair over ``SHARE`` is lost, whatever collides.
The classes of the evaluation splits are the stated query set: in blocks of ``BLOCK`` they are compared with all blocks of the training split.

Defined results: rows without a split are left out; null or empty texts have no class and match by address
only; null or empty addresses match by text only; repeated rows count once; texts of any length are
read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.runtime import materialize, spread

SHINGLE, BANDS, ROWS = 5, 16, 3
#: Classes and bytes of text in a block (a single long text is a block of its own); length in words up to which the first and shortest bitmaps are used, each next length is twice as long.
BLOCK, BLOCK_BYTES, SHORTEST = 2048, 8 << 20, 32
#: Least share of words in common in the same order.
SHARE = 0.8
#: Lines of a text that name its address.
ADDRESS_LINES = r"(?im)^[ \t]*(?:URL|Hostname)[ \t]*:.*$"

_K = BANDS * ROWS
_RNG = np.random.default_rng(20240229)
_A = (_RNG.integers(1, 1 << 61, _K, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _RNG.integers(0, 1 << 62, _K, dtype=np.uint64)


def address_key(url: Column) -> Column:
    """Address without scheme, host case, one leading ``www.``, fragment, final slash and tracking parameters; null if there is none."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(url, r"(?U)^\s+|\s+$", ""), r"^[A-Za-z][A-Za-z0-9+.\-]*://", ""), r"(?s)#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"(?s)^([^/?]*)", 1)), r"^www\.", "")
    path = F.regexp_extract(bare, r"(?s)^[^/?]*([^?]*)", 1)
    query = F.regexp_extract(bare, r"(?s)\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike(r"^(utm_[^=]*|[^=]*clid)(=|$)")), "&")
    return F.nullif(F.concat(host, F.regexp_replace(path, r"/$", ""), F.when(kept != "", F.concat(F.lit("?"), F.regexp_replace(kept, r"/$", ""))).otherwise("")), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text in lower case, one blank apart, its address lines aside; null if there are none."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, ADDRESS_LINES, " ")), r"(?U)\s+", " ")), F.lit(""))


def _shingle_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of all texts one after the other, and how many each text has.

    A text of fewer words than a shingle has one, of all its words.
    """
    lists = pc.split_pattern(texts, pattern=" ")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    table = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
    w = table[coded.indices.to_numpy(zero_copy_only=False)]
    n_sh = np.maximum(counts - SHINGLE + 1, 1)
    starts = np.repeat(np.cumsum(counts) - counts, n_sh) + (np.arange(n_sh.sum()) - np.repeat(np.cumsum(n_sh) - n_sh, n_sh))
    last = np.repeat(np.cumsum(counts) - 1, n_sh)
    h = np.zeros(len(starts), np.uint64)
    for i in range(SHINGLE):
        p = starts + i
        h = (h ^ np.where(p <= last, w[np.minimum(p, last)], np.uint64(0))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h, n_sh


def _minima(h: np.ndarray, n_sh: np.ndarray, k: int) -> np.ndarray:
    """k minima of each text over its shingles."""
    offsets = np.cumsum(n_sh) - n_sh
    out = np.empty((len(n_sh), k), np.uint64)
    for j in range(k):
        out[:, j] = np.minimum.reduceat((h * _A[j] + _B[j]) >> np.uint64(11), offsets)
    return out


def _band_keys(sig: np.ndarray, salt: int) -> np.ndarray:
    n, k = sig.shape
    key = np.full((n, k // ROWS), salt, np.uint64)
    for r in range(ROWS):
        key = (key ^ sig[:, r::ROWS]) * np.uint64(0xC2B2AE3D27D4EB4F)
        key ^= key >> np.uint64(31)
    key += np.arange(k // ROWS, dtype=np.uint64)
    return key


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for start in range(0, b.num_rows, 2000):
            part = b.slice(start, 2000)
            keys = _band_keys(_minima(*_shingle_hashes(part.column("words")), _K), 1)
            of = pa.array(np.repeat(np.arange(part.num_rows), keys.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), *(part.column(c).take(of) for c in ("no", "in_train", "in_eval"))], names=["band", "no", "in_train", "in_eval"])


def _levels(longest: int) -> Iterator[tuple[int, int, int]]:
    """Lengths of texts over and up to which a level stands, and the 64-bit words of its bitmaps."""
    low, high = 0, SHORTEST
    while True:
        yield low, high, max(8, high // 16)
        if longest <= high:
            return
        low, high = high, 2 * high


def _bitmaps(texts: pa.Array) -> tuple[np.ndarray, bytes]:
    """Words of each text, and the bitmaps of all levels: of a level, those of the texts longer than its lower length.

    A bitmap holds the counted words (a word and which of its occurrences it is) of the first five fourths of the level's upper length:
    a shorter text of that level is whole in it, and so is a longer one with which it can have ``SHARE`` of all words in common.
    """
    lists = pc.split_pattern(texts, pattern=" ")
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    table = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(code)) - np.repeat(np.cumsum(counts) - counts, counts)
    key = text * len(table) + code
    order = np.argsort(key, kind="stable")
    first = np.concatenate([[True], np.diff(key[order]) != 0])
    nth = np.empty(len(code), np.int64)
    nth[order] = np.arange(len(code)) - np.flatnonzero(first)[np.cumsum(first) - 1]
    h = (table[code] + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    out = []
    for low, high, width in _levels(int(counts.max())):
        rows = np.flatnonzero(counts > low)
        row_of = np.full(len(counts), -1)
        row_of[rows] = np.arange(len(rows))
        used = (place < high + high // 4) & (row_of[text] >= 0)
        bits = np.zeros((len(rows), 64 * width), bool)
        bits[row_of[text[used]], (h[used] % np.uint64(64 * width)).astype(np.int64)] = True
        out.append(np.packbits(bits, axis=1).tobytes())
    return counts, b"".join(out)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes = np.cumsum(pc.binary_length(b.column("words")).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < b.num_rows:
            end = int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + BLOCK_BYTES, "right"))
            part = b.slice(start, max(1, min(end - start, BLOCK)))
            start += part.num_rows
            counts, bits = _bitmaps(part.column("words"))
            yield pa.RecordBatch.from_arrays([pa.array([part.column("no").to_pylist()], pa.list_(pa.int64())), pa.array([counts.tolist()], pa.list_(pa.int64())), pa.array([bits], pa.binary())], names=["no", "n", "bits"])


def _unpacked(n: np.ndarray, bits: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each level the texts that have a bitmap, and their bitmaps."""
    at = 0
    for low, _, width in _levels(int(n.max())):
        rows = np.flatnonzero(n > low)
        yield rows, np.frombuffer(bits, np.uint64, len(rows) * width, at).reshape(len(rows), width)
        at += len(rows) * width * 8


def _may_share(n_a: np.ndarray, bits_a: bytes, n_b: np.ndarray, bits_b: bytes) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of two blocks of which the shorter text may have ``SHARE`` of its words in the other."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for (low, high, _), (rows_a, a), (rows_b, b) in zip(_levels(1 << 62), _unpacked(n_a, bits_a), _unpacked(n_b, bits_b)):
        # bits in common that a text of this level needs; longer ones are judged by the other text alone
        least_a, least_b = (np.where(n[rows] <= high, np.bitwise_count(x).sum(axis=1, dtype=np.int64) - np.floor((1 - SHARE) * n[rows] + 1e-6).astype(np.int64), 1 << 30).astype(np.int32) for n, rows, x in ((n_a, rows_a, a), (n_b, rows_b, b)))
        own = least_a < 1 << 30
        for rows_x, x, least_x, rows_y, y, least_y, swap in ((rows_a[own], a[own], least_a[own], rows_b, b, least_b, False), (rows_b[least_b < 1 << 30], b[least_b < 1 << 30], least_b[least_b < 1 << 30], rows_a[~own], a[~own], least_a[~own], True)):
            columns = np.ascontiguousarray(y.T)
            for start in range(0, len(rows_x), 32):
                part = x[start : start + 32]
                common = np.zeros((len(part), len(rows_y)), np.uint16 if part.shape[1] < 1024 else np.int32)
                for k in range(part.shape[1]):
                    common += np.bitwise_count(part[:, k, None] & columns[k])
                i, j = np.nonzero(common >= np.minimum(least_x[start : start + 32, None], least_y))
                i, j = rows_x[start + i], rows_y[j]
                found.append((j, i) if swap else (i, j))
    return tuple(np.concatenate(side) for side in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for r in range(whole.num_rows):
            b = whole.slice(r, 1)
            n_a, n_b = (b.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("n_a", "n_b"))
            i, j = _may_share(n_a, b.column("bits_a")[0].as_py(), n_b, b.column("bits_b")[0].as_py())
            yield pa.RecordBatch.from_arrays([b.column("no_a").flatten().take(pa.array(i)), b.column("no_b").flatten().take(pa.array(j))], names=["train_no", "eval_no"])


def exact_candidates(classes: DataFrame) -> DataFrame:
    """train_no, eval_no: every pair that can have ``SHARE`` of the words in common, and some that have not."""
    def blocks(side: str, p: str) -> DataFrame:
        packed = materialize(classes.where(side).select("no", "words").mapInArrow(_blocks, "no array<bigint>, n array<bigint>, bits binary"), "overlap")
        return packed.select(*[F.col(c).alias(f"{c}_{p}") for c in ("no", "n", "bits")])

    pairs = spread(blocks("in_train", "a")).crossJoin(blocks("in_eval", "b"))
    return pairs.mapInArrow(_compared, "train_no bigint, eval_no bigint").where(F.col("train_no") != F.col("eval_no"))


def common_in_order(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bits: one step a word of ``b``."""
    places: dict[str, int] = {}
    for i, w in enumerate(a):
        places[w] = places.get(w, 0) | 1 << i
    mask, v = (1 << len(a)) - 1, (1 << len(a)) - 1
    for w in b:
        if u := v & places.get(w, 0):
            v = ((v + u) | (v - u)) & mask
    return len(a) - v.bit_count()


def share_in_common(a: list[str], b: list[str]) -> float:
    """Words in common in the same order: of the longer text, or of the shorter one and as much of the beginning of the longer."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0.0
    best = common_in_order(a, b) / len(b)
    return max(best, common_in_order(a, b[: len(a)]) / len(a)) if len(b) > len(a) else best


def jaccard(a: list[str], b: list[str]) -> float:
    x, y = ({tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} for w in (a, b))
    return len(x & y) / len(x | y)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        share, sim = [], []
        for x, y in zip(b.column("words_a").to_pylist(), b.column("words_b").to_pylist()):
            x, y = x.split(" "), y.split(" ")
            share.append(share_in_common(x, y))
            sim.append(jaccard(x, y))
        yield pa.RecordBatch.from_arrays([b.column("train_cls"), b.column("eval_cls"), pa.array(share, pa.float64()), pa.array(sim, pa.float64())], names=["train_cls", "eval_cls", "share", "jaccard"])


def split_overlaps(df: DataFrame, ident: str, split: str, url: str, text: str, source: str, train: str = "train") -> DataFrame:
    """Confirmed pairs: train_id, eval_id, eval_split, train_source, eval_source, by_url, by_text, share, jaccard; each pair once."""
    base = df.where(F.col(split).isNotNull() & F.col(ident).isNotNull()).select(F.col(ident).alias("id"), F.col(split).alias("split"), F.col(source).alias("source"), address_key(F.col(url)).alias("url"), words_of(F.col(text)).alias("words"))
    base = base.withColumn("cls", F.when(F.col("words").isNotNull(), F.unhex(F.substring(F.sha2("words", 256), 1, 32))))
    rows = materialize(base.select("id", "split", "source", "url", "cls").distinct(), "overlap")  # without the texts
    is_train = F.col("split") == train
    # classes of equal words, with the sides on which they occur; ``no`` is short for the class until its text is looked at
    classes = base.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.first("words").alias("words"), F.max(is_train).alias("in_train"), F.max(~is_train).alias("in_eval"))
    classes = materialize(classes.withColumn("no", F.xxhash64("cls")), "overlap")
    bands = classes.select("no", "words", "in_train", "in_eval").mapInArrow(_bands, "band bigint, no bigint, in_train boolean, in_eval boolean")
    left = bands.where("in_train").select(F.col("no").alias("train_no"), "band")
    right = bands.where("in_eval").select(F.col("no").alias("eval_no"), "band")
    near = left.join(right, "band").where(F.col("train_no") != F.col("eval_no")).select("train_no", "eval_no")
    candidates = materialize(near.unionByName(exact_candidates(classes)).distinct(), "overlap")
    texts = lambda p, w: classes.select(F.col("no").alias(f"{p}_no"), F.col("cls").alias(f"{p}_cls"), F.col("words").alias(w))
    checked = candidates.join(texts("train", "words_a"), "train_no").join(texts("eval", "words_b"), "eval_no")
    near = checked.mapInArrow(_verify, "train_cls binary, eval_cls binary, share double, jaccard double").where(F.col("share") >= SHARE)
    same = classes.where("in_train and in_eval").select(F.col("cls").alias("train_cls"), F.col("cls").alias("eval_cls"), F.lit(1.0).alias("share"), F.lit(1.0).alias("jaccard"))
    linked = same.unionByName(near)
    side = lambda own, p: rows.where(is_train if own else ~is_train).select(F.col("id").alias(f"{p}_id"), F.col("split").alias(f"{p}_split"), F.col("source").alias(f"{p}_source"), F.col("url").alias(f"{p}_url"), F.col("cls").alias(f"{p}_cls"))
    t, e = side(True, "train").drop("train_split"), side(False, "eval")
    by_text = linked.join(t, "train_cls").join(e, "eval_cls").withColumn("by_text", F.lit(True)).withColumn("by_url", F.lit(False))
    by_url = t.join(e, F.col("train_url") == F.col("eval_url")).withColumn("by_url", F.lit(True)).withColumn("by_text", F.lit(False)).withColumn("share", F.lit(None).cast("double")).withColumn("jaccard", F.lit(None).cast("double"))
    columns = ["train_id", "eval_id", "eval_split", "train_source", "eval_source"]
    both = by_text.select(*columns, "by_url", "by_text", "share", "jaccard").unionByName(by_url.select(*columns, "by_url", "by_text", "share", "jaccard"))
    return both.where(F.col("train_id") != F.col("eval_id")).groupBy(*columns).agg(F.max("by_url").alias("by_url"), F.max("by_text").alias("by_text"), F.max("share").alias("share"), F.max("jaccard").alias("jaccard"))


def overlap_report(pairs: DataFrame) -> DataFrame:
    """Number of overlapping rows and pairs per split and sources."""
    return pairs.groupBy("eval_split", "eval_source", "train_source").agg(
        F.count("*").alias("pairs"), F.countDistinct("eval_id").alias("eval_rows"), F.countDistinct("train_id").alias("train_rows"), F.sum(F.col("by_url").cast("int")).alias("by_url"), F.sum(F.col("by_text").cast("int")).alias("by_text")
    )
