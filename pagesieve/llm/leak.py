"""Passages of held-out items inside a training corpus.

Every shard of the corpus (a batch of its scan) gets a suffix array over its words, sorted together with the
suffixes of the items to their full length by prefix doubling, so that a suffix of an item is looked
up among those of the shard by binary search. The search gives the longest verbatim match of every item suffix, its
location, and all places that agree in ``SEED`` words or more. From the left end of each such run the passage is followed to
both sides, over single changed words, whether or not the change alters the number of tokens.

``SEED`` is derived, not chosen: a passage of L >= 24 words with c <= L / 10 single changed words has a verbatim run of at least
(L - c) / (c + 1) words, which is 7 at its smallest (L = 30, c = 3) and never less. Places that agree with no item in ``SEED`` words
are left out of the array before it is sorted, as no search could end there.

Items are searched in parts of about ``PART_WORDS`` words, each small enough to be sent to all executors; the corpus is
never moved and only passages leave its shards.

Defined results: null and empty texts hold nothing; words are compared without case, punctuation, marks at
line starts, blanks and invisible characters; texts of any length are read whole; repeated rows are repeated passages
and are joined to one; an item shorter than ``LEAST`` words cannot be found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, ONE_IN = 24, 10
#: Shortest verbatim run that a passage is sure to have (see above).
SEED = min(-(-(n - n // ONE_IN) // (n // ONE_IN + 1)) for n in range(LEAST, 20 * ONE_IN))
#: Words of items searched for together.
PART_WORDS = 2_000_000
#: Bytes of text of a shard.
SHARD_BYTES = 24 << 20
#: Pairs of places followed together.
PAIRS = 1 << 20
_BLOOM_BITS = 24

_INVISIBLE = r"[\x{00AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}\x{034F}\x{180E}\x{FE00}-\x{FE0F}]"
_WORD_GAP = r"[^\pL\pN\pM]+"


def normalized(texts: pa.Array) -> pa.Array:
    """Words of letters and digits in lower case, one blank apart."""
    t = pc.replace_substring_regex(pc.fill_null(texts, ""), pattern=_INVISIBLE, replacement="")
    t = pc.utf8_normalize(t, form="NFKC")
    t = pc.replace_substring(pc.utf8_lower(t), pattern="ß", replacement="ss")
    return pc.utf8_trim(pc.replace_substring_regex(t, pattern=_WORD_GAP, replacement=" "), characters=" ")


def _tokens(texts: pa.Array, code: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Tokens of all texts, the blank-separated word of each (numbered through), and how many each text has.

    Only different words are normalized. Tokens are numbers by ``code`` (0 where it has none), or by the list returned.
    """
    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pc.fill_null(texts, "")))
    per_text = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    parts = pc.split_pattern(normalized(coded.dictionary), pattern=" ")
    flat, of = parts.flatten().to_pylist(), pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)
    there = np.array([t != "" for t in flat], bool)
    names = sorted({t for t in flat if t}) if code is None else []
    if code is None:
        code = {t: i + 1 for i, t in enumerate(names)}
    numbers = np.array([code.get(t, 0) for t in flat], np.int64)[there]
    size = np.bincount(of[there], minlength=len(parts)) if len(of) else np.zeros(len(parts), np.int64)
    start = np.cumsum(size) - size
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    each = size[index]
    word = np.repeat(np.arange(len(index)), each)
    known = numbers[start[index][word] + np.arange(len(word)) - np.repeat(np.cumsum(each) - each, each)]
    text = np.repeat(np.arange(len(per_text)), per_text)
    # words without a token are none
    word = np.cumsum(np.r_[False, word[1:] != word[:-1]]) if len(word) else word
    return known, word, np.bincount(text, each, len(per_text)).astype(np.int64), names


def _grams(ids: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places with ``SEED`` known words ahead, and a hash of these."""
    n = max(len(ids) - SEED + 1, 0)
    ok = left[:n] >= SEED
    unknown = np.cumsum(np.r_[0, ids == 0])
    ok &= unknown[SEED : SEED + n] == unknown[:n]
    at = np.flatnonzero(ok)
    h = np.zeros(len(at), np.uint64)
    for k in range(SEED):
        h = (h + ids[at + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return at, (h >> np.uint64(64 - _BLOOM_BITS)).astype(np.int64)


class SuffixArray:
    """Suffixes of several strings of numbers in order, and their ranks by the first 1, 2, 4 ... numbers."""

    def __init__(self, ids: np.ndarray, left: np.ndarray):
        self.left, self.levels = left, []
        n, rank, k = len(ids), ids.astype(np.int64), 1
        while n:
            self.levels.append((k, rank))
            longer = np.flatnonzero(left > k)
            if not len(longer):
                break
            # an ended suffix comes before all that go on
            pair = rank * (int(rank.max()) + 2)
            pair[longer] += rank[longer + k] + 1
            _, rank = np.unique(pair, return_inverse=True)
            k *= 2
            if int(rank.max()) == n - 1:
                self.levels.append((k, rank))
                break
        self.rank = rank
        self.order = np.argsort(rank, kind="stable")

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many numbers the suffixes at ``a`` and ``b`` have in common."""
        a, b = a.copy(), b.copy()
        end_a, end_b = a + self.left[a], b + self.left[b]
        out = np.zeros(len(a), np.int64)
        for k, rank in reversed(self.levels):
            while True:
                ok = (a + k <= end_a) & (b + k <= end_b)
                ok[ok] = rank[a[ok]] == rank[b[ok]]
                if not ok.any():
                    break
                a[ok] += k
                b[ok] += k
                out[ok] += k
                if k != self.levels[-1][0]:
                    break  # twice the same length would have shown on the level above
        return out


def longest_passage(good: list[bool]) -> tuple[int, int, int]:
    """(words, first, last) of the longest passage along aligned words.

    ``good`` says of each item word whether the document has it. A passage begins and ends with
    words that agree, changed words stand alone in it and are at most one in ``ONE_IN``.
    """
    best = (0, 0, 0)
    n, i = len(good), 0
    while i < n:
        if not good[i]:
            i += 1
            continue
        # a stretch without two changed words next to each other
        j, bad = i, []
        while j < n and (good[j] or (j + 1 < n and good[j + 1] and good[j - 1])):
            if not good[j]:
                bad.append(j - i)
            j += 1
        length = j - i
        if length > best[0]:
            marks = [-1, *bad, length]
            for a in range(len(marks) - 1):  # from behind one changed word to before another
                for b in range(len(marks) - 1, a, -1):
                    span = marks[b] - marks[a] - 1
                    if span <= best[0]:
                        break
                    if (b - a - 1) * ONE_IN <= span:
                        best = (span, i + marks[a] + 1, i + marks[b] - 1)
                        break
        i = j + 1
    return best


class _Words:
    """Tokens of several texts one after the other, with the borders of words and texts at each."""

    def __init__(self, known: np.ndarray, word: np.ndarray, counts: np.ndarray):
        self.known, self.counts = known, counts
        self.end = np.cumsum(counts)
        self.of = np.repeat(np.arange(len(counts)), counts)
        self.begin = self.end[self.of] - counts[self.of]
        self.left = self.end[self.of] - np.arange(len(known))
        heads = np.flatnonzero(np.r_[True, (word[1:] != word[:-1]) | (self.of[1:] != self.of[:-1])]) if len(known) else np.zeros(0, np.int64)
        at = np.searchsorted(heads, np.arange(len(known)), "right")
        self.word_begin, self.word_end = heads[at - 1], np.append(heads, len(known))[at]


class _Side:
    """Tokens of one text with its blank-separated words."""

    def __init__(self, texts: _Words, k: int):
        lo, hi = int(texts.end[k] - texts.counts[k]), int(texts.end[k])
        self.ids = texts.known[lo:hi].tolist()
        self.first = np.unique(texts.word_begin[lo:hi] - lo).tolist()
        self.word = (np.searchsorted(self.first, np.arange(hi - lo), "right") - 1).tolist()
        self.first.append(hi - lo)


def _follow(item: _Side, doc: _Side, w: int, p: int, step: int) -> list[tuple[bool, int]]:
    """From item word ``w`` at document token ``p`` to the right (1) or left (-1): of each word whether it agrees, and where it stands.

    ``p`` is where the word begins (to the right) or behind its end (to the left). A changed word takes as many tokens as it has in the item, or one word of the document.
    """
    ids, first, theirs, n = item.ids, item.first, doc.ids, len(doc.ids)

    def agrees(w: int, p: int) -> bool:
        if not 0 <= w < len(first) - 1:
            return False
        a, b = first[w], first[w + 1]
        lo = p if step > 0 else p - (b - a)
        return lo >= 0 and lo + b - a <= n and theirs[lo : lo + b - a] == ids[a:b]

    out = []
    while 0 <= w < len(first) - 1 and 0 <= p <= n:
        size = first[w + 1] - first[w]
        if agrees(w, p):
            out.append((True, p if step > 0 else p - size))
            w, p = w + step, p + step * size
            continue
        q = p + step * size
        if not agrees(w + step, q):
            if step > 0 and p < n:
                q = doc.first[doc.word[p] + 1]
            elif step < 0 and p > 0:
                q = doc.first[doc.word[p - 1]]
            if not agrees(w + step, q):
                break
        out.append((False, min(p, q)))
        w, p = w + step, q
    return out


class Searcher:
    def __init__(self, rows: list[tuple]):
        self.ids = [r[0] for r in rows]
        known, word, counts, names = _tokens(pa.array([r[1] for r in rows], pa.string()))
        self.code = {t: i + 1 for i, t in enumerate(names)}
        self.items = _Words(known, word, counts)
        self.sides = [_Side(self.items, k) for k in range(len(rows))]
        self.seen = np.zeros(1 << _BLOOM_BITS, bool)
        self.seen[_grams(known, self.items.left)[1]] = True

    def matches(self, known: np.ndarray, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(item place, shard place, words in common) of all left ends of verbatim runs of ``SEED`` words or more, some at a time."""
        at, h = _grams(known, left)
        at = at[self.seen[h]]
        if not len(at):
            return
        # stretches of the shard in which a run may lie, each a string of its own
        inside = np.zeros(len(known) + 1, np.int64)
        np.add.at(inside, at, 1)
        np.add.at(inside, at + SEED, -1)
        kept = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
        breaks = np.r_[np.diff(kept) != 1, True] | (left[kept] == 1)
        ends = np.flatnonzero(breaks)
        own_left = ends[np.searchsorted(ends, np.arange(len(kept)))] - np.arange(len(kept)) + 1
        m = len(self.items.known)
        array = SuffixArray(np.concatenate([self.items.known, known[kept]]), np.concatenate([self.items.left, own_left]))
        places = array.order[array.order >= m]
        ordered = array.rank[places]
        queries = np.flatnonzero(self.items.left >= SEED)
        # neighbours in the order have the longest matches; places with SEED words in common lie around them
        spot = np.searchsorted(ordered, array.rank[queries])
        lcp = lambda q, i: array.common(q, places[i])
        near = np.zeros(len(queries), bool)
        near[spot > 0] = lcp(queries[spot > 0], spot[spot > 0] - 1) >= SEED
        right = (spot < len(places)) & ~near
        near[right] = lcp(queries[right], spot[right]) >= SEED
        queries, spot = queries[near], spot[near]
        # borders of groups of places that have SEED words in common
        border = np.r_[True, lcp(places[:-1], np.arange(1, len(places))) < SEED, True]
        heads = np.flatnonzero(border)
        low, high = spot.copy(), spot.copy()
        with_left = (spot > 0) & (lcp(queries, np.maximum(spot - 1, 0)) >= SEED)
        low[with_left] = heads[np.searchsorted(heads, spot[with_left] - 1, "right") - 1]
        with_right = (spot < len(places)) & (lcp(queries, np.minimum(spot, len(places) - 1)) >= SEED)
        high[with_right] = heads[np.searchsorted(heads, spot[with_right], "right")]
        n = high - low
        ahead = np.cumsum(n)
        for s in range(0, int(n.sum()), PAIRS):
            flat = np.arange(s, min(s + PAIRS, int(n.sum())))
            i = np.searchsorted(ahead, flat, "right")
            q, p = queries[i], places[low[i] + flat - (ahead[i] - n[i])]
            # left ends only: the words before differ, or one of the texts begins
            inner = (q > self.items.begin[q]) & (p > m) & ~breaks[np.maximum(p - m - 1, 0)]
            inner[inner] = array.levels[0][1][q[inner] - 1] == array.levels[0][1][p[inner] - 1]
            q, p = q[~inner], p[~inner]
            yield q, kept[p - m], array.common(q, p)

    def _reach(self, docs: _Words, w: np.ndarray, p: np.ndarray, step: int) -> np.ndarray:
        """At most how many words ``_follow`` gets from item token ``w`` at document token ``p``; words are told by their first and last token. Ends at ``LEAST``.

        To the right both are where a word begins, to the left both are behind its end.
        """
        items = self.items
        out = np.zeros(len(w), np.int64)
        live = np.arange(len(w))
        item_of, doc_of = (items.of[w], docs.of[p]) if step > 0 else (items.of[w - 1], docs.of[p - 1])
        low, high = items.end[item_of] - items.counts[item_of], items.end[item_of]
        begin, end = docs.end[doc_of] - docs.counts[doc_of], docs.end[doc_of]
        mi, md = len(items.known) - 1, len(docs.known) - 1

        def size(w):
            return items.word_end[np.minimum(w, mi)] - w if step > 0 else w - items.word_begin[np.maximum(w - 1, 0)]

        def agrees(w, p, n, i):
            lo, at = (w, p) if step > 0 else (w - n, p - n)
            inside = (lo >= low[i]) & (lo + n <= high[i]) & (at >= begin[i]) & (at + n <= end[i]) & (n > 0)
            a, b, n = np.clip(lo, 0, mi), np.clip(at, 0, md), np.maximum(n, 1) - 1
            return inside & (items.known[a] == docs.known[b]) & (items.known[np.minimum(a + n, mi)] == docs.known[np.minimum(b + n, md)])

        while len(live):
            n = size(w)
            same = agrees(w, p, n, live)
            w1, p1 = w + step * n, p + step * n
            n2 = size(w1)
            shifted = docs.word_end[np.clip(p, 0, md)] if step > 0 else docs.word_begin[np.clip(p - 1, 0, md)]
            direct = ~same & agrees(w1, p1, n2, live)
            other = ~same & ~direct & agrees(w1, shifted, n2, live)
            out[live] += same + 2 * direct + 2 * other
            w = np.where(same, w1, w1 + step * n2)
            p = np.where(same, p1, np.where(other, shifted, p1) + step * n2)
            on = (same | direct | other) & (out[live] < LEAST) & ((w < high[live]) & (p < end[live]) if step > 0 else (w > low[live]) & (p > begin[live]))
            live, w, p = live[on], w[on], p[on]
        return out

    def may_go_on(self, docs: _Words, q: np.ndarray, p: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Runs that single changed words may join to ``LEAST`` words."""
        items, reach = self.items, n.copy()
        e = q + n  # the changed word holds the first token behind the run
        i = np.flatnonzero((reach < LEAST) & (e < items.end[items.of[q]]) & (p + n < docs.end[docs.of[p]]))
        w = items.word_begin[e[i]]
        at = p[i] + w - q[i]
        reach[i[at < docs.begin[p[i]]]] = LEAST  # a run within one long word, left to the exact way
        i, w, at = (x[at >= docs.begin[p[i]]] for x in (i, w, at))
        reach[i] += self._reach(docs, w, at, 1)
        i = np.flatnonzero((reach < LEAST) & (q > items.begin[q]) & (p > docs.begin[p]))
        w = items.word_end[q[i] - 1]  # and the last one before it
        at = p[i] + w - q[i]
        reach[i[at > docs.end[docs.of[p[i]]]]] = LEAST
        i, w, at = (x[at <= docs.end[docs.of[p[i]]]] for x in (i, w, at))
        reach[i] += self._reach(docs, w, at, -1)
        return reach >= LEAST

    def shard(self, ids: pa.Array, texts: pa.Array) -> Iterator[tuple]:
        """(doc, item, words, first word in the item, first token in the document, longest verbatim run) of the passages of ``LEAST`` words or more."""
        known, word, counts, _ = _tokens(texts, self.code)
        if not len(known) or not len(self.items.known):
            return
        docs, items = _Words(known, word, counts), self.items
        best: dict[tuple[int, int], tuple] = {}
        verbatim: dict[tuple[int, int], int] = {}
        covered: dict[tuple[int, int], set] = {}
        sides: dict[int, _Side] = {}
        for q, p, n in self.matches(known, docs.left):
            on = self.may_go_on(docs, q, p, n)
            q, p, n = q[on], p[on], n[on]
            for q1, p1, n1, d1, k in zip((q - items.begin[q]).tolist(), (p - docs.begin[p]).tolist(), n.tolist(), docs.of[p].tolist(), items.of[q].tolist()):
                key = (d1, k)
                verbatim[key] = max(verbatim.get(key, 0), n1)
                item = self.sides[k]
                w = item.word[q1] + (q1 != item.first[item.word[q1]])  # the first word that is whole in the run
                if w >= len(item.first) - 1:
                    continue
                at = p1 + item.first[w] - q1
                done = covered.setdefault(key, set())
                if (w, at) in done:
                    continue
                doc = sides.get(d1) or sides.setdefault(d1, _Side(docs, d1))
                back, ahead = _follow(item, doc, w - 1, at, -1), _follow(item, doc, w, at, 1)
                path = back[::-1] + ahead
                done.update((w - len(back) + i, where) for i, (_, where) in enumerate(path))
                if len(path) < LEAST:
                    continue
                words, first, _ = longest_passage([g for g, _ in path])
                if words >= LEAST and words > best.get(key, (0,))[0]:
                    best[key] = (words, w - len(back) + first, path[first][1])
        for (d1, k), (words, item_from, doc_from) in best.items():
            yield ids[d1].as_py(), self.ids[k], words, item_from, doc_from, verbatim[d1, k]


def _shards(b: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < b.num_rows:
        end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + SHARD_BYTES, "right")))
        yield b.slice(start, end - start)
        start = end


def _searched(corpus: DataFrame, doc_type: str, item_type: str, rows: list[tuple]) -> DataFrame:
    shared = corpus.sparkSession.sparkContext.broadcast(rows)
    numbers = item_type == "bigint"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = None
        for whole in batches:
            searcher = searcher or Searcher(shared.value)
            for b in _shards(whole, "text"):
                found = list(zip(*searcher.shard(b.column("doc"), b.column("text")))) or [()] * 6
                types = [b.schema.field("doc").type, pa.int64() if numbers else pa.string(), *[pa.int32()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(f, t) for f, t in zip(found, types)], names=["doc", "item", "words", "item_from", "doc_from", "verbatim"])

    return corpus.mapInArrow(search, f"doc {doc_type}, item {item_type}, words int, item_from int, doc_from int, verbatim int")


def leaked_passages(corpus: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, part_words: int = PART_WORDS) -> DataFrame:
    """(doc_id, item_id, words, item_from, doc_from, verbatim): the longest passage of each item that a document holds.

    ``item_from`` is the number of its first word in the item, ``doc_from`` that of its first token in the document, ``verbatim`` the longest run without a change.
    """
    held = items.where(F.col(item_text).isNotNull() & F.col(item_id).isNotNull())
    total = held.agg(F.sum(F.size(F.split(item_text, r"\s+")))).first()[0] or 0
    parts = max(1, -(-total // part_words))
    types = dict(corpus.dtypes)
    item_type = "bigint" if dict(items.dtypes)[item_id] in ("tinyint", "smallint", "int", "bigint") else "string"
    docs = corpus.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"))
    found = None
    for k in range(parts):  # each part of bounded size in expectation; the corpus is scanned once a part
        mine = held.where(F.pmod(F.xxhash64(item_id), F.lit(parts)) == k) if parts > 1 else held
        rows = [(r[0], r[1]) for r in mine.select(F.col(item_id).cast(item_type), item_text).orderBy(item_id).collect()]
        one = _searched(docs, types[doc_id], item_type, rows)
        found = one if found is None else found.unionByName(one)
    best = found.groupBy("doc", "item").agg(F.max(F.struct("words", F.col("item_from") * -1, F.col("doc_from") * -1)).alias("b"), F.max("verbatim").alias("verbatim"))
    return best.select(F.col("doc").alias(doc_id), F.col("item").alias(item_id), "b.words", (-F.col("b.col2")).alias("item_from"), (-F.col("b.col3")).alias("doc_from"), "verbatim")


def without_leaks(corpus: DataFrame, doc_id: str, leaks: DataFrame) -> DataFrame:
    """The corpus without the documents that hold passages of held-out items."""
    return corpus.join(leaks.select(doc_id).distinct(), doc_id, "left_anti")
