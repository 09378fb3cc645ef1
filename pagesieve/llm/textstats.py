"""Text statistics of documents, and the kind of text they tell: prose, list, table or junk.

The statistics are per document: words, mean word length, symbols, line ends, common words and some more. Thresholds
on them act as noisy labelling functions, each of which votes for a kind or stays silent. The
accuracy of every function is learnt without labels by expectation-maximization on where the
functions agree and disagree over all documents, and each document gets the posterior of the kinds.

Documents with the same votes have the same posterior, so the corpus is aggregated to its vote patterns
(each function votes for its kind or is silent, so 20 functions have at most ``2 ** 20`` patterns; in practice there are some dozens),
on which the algorithm runs on the driver; the posteriors go back by pattern.

Defined results: null and empty texts have zero counts and kind 'junk' is never said of them, their kind is 'prose'
with probability 0.25; texts of any length are read whole; repeated rows are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagesieve.runtime import materialize

KINDS = ("prose", "list", "table", "junk")
#: Most vote patterns there can be (each of 20 functions votes or not), and up to how many their posteriors are broadcast.
MAX_PATTERNS, BROADCAST = 1 << 20, 1 << 16
SLICE_BYTES = 24 << 20

# The most common words of the four languages.
COMMON = (
    "the of and to a in is that it for on was with as be by at from or an are this not but which have has had were their they his her its we you your our my "
    "der die das und ist nicht ein eine einen einem einer des dem den zu von mit auf für im in sich als auch bei nach aus an über unter wird wurde sind durch oder "
    "le la les et est une un des du de que qui dans sur pour pas par avec au aux ce cette ces il elle sont ont plus mais se sans son sa ses on "
    "el los las y es una que de en del por con para se al lo su sus como más pero no ha son sin si esta este entre cuando"
).split()
_COMMON_SET = pa.array(sorted(set(COMMON)))
_BULLET = r"^\s*(?:[-*+•·→▪◦‣–—]|\(?[0-9]{1,3}[.):]|\(?[a-zA-Z][.)])\s+\S"
_TERMINAL = r"[.!?…:;»”\"'’)]\s*$"
_CELLS = {"tab": r"\t", "pipe": r"\|", "semicolon": r";", "comma": r",", "gap": r"\S {2,}\S"}
_CODE = r"\b(?:function|return|var|let|const|def|class|import|include|public|static|void|null|elif|endif|foreach)\b|[{}]|=>|==|&&|\|\||\(\)|;$"
_COMMON_IN_LINE = r"(?i)(?:^|[ ])(?:" + "|".join(w for w in sorted(set(COMMON)) if len(w) > 1) + r")(?:$|[ ,.;:!?])"
# between entries one after the other on a line
_BETWEEN = r" [·•|/→*+-] |[,;] "

STATS = (
    "words bigint, chars bigint, lines bigint, mean_word_length double, symbol_ratio double, digit_ratio double, upper_ratio double, ended_lines double, ended_words double, common_share double, bullet_lines double, "
    "short_lines double, words_per_line double, cell_lines double, unique_share double, longest_word bigint, top_word_share double, broken_share double, letters_share double, code_rate double, hex_share double, odd_words double, sentences bigint, plain_lines double, separated double"
)


def _np(a) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False)


def _hit(values: pa.Array, pattern: str) -> np.ndarray:
    return _np(pc.match_substring_regex(values, pattern=pattern))


def _count(values: pa.Array, pattern: str) -> np.ndarray:
    return _np(pc.count_substring_regex(values, pattern=pattern)).astype(np.float64)


def _byte_classes() -> np.ndarray:
    """Classes of the first bytes of characters: 1 letter, 2 digit, 3 blank, 4 upper-case letter, 5 other; 0 for bytes within a character."""
    table = np.zeros(256, np.uint8)
    table[:128] = [3 if c in b" \t\n\r\v\f" else 2 if chr(c).isdigit() else 4 if chr(c).isupper() else 1 if chr(c).isalpha() else 5 for c in range(128)]
    table[0xC0:0xC3] = 5  # Latin-1 signs
    table[0xC3:0xE2], table[0xE2], table[0xE3:0xEF], table[0xEF], table[0xF0:] = 1, 5, 1, 5, 5
    return table


_CLASS = _byte_classes()


def _characters(texts: pa.Array) -> np.ndarray:
    """For each text the number of its letters, digits, blanks, upper-case ASCII letters and other characters."""
    texts = pa.concat_arrays([texts])  # own offsets from 0
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[: len(texts) + 1]
    classes = _CLASS[np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]] if data is not None else np.zeros(0, np.uint8)
    out = np.zeros((6, len(texts)))
    for k in range(1, 6):
        total = np.append(0, np.cumsum(classes == k))
        out[k] = total[ends[1:] - ends[0]] - total[ends[:-1] - ends[0]]
    return out


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """The columns of ``STATS`` for a column of texts."""
    n = len(texts)
    texts = pc.fill_null(texts, "").cast(pa.string())
    _, lower, digits, blanks, upper, symbols = _characters(texts)
    letters = lower + upper
    chars = letters + digits + blanks + symbols
    some = np.maximum(chars, 1)
    # words, and the stretches between full stops
    split = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(texts))
    word, wrow = split.flatten(), _np(pc.list_parent_indices(split))
    ok = _np(pc.binary_length(word)) > 0
    word, wrow = word.filter(pa.array(ok)), wrow[ok]
    words = np.bincount(wrow, minlength=n).astype(np.float64)
    some_words = np.maximum(words, 1)
    per_word = lambda flag: np.bincount(wrow, flag, n)
    coded = word.dictionary_encode()
    code, lexicon = _np(coded.indices).astype(np.int64), coded.dictionary
    folded = pc.utf8_lower(lexicon)
    bare = pc.utf8_trim(folded, characters=".,;:!?…\"'()[]{}«»“”„‘’|*_-·•+→/")
    length = _np(pc.utf8_length(lexicon)).astype(np.float64)[code]
    common = (_np(pc.is_in(bare, value_set=_COMMON_SET)) | _hit(bare, r"^(?:l|d|qu|n|s|c|j|m|t)['’]"))[code]
    stop = (_hit(lexicon, r"[.!?…][\"'»”’)]*$") & ~_hit(lexicon, r"^\(?(?:[0-9]+|[A-Za-z])[.)]$"))[code]
    wordy = (_np(pc.utf8_length(bare)) > 0)[code]
    odd = (~_hit(bare, r"[aeiouyäöüáéíóúàèìòùâêîôûëïœæ]") & _hit(bare, r"^\pL{4,}$"))[code]
    hexed = _hit(bare, r"^(?:[0-9a-f]{2}|[0-9a-f]{8})$")[code]
    longest = np.zeros(n)
    starts = np.flatnonzero(np.r_[True, wrow[1:] != wrow[:-1]]) if len(wrow) else np.zeros(0, int)
    if len(starts):
        longest[wrow[starts]] = np.maximum.reduceat(length, starts)
    stops = np.flatnonzero(stop)
    since = np.diff(np.append(-1, stops))
    first = np.zeros(n, np.int64)
    first[wrow[starts]] = starts
    since = np.minimum(since, stops - first[wrow[stops]] + 1)  # a sentence begins with its text
    full = (since >= 5) & (since <= 60)
    in_sentences = np.bincount(wrow[stops], np.where(full, since, 0), n) / some_words
    sentences = np.bincount(wrow[stops], full, n)
    keyed, to = np.unique(_np(pc.dictionary_encode(bare).indices), return_inverse=True)
    pairs, times = np.unique(wrow[wordy].astype(np.int64) * (len(keyed) + 1) + to[code[wordy]], return_counts=True)
    of = pairs // (len(keyed) + 1)
    unique = np.bincount(of, minlength=n) / some_words
    top = np.zeros(n)
    heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, int)
    if len(heads):
        top[of[heads]] = np.maximum.reduceat(times, heads)
    # lines
    lists = pc.split_pattern_regex(texts, pattern=r"\r?\n|\r")
    line, row = lists.flatten(), _np(pc.list_parent_indices(lists))
    line_words = _np(pc.list_value_length(pc.utf8_split_whitespace(pc.utf8_trim_whitespace(line)))).astype(np.float64)
    filled = _np(pc.binary_length(pc.utf8_trim_whitespace(line))) > 0
    line, row, line_words = line.filter(pa.array(filled)), row[filled], line_words[filled]
    lines = np.bincount(row, minlength=n).astype(np.float64)
    some_lines = np.maximum(lines, 1)
    per_line = lambda flag: np.bincount(row, flag, n) / some_lines
    ended, bullet = _hit(line, _TERMINAL), _hit(line, _BULLET)
    between = _count(line, _BETWEEN)
    entries = (between >= 3) & (line_words <= 6.5 * (between + 1)) & ~ended & ~bullet
    # a line that reads as part of a sentence
    prosy = (_count(line, _COMMON_IN_LINE) >= 2) & (line_words >= 5) & ~((line_words <= 9) & bullet) & ~entries
    # cells: the separator that most lines of a document share, with one number of cells
    cells = np.zeros(n)
    for name, p in _CELLS.items():
        k = _count(line, p)
        has = (k >= (1 if name in ("tab", "pipe", "gap") else 2)) & ~(bullet & (k < 2)) & ~prosy
        keys, counts = np.unique((row * 64 + np.minimum(k, 63).astype(np.int64))[has], return_counts=True)
        most = np.zeros(n)
        np.maximum.at(most, keys // 64, counts)
        if name == "gap":  # an empty cell takes its separator along
            most = np.maximum(most, np.bincount(row, has, n))
        cells = np.maximum(cells, np.where(most >= 2, most, 0) / some_lines)
    return {
        "words": words.astype(np.int64), "chars": chars.astype(np.int64), "lines": lines.astype(np.int64),
        "mean_word_length": per_word(length) / some_words, "symbol_ratio": symbols / some, "digit_ratio": digits / some, "upper_ratio": upper / np.maximum(letters, 1),
        "ended_lines": per_line(ended), "ended_words": in_sentences, "common_share": per_word(common) / some_words, "bullet_lines": per_line(bullet), "short_lines": per_line((line_words <= 7) & ~ended),
        "words_per_line": words / some_lines, "cell_lines": cells, "unique_share": unique, "longest_word": longest.astype(np.int64), "top_word_share": top / some_words,
        "broken_share": (_count(texts, "�") + 3 * _count(texts, r"%[0-9A-F]{2}|\\x[0-9a-f]{2}")) / some, "letters_share": letters / some, "code_rate": _count(texts, _CODE) / some_words,
        "hex_share": per_word(hexed) / some_words, "odd_words": per_word(odd) / some_words, "sentences": sentences.astype(np.int64), "plain_lines": per_line(~prosy & ~ended | bullet), "separated": np.bincount(row, entries * line_words, n) / some_words,
    }


def _slices(b: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    sizes = np.cumsum(_np(pc.fill_null(pc.binary_length(b.column(column)), 0)).astype(np.int64))
    start = 0
    while start < b.num_rows:
        end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + SLICE_BYTES, "right")))
        yield b.slice(start, end - start)
        start = end


def votes(s: dict[str, np.ndarray]) -> np.ndarray:
    """Votes of the labelling functions, a column each: 0 silent, else 1 + the kind's number in ``KINDS``."""
    n = len(s["words"])
    prose, a_list, table, junk = 1, 2, 3, 4
    dump = s["hex_share"] >= 0.5
    few = (s["sentences"] <= 1) | (s["ended_words"] < 0.4)
    # most lines are no part of a sentence, and most words are not in one
    block = (s["plain_lines"] >= 0.55) & ((s["lines"] >= 5) | (s["ended_words"] < 0.5))
    functions = [
        # prose
        ((s["ended_words"] >= 0.6) & (s["common_share"] >= 0.2) & ~(block & few), prose),
        ((s["common_share"] >= 0.28) & ~(block & few), prose),
        ((s["words_per_line"] >= 8) & (s["common_share"] >= 0.22) & (s["plain_lines"] < 0.5), prose),
        ((s["sentences"] >= 3) & (s["ended_words"] >= 0.5) & (s["common_share"] >= 0.15), prose),
        # tables
        ((s["cell_lines"] >= 0.6) & (s["lines"] >= 3) & (s["bullet_lines"] < 0.5) & ~dump, table),
        ((s["cell_lines"] >= 0.5) & (s["lines"] >= 3) & block & few & (s["bullet_lines"] < 0.4) & ~dump, table),
        ((s["cell_lines"] >= 0.3) & (s["digit_ratio"] >= 0.06) & (s["bullet_lines"] < 0.3) & (s["lines"] >= 3) & ~dump, table),
        # lists
        ((s["bullet_lines"] >= 0.5) & (s["lines"] >= 3) & few, a_list),
        ((s["short_lines"] >= 0.6) & (s["lines"] >= 4) & (s["cell_lines"] < 0.4) & few & ~dump & ((s["common_share"] < 0.27) | (s["bullet_lines"] >= 0.5)), a_list),
        ((s["separated"] >= 0.6) & (s["lines"] <= 3), a_list),
        (block & few & (s["lines"] >= 4) & (s["cell_lines"] < 0.4) & ~dump & (s["symbol_ratio"] < 0.3) & ((s["common_share"] < 0.27) | (s["bullet_lines"] >= 0.5)), a_list),
        # junk
        ((s["symbol_ratio"] >= 0.28) & (s["separated"] < 0.5), junk),
        ((s["longest_word"] >= 70) & (s["words"] <= 0.05 * s["chars"]) & (s["cell_lines"] < 0.5), junk),
        ((s["top_word_share"] >= 0.35) & (s["words"] >= 8) & (s["cell_lines"] < 0.5) & (s["bullet_lines"] < 0.3), junk),
        (s["broken_share"] >= 0.02, junk),
        (dump & (s["words"] >= 8), junk),
        ((s["code_rate"] >= 0.2) & (s["common_share"] < 0.2), junk),
        ((s["common_share"] < 0.1) & (s["words"] >= 10) & (s["words_per_line"] >= 10) & (s["separated"] < 0.5) & (s["cell_lines"] < 0.4), junk),
        ((s["odd_words"] >= 0.12) & (s["common_share"] < 0.15), junk),
        ((s["words"] > 0) & (s["ended_words"] < 0.1) & (s["common_share"] < 0.12) & (s["lines"] <= 3) & (s["separated"] < 0.5), junk),
    ]
    out = np.zeros((n, len(functions)), np.uint8)
    for k, (flag, kind) in enumerate(functions):
        out[flag, k] = kind
    return out


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximization over vote patterns: the posterior of the kinds for each pattern, and the accuracy of each function.

    Given the kind, functions vote independently; a function votes for its kind or is silent, and what it does under the other kinds is one rate. Starts from the share of votes for each kind.
    """
    k = len(KINDS)
    fired = (patterns > 0).astype(float)
    own = np.stack([(patterns == y + 1).sum(axis=1) for y in range(k)], axis=1) + 0.1
    posterior = own / own.sum(axis=1, keepdims=True)
    kind_of, columns = np.maximum(patterns.max(axis=0).astype(int) - 1, 0), np.arange(patterns.shape[1])
    for _ in range(rounds):
        weight = posterior * counts[:, None]
        total = weight.sum(axis=0)
        prior = (total + 1) / (total.sum() + k)
        # how often a function fires under its own kind and, alike for all of them, under the others
        hit = fired.T @ weight
        rate = np.repeat(((hit.sum(axis=1) - hit[columns, kind_of] + 0.05) / (total.sum() - total[kind_of] + 1))[:, None], k, axis=1)
        rate[columns, kind_of] = (hit[columns, kind_of] + 0.5) / (total[kind_of] + 1)
        rate = np.clip(rate, 1e-9, 1 - 1e-3)
        before = posterior
        log = np.log(prior) + fired @ np.log(rate) + (1 - fired) @ np.log(1 - rate)
        posterior = np.exp(log - log.max(axis=1, keepdims=True))
        posterior /= posterior.sum(axis=1, keepdims=True)
        silent = fired.sum(axis=1) == 0
        posterior[silent] = 1 / k
        if np.abs(posterior - before).max() < 1e-6:
            break
    weight = posterior * counts[:, None]
    hits = np.array([weight[fired[:, j] > 0, kind_of[j]].sum() for j in range(patterns.shape[1])])
    return posterior, hits / np.maximum((fired * counts[:, None]).sum(axis=0), 1)


def text_statistics(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, statistics..., votes) of every row; ``votes`` has a digit for each labelling function."""
    types = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in _slices(whole, "_text"):
                s = statistics(b.column("_text"))
                v = votes(s) + ord("0")
                cast = pa.array([r.tobytes().decode() for r in v], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(ident), *[pa.array(c) for c in s.values()], cast], names=[ident, *s, "votes"])

    return docs.select(ident, F.col(text).alias("_text")).mapInArrow(run, f"`{ident}` {types[ident]}, {STATS}, votes string")


def text_kinds(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, kind, probability, prose, list, table, junk): posterior text kinds of every row."""
    voted = text_statistics(docs, ident, text).select(ident, "votes")
    voted = materialize(voted, "kinds")
    rows = voted.groupBy("votes").count().collect()  # at most MAX_PATTERNS, for a pattern is a choice of 20 functions that vote
    rows.sort(key=lambda r: r["votes"])
    if not rows:
        return voted.select(ident, F.lit("").alias("kind"), *[F.lit(0.0).alias(c) for c in ("probability", *KINDS)])
    patterns = np.frombuffer("".join(r["votes"] for r in rows).encode(), np.uint8).reshape(len(rows), -1) - ord("0")
    posterior, _ = fit(patterns, np.array([r["count"] for r in rows], float))
    best = posterior.argmax(axis=1)
    table = [(r["votes"], KINDS[b], float(p[b]), *map(float, p)) for r, b, p in zip(rows, best, posterior)]
    known = docs.sparkSession.createDataFrame(table, "votes string, kind string, probability double, " + ", ".join(f"`{k}` double" for k in KINDS))
    # one row a pattern; more than BROADCAST of them are joined the ordinary way
    return voted.join(F.broadcast(known) if len(table) <= BROADCAST else known, "votes").drop("votes")
