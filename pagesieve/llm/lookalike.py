"""One form for texts that look the same but differ in characters.

``visual_form`` folds what the eye cannot tell apart: full-width and half-width forms, composed
and combining accents, joined letters, kinds of blank, invisible characters. Raised or circled
digits, case, accents and signs such as the numero sign stay, for they look different.

Letters of other scripts are handled by script-aware repair. The dominant script of each token is the one most of its
letters are in (on a tie, most letters of the value). In a token of several scripts the look-alikes are replaced by letters of
the dominant script, or, where that gives no word, of the next; but only if the token that comes out is in one script and in the
corpus vocabulary. So Latin words with a Cyrillic letter and Cyrillic words with a Latin one are both repaired, and words
written wholly in Greek, Cyrillic or Armenian stay as they are.

Two things go beyond that, because values that look the same have to become equal: a token wholly in another script
than its value's other tokens counts as mixed with them (it is still repaired only to a word of the corpus), and a word of which the corpus has no plain
spelling is in the vocabulary if two different mixed spellings come to it in Latin letters.

The vocabulary is never collected: candidate tokens, which are few, are joined with the distinct tokens of all values.

Defined results: null stays null, '' stays ''; blanks around a value are dropped, since they cannot be seen;
texts of any length are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagesieve.runtime import materialize

# Letters of other scripts drawn like a Latin one (upper case first where both exist).
LOOKALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԁ": "d", "Ԛ": "Q", "Ԝ": "W", "Ғ": "F",
    "а": "a", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "о": "o", "р": "p", "ѕ": "s", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y", "ӏ": "l", "Ӏ": "I", "к": "k", "ѵ": "v", "Ѵ": "V",
    "Ё": "Ë", "ё": "ë", "Ї": "Ï", "ї": "ï", "Ӓ": "Ä", "ӓ": "ä", "Ӧ": "Ö", "ӧ": "ö", "Ӱ": "Ÿ", "ӱ": "ÿ", "Ѐ": "È", "ѐ": "è", "ӑ": "ă", "Ӑ": "Ă", "ӗ": "ĕ", "Ӗ": "Ĕ", "ў": "y̆",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "Ϲ": "C", "Ϳ": "J",
    "ο": "o", "ν": "v", "α": "a", "ι": "i", "κ": "k", "ρ": "p", "υ": "u", "χ": "x", "γ": "y", "ϲ": "c", "ϳ": "j", "ε": "e", "ό": "ó", "ί": "í", "ά": "á", "ύ": "ú",
    # Armenian
    "օ": "o", "ո": "n", "ս": "u", "հ": "h", "ց": "g", "զ": "q", "ք": "p", "ա": "w", "յ": "j", "ռ": "n", "Օ": "O", "Ս": "U", "Տ": "S", "Լ": "L",
    # others
    "ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ᴄ": "c", "ᴏ": "o", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s", "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭼ": "E", "Ꮋ": "H", "Ꮖ": "I", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "ⲟ": "o", "Ⲟ": "O", "ⲣ": "p", "Ⲣ": "P", "ⲥ": "c", "Ⲥ": "C", "၀": "o", "ဝ": "o", "ഠ": "o", "๐": "o", "໐": "o", "०": "o",
}
#: Decompositions that only change the width, the joining or the font of a letter.
_SAME_LOOK = frozenset(("<wide>", "<narrow>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>"))
#: Joined letters and Roman numerals: drawn as the letters they consist of.
_JOINED = frozenset((*range(0xFB00, 0xFB07), *range(0xFB13, 0xFB18), *range(0x0132, 0x0134), *range(0x01C4, 0x01CD), *range(0x01F1, 0x01F4), *range(0x2160, 0x2180), 0x2024, 0x2025, 0x2026))
_DASHES = dict.fromkeys((0x2010, 0x2011, 0xFE63, 0x02D7, 0x2212), "-")
_OTHERS = {0x2044: "/", 0x2215: "/", 0x29F8: "/", 0x2236: ":", 0xA789: ":", 0x0589: ":", 0x05C3: ":", 0x2223: "|", 0x01C0: "|", 0x23D0: "|", 0x00B7: "·", 0x2219: "·", 0x22C5: "·", 0x0387: "·", 0x30FB: "·", 0x00B4: "'", 0x2018: "'", 0x2019: "'", 0x02B9: "'", 0x02BC: "'", 0x2032: "'", 0x05F3: "'", 0xFF07: "'", 0x3002: "。"}
_INVISIBLE_EXTRA = frozenset((0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E, 0x2800, 0x3164, 0xFFA0, 0xFE0E, 0xFE0F, *range(0xFE00, 0xFE0E)))
_folded: dict[str, str] = {}


def _fold(c: str) -> str:
    """What one character becomes; blanks become ' ', invisible ones ''."""
    o = ord(c)
    if o < 0x80:
        return c if 0x20 < o < 0x7F else " " if c in " \t\n\r\v\f" else ""
    if o in _INVISIBLE_EXTRA or o in range(0xE0000, 0xE1000):
        return ""
    if o in _DASHES:
        return "-"
    if o in _OTHERS:
        return _OTHERS[o]
    kind = unicodedata.category(c)
    if kind in ("Zs", "Zl", "Zp") or o == 0x85:
        return " "
    if kind in ("Cf", "Cc"):
        return ""
    parts = unicodedata.decomposition(c).split()
    if parts and (parts[0] in _SAME_LOOK or o in _JOINED):
        return "".join(_fold(chr(int(p, 16))) for p in parts if p[0] != "<")
    return c


def visual_form(text: str | None) -> str | None:
    """The common form of texts that look the same, letters of other scripts aside."""
    if text is None or text.isascii() and not _ODD_ASCII.search(text):
        return text
    if text.isascii():
        out = "".join(map(_fold, text))
    else:
        out = "".join(_folded[c] if c in _folded else _folded.setdefault(c, _fold(c)) for c in text)
    return re.sub(" {2,}", " ", unicodedata.normalize("NFC", out)).strip(" ")


_ODD_ASCII = re.compile(r"[^!-~ ]|^ | $|  ")
TOKEN = re.compile(r"[^\W_]+(?:[̀-ͯ][^\W_]*)*")
_scripts: dict[str, str] = {}


def script(c: str) -> str:
    """Script of a letter by the first word of its name; '' for digits and signs."""
    if c not in _scripts:
        name = unicodedata.name(c, "") if c.isalpha() else ""
        _scripts[c] = name.split(" ")[0].split("-")[0]
    return _scripts[c]


@lru_cache(maxsize=64)
def _table(to: str) -> dict[int, str]:
    """What letters of other scripts become in script ``to``: by way of the Latin letter they look like."""
    if to == "LATIN":
        return {ord(k): v for k, v in LOOKALIKES.items()}
    own: dict[str, str] = {}
    for k, v in LOOKALIKES.items():
        if script(k) == to:
            own.setdefault(v, k)
    return {ord(v): k for v, k in own.items() if len(v) == 1} | {ord(k): own[v] for k, v in LOOKALIKES.items() if script(k) != to and v in own}


def _by_frequency(text: str, ties: list[str] = ()) -> list[str]:
    """Scripts of the letters of a text, the most frequent first; ties in the order of ``ties``."""
    counts: dict[str, int] = {}
    for c in text:
        if s := script(c):
            counts[s] = counts.get(s, 0) + 1
    return sorted(counts, key=lambda s: (-counts[s], ties.index(s) if s in ties else len(ties), s))


def repair_candidates(value: str) -> list[tuple[str, str, int]]:
    """(token, repaired token, place of its script) of the tokens of a folded value that mix scripts; place 0 is the dominant script."""
    if value.isascii():
        return []
    of_value = _by_frequency(value)
    if len(of_value) < 2:
        return []
    out: list[tuple[str, str, int]] = []
    for token in dict.fromkeys(m.group(0) for m in TOKEN.finditer(value)):
        scripts = _by_frequency(token, of_value)
        if not scripts or scripts == ["LATIN"]:
            continue
        # a token of another script than its value's other tokens is mixed with them
        tried = [*(scripts if len(scripts) > 1 else ()), *(x for x in of_value if x not in scripts)]
        for place, to in enumerate(tried):
            table = _table(to)
            repaired = unicodedata.normalize("NFC", "".join(c if script(c) in ("", to) else table.get(ord(c), c) for c in token))
            if all(script(c) in ("", to) for c in repaired):
                out.append((token, repaired, place))
    return out


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        column = b.column("raw")
        folded = [visual_form(v) for v in column.to_pylist()]
        pairs = [[{"token": t, "repaired": r, "place": p} for t, r, p in repair_candidates(v)] if v else [] for v in folded]
        yield pa.RecordBatch.from_arrays([column, pa.array(folded, pa.string()), pa.array(pairs, pa.list_(pa.struct([("token", pa.string()), ("repaired", pa.string()), ("place", pa.int32())])))], names=["raw", "folded", "pairs"])


_PLAIN = r"^[!-~]+( [!-~]+)*$"


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+(?:\p{Mn}[\p{L}\p{N}]*)*)"), F.lit(1))


def canonical_forms(values: DataFrame) -> DataFrame:
    """(raw, form) of the distinct values in column ``raw`` that are not in their common form already.

    Every other value is its own form.
    """
    raws = values.select("raw").where(F.col("raw").isNotNull())
    odd = raws.where(~F.col("raw").rlike(_PLAIN)).distinct()
    folded = odd.mapInArrow(_forms, "raw string, folded string, pairs array<struct<token:string,repaired:string,place:int>>")
    # tokens that may be repaired, each once; of the repairs that are words of the corpus the one in the most frequent script counts
    pairs = folded.where(F.size("pairs") > 0).select(F.explode("pairs").alias("p")).groupBy("p.token", "p.repaired").agg(F.min("p.place").alias("place"))
    # words are the tokens that nothing in their value asks to repair
    vocabulary = raws.where(F.col("raw").rlike(_PLAIN)).select(F.explode(_tokens(F.col("raw"))).alias("repaired")).union(folded.select(F.explode(F.array_except(_tokens(F.col("folded")), F.col("pairs.token"))).alias("repaired")))
    known = vocabulary.join(pairs.select("repaired").distinct(), "repaired", "left_semi").distinct().withColumn("known", F.lit(True))
    # without a plain original two different spellings that come to the same Latin word attest it
    attested = pairs.groupBy("repaired").agg(F.count("*").alias("spellings"))
    ranked = pairs.join(attested, "repaired").join(known, "repaired", "left").where(F.col("known") | ((F.col("spellings") > 1) & F.col("repaired").rlike(r"\p{IsLatin}")))
    order = F.when(F.col("known"), F.col("place")).otherwise(1000)
    accepted = ranked.groupBy("token").agg(F.min(F.struct(order.alias("o"), "repaired")).alias("b")).select("token", "b.repaired")
    plain = folded.where(F.size("pairs") == 0).select("raw", F.col("folded").alias("form"))
    mended = folded.where(F.size("pairs") > 0).select("raw", "folded", F.explode(F.array_distinct("pairs.token")).alias("token")).join(accepted, "token", "left")
    mended = mended.groupBy("raw", "folded").agg(F.map_from_entries(F.collect_list(F.when(F.col("repaired").isNotNull(), F.struct("token", "repaired")))).alias("m"))
    parts = F.regexp_extract_all("folded", F.lit(r"([\p{L}\p{N}]+(?:\p{Mn}[\p{L}\p{N}]*)*|[^\p{L}\p{N}]+)"), F.lit(1))
    mended = mended.select("raw", F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at("m", p), p)), "").alias("form"))
    return plain.unionByName(mended).where(~F.col("raw").eqNullSafe(F.col("form")))


def consistent_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with every listed text column brought to its common form."""
    for c in columns:
        forms = canonical_forms(df.select(F.col(c).alias("raw"))).select(F.col("raw").alias("_raw"), F.col("form").alias("_form"))
        df = df.join(forms, F.col(c) == F.col("_raw"), "left").withColumn(c, F.coalesce("_form", c)).drop("_raw", "_form")
    return df


def lookalike_pairs(records: DataFrame, id_col: str, columns: dict[str, str]) -> DataFrame:
    """(id_a, id_b, field): records whose values of a field differ in characters but have one common form.

    A pair needs at least one value that is not in its common form. Only the groups of such values are
    joined with the rest, so exact copies never meet each other.
    """
    entries = F.array(*[F.struct(F.lit(name).alias("field"), F.col(c).alias("raw")) for name, c in columns.items()])
    long = records.select(F.col(id_col).alias("id"), F.explode(entries).alias("e")).select("id", "e.field", "e.raw").where(F.col("raw").isNotNull())
    # both are read several times: values once picked from the states of their records, forms once made
    long = materialize(long, "values")
    forms = materialize(canonical_forms(long), "forms")
    changed = long.join(forms, "raw").select("field", "form", "raw", "id")
    odd_raw = forms.select(F.col("raw"))
    own = long.join(odd_raw, "raw", "left_anti").select("field", F.col("raw").alias("form"), "raw", "id")
    a = changed.select("field", "form", F.col("raw").alias("raw_a"), F.col("id").alias("ida"))
    b = changed.unionByName(own).select("field", "form", F.col("raw").alias("raw_b"), F.col("id").alias("idb"))
    pairs = a.join(b, ["field", "form"]).where((F.col("raw_a") != F.col("raw_b")) & (F.col("ida") != F.col("idb")))
    return pairs.select(F.least("ida", "idb").alias("id_a"), F.greatest("ida", "idb").alias("id_b"), "field").distinct()
