"""The body of a page without menus, consent lines, side columns, share bars and footers.

A page becomes the sequence of its text-bearing leaf blocks. A linear-chain conditional random field labels them as
body or not from features of the block (tag, ancestors, names of containers, shape and words of the
text), of the containers around it (how many blocks, links and sentences they hold, whether the first
headline is in them) and of its neighbours; the best labelling of a page is found by Viterbi decoding. Transitions
have weights of their own within a container, from one to its neighbour, and between distant ones.

The weights ship with the package (``mainbody_weights.json``). ``train_mainbody`` makes them from labelled pages, that is pages
whose cleaned text is known from another table, at most ``TRAIN_PAGES`` of them; decoding covers every page.

Defined results: null and empty html have no blocks; unclosed tags end where HTML lets them end; comments, scripts and styles are no
text; blocks without text are no body; repeated pages give the same blocks; pages of any length are read whole.
"""

from __future__ import annotations

import html as html_lib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most labelled pages a model is fitted on.
TRAIN_PAGES = 4000
#: Characters of html parsed together.
SLICE_CHARS = 16 << 20
WEIGHTS = Path(__file__).with_name("mainbody_weights.json")

_TOKEN = re.compile(r"<(?:!--.*?(?:-->|$)|(script|style|noscript|template|svg|textarea)\b[^>]*>.*?(?:</\1\s*>|$)|(/?)([a-zA-Z][a-zA-Z0-9]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>?)", re.S)
_BID = re.compile(r"\bdata-bid\s*=\s*[\"']?(\d+)")
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_HREF = re.compile(r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_WORD = re.compile(r"[a-z]{3,}")
# Words of which names of containers are made everywhere on the web. Other names, as site builders invent them, say nothing.
NAME_STEMS = (
    "nav menu foot head side aside cookie consent notice privacy share social follow relat popular recent trend widget crumb legal copyright imprint banner promo advert sponsor newsletter subscribe login search "
    "tool toolbar dialog modal popup overlay skip lang topbar bottom colophon rail link more extra "
    "content main article post body story entry text page wrap inner container col row list card table comment author meta title info site layout note end bar top dropdown tags"
).split()
CONTAINERS = frozenset("body div section nav header footer aside main article ul ol dl table tbody td form figure center fieldset".split())
_CELL_ENDS = {"td": ("td",), "tr": ("td",), "th": ("td",)}
#: Text-bearing elements, where a page does not number its blocks.
LEAVES = frozenset("h1 h2 h3 h4 h5 h6 p li td th a span small blockquote dt dd figcaption pre".split())

# Words of lines that stand around a body.
LEXICONS = {
    "consent": r"(?i)\bcookies?\b|small files|kleine dateien|petits fichiers|pequeños archivos|usage data|nutzungsdaten|données d.usage|datos de uso|\bconsent\b|accept all|preferences|préférences|ajustes",
    "legal": r"(?i)prices include|subject to availability|nothing on this site|change without notice|vorrat reicht|keine haftung|preise können|inklusive|limite des stocks|ne répondons pas|prix peuvent|hasta agotar|no respondemos|precios pueden|all rights reserved|alle rechte|tous droits|derechos reservados",
    "mark": r"©|\(c\) ?(?:19|20)\d\d|®",
    "footer": r"(?i)^(?:imprint|impressum|privacy|datenschutz|terms(?: of use)?|nutzungsbedingungen|accessibility|barrierefreiheit|press|presse|prensa|security|site map|cookies|confidentialité|conditions|mentions légales|accessibilité|aviso legal|privacidad|condiciones|accesibilidad)$",
    "share": r"(?i)^(?:share|print|save|send|follow|tweet|e-?mail|pin|copy link|teilen|drucken|merken|senden|partager|imprimer|garder|envoyer|compartir|guardar|enviar|seite teilen|weitersagen)\b.{0,24}$",
    "aside": r"(?i)^(?:popular|related|recently|most read|our newsletter|follow us|see also|more (?:from|on|about)|trending|meistgelesen|unser rundbrief|zuletzt|verwandte|folgen sie|ähnliche|les plus lus|pages voisines|notre lettre|suivez|vus récemment|lo más|páginas afines|nuestro boletín|síguenos|vistos)\b",
    "counter": r"\(\d+\)$",
    "price": r"^\d[\d.,]* ?(?:cr|€|\$|eur|usd)\b",
}


class Page:
    """Blocks of one page and the containers they stand in."""

    __slots__ = ("bids", "tags", "texts", "container", "hrefs", "separated", "parents", "names", "kinds", "depths")

    def __init__(self) -> None:
        self.bids: list[int] = []
        self.tags: list[str] = []
        self.texts: list[str] = []
        self.container: list[int] = []
        self.hrefs: list[str] = []
        self.separated: list[bool] = []
        self.parents: list[int] = [-1]
        self.names: list[str] = [""]
        self.kinds: list[str] = ["page"]
        self.depths: list[int] = [0]


def parse(source: str) -> Page:
    page = Page()
    pos = 0
    stack = [(0, "page")]
    numbered = "data-bid" in source
    parts: list[str] = []
    open_tag = ""
    last_end = False

    def close() -> None:
        nonlocal open_tag
        if open_tag:
            page.texts.append("".join(parts))
            parts.clear()
            open_tag = ""

    bids, tags, hrefs = page.bids, page.tags, page.hrefs
    for m in _TOKEN.finditer(source, pos):
        start = m.start()
        if start > pos:
            text = source[pos:start]
            if open_tag:
                parts.append(text)
            elif last_end:
                t = text.strip()
                if t:
                    page.separated[-1] = t[0] in ">»›/|·•" or t.startswith("&gt;") or t.startswith("&raquo;")
                    last_end = False
        pos = m.end()
        name = m.group(3)
        if not name:
            continue
        name = name.lower()
        if m.group(2):
            if name == open_tag:
                close()
                last_end = True
            elif name in CONTAINERS:
                close()
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][1] == name:
                        del stack[k:]
                        break
            elif open_tag:
                parts.append(" ")
            continue
        attrs = m.group(4)
        found = _BID.search(attrs) if numbered and attrs else None
        if found or not numbered and name in LEAVES:
            close()
            if name == "td":
                while stack[-1][1] == "td":
                    stack.pop()
            bids.append(int(found.group(1)) if found else len(bids))
            tags.append(name)
            page.container.append(stack[-1][0])
            page.separated.append(False)
            href = _HREF.search(attrs) if name == "a" else None
            hrefs.append((href.group(1) or href.group(2) or href.group(3) or "") if href else "-" if name == "a" else "")
            open_tag = name
            last_end = False
            continue
        if name in CONTAINERS or name == "tr":
            if name != "tbody" or open_tag:
                close()
            if name in ("td", "tr"):
                while stack[-1][1] == "td":
                    stack.pop()
            if name != "tr":
                names = " ".join(a or b or c for a, b, c in _NAMES.findall(attrs)) if attrs else ""
                page.parents.append(stack[-1][0])
                page.names.append(names.lower())
                page.kinds.append(name)
                page.depths.append(len(stack))
                stack.append((len(page.kinds) - 1, name))
        elif open_tag:
            if name in ("label", "button", "input", "select", "option", "p", "li", "h1", "h2", "h3"):
                close()
            elif name != "b" and name != "a" and name != "i" and name != "em" and name != "strong":
                parts.append(" ")
    if open_tag:
        parts.append(source[pos:])
        close()
    return page


def _bucket(v: np.ndarray, edges: tuple) -> np.ndarray:
    return np.digitize(v, edges)



def _clean(text: str) -> str:
    if "&" in text:
        text = html_lib.unescape(text)
    return " ".join(text.split())


def _codes(table: dict[str, int], values: list[str]) -> np.ndarray:
    return np.array([table.setdefault(v, len(table)) for v in values], np.int64)


@lru_cache(maxsize=1 << 16)
def _stems(names: str) -> tuple[str, ...]:
    """The listed words that the names of a container begin with."""
    return tuple(sorted({stem for w in _WORD.findall(names) for stem in NAME_STEMS if w.startswith(stem)}))


class Blocks:
    """Blocks of many pages in flat arrays, with the features of each."""

    def __init__(self, pages: list[Page]):
        self.count = np.array([len(p.bids) for p in pages], np.int64)
        self.page = np.repeat(np.arange(len(pages)), self.count)
        self.bids = np.array([b for p in pages for b in p.bids], np.int64)
        self.texts = [_clean(t) for p in pages for t in p.texts]
        n = len(self.bids)
        self.first = np.r_[True, self.page[1:] != self.page[:-1]] if n else np.zeros(0, bool)
        tag_table: dict[str, int] = {}
        tag = _codes(tag_table, [t for p in pages for t in p.tags])
        tag_names = list(tag_table)
        base = np.cumsum([0, *[len(p.kinds) for p in pages]])
        parent = np.array([q + base[i] if q >= 0 else -1 for i, p in enumerate(pages) for q in p.parents], np.int64)
        kinds = [k for p in pages for k in p.kinds]
        names = [k for p in pages for k in p.names]
        box = np.array([c + base[i] for i, p in enumerate(pages) for c in p.container], np.int64)
        hrefs = [h for p in pages for h in p.hrefs]
        separated = np.array([s for p in pages for s in p.separated], bool)
        text = pa.array(self.texts, pa.string())
        words = (pc.add(pc.count_substring(text, pattern=" "), 1)).to_numpy(zero_copy_only=False)
        self.empty = (pc.binary_length(text).to_numpy(zero_copy_only=False) == 0) if n else np.zeros(0, bool)
        words = np.where(self.empty, 0, words)
        ended = pc.match_substring_regex(text, pattern=r"[.!?…][\"'»”’)]*$").to_numpy(zero_copy_only=False) if n else np.zeros(0, bool)
        lexicon = {k: pc.match_substring_regex(text, pattern=p).to_numpy(zero_copy_only=False) for k, p in LEXICONS.items()} if n else {}
        link = np.array([h != "" for h in hrefs], bool)
        sentence = ended & (words >= 5)
        is_h1 = np.array([t == "h1" for t in tag_names], bool)[tag] if n else np.zeros(0, bool)
        # what containers hold, with all that is within them
        size = len(parent)
        hold = {k: np.zeros(size) for k in ("blocks", "links", "sentences", "h1")}
        # containers by depth, each level at once: what a container holds goes to its parent, however deep it stands
        depth_of = np.array([d for p in pages for d in p.depths], np.int64)
        by_depth = np.argsort(depth_of, kind="stable")
        levels = [x for x in np.split(by_depth, np.cumsum(np.bincount(depth_of))[:-1])] if size else []
        for k, v in (("blocks", None), ("links", link), ("sentences", sentence), ("h1", is_h1)):
            hold[k] += np.bincount(box, v, size)
            for level in reversed(levels[1:]):
                np.add.at(hold[k], parent[level], hold[k][level])
        boxes = [box]
        for _ in range(3):
            boxes.append(np.where(boxes[-1] >= 0, parent[boxes[-1]], -1))
        kind_table: dict[str, int] = {}
        kind = _codes(kind_table, kinds)
        kind_names = list(kind_table)
        tokens: dict[str, int] = {}
        box_tokens = [[tokens.setdefault(w, len(tokens)) for w in _stems(s)] if s else [] for s in names]
        token_names = list(tokens)
        token_count = np.array([len(x) for x in box_tokens], np.int64)
        token_start = np.cumsum(token_count) - token_count
        token_flat = np.array([w for x in box_tokens for w in x] or [0], np.int64)
        ids, rows, labels = [], [], []

        def add(prefix: str, values: np.ndarray, text_of: list[str] | None = None, at: np.ndarray | None = None) -> None:
            """A categorical feature; negative values are none. ``at`` are the blocks of the values, all in order if not given."""
            ok = np.flatnonzero(values >= 0)
            if len(ok):
                seen, code = np.unique(values[ok], return_inverse=True)
                rows.append(ok if at is None else at[ok])
                ids.append(code + len(labels))
                labels.extend(f"{prefix}={text_of[u] if text_of else u}" for u in seen)

        flag = lambda p, f: add(p, np.where(f, 1, -1))
        length = _bucket(words, (1, 2, 3, 5, 9, 15, 30))
        add("tag", tag, tag_names)
        add("len", length)
        add("tag_len", tag * 8 + length, [f"{t}/{k}" for t in tag_names for k in range(8)])
        flag("ended", ended)
        flag("sentence", sentence)
        for k, v in lexicon.items():
            flag(k, v)
        flag("crumb", separated)
        flag("crumb_before", np.r_[False, separated[:-1]] & ~self.first if n else separated)
        href_kind = np.array([-1 if h == "" else 0 if h == "-" else 1 if h[:1] == "#" else 2 if h[:10] == "javascript" else 3 if h[:2] == "//" or h[:4] == "http" else 4 if h[:6] in ("mailto", "tel:") else 5 if h.count("/") > 1 else 6 if h == "/" else 7 for h in hrefs], np.int64)
        add("href", href_kind)
        wraps = np.zeros(n, np.int64)
        for depth, b in enumerate(boxes):
            ok = b >= 0
            safe = np.where(ok, b, 0)
            add(f"box{depth}", np.where(ok, kind[safe], -1), kind_names)
            held, links, sents = (hold[k][safe] for k in ("blocks", "links", "sentences"))
            shape = _bucket(held, (2, 4, 9)) * 12 + _bucket(links / np.maximum(held, 1), (0.01, 0.5, 0.99)) * 3 + _bucket(sents, (1, 3))
            add(f"shape{depth}", np.where(ok, shape * 2 + (hold["h1"][safe] > 0), -1))
            wraps += ok & (hold["h1"][safe] > 0)
            if depth < 3:
                k = np.where(ok, token_count[safe], 0)
                block = np.repeat(np.arange(n), k)
                nth = np.arange(len(block)) - np.repeat(np.cumsum(k) - k, k)
                add(f"name{depth}", token_flat[token_start[safe[block]] + nth] if len(block) else block, token_names, block)
        above = {k: np.zeros(size, bool) for k in ("nav", "footer", "header", "aside", "main", "article", "form", "ul", "table")}
        for k, flags in above.items():
            flags[:] = kind == kind_table.get(k, -1)
            for level in levels[1:]:
                flags[level] |= flags[parent[level]]
            flag(f"in_{k}", flags[box] if n else np.zeros(0, bool))
        add("with_h1", np.minimum(wraps, 3))
        # the way from the first headline
        seen = np.cumsum(is_h1) - np.repeat((np.cumsum(is_h1) - is_h1)[np.flatnonzero(self.first)], self.count[self.count > 0]) if n else np.zeros(0)
        has = np.repeat(np.add.reduceat(is_h1.astype(int), np.flatnonzero(self.first)), self.count[self.count > 0]) if n else np.zeros(0)
        add("h1_side", np.where(has == 0, 0, np.where(seen == 0, 1, 2)))
        before, after = np.r_[False, ~self.first[1:]] if n else self.first, np.r_[~self.first[1:], False] if n else self.first
        prior, later = np.arange(n) - 1, np.minimum(np.arange(n) + 1, max(n - 1, 0))
        for p, ok, o in (("prev", before, prior), ("next", after, later)):
            add(f"{p}_tag", np.where(ok, tag[o], -1), tag_names)
            add(f"{p}_len", np.where(ok, length[o], -1))
            flag(f"{p}_sentence", ok & sentence[o])
            for k in ("consent", "share", "footer", "aside", "mark", "counter"):
                flag(f"{p}_{k}", ok & lexicon[k][o] if n else np.zeros(0, bool))
            flag(f"{p}_same", ok & (box == box[o]))
            flag(f"{p}_same1", ok & (boxes[1] == boxes[1][o]) & (boxes[1] >= 0))
        flag("edge", ~before)
        # kind of step from the block before: within a box, between boxes of one box, farther
        self.step = np.where(~before, 0, np.where(box == box[prior], 0, np.where((boxes[1] == boxes[1][prior]) | (boxes[1] == box[prior]) | (box == boxes[1][prior]), 1, 2))).astype(np.int64) if n else np.zeros(0, np.int64)
        self.rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
        self.labels = labels


def emissions(b: Blocks, weights: dict[str, float]) -> np.ndarray:
    """Score of 'body' against 'not body' of each block."""
    w = np.array([weights.get(k, 0.0) for k in b.labels])
    return np.bincount(b.rows, w[b.ids], len(b.bids)) + weights.get("bias", 0.0) if len(b.bids) else np.zeros(0)


def _padded(b: Blocks, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values by page and place, and which of them are there."""
    n, longest = len(b.count), int(b.count.max()) if len(b.count) else 0
    place = np.arange(len(b.page)) - np.repeat(np.cumsum(b.count) - b.count, b.count)
    out, there = np.zeros((n, longest), values.dtype), np.zeros((n, longest), bool)
    out[b.page, place] = values
    there[b.page, place] = True
    return out, there


def viterbi(score: np.ndarray, step: np.ndarray, there: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best labels (1 body) of padded pages; ``trans[kind of step, from, to]``."""
    n, t = score.shape
    if not t:
        return np.zeros((n, 0), np.int64)
    best = np.stack([np.zeros(n), score[:, 0]], axis=1)
    back = np.zeros((n, t, 2), np.int64)
    for i in range(1, t):
        paths = best[:, :, None] + trans[step[:, i]]
        back[:, i] = paths.argmax(axis=1)
        new = paths.max(axis=1)
        new[:, 1] += score[:, i]
        best = np.where(there[:, i, None], new, best)
        back[:, i] = np.where(there[:, i, None], back[:, i], [0, 1])
    out = np.zeros((n, t), np.int64)
    out[:, -1] = best.argmax(axis=1)
    for i in range(t - 1, 0, -1):
        out[:, i - 1] = np.where(there[:, i], back[np.arange(n), i, out[:, i]], out[:, i])
    return out


def log_likelihood(score: np.ndarray, step: np.ndarray, there: np.ndarray, label: np.ndarray, trans: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood of labels of padded pages and its gradients with respect to scores and transitions."""
    n, t = score.shape
    emit = np.stack([np.zeros_like(score), score], axis=2)
    alpha, beta = np.zeros((n, t, 2)), np.zeros((n, t, 2))
    alpha[:, 0] = emit[:, 0]
    for i in range(1, t):
        a = np.logaddexp.reduce(alpha[:, i - 1, :, None] + trans[step[:, i]], axis=1) + emit[:, i]
        alpha[:, i] = np.where(there[:, i, None], a, alpha[:, i - 1])
    z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    for i in range(t - 2, -1, -1):
        b = np.logaddexp.reduce(trans[step[:, i + 1]] + (emit[:, i + 1] + beta[:, i + 1])[:, None, :], axis=2)
        beta[:, i] = np.where(there[:, i + 1, None], b, beta[:, i + 1])
    p = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z[:, None])
    g_score = np.where(there, label - p, 0.0)
    g_trans, total = np.zeros_like(trans), -z.sum() + (score * label * there).sum()
    for i in range(1, t):
        ok = there[:, i]
        s, x, y = step[ok, i], label[ok, i - 1], label[ok, i]
        total += trans[s, x, y].sum()
        np.add.at(g_trans, (s, x, y), 1.0)
        joint = np.exp(alpha[ok, i - 1, :, None] + trans[s] + (emit[ok, i] + beta[ok, i])[:, None, :] - z[ok, None, None])
        np.add.at(g_trans, s, -joint)
    return total, g_score, g_trans


def fit(blocks: Blocks, label: np.ndarray, site: np.ndarray | None = None, rounds: int = 250, l2: float = 0.5, rare: int = 8) -> dict:
    """Weights by gradient ascent with adaptive steps on the penalized log-likelihood.

    A feature counts if at least ``rare`` sites (``site`` has a number for each page; pages, if not given) have it.
    """
    of = (np.arange(len(blocks.count)) if site is None else site)[blocks.page[blocks.rows]]
    pairs = np.unique(blocks.ids * (int(of.max(initial=0)) + 1) + of)
    keep = np.bincount(pairs // (int(of.max(initial=0)) + 1), minlength=len(blocks.labels)) >= rare
    w, bias, trans = np.zeros(len(blocks.labels)), 0.0, np.zeros((3, 2, 2))
    (step, there), (y, _) = _padded(blocks, blocks.step), _padded(blocks, label.astype(np.int64))
    theta = np.concatenate([w, [bias], trans.ravel()])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    n = max(len(label), 1)
    for r in range(1, rounds + 1):
        w, bias, trans = theta[: len(w)], theta[len(w)], theta[len(w) + 1 :].reshape(3, 2, 2)
        score, _ = _padded(blocks, np.bincount(blocks.rows, w[blocks.ids], len(label)) + bias)
        _, g_score, g_trans = log_likelihood(score, step, there, y, trans)
        flat = g_score[there]
        g = np.concatenate([np.bincount(blocks.ids, flat[blocks.rows], len(w)) * keep, [flat.sum()], g_trans.ravel()]) - l2 * theta
        g /= n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + 0.05 * (1 - r / rounds / 1.05) * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-10)
    w, bias, trans = theta[: len(w)], theta[len(w)], theta[len(w) + 1 :]
    weights = {k: round(float(x), 4) for k, x, ok in zip(blocks.labels, w, keep) if ok and abs(x) >= 0.01}
    return {"weights": {"bias": round(float(bias), 4)} | dict(sorted(weights.items())), "transitions": np.round(trans, 4).reshape(3, 2, 2).tolist()}


@lru_cache(maxsize=4)
def load(path: str = str(WEIGHTS)) -> tuple[dict[str, float], np.ndarray]:
    model = json.loads(Path(path).read_text())
    return model["weights"], np.array(model["transitions"])


def body_flags(blocks: Blocks, model: tuple[dict[str, float], np.ndarray]) -> np.ndarray:
    """True for the blocks of the body."""
    if not len(blocks.bids):
        return np.zeros(0, bool)
    weights, trans = model
    score = emissions(blocks, weights)
    out = np.zeros(len(score), bool)
    # pages of like length are decoded together
    order = np.argsort(blocks.count, kind="stable")
    starts = np.cumsum(blocks.count) - blocks.count
    for part in np.array_split(order, max(1, len(order) // 256)):
        part = part[blocks.count[part] > 0]
        if not len(part):
            continue
        longest = int(blocks.count[part].max())
        there = np.arange(longest) < blocks.count[part][:, None]
        at = np.where(there, starts[part][:, None] + np.arange(longest), 0)
        labels = viterbi(np.where(there, score[at], 0.0), blocks.step[at], there, trans)
        out[at[there]] = labels[there] == 1
    return out & ~blocks.empty


def aligned_labels(page: Page, clean: str, limit: int) -> tuple[list[int], bool]:
    """Labels of the leading blocks by a page's cleaned text: blocks that follow each other in it are body. True if it reaches the end.

    ``clean`` may be cut off at ``limit`` characters; labels then end where it does.
    """
    labels, rest = [], " ".join(clean.split())
    heads = [i for i, t in enumerate(page.texts) if page.tags[i] == "h1" and rest.startswith(_clean(t) + " ")]
    begin = heads[0] if heads else 0  # a link with the words of the headline may come first
    whole = len(clean) < limit - 50  # the last word is dropped, cut off or not
    for i, t in enumerate(page.texts):
        t = _clean(t) if i >= begin else ""
        if not rest and not whole:
            break  # unknown from here on
        if t and rest.startswith(t) and (len(rest) == len(t) or rest[len(t)] == " "):
            labels.append(1)
            rest = rest[len(t) :].lstrip()
        elif t and rest and len(rest) < len(t) and t.startswith(rest) and (not whole or " " not in t[len(rest) :].strip()):
            labels.append(1)
            rest = ""
        else:
            labels.append(0)
    return labels, whole and not rest


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = load()
    for b in batches:
        ids, sources = b.column("id"), b.column("html")
        sizes = np.cumsum(pc.fill_null(pc.binary_length(sources), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < b.num_rows:
            end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + SLICE_CHARS, "right")))
            end = min(end, start + 1000)
            pages = [parse(s or "") for s in sources.slice(start, end - start).to_pylist()]
            blocks = Blocks(pages)
            body = body_flags(blocks, model)
            kept = np.flatnonzero(body)
            counts = np.bincount(blocks.page[kept], minlength=len(pages)) if len(kept) else np.zeros(len(pages), np.int64)
            offsets = pa.array(np.append(0, np.cumsum(counts)).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(blocks.bids[kept].astype(np.int32)))
            texts = pa.ListArray.from_arrays(offsets, pa.array([blocks.texts[i] for i in kept], pa.string()))
            yield pa.RecordBatch.from_arrays([ids.slice(start, end - start), lists, texts], names=["id", "bids", "texts"])
            start = end


def _all_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = load()
    for b in batches:
        for start in range(0, b.num_rows, 1000):
            part = b.slice(start, 1000)
            blocks = Blocks([parse(s or "") for s in part.column("html").to_pylist()])
            offsets = pa.array(np.append(0, np.cumsum(blocks.count)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (pa.array(blocks.texts, pa.string()), pa.array(body_flags(blocks, model)))]
            yield pa.RecordBatch.from_arrays([part.column("id"), *lists], names=["id", "texts", "body"])


def visible_body(visible: str, texts: list[str], body: list[bool]) -> str:
    """The body within a page's visible text, which holds the texts of its blocks one after the other and may be cut off.

    Blocks are looked for in order; what stands between them (labels, buttons) belongs to no block. A block at the cut is kept as far as it goes.
    """
    out, at = [], 0
    visible = " ".join(visible.split())
    for t, keep in zip(texts, body):
        if not t:
            continue
        found = visible.find(t, at)
        if found < 0:  # at the cut: what is left is the beginning of the block
            rest = visible[at:].strip()
            for k in range(len(rest)):
                if t.startswith(rest[k:]) and (k == 0 or rest[k - 1] == " "):
                    out += [rest[k:]] * keep
                    return "\n".join(out)
            continue
        if keep:
            out.append(t)
        at = found + len(t)
    return "\n".join(out)


def _visible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = zip(*(b.column(c).to_pylist() for c in ("visible", "texts", "body")))
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([None if v is None else v if t is None else visible_body(v, t, f) for v, t, f in rows], pa.string())], names=["id", "body"])


def visible_bodies(pages: DataFrame, ident: str, html: str, records: DataFrame, record_id: str, visible: str) -> DataFrame:
    """(id, body): the body of ``visible``, the text of a page without its markup, by the blocks of the page of the same id.

    The visible text of a record without a page stays as it is; null stays null. Repeated pages of an id have one content, of which one is taken.
    """
    rows = pages.where(F.col(html).isNotNull() & (F.length(html) > 0)).select(F.col(ident).alias("id"), F.col(html).alias("html"))
    blocks = rows.mapInArrow(_all_blocks, "id string, texts array<string>, body array<boolean>")
    one = blocks.groupBy("id").agg(F.max(F.struct("texts", "body")).alias("b")).select("id", "b.texts", "b.body")
    joined = records.select(F.col(record_id).alias("id"), F.col(visible).alias("visible")).join(one, "id", "left")
    return joined.mapInArrow(_visible, "id string, body string")


def page_bodies(pages: DataFrame, ident: str, html: str) -> DataFrame:
    """(id, bids, texts) of every row with html: numbers and texts of its body blocks, in order."""
    rows = pages.where(F.col(html).isNotNull() & (F.length(html) > 0)).select(F.col(ident).alias("id"), F.col(html).alias("html"))
    return rows.mapInArrow(_bodies, "id string, bids array<int>, texts array<string>")
