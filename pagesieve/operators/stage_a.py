"""Observations from page documents: markup to title, visible text, meta, forms, anchors, iframes and resources.

A page is parsed once, in Arrow batches, into a list of elements in document order with the end of each, so that what lies
within an element is a slice. Limits are parameters; the numbers observed are counted before they apply.

Defined results: null and empty markup give empty lists; unclosed elements end where their parent ends; attribute values and texts have
their blanks collapsed, and empty ones are left out; values typed into inputs are never copied.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements without an end, and elements whose text is not seen.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = frozenset("script style noscript svg template".split())
# What the start of an element closes.
CLOSES = {"li": ("li",), "option": ("option",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "p": ("p",)}
META, INPUT = ("name", "property", "http-equiv", "charset", "content"), ("type", "name", "id", "placeholder", "autocomplete", "aria-label")
FORM, IFRAME = ("method", "action", "name", "id"), ("src", "name", "id", "title", "width", "height", "style")


@dataclass
class Limits:
    items: int = 100
    visible: int = 4000
    node: int = 300
    attribute: int = 500
    title: int = 300
    label: int = 160
    button: int = 120
    option: int = 80
    options: int = 10


def squeezed(value: str | None, most: int) -> str | None:
    """Blanks collapsed, cut to ``most`` characters; None if nothing is left."""
    text = re.sub(r"\s+", " ", value or "").strip()
    return text[:most].rstrip() or None


@dataclass
class Element:
    tag: str
    attrs: dict[str, str]
    up: int
    end: int = 0
    first_text: int = 0
    last_text: int = 0


class Tree(HTMLParser):
    """Elements of a page in document order; an element's descendants are those up to its ``end``."""

    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.elements = [Element("", {}, -1)]
        self.texts: list[str] = []  # those that are seen
        self.unseen = 0
        self.open = [0]
        self.feed(source)
        self.close()
        while self.open:
            self._end()

    def _end(self) -> None:
        e = self.elements[self.open.pop()]
        e.end, e.last_text = len(self.elements), len(self.texts)
        self.unseen -= e.tag in UNSEEN

    def handle_starttag(self, tag, attrs):
        closes = CLOSES.get(tag, ())
        while len(self.open) > 1 and self.elements[self.open[-1]].tag in closes:
            self._end()
        self.elements.append(Element(tag, {k: v or "" for k, v in reversed(attrs)}, self.open[-1], len(self.elements) + 1, len(self.texts), len(self.texts)))
        if tag not in VOID:
            self.open.append(len(self.elements) - 1)
            self.unseen += tag in UNSEEN

    def handle_endtag(self, tag):
        at = next((k for k in range(len(self.open) - 1, 0, -1) if self.elements[self.open[k]].tag == tag), 0)
        while at and len(self.open) > at:
            self._end()

    def handle_data(self, data):
        if not self.unseen:
            self.texts.append(data)

    def within(self, root: int, *tags: str) -> list[int]:
        return [i for i in range(root + 1, self.elements[root].end) if self.elements[i].tag in tags]

    def text(self, root: int, most: int) -> str | None:
        """Visible text of an element, its pieces one blank apart."""
        e = self.elements[root]
        return squeezed(" ".join(self.texts[e.first_text : e.last_text]), most)

    def attr(self, i: int, name: str, most: int) -> str | None:
        return squeezed(self.elements[i].attrs.get(name), most)


def _some(tree: Tree, i: int, names: tuple[str, ...], limits: Limits) -> dict[str, str]:
    found = {n.replace("-", "_"): tree.attr(i, n, limits.attribute) for n in names}
    return {k: v for k, v in found.items() if v}


def _label(tree: Tree, form: int, i: int, limits: Limits) -> str | None:
    ident = tree.attr(i, "id", limits.attribute)
    if ident:
        for k in tree.within(form, "label"):
            if tree.elements[k].attrs.get("for") == ident:
                return tree.text(k, limits.label)
    up = tree.elements[i].up
    while up > 0 and tree.elements[up].tag != "label":
        up = tree.elements[up].up
    return tree.text(up, limits.label) if up > 0 else None


def _inputs(tree: Tree, form: int, limits: Limits) -> list[list[tuple[str, str]]]:
    out = []
    for i in tree.within(form, "input", "textarea", "select")[: limits.items]:
        item = {"tag": tree.elements[i].tag, **_some(tree, i, INPUT, limits)}
        if label := _label(tree, form, i, limits):
            item["label"] = label
        if item["tag"] == "select":
            options = [tree.text(k, limits.option) for k in tree.within(i, "option")[: limits.options]]
            if any(options):
                item["options_sample"] = " | ".join(o for o in options if o)
        out.append(list(item.items()))
    return out


def _buttons(tree: Tree, form: int, limits: Limits) -> list[str]:
    out = []
    for i in tree.within(form, "button", "input")[: limits.items]:
        kind = (tree.attr(i, "type", limits.attribute) or "").lower()
        if tree.elements[i].tag == "input" and kind not in ("submit", "button", "reset"):
            continue
        text = tree.text(i, limits.button) or tree.attr(i, "value", limits.button)
        out += [text] if text else []
    return out


def _kept(items: list[dict]) -> list[dict]:
    return [i for i in items if i]


def observation(source: str | None, title: str | None, limits: Limits) -> dict:
    """What is observed in a page."""
    tree = Tree(source or "")
    of = lambda *tags: tree.within(0, *tags)
    forms, anchors, iframes, links = of("form"), of("a"), of("iframe"), of("link")
    body = of("body")
    titles = [t for t in (tree.text(i, limits.title) for i in of("title")) if t]
    rel = {i: (tree.attr(i, "rel", limits.attribute) or "").lower() for i in links if tree.attr(i, "href", limits.attribute)}
    hrefs = lambda on: [tree.attr(i, "href", limits.attribute) for i in rel if on(rel[i])][: limits.items]
    sources = lambda tag: [s for s in (tree.attr(i, "src", limits.attribute) for i in of(tag)) if s][: limits.items]
    links_of = [{k: v for k, v in {"text": tree.text(i, limits.node), **_some(tree, i, ("href", "title", "aria-label"), limits)}.items() if v} for i in anchors[: limits.items]]
    return {
        "title": squeezed(title, limits.title) or (titles[0] if titles else None),
        "visible_text": (tree.text(body[0], limits.visible) if body else None) or tree.text(0, limits.visible) or "",
        "meta": [list(m.items()) for m in _kept([_some(tree, i, META, limits) for i in of("meta")[: limits.items]])],
        "forms": {"total_observed": len(forms), "items": [{**_some(tree, i, FORM, limits), "text": tree.text(i, limits.node), "inputs": _inputs(tree, i, limits), "buttons": _buttons(tree, i, limits)} for i in forms[: limits.items]]},
        "anchors": {"total_observed": len(anchors), "items": _kept(links_of)},
        "iframes": {"total_observed": len(iframes), "items": _kept([_some(tree, i, IFRAME, limits) for i in iframes[: limits.items]])},
        "resources": {"favicon_hrefs": hrefs(lambda r: "icon" in r), "stylesheet_href_sample": hrefs(lambda r: "icon" not in r and "stylesheet" in r), "script_src_sample": sources("script"), "image_src_sample": sources("img")},
    }


_S = pa.string()
_ATTRIBUTES, _STRINGS = pa.map_(_S, _S), pa.list_(pa.string())


def _items(*fields) -> pa.DataType:
    return pa.struct([("total_observed", pa.int32()), ("items", pa.list_(pa.struct([f if isinstance(f, tuple) else (f, _S) for f in fields])))])


OBSERVED = pa.struct(
    [
        ("title", _S), ("visible_text", _S), ("meta", pa.list_(_ATTRIBUTES)),
        ("forms", _items(*FORM, "text", ("inputs", pa.list_(_ATTRIBUTES)), ("buttons", _STRINGS))),
        ("anchors", _items("text", "href", "title", "aria_label")), ("iframes", _items(*IFRAME)),
        ("resources", pa.struct([(n, _STRINGS) for n in ("favicon_hrefs", "stylesheet_href_sample", "script_src_sample", "image_src_sample")])),
    ]
)
_TEXTS = "array<string>"
OBSERVED_DDL = (
    "struct<title:string,visible_text:string,meta:array<map<string,string>>,"
    "forms:struct<total_observed:int,items:array<struct<method:string,action:string,name:string,id:string,text:string,inputs:array<map<string,string>>,buttons:array<string>>>>,"
    "anchors:struct<total_observed:int,items:array<struct<text:string,href:string,title:string,aria_label:string>>>,"
    "iframes:struct<total_observed:int,items:array<struct<src:string,name:string,id:string,title:string,width:string,height:string,style:string>>>,"
    f"resources:struct<favicon_hrefs:{_TEXTS},stylesheet_href_sample:{_TEXTS},script_src_sample:{_TEXTS},image_src_sample:{_TEXTS}>>"
)


def observations(pages: DataFrame, ident: str, html: str, title: str, limits: Limits = Limits()) -> DataFrame:
    """(id, observed) of every row of ``pages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen = [observation(h, t, limits) for h, t in zip(b.column("html").to_pylist(), b.column("title").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(seen, OBSERVED)], names=["id", "observed"])

    rows = pages.select(F.col(ident).alias("id"), F.col(html).alias("html"), F.col(title).alias("title"))
    return rows.mapInArrow(run, f"id string, observed {OBSERVED_DDL}")
