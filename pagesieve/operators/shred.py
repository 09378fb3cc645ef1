"""Columnar shredding of nested records into related flat tables.

A nested Arrow column is shredded into one sequence of levels per leaf path: for each slot a
*repetition level* (at which list the path repeats; 0 starts a record) and a *definition level* (how much of
the path is there), as column stores keep them. Everything after that works on the sequences alone: the flat table
of a repeated ancestor is put together from the sequences of the leaves below it, with one row per slot that opens a defined element; the position at
each list follows from the repetition levels, and so every row knows its record, its parent's position and its own.

Defined results: null containers, null lists and empty lists give no row; null elements give no row but
keep their position; empty objects are rows; a single object in place of a list has position 0; other columns
of a record, whatever their names, are not touched. Records of any size stay in their Arrow batch; nothing is collected.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


@dataclass
class Levels:
    """Level sequences of a path; ``index`` points into ``values``, -1 where nothing is defined."""

    rep: np.ndarray
    definition: np.ndarray
    index: np.ndarray
    values: pa.Array
    depth: int = 0  # lists so far
    defined: int = 0  # definition level of a present value

    def record(self) -> np.ndarray:
        return np.cumsum(self.rep == 0) - 1

    def position(self, level: int) -> np.ndarray:
        """Position of each slot within its list at a repetition level (1 for the outermost list)."""
        count = np.cumsum(self.rep <= level)
        opens = np.maximum.accumulate(np.where(self.rep < level, np.arange(len(self.rep)), 0)) if len(self.rep) else np.zeros(0, int)
        return count - count[opens]

    def present(self) -> np.ndarray:
        """Slots whose value is there; null and missing ones are not."""
        return self.definition == self.defined


def _valid(a: pa.Array) -> np.ndarray:
    return pc.is_valid(a).to_numpy(zero_copy_only=False)


def root(values: pa.Array) -> Levels:
    n, ok = len(values), _valid(values)
    return Levels(np.zeros(n, np.int8), ok.astype(np.int8), np.where(ok, np.arange(n), -1), values, 0, 1)


def field(parent: Levels, name: str) -> Levels:
    """An optional field of a struct."""
    child = pc.struct_field(parent.values, name)
    ok = np.append(_valid(child), False)[parent.index]  # -1 reads the last: not there
    return Levels(parent.rep, parent.definition + ok, np.where(ok, parent.index, -1), child, parent.depth, parent.defined + 1)


def elements(parent: Levels) -> Levels:
    """The elements of an optional list: its slot repeats, once for each."""
    lists = parent.values
    sizes = np.append(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64), 0)
    offsets = np.append(np.cumsum(sizes[:-1]) - sizes[:-1], 0)
    flat = lists.flatten()  # of the valid lists, one after the other
    n = sizes[parent.index]
    times = np.maximum(n, 1)
    slot = np.repeat(np.arange(len(times)), times)
    first = np.cumsum(times) - times
    nth = np.arange(len(slot)) - first[slot]
    there = n[slot] > 0
    index = np.where(there, offsets[parent.index][slot] + nth, -1)
    ok = np.append(_valid(flat), False)[index]
    rep = np.where(nth > 0, parent.depth + 1, parent.rep[slot]).astype(np.int8)
    return Levels(rep, (parent.definition[slot] + there + ok).astype(np.int8), np.where(ok, index, -1), flat, parent.depth + 1, parent.defined + 2)


def walk(values: pa.Array, path: str) -> Levels:
    """Levels of a path such as ``forms.items[].inputs[]``."""
    at = root(values)
    for step in path.split("."):
        at = field(at, step.removesuffix("[]"))
        if step.endswith("[]"):
            at = elements(at)
    return at


@dataclass
class Ancestor:
    """A repeated ancestor: lists on the way to it and the definition level of its elements."""

    depth: int
    defined: int


def shred(values: pa.Array) -> tuple[dict[str, Levels], dict[str, Ancestor]]:
    """Levels of every leaf path of a nested column, and its repeated ancestors. A map is a leaf."""
    leaves: dict[str, Levels] = {}
    repeated: dict[str, Ancestor] = {}

    def down(at: Levels, path: str) -> None:
        t = at.values.type
        if pa.types.is_struct(t):
            for f in t:
                down(field(at, f.name), f"{path}.{f.name}" if path else f.name)
        elif pa.types.is_list(t) or pa.types.is_large_list(t):
            inner = elements(at)
            repeated[path + "[]"] = Ancestor(inner.depth, inner.defined)
            down(inner, path + "[]")
        else:
            leaves[path] = at

    down(root(values), "")
    return leaves, repeated


def rebuilt(leaves: dict[str, Levels], ancestor: Ancestor, path: str) -> tuple[dict[str, np.ndarray], dict[str, pa.Array]]:
    """The flat table of a repeated ancestor: record, parent_no, item_no of its rows, and the leaves that belong to them alone."""
    below = {p: at for p, at in leaves.items() if p == path or p.startswith(path + ".")}
    # any leaf below tells where elements begin; deeper lists only add slots that repeat at deeper levels
    at = next(iter(below.values()))
    on = (at.rep <= ancestor.depth) & (at.definition >= ancestor.defined)
    parent = at.position(ancestor.depth - 1)[on] if ancestor.depth > 1 else np.full(int(on.sum()), -1)
    rows = {"record": at.record()[on], "parent_no": parent, "item_no": at.position(ancestor.depth)[on]}
    cells = {}
    for p, leaf in below.items():
        if "[]" in p[len(path) :]:
            continue
        mine = leaf.index[(leaf.rep <= ancestor.depth) & (leaf.definition >= ancestor.defined)]
        cells[p[len(path) :].lstrip(".") or "value"] = leaf.values.take(pa.array(mine, mask=mine < 0))
    return rows, cells


#: Repeated paths of an observation's input, by the name of their table.
OBSERVATION_PATHS = {"redirect": "redirects[]", "form": "forms.items[]", "anchor": "anchors.items[]", "form_input": "forms.items[].inputs[]", "form_button": "forms.items[].buttons[]"}

_CHILDREN = list(OBSERVATION_PATHS)
#: Positions of the child rows of a record: which table, parent's position, own position.
POSITIONS = "array<struct<child:tinyint,parent_no:int,item_no:int>>"


def child_positions(inputs: pa.Array) -> pa.Array:
    """For each record the positions of the rows of all its child tables."""
    leaves, repeated = shred(inputs)
    tables = [rebuilt(leaves, repeated[path], path)[0] for path in OBSERVATION_PATHS.values()]
    of = np.concatenate([t["record"] for t in tables])
    child = np.repeat(np.arange(len(tables)), [len(t["record"]) for t in tables])
    parent, item = (np.concatenate([t[c] for t in tables]) for c in ("parent_no", "item_no"))
    order = np.argsort(of, kind="stable")
    rows = pa.StructArray.from_arrays([pa.array(child[order].astype(np.int8)), pa.array(parent[order].astype(np.int32)), pa.array(item[order].astype(np.int32))], names=["child", "parent_no", "item_no"])
    counts = np.bincount(of, minlength=len(inputs))
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), rows)


def position_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (id, at, input) to (id, at, children)."""
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("at"), child_positions(b.column("input"))], names=["id", "at", "children"])


_TEXT = pa.string()
_MAP = pa.map_(pa.string(), pa.string())
#: The one form into which payloads of all shapes are read.
INPUT_TYPE = pa.struct(
    [
        ("redirects", pa.list_(pa.struct([("status_code", pa.int64()), ("url", _TEXT)]))),
        ("forms", pa.struct([("items", pa.list_(pa.struct([("method", _TEXT), ("action", _TEXT), ("name", _TEXT), ("id", _TEXT), ("text", _TEXT), ("inputs", pa.list_(_MAP)), ("buttons", pa.list_(_TEXT))])))])),
        ("anchors", pa.struct([("items", pa.list_(pa.struct([("text", _TEXT), ("href", _TEXT), ("title", _TEXT), ("aria_label", _TEXT)])))])),
    ]
)


def _as_list(v: object) -> list | None:
    """A container of any shape as its list: wrapped, bare, or a single object."""
    if isinstance(v, dict) and ("items" in v or "total_observed" in v or "totalObserved" in v):
        v = v.get("items")
    return v if isinstance(v, list) or v is None else [v]


def _as_text(v: object) -> str | None:
    return v if isinstance(v, str) or v is None else json.dumps(v, ensure_ascii=False)


def _as_int(v: object) -> int | None:
    try:
        return None if v is None or isinstance(v, bool) else int(v)
    except (TypeError, ValueError):
        return None


def _get(d: dict, name: str) -> object:
    """A key in either of its spellings."""
    head, *rest = name.split("_")
    for k in (name, name.replace("_", "-"), head + "".join(p.title() for p in rest)):
        if k in d:
            return d[k]
    return None


def _record(v: object, kind: str) -> object:
    if v is None:
        return None
    d = v if isinstance(v, dict) else {}
    if kind == "redirect":
        return {"status_code": _as_int(_get(d, "status_code")), "url": _as_text(d.get("url")) if d else _as_text(v)}
    if kind == "anchor":
        return {k: _as_text(_get(d, k)) for k in ("text", "href", "title", "aria_label")}
    inputs, buttons = _as_list(d.get("inputs")), _as_list(d.get("buttons"))
    return {k: _as_text(_get(d, k)) for k in ("method", "action", "name", "id", "text")} | {
        "inputs": inputs and [None if i is None else [(str(k), _as_text(x)) for k, x in i.items()] if isinstance(i, dict) else [("value", _as_text(i))] for i in inputs],
        "buttons": buttons and [_as_text(b) for b in buttons],
    }


def read_payload(text: str | None) -> dict | None:
    """The containers of a payload in their one form; None if the text is no JSON object. Lines may be encoded twice and lack the ``input`` level."""
    try:
        v = json.loads(text) if text is not None else None
        if isinstance(v, str):
            v = json.loads(v)
    except (ValueError, RecursionError):
        return None
    if not isinstance(v, dict):
        return None
    d = v["input"] if isinstance(v.get("input"), dict) else v
    lists = {k: _as_list(d.get(k)) for k in ("redirects", "forms", "anchors")}
    forms, anchors = (lists[k] and [_record(x, k[:-1]) for x in lists[k]] for k in ("forms", "anchors"))
    return {"redirects": lists["redirects"] and [_record(x, "redirect") for x in lists["redirects"]], "forms": {"items": forms}, "anchors": {"items": anchors}}


def payload_inputs(payloads: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Payload texts as an Arrow column of one type, and which of them are readable."""
    read = [read_payload(t) for t in payloads.to_pylist()]
    return pa.array(read, INPUT_TYPE), np.array([r is not None for r in read], bool)


def payload_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (id, at, payload) to (id, at, input) of the readable payloads."""
    for b in batches:
        inputs, ok = payload_inputs(b.column("payload"))
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("at"), inputs], names=["id", "at", "input"]).filter(pa.array(ok))


def payload_position_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: (id, at, payload) to (id, at, children) of the readable payloads."""
    yield from position_batches(payload_batches(batches))


def child_rows(positions):
    """(id, child, parent_no, item_no) from (id, at, children): each id once, in its latest state."""
    from pyspark.sql import functions as F

    last = positions.groupBy("id").agg(F.max_by("children", F.struct("at", F.xxhash64("children"))).alias("children"))
    names = F.array(*[F.lit(c) for c in _CHILDREN])
    rows = last.select("id", F.explode("children").alias("c"))
    return rows.select("id", F.element_at(names, F.col("c.child").cast("int") + 1).alias("child"), "c.parent_no", "c.item_no")


#: Containers of a record as a Spark type, in the one form of ``INPUT_TYPE``.
INPUT_DDL = (
    "struct<redirects:array<struct<status_code:bigint,url:string>>,forms:struct<items:array<struct<method:string,action:string,name:string,id:string,text:string,inputs:array<map<string,string>>,buttons:array<string>>>>,"
    "anchors:struct<items:array<struct<text:string,href:string,title:string,aria_label:string>>>>"
)
#: Value columns of the flat tables.
TABLE_COLUMNS = {
    "redirect": "status_code bigint, url string",
    "form": "method string, action string, name string, form_id string, text string",
    "anchor": "text string, href string, title string, aria_label string",
    "form_input": "attributes map<string,string>",
    "form_button": "label string",
}
_LEAF_OF = {"form_id": "id", "attributes": "value", "label": "value"}


def table_batches(name: str):
    """For mapInArrow: (id, input) to the flat table ``name`` (id, parent_no, item_no, values)."""
    columns = [c.split()[0] for c in TABLE_COLUMNS[name].split(", ")]
    path = OBSERVATION_PATHS[name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaves, repeated = shred(b.column("input"))
            rows, cells = rebuilt(leaves, repeated[path], path)
            of = pa.array(rows["record"].astype(np.int64))
            values = [cells[_LEAF_OF.get(c, c)] for c in columns]
            if name == "redirect":
                values[0] = pc.cast(values[0], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id").take(of), pa.array(rows["parent_no"].astype(np.int32)), pa.array(rows["item_no"].astype(np.int32)), *values], names=["id", "parent_no", "item_no", *columns])

    return run


def flat_table(records, name: str):
    """The flat table ``name`` of records (id, input), each id once."""
    return records.mapInArrow(table_batches(name), f"id string, parent_no int, item_no int, {TABLE_COLUMNS[name]}")
