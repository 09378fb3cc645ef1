import json
import random

import pyarrow as pa
import pytest

from pagesieve.operators import shred


def _random_input(rng):
    def maybe(v, p=0.2):
        return None if rng.random() < p else v

    def form():
        return maybe({"method": maybe("get"), "action": maybe("/a"), "name": None, "id": None, "text": maybe("t"), "inputs": maybe([maybe([("type", "text")]) for _ in range(rng.randrange(4))]), "buttons": maybe([maybe("b") for _ in range(rng.randrange(3))])})

    return maybe(
        {
            "redirects": maybe([maybe({"status_code": 301, "url": maybe("u")}) for _ in range(rng.randrange(4))]),
            "forms": maybe({"items": maybe([form() for _ in range(rng.randrange(4))])}),
            "anchors": maybe({"items": maybe([maybe({"text": "x", "href": maybe("#"), "title": None, "aria_label": None}) for _ in range(rng.randrange(5))])}),
        },
        0.1,
    )


def _expected(v):
    out = set()
    v = v or {}
    for i, r in enumerate(v.get("redirects") or []):
        if r is not None:
            out.add(("redirect", -1, i))
    for i, a in enumerate((v.get("anchors") or {}).get("items") or []):
        if a is not None:
            out.add(("anchor", -1, i))
    for i, f in enumerate((v.get("forms") or {}).get("items") or []):
        if f is None:
            continue
        out.add(("form", -1, i))
        out |= {("form_input", i, j) for j, x in enumerate(f["inputs"] or []) if x is not None}
        out |= {("form_button", i, j) for j, x in enumerate(f["buttons"] or []) if x is not None}
    return out


def _row(r):
    return list(shred.OBSERVATION_PATHS)[r["child"]], r["parent_no"], r["item_no"]


@pytest.mark.parametrize("seed", range(6))
def test_levels_give_the_rows_of_a_plain_walk(seed):
    rng = random.Random(seed)
    values = [_random_input(rng) for _ in range(200)]
    arrow = pa.array(values, shred.INPUT_TYPE)
    for a, v in ((arrow, values), (arrow.slice(37, 90), values[37:127])):  # slices have offsets
        got = [{_row(n) for n in r} for r in shred.child_positions(a).to_pylist()]
        assert got == [_expected(x) for x in v]


def test_levels_are_those_of_a_column_store():
    a = pa.array([{"forms": {"items": [{"inputs": [[("a", "1")], None]}, {"inputs": []}, None]}}, {"forms": None}, None], pa.struct([("forms", pa.struct([("items", pa.list_(pa.struct([("inputs", pa.list_(pa.map_(pa.string(), pa.string())))])))]))]))
    levels = shred.walk(a, "forms.items[].inputs[]")
    assert levels.rep.tolist() == [0, 2, 1, 1, 0, 0]
    assert levels.definition.tolist() == [8, 7, 6, 4, 1, 0]
    assert levels.record().tolist() == [0, 0, 0, 0, 1, 2]


def test_values_follow_their_rows():
    a = pa.array([{"redirects": [{"status_code": 301, "url": "a"}, None, {"status_code": None, "url": "b"}], "forms": None, "anchors": None}], shred.INPUT_TYPE)
    batch = pa.RecordBatch.from_arrays([pa.array(["r"]), pa.array([1]), a], names=["id", "at", "input"])
    rows = next(shred.table_batches("redirect")([batch])).to_pylist()
    assert [(r["item_no"], r["status_code"], r["url"]) for r in rows] == [(0, 301, "a"), (2, None, "b")]


@pytest.mark.parametrize(
    "payload, rows",
    [
        ({"input": {"forms": {"total_observed": 9, "items": [{"inputs": [{}], "buttons": ["x", None]}]}}}, {("form", -1, 0), ("form_input", 0, 0), ("form_button", 0, 0)}),
        ({"forms": [None, {}], "anchors": {"text": "one"}}, {("form", -1, 1), ("anchor", -1, 0)}),
        ({"input": {"forms": {"action": "/x", "inputs": {"type": "text"}}, "redirects": [None, {"url": "u"}]}}, {("form", -1, 0), ("form_input", 0, 0), ("redirect", -1, 1)}),
        ({"input": {"forms": None, "anchors": []}}, set()),
    ],
)
def test_payload_shapes(payload, rows):
    for text in (json.dumps(payload), json.dumps(json.dumps(payload))):
        inputs, ok = shred.payload_inputs(pa.array([text, None, "{cut", "3"]))
        assert ok.tolist() == [True, False, False, False]
        assert {_row(n) for n in shred.child_positions(inputs)[0].as_py()} == rows


def test_keys_in_two_spellings():
    v = shred.read_payload('{"anchors": [{"aria-label": "a"}, {"aria_label": "b"}, {"ariaLabel": "c"}]}')
    assert [x["aria_label"] for x in v["anchors"]["items"]] == ["a", "b", "c"]


def test_empty_column():
    assert shred.child_positions(pa.array([], shred.INPUT_TYPE)).to_pylist() == []
    assert shred.child_positions(pa.array([None], shred.INPUT_TYPE)).to_pylist() == [[]]


def test_long_record():
    a = pa.array([{"anchors": {"items": [{"text": "x"}] * 50_000}}], shred.INPUT_TYPE)
    got = shred.child_positions(a)[0].as_py()
    assert len(got) == 50_000 and _row(got[-1]) == ("anchor", -1, 49_999)


def test_latest_state_of_an_id_counts(spark):
    df = spark.createDataFrame([("a", 1, [(0, -1, 1), (0, -1, 2)]), ("a", 2, [(1, -1, 3)]), ("b", 1, [])], f"id string, at int, children {shred.POSITIONS}")
    assert {(r["id"], r["child"], r["item_no"]) for r in shred.child_rows(df).collect()} == {("a", "form", 3)}


def test_every_leaf_has_levels_and_tables_are_rebuilt_from_any():
    rng = random.Random(9)
    values = [_random_input(rng) for _ in range(80)]
    leaves, repeated = shred.shred(pa.array(values, shred.INPUT_TYPE))
    assert set(repeated) == set(shred.OBSERVATION_PATHS.values()) and len(leaves) == 13
    forms = [x for x in leaves if x.startswith("forms.items[].")]
    for leaf in forms:  # those of deeper lists too
        rows, _ = shred.rebuilt({leaf: leaves[leaf]}, repeated["forms.items[]"], "forms.items[]")
        want = [(i, -1, k) for i, v in enumerate(values) for k, f in enumerate(((v or {}).get("forms") or {}).get("items") or []) if f is not None]
        assert list(zip(*(rows[c].tolist() for c in ("record", "parent_no", "item_no")))) == want
    rows, cells = shred.rebuilt(leaves, repeated["anchors.items[]"], "anchors.items[]")
    want = [a["href"] for v in values for a in ((v or {}).get("anchors") or {}).get("items") or [] if a is not None]
    assert cells["href"].to_pylist() == want and set(cells) == {"text", "href", "title", "aria_label"}
