"""Queries on deeply nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagesieve.operators import shred
from pagesieve.runtime import latest, table

_AT = "struct<first:timestamp_ntz,second:timestamp_ntz,line:bigint>"


def _at(first: str, second: str, line: Column) -> Column:
    return F.struct(F.col(first).alias("first"), F.col(second).alias("second"), line.alias("line")).cast(_AT)


def _containers() -> Column:
    """The nested containers of an observation."""
    return F.struct(*[F.col(f"input.{c}").alias(c) for c in ("redirects", "forms", "anchors")])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of all child rows. Records are shredded where they lie; only positions are shuffled."""
    seen = table(spark, sf_dir, "observations").select("id", _at("captured_at", "ingested_at", F.lit(0)).alias("at"), F.when(F.col("input").isNotNull(), _containers()).alias("input"))
    own = seen.mapInArrow(shred.position_batches, f"id string, at {_AT}, children {shred.POSITIONS}")
    raw = table(spark, sf_dir, "raw_records").select("id", _at("received_at", "received_at", F.col("line_no")).alias("at"), "payload")
    payloads = raw.mapInArrow(shred.payload_position_batches, f"id string, at {_AT}, children {shred.POSITIONS}")
    return shred.child_rows(own).unionByName(shred.child_rows(payloads))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The flat table ``name`` of observations and readable payloads, each id in its latest state."""
    only = shred.OBSERVATION_PATHS[name].split(".")[0].removesuffix("[]")
    at = {"c": F.col("c")}
    seen = table(spark, sf_dir, "observations").select("id", "captured_at", "ingested_at", F.col(f"input.{only}").alias("c"))
    raw = table(spark, sf_dir, "raw_records").select("id", _at("received_at", "received_at", F.col("line_no")).alias("at"), "payload").mapInArrow(shred.payload_batches, f"id string, at {_AT}, input {shred.INPUT_DDL}")
    raw = raw.select("id", "at", F.col(f"input.{only}").alias("c"))
    own, payloads = latest(seen, "id", ["captured_at", "ingested_at"], at), latest(raw, "id", ["at"], at)
    both = [shred.flat_table(r.select("id", F.struct(F.col("c").alias(only)).alias("input")), name) for r in (own, payloads)]
    return both[0].unionByName(both[1])


def _flat(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = _table(spark, sf_dir, name)
        # as text, in which a missing status stays missing
        return t.withColumn("status_code", F.col("status_code").cast("string")) if name == "redirect" else t

    return query


def p7_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of form inputs as text, for a map has no equality in SQL."""
    t = _table(spark, sf_dir, "form_input")
    return t.select("id", "parent_no", "item_no", F.try_element_at("attributes", F.lit("type")).alias("type"), F.try_element_at("attributes", F.lit("name")).alias("name"), F.size("attributes").alias("attributes"))


def _entries(container: str, source: str, items: bool = True) -> str:
    """The entries of a container of any shape with their positions from 0; nulls keep theirs and are no rows."""
    inner = f"CASE json_type({container}->'items') WHEN 'ARRAY' THEN {container}->'items' WHEN 'NULL' THEN NULL ELSE CASE WHEN json_exists({container}, '$.items') THEN json_array({container}->'items') END END"
    single = f"CASE WHEN json_exists({container}, '$.items') OR json_exists({container}, '$.total_observed') OR json_exists({container}, '$.totalObserved') THEN {inner} ELSE json_array({container}) END" if items else f"json_array({container})"
    entries = f"CAST(CASE json_type({container}) WHEN 'ARRAY' THEN {container} WHEN 'OBJECT' THEN {single} WHEN 'NULL' THEN NULL ELSE CASE WHEN {container} IS NOT NULL THEN json_array({container}) END END AS JSON[])"
    return f"SELECT id, parent_no, x, item_no FROM (SELECT id, {{parent}} AS parent_no, unnest({entries}) AS x, generate_subscripts({entries}, 1) - 1 AS item_no FROM {source}) WHERE x IS NOT NULL AND json_type(x) <> 'NULL'"


def _own_entries(path: str, source: str, parent: str) -> str:
    return f"SELECT id, parent_no, x, item_no FROM (SELECT id, {parent} AS parent_no, unnest({path}) AS x, generate_subscripts({path}, 1) - 1 AS item_no FROM {source}) WHERE x IS NOT NULL"


def _key(name: str) -> str:
    """A key of a payload's record in any of its spellings."""
    head, *rest = name.split("_")
    return "coalesce(" + ", ".join(f"x->>'{k}'" for k in dict.fromkeys((name, name.replace("_", "-"), head + "".join(p.title() for p in rest)))) + ")" if rest else f"x->>'{name}'"


_TEXT_OF = "CASE WHEN json_valid(payload) THEN CASE WHEN json_type(payload) = 'VARCHAR' THEN json_extract_string(payload, '$') ELSE payload END END"
_STATES = f"""WITH o AS (SELECT id, input FROM observations QUALIFY row_number() OVER (PARTITION BY id ORDER BY captured_at DESC, ingested_at DESC) = 1),
  lines AS (SELECT id, received_at, line_no, {_TEXT_OF} AS t FROM raw_records),
  readable AS (SELECT id, CAST(CASE WHEN json_valid(t) THEN t END AS JSON) AS j FROM lines WHERE CASE WHEN json_valid(t) THEN json_type(t) = 'OBJECT' ELSE false END QUALIFY row_number() OVER (PARTITION BY id ORDER BY received_at DESC, line_no DESC) = 1),
  d AS (SELECT id, CASE WHEN json_type(j->'input') = 'OBJECT' THEN j->'input' ELSE j END AS d FROM readable),
  redirect_o AS ({_own_entries("input.redirects", "o", "-1")}), redirect_d AS ({_entries("(d->'redirects')", "d").format(parent="-1")}),
  anchor_o AS ({_own_entries("input.anchors.items", "o", "-1")}), anchor_d AS ({_entries("(d->'anchors')", "d").format(parent="-1")}),
  form_o AS ({_own_entries("input.forms.items", "o", "-1")}), form_d AS ({_entries("(d->'forms')", "d").format(parent="-1")}),
  form_input_o AS ({_own_entries("x.inputs", "form_o", "item_no")}), form_input_d AS ({_entries("(x->'inputs')", "form_d").format(parent="item_no")}),
  form_button_o AS ({_own_entries("x.buttons", "form_o", "item_no")}), form_button_d AS ({_entries("(x->'buttons')", "form_d").format(parent="item_no")})
"""


def _sql(name: str, own: str, payload: str) -> str:
    return f"{_STATES} SELECT id, parent_no, item_no, {own} FROM {name}_o UNION ALL SELECT id, parent_no, item_no, {payload} FROM {name}_d"


def _columns(names: list[str], of) -> str:
    return ", ".join(f"{of('id' if n == 'form_id' else n)} AS {n}" for n in names)


_FORM, _ANCHOR = ["method", "action", "name", "form_id", "text"], ["text", "href", "title", "aria_label"]
SQL = {
    "p7_found": _STATES + " UNION ALL ".join(f"SELECT id, '{c}' AS child, parent_no, item_no FROM {c}_{s}" for c in shred.OBSERVATION_PATHS for s in "od"),
    "p7_redirects": _sql("redirect", "CAST(x.status_code AS VARCHAR) AS status_code, x.url AS url", f"CAST(TRY_CAST({_key('status_code')} AS BIGINT) AS VARCHAR) AS status_code, x->>'url' AS url"),
    "p7_forms": _sql("form", _columns(_FORM, lambda n: f"x.{n}"), _columns(_FORM, _key)),
    "p7_anchors": _sql("anchor", _columns(_ANCHOR, lambda n: f"x.{n}"), _columns(_ANCHOR, _key)),
    "p7_inputs": _sql("form_input", "x['type'] AS type, x['name'] AS name, cardinality(x) AS attributes", "x->>'type' AS type, x->>'name' AS name, len(json_keys(x)) AS attributes"),
    "p7_buttons": _sql("form_button", "x AS label", "x->>'$' AS label"),
}
QUERIES = {"p7_found": p7_found, "p7_redirects": _flat("redirect"), "p7_forms": _flat("form"), "p7_anchors": _flat("anchor"), "p7_inputs": p7_inputs, "p7_buttons": _flat("form_button")}
