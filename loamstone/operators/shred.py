"""Adjacency-table shredding of nested JSON records.

A record becomes rows of one node table (record, node, parent, label, ordinal, kind, scalar): the relational form of the tree.
Object nodes joined with their scalar children and pivoted give one flat table per kind of object, each row with a link to its
parent object and its record.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstone.session import strip_clash

#: Marks of the stored path: before a field name, and after the name of a field that holds a single object.
FIELD, SINGLE = "", ""
#: Field names that hold arrays of objects are matched by one regular expression up to this number; beyond it they are joined.
MAX_PATTERN_NAMES = 5_000

NODE_SCHEMA = "record_id string, node int, parent int, label string, ordinal int, kind string, scalar string, in_array boolean, marked_path string, entity string, parent_object int, position array<int>"
NODE_ARROW = pa.schema(
    [("record_id", pa.string()), ("node", pa.int32()), ("parent", pa.int32()), ("label", pa.string()), ("ordinal", pa.int32()), ("kind", pa.string()), ("scalar", pa.string()), ("in_array", pa.bool_()), ("marked_path", pa.string()), ("entity", pa.string()), ("parent_object", pa.int32()), ("position", pa.list_(pa.int32()))]
)
ROWS_PER_BATCH = 20_000


def _refuse(name: str) -> None:
    raise ValueError(name)


def _clean(text: str) -> str:
    return text.encode("utf-8", "replace").decode("utf-8").replace(FIELD, "?").replace(SINGLE, "?")


def parse(text: str | None):
    """(True, value) of complete valid JSON, else (False, None). A JSON string that holds JSON is read as that JSON, as often as it is wrapped."""
    try:
        value = json.loads(text, parse_constant=_refuse)
        while isinstance(value, str):
            value = json.loads(value, parse_constant=_refuse)
    except (ValueError, TypeError, RecursionError):
        return False, None
    return True, value


def nodes_of(value) -> Iterator[tuple]:
    """(node, parent, label, ordinal, kind, scalar, in_array, marked_path, entity, parent_object, position) of every node, numbered in pre-order.

    parent_object is the nearest object above, through any arrays between; position has the places in these arrays. No recursion:
    depth is bounded by memory only.
    """
    stack = [(value, None, None, 0, False, "$", "$", None, ())]
    number = 0
    while stack:
        x, parent, label, ordinal, in_array, path, entity, above, position = stack.pop()
        node, number = number, number + 1
        if isinstance(x, dict):
            yield node, parent, label, ordinal, "object", None, in_array, path, entity, above, position
            for i, (k, v) in reversed(list(enumerate(x.items()))):
                name = _clean(k)
                here = path + FIELD + name
                stack.append((v, node, name, i, False, here + SINGLE if isinstance(v, dict) else here, f"{entity}.{name}", node, ()))
        elif isinstance(x, list):
            yield node, parent, label, ordinal, "array", None, in_array, path, entity, above, position
            for i, v in reversed(list(enumerate(x))):
                stack.append((v, node, label, i, True, f"{path}[{i}]", entity, above, (*position, i)))
        else:
            kind = "null" if x is None else "boolean" if isinstance(x, bool) else "string" if isinstance(x, str) else "number"
            scalar = None if x is None else x.encode("utf-8", "replace").decode() if isinstance(x, str) else json.dumps(x)
            yield node, parent, label, ordinal, kind, scalar, in_array, path, entity, above, position


def _shredder(only_objects: bool):
    def shred_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ok, value = parse(text)
                if not ok or only_objects and not isinstance(value, (dict, list)):
                    continue
                for n in nodes_of(value):
                    if not only_objects or n[4] == "object":
                        rows.append((rid, *n))
                if len(rows) >= ROWS_PER_BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), NODE_ARROW, strict=True)], schema=NODE_ARROW)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), NODE_ARROW, strict=True)], schema=NODE_ARROW)

    return shred_batches


def shred(df: DataFrame, record_id: str = "id", json_col: str = "metadata_json", only_objects: bool = False) -> DataFrame:
    """The node table of every record of df.

    Repeated rows count once. Null, blank, incomplete or otherwise invalid JSON gives no rows; a null record_id is kept as null.
    An empty table gives an empty table. Equal field names inside one object: the last one holds. Other columns of df are ignored.
    One narrow pass after one exchange that removes repeated rows; no group is ever gathered.
    """
    rows = strip_clash(df, {"record_id": record_id, "json_text": json_col}).filter(F.length("json_text") > 0).distinct()
    return rows.mapInArrow(_shredder(only_objects), NODE_SCHEMA)


def array_fields(nodes: DataFrame) -> DataFrame:
    """Distinct names of fields that hold an array with an object in it, in any record: one partial aggregate per task, then few rows."""
    return nodes.filter((F.col("kind") == "object") & F.col("in_array") & F.col("label").isNotNull()).select("label").distinct()


def _plain(path: Column) -> Column:
    return F.translate(path, FIELD + SINGLE, ".")


def _quoted(name: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else f"\\x{{{ord(c):x}}}" for c in name)


def object_paths(nodes: DataFrame, max_pattern_names: int = MAX_PATTERN_NAMES) -> DataFrame:
    """(record_id, node, object_path) of each object that is an element of an array, at any depth.

    An object alone under a field name that elsewhere holds an array of objects counts as that array's element 0, and paths below
    it go through [0]. The names are a property of the schema, so they're few; they're fetched up to max_pattern_names, and when
    there are more, the paths' fields are joined with them instead, which needs no bound.
    """
    objects = nodes.filter(F.col("kind") == "object").select("record_id", "node", "in_array", "label", "marked_path")
    names = array_fields(nodes)
    known = [r.label for r in names.limit(max_pattern_names + 1).collect()]
    if len(known) <= max_pattern_names:
        if not known:
            return objects.filter("in_array").select("record_id", "node", _plain(F.col("marked_path")).alias("object_path"))
        pattern = f"{FIELD}({'|'.join(sorted(map(_quoted, known)))}){SINGLE}"
        element = F.col("in_array") | F.col("marked_path").rlike(pattern + "$")
        return objects.filter(element).select("record_id", "node", _plain(F.regexp_replace("marked_path", pattern, FIELD + "$1[0]")).alias("object_path"))
    piece = objects.select("record_id", "node", "in_array", F.posexplode(F.split("marked_path", SINGLE, -1)).alias("at", "piece"), F.size(F.split("marked_path", SINGLE, -1)).alias("pieces"))
    piece = piece.withColumn("label", F.when(F.col("at") < F.col("pieces") - 1, F.regexp_extract("piece", f"{FIELD}([^{FIELD}]*)$", 1)))
    piece = piece.join(names.withColumn("is_array", F.lit(True)), "label", "left")
    piece = piece.withColumn("text", F.when(F.col("is_array"), F.concat("piece", F.lit("[0]"))).otherwise(F.col("piece")))
    key = F.coalesce("record_id", F.lit("")), F.col("record_id").isNull()
    whole = piece.groupBy(key[0].alias("k"), key[1].alias("no_id"), "node").agg(
        F.first("record_id").alias("record_id"),
        F.first("in_array").alias("in_array"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda s: s["text"]), "").alias("path"),
    )
    whole = whole.filter(F.col("in_array") | F.col("path").endswith("[0]"))
    return whole.select("record_id", "node", _plain(F.col("path")).alias("object_path"))


def entity_kinds(nodes: DataFrame, limit: int = 10_000) -> list[str]:
    """The kinds of nested objects (their paths without positions), as a schema listing; more than limit kinds is an error, since keys are then data."""
    kinds = [r.entity for r in nodes.filter(F.col("kind") == "object").select("entity").distinct().limit(limit + 1).collect()]
    if len(kinds) > limit:
        raise ValueError(f"more than {limit} kinds of objects: field names seem to be data")
    return sorted(kinds)


_SCALARS = ("string", "number", "boolean")


def _is(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def entity_rows(nodes: DataFrame) -> DataFrame:
    """kind, record_id, node, parent_node, position, fields of every object of every kind: the flat tables of all kinds as one, with the scalar fields as a map.

    parent_node is the nearest object above, through any arrays; position has the places in the arrays between. Object nodes meet
    their scalar children on (record_id, parent), so no group is larger than an object.
    """
    objects = nodes.filter(F.col("kind") == "object").select(F.col("entity").alias("kind"), "record_id", "node", F.col("parent_object").alias("parent_node"), "position")
    scalars = nodes.filter(F.col("kind").isin(*_SCALARS) & ~F.col("in_array")).select(F.col("record_id").alias("s_record"), F.col("parent").alias("s_node"), F.struct("label", "scalar").alias("field"))
    fields = scalars.groupBy("s_record", "s_node").agg(F.map_from_entries(F.array_sort(F.collect_list("field"))).alias("fields"))
    joined = objects.join(fields, _is("record_id", "s_record") & (F.col("node") == F.col("s_node")), "left")
    return joined.select("kind", "record_id", "node", "parent_node", "position", F.coalesce("fields", F.create_map().cast("map<string,string>")).alias("fields"))


def value_rows(nodes: DataFrame) -> DataFrame:
    """kind, record_id, parent_node, position, value of every scalar that is an element of an array: the child tables of multi-valued fields, kind being the path of the field. One narrow pass."""
    scalars = nodes.filter(F.col("kind").isin(*_SCALARS) & F.col("in_array"))
    return scalars.select(F.col("entity").alias("kind"), "record_id", F.col("parent_object").alias("parent_node"), "position", F.col("scalar").alias("value"))


def entity_table(nodes: DataFrame, entity: str, max_columns: int = 1_000) -> DataFrame:
    """The flat table of one kind of object: record_id, node, parent_node (the nearest object above), ordinal and a string column for each scalar field, prefixed f_.

    A child that is absent or null gives null. Objects without scalar fields keep their row; scalars that are elements of arrays are
    in value_rows. ordinal is the place in the innermost array, 0 for an object in none.
    """
    rows = entity_rows(nodes.filter(F.col("entity").isin(entity) | F.col("entity").startswith(entity + "."))).filter(F.col("kind") == entity)
    found = nodes.filter(F.col("kind").isin(*_SCALARS) & ~F.col("in_array") & (F.col("entity") == F.concat(F.lit(entity + "."), F.col("label"))))
    columns = [r.label for r in found.select("label").distinct().limit(max_columns + 1).collect()]
    if len(columns) > max_columns:
        raise ValueError(f"more than {max_columns} fields in {entity}: field names seem to be data")
    ordinal = F.element_at("position", -1)
    return rows.select("record_id", "node", "parent_node", F.when(F.size("position") > 0, ordinal).otherwise(0).alias("ordinal"), *(F.col("fields")[c].alias(f"f_{c}") for c in sorted(columns)))
