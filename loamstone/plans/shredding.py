"""Queries of problem 5: nested message metadata as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamstone.operators.shred import entity_rows, entity_table, object_paths, shred, value_rows
from loamstone.session import materialize, table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object that is an element of an array, with its path."""
    # written down, since the names of fields that hold arrays are looked up first
    nodes = materialize(shred(table(spark, sf_dir, "messages"), only_objects=True).select("record_id", "node", "kind", "in_array", "label", "marked_path"))
    return object_paths(nodes).select(F.col("record_id").alias("message_id"), "object_path")


def p5_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of the objects under $.sources, one row per object."""
    flat = entity_table(shred(table(spark, sf_dir, "messages")), "$.sources")
    return flat.select(F.col("record_id").alias("message_id"), "node", "parent_node", "ordinal", *(c for c in flat.columns if c.startswith("f_")))


def _position(column: str):
    return F.array_join(F.col(column).cast("array<string>"), ".").alias("position")


def p5_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat tables of all kinds of objects as rows, parsed once; fields as lines name=value."""
    rows = entity_rows(materialize(shred(table(spark, sf_dir, "messages")).drop("marked_path")))
    fields = F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return rows.select("kind", F.col("record_id").alias("message_id"), "node", "parent_node", _position("position"), F.array_join(fields, "\n").alias("fields"))


def p5_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The child tables of all fields with several values."""
    rows = value_rows(shred(table(spark, sf_dir, "messages")))
    return rows.select("kind", F.col("record_id").alias("message_id"), "parent_node", _position("position"), "value")


_SQL_NODES = r"""
WITH RECURSIVE m AS (SELECT DISTINCT id, metadata_json AS j FROM messages WHERE length(metadata_json) > 0),
v AS (SELECT id, CASE WHEN json_type(j) = 'VARCHAR' THEN json_extract_string(j, '$') ELSE j END AS j FROM m WHERE json_valid(j)),
w AS (SELECT id, j::JSON AS j FROM v WHERE json_valid(j)),
raw AS (SELECT w.id AS message_id, t.id AS n, t.parent AS p, t.type AS kind, t.key AS k, t.atom AS atom, t.value AS val, t.fullkey AS fullkey
    FROM w, json_tree(w.j) t WHERE json_type(w.j) IN ('OBJECT', 'ARRAY')),
numbered AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY n) - 1 AS node FROM raw),
nodes AS (SELECT c.*, u.node AS up, u.kind AS up_kind, coalesce(u.kind = 'ARRAY', false) AS in_array FROM numbered c LEFT JOIN numbered u ON u.message_id = c.message_id AND u.n = c.p),
names AS (SELECT DISTINCT regexp_extract(u.fullkey, '\.([^.\[\]]+)(\[\d+\])*$', 1) AS name FROM numbered u WHERE u.kind = 'OBJECT' AND u.fullkey LIKE '%]'),
down AS (
    SELECT message_id, node, kind, atom, val, in_array, k, '$' AS entity, '$' AS path, CAST(NULL AS BIGINT) AS above, '' AS position, CAST(NULL AS VARCHAR) AS label FROM nodes WHERE up IS NULL
    UNION ALL
    SELECT c.message_id, c.node, c.kind, c.atom, c.val, c.in_array, c.k,
        CASE WHEN c.in_array THEN d.entity ELSE d.entity || '.' || c.k END,
        CASE WHEN c.in_array THEN d.path || '[' || c.k || ']'
             WHEN c.kind = 'OBJECT' AND c.k IN (SELECT name FROM names) THEN d.path || '.' || c.k || '[0]' ELSE d.path || '.' || c.k END,
        CASE WHEN d.kind = 'OBJECT' THEN d.node ELSE d.above END,
        CASE WHEN c.in_array THEN d.position || CASE WHEN d.position = '' THEN '' ELSE '.' END || c.k ELSE '' END,
        CASE WHEN c.in_array THEN d.label ELSE c.k END
    FROM nodes c JOIN down d ON d.message_id = c.message_id AND d.node = c.up)"""
_SCALAR = "CASE WHEN kind = 'VARCHAR' THEN json_extract_string(atom, '$') ELSE CAST(atom AS VARCHAR) END"

QUERIES = {"p5_found": p5_found, "p5_sources": p5_sources, "p5_tables": p5_tables, "p5_values": p5_values}
_SOURCE_FIELDS = ("chunk_type", "end_line", "file_path", "name", "relevance_score", "start_line")
ORACLE = {
    "p5_sources": _SQL_NODES
    + f""", s AS (SELECT message_id, above, k, {_SCALAR} AS value FROM down WHERE NOT in_array AND kind NOT IN ('OBJECT', 'ARRAY', 'NULL'))
    SELECT d.message_id, d.node, any_value(d.above) AS parent_node, any_value(CASE WHEN d.position = '' THEN 0 ELSE CAST(list_last(string_split(d.position, '.')) AS INT) END) AS ordinal,
        {", ".join(f"max(value) FILTER (WHERE s.k = '{f}') AS f_{f}" for f in _SOURCE_FIELDS)}
    FROM down d LEFT JOIN s ON s.message_id = d.message_id AND s.above = d.node WHERE d.kind = 'OBJECT' AND d.entity = '$.sources' GROUP BY 1, 2""",
    "p5_found": _SQL_NODES + " SELECT message_id, path AS object_path FROM down WHERE kind = 'OBJECT' AND path LIKE '%]'",
    "p5_values": _SQL_NODES + f" SELECT entity AS kind, message_id, above AS parent_node, position, {_SCALAR} AS value FROM down WHERE in_array AND kind NOT IN ('OBJECT', 'ARRAY', 'NULL')",
    "p5_tables": _SQL_NODES
    + f""", s AS (SELECT message_id, above, string_agg(k || '=' || {_SCALAR}, chr(10) ORDER BY k) AS fields FROM down WHERE NOT in_array AND kind NOT IN ('OBJECT', 'ARRAY', 'NULL') GROUP BY 1, 2)
    SELECT d.entity AS kind, d.message_id, d.node, d.above AS parent_node, d.position, coalesce(s.fields, '') AS fields
    FROM down d LEFT JOIN s ON s.message_id = d.message_id AND s.above = d.node WHERE d.kind = 'OBJECT'""",
}
