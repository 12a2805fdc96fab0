"""Constraints of the records, as predicates that hold for sound rows. A null in a column that must not be null breaks its constraint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamstone.config import SETTINGS
from loamstone.schemas import CHUNK_TYPES, PHASES, ROLES, STATUSES


def _length(c: str, low: int, high: int) -> Column:
    return F.length(c).between(low, high)


def _optional(c: str, rule: Column) -> Column:
    return F.col(c).isNull() | rule


CONSTRAINTS: dict[str, dict[str, Callable[[], Column]]] = {
    "repositories": {
        "id": lambda: F.col("id").isNotNull(),
        "name": lambda: _length("name", 1, 255),
        "url": lambda: _optional("url", _length("url", 1, 1024)),
        "status": lambda: F.col("status").isin(*STATUSES),
        "phase": lambda: _optional("ingestion_phase", F.col("ingestion_phase").isin(*PHASES)),
        "counts": lambda: (F.col("file_count") >= 0) & (F.col("chunk_count") >= 0) & (F.col("ingestion_progress") >= 0),
        "times": lambda: F.col("updated_at") >= F.col("created_at"),
    },
    "conversations": {"id": lambda: F.col("id").isNotNull(), "repo": lambda: F.col("repo_id").isNotNull(), "title": lambda: _length("title", 1, SETTINGS.title_chars), "times": lambda: F.col("updated_at") >= F.col("created_at")},
    "messages": {"id": lambda: F.col("id").isNotNull(), "role": lambda: F.col("role").isin(*ROLES), "content": lambda: F.length("content") >= 1, "time": lambda: F.col("created_at").isNotNull()},
    "chunks": {"id": lambda: F.col("chunk_id").rlike("^[0-9a-f]{16}$"), "lines": lambda: (F.col("start_line") >= 1) & (F.col("end_line") >= F.col("start_line")), "type": lambda: F.col("chunk_type").isin(*CHUNK_TYPES), "content": lambda: F.length("content") >= 1},
}


def violations(rows: DataFrame, table: str) -> DataFrame:
    """table, rule, n: how many rows break each constraint. One pass and one aggregate, whatever the number of rules."""
    rules = CONSTRAINTS[table]
    counted = rows.agg(*(F.count_if(~F.coalesce(rule(), F.lit(False))).alias(name) for name, rule in rules.items()))
    pairs = F.array(*(F.struct(F.lit(name).alias("rule"), F.col(name).alias("n")) for name in rules))
    return counted.select(F.lit(table).alias("table"), F.explode(pairs).alias("p")).select("table", "p.rule", "p.n")


def sound(rows: DataFrame, table: str) -> DataFrame:
    """The rows that keep all constraints."""
    for rule in CONSTRAINTS[table].values():
        rows = rows.filter(rule())
    return rows


def dangling(rows: DataFrame, key: str, parents: DataFrame, parent_key: str = "id") -> DataFrame:
    """The rows whose reference leads nowhere; null references lead nowhere and aren't dangling."""
    known = parents.select(F.col(parent_key).alias(key)).distinct()
    return rows.filter(F.col(key).isNotNull()).join(known, key, "left_anti")
