"""Pieces of DuckDB SQL that several oracles share."""

from __future__ import annotations

_SPACE = r"[\s\v\x1c-\x1f\p{Z}\x{85}]"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def case(x: str, table: dict[str, str], default: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE '{default}' END"


def strings(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def slashes(x: str) -> str:
    return rf"replace({x}, '\', '/')"


def file_name(x: str) -> str:
    return f"list_last(string_split({slashes(x)}, '/'))"


def extension(x: str) -> str:
    return rf"lower(regexp_extract({file_name(x)}, '[^.](\.[^.]+)$', 1))"


def indent(x: str) -> str:
    return rf"length(replace(regexp_extract({x}, '^[ \t]*'), chr(9), '    '))"


def line_count(x: str) -> str:
    return f"(length({x}) - length(replace({x}, chr(10), '')) + 1)"


def vectors(texts: str, keys: str, dimensions: int) -> str:
    """The sparse vectors of a hashing embedder: keys, i, x (float) of a query with keys and t, one row for each coordinate that isn't zero."""
    return rf"""SELECT {keys}, i, CAST(x / sqrt(sum(x * x) OVER (PARTITION BY {keys})) AS FLOAT) AS x FROM (
        SELECT {keys}, CAST('0x' || substr(h, 1, 8) AS UBIGINT) % {dimensions} AS i, CAST(sum(CASE WHEN substr(h, 9, 1) >= '8' THEN 1 ELSE -1 END) AS DOUBLE) AS x
        FROM (SELECT {keys}, md5(w) AS h FROM (SELECT {keys}, unnest(regexp_split_to_array(lower(t), '{_SPACE}+')) AS w FROM ({texts})) WHERE w <> '') GROUP BY ALL) WHERE x <> 0"""
