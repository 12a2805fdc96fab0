"""Splitting oversized items at natural boundaries by recursive bisection."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstone.session import strip_clash

LIMIT, OVERLAP = 2048, 200
#: A line that opens a definition, in any of the languages of the chunks.
DEFINITION = re.compile(
    r"[ \t]*(?:@\w|(?:export\s+|default\s+|public\s+|private\s+|protected\s+|static\s+|final\s+|abstract\s+|async\s+|pub(?:\(\w+\))?\s+|unsafe\s+|extern\s+|inline\s+|virtual\s+)*"
    r"(?:def|class|function|func|fn|impl|trait|struct|enum|interface|type|namespace|module|message|service|rpc|CREATE|ALTER|INSERT|UPDATE|DELETE|SELECT|create|alter|package|syntax)\b|(?:public|private|protected|static)\s+[\w<>\[\], ]+\(|\[[\w.\-]+\]\s*$|#{1,6}\s|<(?:section|article|div|table|script|style|h[1-6])\b|[.#@][\w-]+[^{};]*\{)"
)
DEFINITION_STRENGTH, BLANK_STRENGTH, STATEMENT_STRENGTH, LINE_STRENGTH = 4, 3, 2, 1
#: Inside a line: after these, strongest first.
INNER = (re.compile(r"[;}]"), re.compile(r"[,)\]>]"), re.compile(r"\s"), re.compile(r"[^\w\s]"))


def line_bounds(text: str) -> tuple[list[int], list[int]]:
    """Positions after each line break inside text, and how natural a cut there is."""
    starts, strengths = [], []
    indent_at: list[int] = []
    at = text.find("\n")
    while at != -1 and at + 1 < len(text):
        starts.append(at + 1)
        at = text.find("\n", at + 1)
    before = text[: starts[0] - 1] if starts else text
    for k, s in enumerate(starts):
        end = starts[k + 1] - 1 if k + 1 < len(starts) else len(text)
        line = text[s:end]
        bare = line.strip()
        indent = len(line) - len(line.lstrip())
        indent_at.append(indent)
        if not before.strip() and bare:
            strength = BLANK_STRENGTH + (1.5 if DEFINITION.match(line) else 0) - min(indent, 40) / 100
        elif DEFINITION.match(line):
            strength = DEFINITION_STRENGTH - min(indent, 40) / 50
        elif bare and (before.rstrip().endswith((";", "}", ")", "*/", '"""', ".")) or not before.rstrip().endswith((",", "(", "[", "{", "\\", "=", "+", "&&", "||", "|", ":"))):
            strength = STATEMENT_STRENGTH - min(indent, 40) / 50
        else:
            strength = LINE_STRENGTH
        strengths.append(strength)
        before = line
    return starts, strengths


def inner_cut(text: str, lo: int, hi: int) -> int:
    """A place inside a line, near its middle: after a separator if there is one, never inside a character with its marks."""
    mid, reach = (lo + hi) // 2, max(1, (hi - lo) // 4)
    for pattern in INNER:
        best = None
        for m in pattern.finditer(text, max(lo + 1, mid - reach) - 1, min(hi - 1, mid + reach)):
            if lo < m.end() < hi and (best is None or abs(m.end() - mid) < abs(best - mid)):
                best = m.end()
        if best is not None:
            return best
    cut = mid
    while cut > lo + 1 and (unicodedata.combining(text[cut]) or text[cut] in "‍︎️" or text[cut - 1] == "‍"):
        cut -= 1
    return cut if cut > lo + 1 else mid


def cores(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[tuple[int, int]], bool]:
    """The pieces before overlaps are attached, which together are the text, and whether a line had to be cut.

    A range longer than limit - overlap is halved at the strongest line boundary in its middle half, or the nearest one outside;
    a range of one line that fits into limit stays whole, and one that doesn't is halved inside.
    """
    starts, strengths = line_bounds(text)
    done, cut_line = [], False
    todo = [(0, len(text))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= limit - overlap:
            done.append((lo, hi))
            continue
        first, last = bisect_right(starts, lo), bisect_left(starts, hi)
        if first < last:
            mid, reach = (lo + hi) / 2, (hi - lo) / 4
            a, b = bisect_left(starts, mid - reach, first, last), bisect_right(starts, mid + reach, first, last)
            if a < b:
                k = max(range(a, b), key=lambda i: (strengths[i] - abs(starts[i] - mid) / reach, -starts[i]))
            else:
                k = min((i for i in (a - 1, a) if first <= i < last), key=lambda i: abs(starts[i] - mid))
            cut = starts[k]
        elif hi - lo <= limit:
            done.append((lo, hi))
            continue
        elif hi - lo == limit + 1 and text[hi - 1] == "\n":
            cut = hi - 1  # the line fits without its break, which then opens the next piece
        else:
            cut, cut_line = inner_cut(text, lo, hi), True
        todo.append((cut, hi))
        todo.append((lo, cut))
    return done, cut_line


def merged(text: str, parts: list[tuple[int, int]], limit: int, overlap: int) -> list[tuple[int, int]]:
    """Joins a break that was left alone with the piece after it, where that fits."""
    out: list[tuple[int, int]] = []
    for lo, hi in parts:
        if out and text[out[-1][0] : out[-1][1]] == "\n" and hi - out[-1][0] <= limit:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[tuple[int, int, int]], bool]:
    """(start, own start, end) of each piece, start being where the repeated end of the piece before begins; and whether a line had to be cut.

    Repeated are whole lines as far as they fit into overlap and limit, or, where not even one does, the last characters.
    """
    parts, cut_line = cores(text, limit, overlap)
    parts = merged(text, parts, limit, overlap)
    out = []
    for k, (lo, hi) in enumerate(parts):
        start = lo
        room = min(overlap, limit - (hi - lo))
        if k and room > 0:
            floor = max(lo - room, out[-1][0])
            line = text.find("\n", max(floor - 1, 0), lo - 1)
            if floor == 0 or text[floor - 1] == "\n":
                start = floor
            elif line != -1:
                start = line + 1
            elif text[lo - 1] != "\n" or lo - 1 - text.rfind("\n", 0, lo - 1) > room:
                start = floor
        out.append((start, lo, hi))
    return out, cut_line


PIECES = "chunk_id string, piece int, content string, start_line int, end_line int, overlap int, cut string"
_ARROW = pa.schema([("chunk_id", pa.string()), ("piece", pa.int32()), ("content", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("overlap", pa.int32()), ("cut", pa.string())])


def _split(limit: int, overlap: int):
    def split_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for cid, text, line in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts, cut_line = pieces(text, limit, overlap)
                at, seen = 0, 0
                for k, (start, own, end) in enumerate(parts):
                    seen += text.count("\n", at, own)
                    at = own
                    first = seen - text.count("\n", start, own)
                    last = seen + text.count("\n", own, end - 1)
                    rows.append((cid, k, text[start:end], None if line is None else line + first, None if line is None else line + last, own - start, "inner" if cut_line else "line"))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

    return split_batches


def split_oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of the chunks longer than limit characters: chunk_id, piece (from 0), content, start_line, end_line, overlap (characters repeated), cut (inner if a line of the chunk was cut, else line).

    Repeated rows count once. Null and short contents give no pieces; a null start_line gives null lines. Without its overlaps,
    the pieces of a chunk joined are its content. Only long chunks leave the JVM, and only they are shuffled, by their text's hash,
    so that equal rows meet; no group is gathered.
    """
    rows = strip_clash(chunks, {"chunk_id": "chunk_id", "content": "content", "start_line": "start_line"})
    return rows.filter(F.length("content") > limit).dropDuplicates().mapInArrow(_split(limit, overlap), PIECES)
