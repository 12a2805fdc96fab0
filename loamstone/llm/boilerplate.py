"""Text that pages of one host share, by suffix arrays: what the pages' markup left over, and what isn't theirs.

The token streams of a host's pages stand in one array. Its suffixes are ordered by doubling as far as the least length asked for;
equal ones of different pages are repeats, and what repeats cover is boilerplate. What is left are the runs unique to their page.
A host too large for one array is several, which tell each other the fingerprints of their suffixes; the repeats are the same.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstone.session import strip_clash

TOKEN = re.compile(r"\w+|[^\w\s]")
#: Tokens that a repeat has at least, a power of two.
LEAST = 16
#: Characters of the pages whose suffixes are ordered at once; a larger host is several parts, by its pages. Results don't depend on it.
PART_CHARS = 20_000_000
#: Rows of fingerprints that go to Spark at once.
PRINT_ROWS = 65_536


def suffix_classes(stream: np.ndarray, least: int = LEAST) -> np.ndarray:
    """For each suffix of stream the rank of its first `least` symbols, equal for equal ones: prefix doubling, stopped there. Suffixes that are shorter rank by what they have."""
    _, rank = np.unique(stream, return_inverse=True)
    k = 1
    while k < least:
        ahead = np.zeros_like(rank)
        ahead[:-k or None] = rank[k:] + 1 if k < len(rank) else 0
        _, rank = np.unique(rank * (rank.max() + 2) + ahead, return_inverse=True)
        k *= 2
    return rank


def suffix_prints(stream: np.ndarray, words: Iterable[str], least: int = LEAST) -> np.ndarray:
    """For each suffix of stream, which numbers words, two numbers of 64 bits that tell its first `least` words anywhere: those of words, doubled as ranks are. Suffixes that are shorter go by what they have."""
    digests = b"".join(hashlib.blake2b(w.encode(), digest_size=16).digest() for w in words)
    prints = np.frombuffer(digests, dtype="<u8").reshape(-1, 2)[stream]
    k = 1
    while k < least:
        ahead = np.zeros_like(prints)
        ahead[:-k] = prints[k:]
        prints = (prints ^ (prints >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + ahead
        prints = (prints ^ (prints >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        k *= 2
    return prints.view(np.int64)


def _stream(pages: list[list[str]], least: int) -> tuple[np.ndarray, dict[str, int], np.ndarray, np.ndarray, np.ndarray]:
    """The words of all pages as numbers, the number of each, where pages begin and end, whose each word is, and where `least` words of one page begin."""
    number: dict[str, int] = {}
    stream = np.array([number.setdefault(w, len(number)) for page in pages for w in page], dtype=np.int64)
    sizes = np.array([len(p) for p in pages], dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(pages)), sizes)
    return stream, number, bounds, owner, np.flatnonzero(np.arange(len(stream)) + least <= bounds[owner + 1])


def run_prints(pages: list[list[str]], least: int = LEAST) -> np.ndarray:
    """The fingerprint of each different run of `least` words of a page, in order."""
    stream, number, _, _, whole = _stream(pages, least)
    prints = _ordered(suffix_prints(stream, number, least)[whole])
    return prints[np.concatenate([[True], (prints[1:] != prints[:-1]).any(axis=1)])[: len(prints)]]


def _ordered(prints: np.ndarray) -> np.ndarray:
    return prints[np.lexsort((prints[:, 1], prints[:, 0]))]


def _among(prints: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of prints are rows of known."""
    known = _ordered(known)
    low, high = (np.searchsorted(known[:, 0], prints[:, 0], side) for side in ("left", "right"))
    found = np.zeros(len(prints), dtype=bool)
    for i in range(int((high - low).max(initial=0))):
        at = np.minimum(low + i, len(known) - 1)
        found |= (low + i < high) & (known[at, 1] == prints[:, 1])
    return found


def repeated(pages: list[list[str]], least: int = LEAST, elsewhere: np.ndarray | None = None) -> list[np.ndarray]:
    """For each page which of its tokens lie in a run of `least` or more that another page has too. elsewhere: fingerprints (run_prints) of runs that pages besides these have."""
    stream, number, bounds, owner, whole = _stream(pages, least)
    covered = np.zeros(bounds[-1] + 1, dtype=np.int64)
    if len(whole):
        rank = suffix_classes(stream, least)
        order = whole[np.argsort(rank[whole], kind="stable")]
        first = np.flatnonzero(np.concatenate([[True], rank[order][1:] != rank[order][:-1]]))
        several = np.minimum.reduceat(owner[order], first) != np.maximum.reduceat(owner[order], first)
        hits = [order[np.repeat(several, np.diff(np.append(first, len(order))))]]
        if elsewhere is not None and len(elsewhere):
            hits.append(whole[_among(suffix_prints(stream, number, least)[whole], elsewhere)])
        for hit in hits:
            np.add.at(covered, hit, 1)
            np.add.at(covered, hit + least, -1)
    inside = np.cumsum(covered)[:-1] > 0
    return [inside[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Scalar, int, list[tuple[str | None, str]], np.ndarray]]:
    """host, part, its pages and the fingerprints sent to it, from sorted rows of host, part, page_id, text, high, low, where a row has a text or a fingerprint."""
    key, kind, held, prints = None, None, [], array("q")
    for batch in batches:
        kind = batch.schema.field(0).type
        for h, part, i, t, high, low in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (h, part) != key:
                if held:
                    yield pa.scalar(key[0], kind), key[1], held, np.array(prints, dtype=np.int64).reshape(-1, 2)
                key, held, prints = (h, part), [], array("q")
            if t is None:
                prints.extend((high, low))
            else:
                held.append((i, t))
    if held:
        yield pa.scalar(key[0], kind), key[1], held, np.array(prints, dtype=np.int64).reshape(-1, 2)


def without_repeats(pages: DataFrame, host: str, page_id: str, text: str, least: int = LEAST, part_chars: int = PART_CHARS) -> DataFrame:
    """page_id, tokens, covered, unique of each page: how many of its tokens repeats cover, and its text without them.

    Repeated rows count once. Null and empty texts have no tokens and give no rows; a null host is one like others. A host whose
    pages have more than part_chars characters is parted by its pages' hashes; its parts send out the fingerprints (128 bits) of
    their runs, and each gets back those of its own that another part has, so that repeats are seen over the whole host. An empty
    table gives an empty result, other columns are ignored.
    """
    rows = strip_clash(pages, {"host": host, "page_id": page_id, "text": text}).filter(F.length("text") > 0).distinct()
    parts = rows.groupBy("host").agg(F.ceil(F.sum(F.length("text")) / part_chars).cast("int").alias("parts"))
    rows = rows.join(parts.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host")))
    rows = rows.select("host", "parts", F.pmod(F.xxhash64("page_id", "text"), F.col("parts")).cast("int").alias("part"), F.col("page_id").cast("string").alias("page_id"), "text", F.lit(None).cast("long").alias("high"), F.lit(None).cast("long").alias("low"))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, part, held, _ in _parts(batches):
            prints = run_prints([TOKEN.findall(t) for _, t in held], least)
            for at in range(0, len(prints), PRINT_ROWS):
                some = prints[at : at + PRINT_ROWS]
                yield pa.RecordBatch.from_arrays([pa.repeat(h, len(some)), pa.repeat(pa.scalar(part, pa.int32()), len(some)), pa.array(some[:, 0]), pa.array(some[:, 1])], names=["host", "part", "high", "low"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, held, elsewhere in _parts(batches):
            found = [list(TOKEN.finditer(t)) for _, t in held]
            marks = repeated([[m[0] for m in f] for f in found], least, elsewhere)
            unique = []
            for (_, t), f, mark in zip(held, found, marks, strict=True):
                out, at = [], 0
                for m, covered in zip(f, mark.tolist(), strict=True):
                    if covered:
                        out.append(t[at : m.start()])
                        at = m.end()
                unique.append("".join([*out, t[at:]]))
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in held], pa.string()), pa.array([len(f) for f in found], pa.int32()), pa.array([int(m.sum()) for m in marks], pa.int32()), pa.array(unique, pa.string())], names=["page_id", "tokens", "covered", "unique"])

    columns = ["host", "part", "page_id", "text", "high", "low"]
    parted = rows.filter("parts > 1").repartition("host", "part").sortWithinPartitions("host", "part").select(*columns)
    kinds = rows.select("host", "part", "high", "low").schema
    told = parted.mapInArrow(tell, kinds).groupBy("host", "high", "low").agg(F.collect_set("part").alias("among")).filter(F.size("among") > 1)
    told = told.select("host", F.explode("among").alias("part"), F.lit(None).cast("string").alias("page_id"), F.lit(None).cast("string").alias("text"), "high", "low")
    placed = rows.select(*columns).unionByName(told).repartition("host", "part").sortWithinPartitions("host", "part", "page_id").select(*columns)
    return placed.mapInArrow(run, "page_id string, tokens int, covered int, unique string")
