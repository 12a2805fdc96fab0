"""Filling fixed-capacity containers: vector bin packing of tokenised texts.

An item has three sizes, tokens, segments and loss-bearing tokens, and a container a limit on each. Items are packed where they are
read, in blocks of bounded size; only what lies in badly filled containers moves on, to be packed again with that of many blocks.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstone.session import materialize, strip_clash

#: The vocabulary and the pattern it is used with; any file of ranks of the same form will do.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Items packed at once, and the fill below which a container of a block is opened again.
BLOCK, FILLED = 4096, 0.97
#: Blocks whose open containers are packed together in the second round.
MERGE = 64
#: Texts longer than this are tokenised in parts, cut where no token can go over.
PART = 200_000
_CUT = re.compile(r"(?<=[^\s]) (?=[^\s])")


@dataclass(frozen=True)
class Limits:
    """segment_tokens: a container has one segment for so many tokens of its capacity at most, and least_segments in any case. loss_share: the share of the capacity that loss-bearing tokens may take; an item with more than that by itself is alone in its container."""

    segment_tokens: int = 40
    least_segments: int = 4
    loss_share: float = 0.98

    def segments(self, capacity: int) -> int:
        return max(self.least_segments, capacity // self.segment_tokens)


#: How much an item loses by each share of the loss that a container would lack after it.
_BALANCE = 4.0
_ENCODERS: dict = {}


def encoder(path: str, pattern: str):
    if (path, pattern) not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path, pattern]


def count_tokens(text: str, enc) -> int:
    """The number of tokens of the whole text. A single blank between two other characters always starts a new piece of PATTERN, so a long text is cut at such blanks, with the same tokens."""
    total, at = 0, 0
    while len(text) - at > PART:
        m = _CUT.search(text, at + PART)
        if m is None:
            break
        total += len(enc.encode_ordinary(text[at : m.start()]))
        at = m.start()
    return total + len(enc.encode_ordinary(text[at:]))


_QUOTED = re.compile(r"^[ \t]*>.*\n?", re.M)


def prompt_of(text: str) -> str:
    """What bears no loss: the first line, which is the title or question of a document of several lines, and lines that quote another."""
    first, newline, rest = text.partition("\n")
    quoted = "".join(_QUOTED.findall(rest if newline else text)) if ">" in text else ""
    return (first + newline if newline else "") + quoted


def pack(tokens: np.ndarray, loss: np.ndarray, capacity: int, limits: Limits) -> tuple[np.ndarray, int]:
    """(container of each item, containers). The dot-product heuristic: a container takes, of the items that fit, the one whose sizes go along best with the room that is left, until none fits; an item that uses up the loss before the tokens comes later. Sizes are shares of the limits, weighted by how much of each all items need."""
    n = len(tokens)
    out = np.full(n, -1)
    if not n:
        return out, 0
    most_loss = max(1.0, capacity * limits.loss_share)
    most = limits.segments(capacity)
    need = np.array([tokens.sum() / capacity, n / most, loss.sum() / most_loss])
    weight = need / max(need.sum(), 1e-12)
    # longest first, so that what fits by tokens is the rest of the arrays from some place on
    order = np.lexsort((np.arange(n), -tokens))
    size, lost = tokens[order] / capacity, loss[order] / most_loss
    alive = np.ones(n, dtype=bool)
    rate = lost.sum() / max(size.sum(), 1e-12)
    left, box = n, 0
    while left:
        room, room_loss, room_segments = 1.0 + 1e-9, 1.0 + 1e-9, most
        took = 0
        while room_segments:
            first = int(np.searchsorted(-size, -room))
            if first == len(size):
                break
            # all items take one segment, so that term is the same for each and decides nothing
            score = size[first:] * (weight[0] * room) + lost[first:] * (weight[2] * room_loss)
            # what is left of the loss has to do for what is left of the tokens, at the rate of all items
            score -= _BALANCE * np.maximum(0.0, (room - size[first:]) * rate - (room_loss - lost[first:]))
            score[~(alive[first:] & (lost[first:] <= room_loss))] = -np.inf
            k = int(score.argmax())
            if score[k] == -np.inf:
                break
            k += first
            out[order[k]] = box
            alive[k] = False
            room, room_loss, room_segments, took = room - size[k], room_loss - lost[k], room_segments - 1, took + 1
        if not took:
            # nothing fits an empty container: the first item is alone, whatever its other sizes
            k = int(alive.argmax())
            out[order[k]] = box
            alive[k] = False
            took = 1
        left -= took
        box += 1
        if left < 0.75 * len(size):
            size, lost, order, alive = size[alive], lost[alive], order[alive], np.ones(left, dtype=bool)
    return out, box


ITEMS = "item_id long, piece int, tokens int, loss int"
PLACED = "budget_id int, container string, item_id long, piece int, tokens int, loss int, block long, open boolean"
_PLACED = pa.schema([("budget_id", pa.int32()), ("container", pa.string()), ("item_id", pa.int64()), ("piece", pa.int32()), ("tokens", pa.int32()), ("loss", pa.int32()), ("block", pa.int64()), ("open", pa.bool_())])


def measured(documents: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """item_id, tokens, loss of each text with a token. The tokenizer's file is read on each executor from the path given."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary, pattern)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            tokens = [count_tokens(t, enc) for t in texts]
            loss = [max(0, n - count_tokens(prompt_of(t), enc)) for n, t in zip(tokens, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(tokens, pa.int32()), pa.array(loss, pa.int32())], names=["item_id", "tokens", "loss"])

    docs = strip_clash(documents, {"item_id": "doc_id", "text": "text"}).filter(F.length("text") > 0)
    return docs.mapInArrow(measure, "item_id long, tokens int, loss int").filter("tokens > 0")


def _cut(ids: np.ndarray, tokens: np.ndarray, loss: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Items, of which those that exceed the capacity by themselves are cut into full pieces and a rest; the tokens that bear no loss are the first ones."""
    count = np.maximum(1, -(-tokens // capacity))
    item = np.repeat(np.arange(len(ids)), count)
    piece = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
    size = np.minimum(capacity, tokens[item] - piece * capacity)
    free = np.clip((tokens - loss)[item] - piece * capacity, 0, size)
    return ids[item], piece, size, size - free


def _rows(budget: int, ids: np.ndarray, piece: np.ndarray, size: np.ndarray, loss: np.ndarray, capacity: int, limits: Limits, name: str, block: int, close: bool) -> pa.RecordBatch:
    box, n = pack(size, loss, capacity, limits)
    fill = np.bincount(box, weights=size, minlength=n) / capacity
    crowded = np.bincount(box, minlength=n) >= limits.segments(capacity)
    opened = np.zeros(len(box), dtype=bool) if close else ~((fill >= FILLED) | crowded)[box]
    width = len(str(n))
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(ids), budget), pa.int32()), pa.array([f"{name}-{b:0{width}}" for b in box.tolist()], pa.string()), pa.array(ids, pa.int64()), pa.array(piece, pa.int32()), pa.array(size, pa.int32()), pa.array(loss, pa.int32()), pa.array(np.full(len(ids), block), pa.int64()), pa.array(opened)],
        schema=_PLACED,
    )


def _first_round(budgets: list[tuple[int, int]], limits: Limits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        held: list[np.ndarray] = []
        block = 0

        def work(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            for budget, capacity in budgets:
                ids, piece, size, loss = _cut(rows[:, 0], rows[:, 1], rows[:, 2], capacity)
                yield _rows(budget, ids, piece, size, loss, capacity, limits, f"{budget}-{task}-{block}", task * 1_000_003 + block, False)

        for batch in batches:
            held.append(np.stack([np.asarray(c).astype(np.int64) for c in batch.columns], axis=1))
            while sum(map(len, held)) >= BLOCK:
                rows = np.concatenate(held)
                yield from work(rows[:BLOCK])
                held, block = [rows[BLOCK:]], block + 1
        rows = np.concatenate(held) if held else np.empty((0, 3), dtype=np.int64)
        if len(rows):
            yield from work(rows)

    return run


def _second_round(capacities: dict[int, int], limits: Limits, counter: str):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        budget, group = key[0].as_py(), key[1].as_py()
        # order by item, so that a run again gives the same containers
        table = table.sort_by([("item_id", "ascending"), ("piece", "ascending")])
        out = [
            _rows(budget, *(np.asarray(part.column(c)).astype(np.int64) for c in ("item_id", "piece", "tokens", "loss")), capacities[budget], limits, f"{budget}-{counter}{group}-{i}", group, True)
            for i, part in enumerate(table.slice(i, BLOCK * 4) for i in range(0, len(table), BLOCK * 4))
        ]
        return pa.Table.from_batches(out, schema=_PLACED)

    return run


def containers(documents: DataFrame, budgets: DataFrame, limits: Limits = Limits(), vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """budget_id, container, item_id, piece, tokens, loss: the container of each text for each capacity. Null, blank and empty texts have no tokens or few; those without take no room and are left out.

    Only a text that exceeds a capacity by itself is cut, into pieces of the capacity and a rest. Repeated documents are packed each;
    budgets with a null or non-positive capacity are left out, equal rows of them count once; an empty table on either side gives
    an empty result. The first round shuffles nothing. Of a block's containers a handful stay open, so the second round moves a
    small and constant share of items, spread over groups of MERGE blocks; no group is larger than those blocks' open containers.
    """
    spark = documents.sparkSession
    known = strip_clash(budgets, {"budget_id": "budget_id", "capacity": "capacity_tokens"}).filter("budget_id IS NOT NULL AND capacity > 0").distinct().limit(1001).collect()
    if len(known) > 1000:
        raise ValueError("more than 1000 capacities")
    if not known:
        return spark.createDataFrame([], "budget_id int, container string, item_id long, piece int, tokens int, loss int")
    sizes = sorted((r.budget_id, r.capacity) for r in known)
    # item_id is null where doc_id is; such texts are packed too, so they get ids below all others
    items = measured(documents, vocabulary, pattern).withColumn("item_id", F.coalesce("item_id", F.lit(-(2**62))))
    placed = materialize(items.mapInArrow(_first_round(sizes, limits), PLACED))
    columns = ("budget_id", "container", F.when(F.col("item_id") != -(2**62), F.col("item_id")).alias("item_id"), "piece", "tokens", "loss")
    again = placed.filter("open").withColumn("group", F.floor(F.col("block") / 1_000_003 / MERGE) * 1_000 + F.floor(F.col("block") % 1_000_003 / MERGE))
    moved = again.groupBy("budget_id", "group").applyInArrow(_second_round(dict(sizes), limits, "m"), PLACED)
    return placed.filter("NOT open").select(*columns).unionByName(moved.select(*columns))


def fill_report(placed: DataFrame, budgets: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """budget_id, containers, tokens, fill (share of the room used, to four places), loss_fill and segment_fill (the same of the other limits), full_loss and full_segments (containers within 2 % of these limits, or at them), least (containers that any packing needs)."""
    capacities = strip_clash(budgets, {"budget_id": "budget_id", "capacity": "capacity_tokens"}).distinct()
    capacities = capacities.withColumns({"most_loss": F.col("capacity") * limits.loss_share, "most": F.greatest(F.lit(limits.least_segments), F.floor(F.col("capacity") / limits.segment_tokens))})
    each = placed.groupBy("budget_id", "container").agg(F.sum("tokens").alias("tokens"), F.sum("loss").alias("loss"), F.count(F.lit(1)).alias("items"))
    each = each.join(F.broadcast(capacities), "budget_id")  # at most 1000 rows, see containers()
    share = lambda c, limit: F.round(F.sum(c) / F.sum(limit), 4)
    out = each.groupBy("budget_id").agg(
        F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), share("tokens", "capacity").alias("fill"), share("loss", "most_loss").alias("loss_fill"), share("items", "most").alias("segment_fill"),
        F.count_if(F.col("loss") >= 0.98 * F.col("most_loss")).alias("full_loss"), F.count_if(F.col("items") >= F.col("most")).alias("full_segments"), F.ceil(F.sum("tokens") / F.first("capacity")).alias("least"),
    )
    return out
