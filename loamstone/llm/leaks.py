"""Evaluation texts leaking into a corpus: a generalised suffix automaton of the test items, and the corpus streamed through it."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamstone.session import strip_clash

#: A leak is this many consecutive words of an item, or a passage with this share of its words in order.
WORDS, SHARE = 12, 0.8
#: A passage is at most this many times as long as the item.
STRETCH = 1.5
#: Items are matched in blocks of so many words; the automaton of a block is all that is sent with a task, whatever the corpus is.
MAX_BLOCK_WORDS = 2_000_000

#: Words with what has to be left out around them: tags, targets of links, entities; line prefixes and other markup have no word
#: characters. A word that is hyphenated at a line's end comes in two groups.
TOKEN = re.compile(
    r"</?[A-Za-z][^<>\n]{0,200}>|<!--|-->|\]\([^()\s]{1,300}\)|&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z]{2,8});|"
    r"(\w+(?:(?:\\_|[­​‌‍⁠﻿])\w*)*)(?:[-‐][ \t]*\r?\n[ \t]*(?:(?:[>#*/|+%;]+|--)[ \t]*)*(\w+))?"
)
_INNER = re.compile(r"\\_|[­​‌‍⁠﻿]")


def _clean(word: str) -> str:
    if "\\" in word or not word.isascii():
        word = _INNER.sub(lambda m: "_" if m[0] == "\\_" else "", word)
    return word.casefold().strip("_") or "_"


def words_of(text: str, known: dict[str, int] | None = None) -> list[str]:
    """The normalised words. A word hyphenated at a line's end is one word if the whole is known, two if not."""
    out = []
    for first, second in TOKEN.findall(text):
        if not first:
            continue
        w = _clean(first)
        if second:
            rest = _clean(second)
            if known is None or w + rest in known:
                out.append(w + rest)
                continue
            out.append(w)
            w = rest
        out.append(w)
    return out


#: Up to so many words of items in all, counting them takes less time than looking for items that may have enough.
_FEW = 30_000


class SuffixAutomaton:
    """All runs of words of all items, in flat arrays: most states go on by one word only, and only the others have a table.

    The items a run occurs in are those that end a prefix in its state or below it in the tree of suffix links. These ends stand in
    one array in the order of that tree, so that a state's items are a part of it, whatever their number.
    """

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.ids = [i for i, _ in items]
        self.number: dict[str, int] = {}
        self.word, self.to, self.link, self.length = array("i", [-1]), array("i", [-1]), array("i", [-1]), array("i", [0])
        self.more: dict[int, dict[int, int]] = {}
        ends, owners, words, sizes = array("i"), array("i"), array("i"), array("i")
        for k, (_, text) in enumerate(items):
            sequence = [self.number.setdefault(w, len(self.number)) for w in words_of(text)]
            words.extend(sequence)
            sizes.append(len(sequence))
            last = 0
            for symbol in sequence:
                last = self._extend(last, symbol)
                ends.append(last)
                owners.append(k)
        self.sizes = np.array(sizes, dtype=np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(self.sizes)])
        self.words = np.array(words, dtype=np.int32)
        self._place_owners(np.array(ends, dtype=np.int64), np.array(owners, dtype=np.int32))
        self._count_words()

    def _place_owners(self, ends: np.ndarray, owners: np.ndarray) -> None:
        n = len(self.length)
        link, length = np.array(self.link), np.array(self.length)
        own = np.bincount(ends, minlength=n)
        total = own.copy()
        by_length = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[by_length])) + 1
        levels = np.split(by_length, cuts)
        for states in reversed(levels[1:]):  # a link is shorter than what it is the link of
            np.add.at(total, link[states], total[states])
        start = np.zeros(n, dtype=np.int64)
        free = own.copy()  # where the next state below begins, from the start of the one above
        for states in levels[1:]:
            up = link[states]
            order = np.argsort(up, kind="stable")
            states, up = states[order], up[order]
            before = np.cumsum(total[states]) - total[states]
            first = np.flatnonzero(np.concatenate([[True], up[1:] != up[:-1]])) if len(up) else np.empty(0, dtype=np.int64)
            inside = before - np.repeat(before[first], np.diff(np.append(first, len(up))))
            start[states] = start[up] + free[up] + inside
            np.add.at(free, up, total[states])
        order = np.argsort(start[ends], kind="stable")
        at = start[ends][order]
        repeat = np.arange(len(at)) - np.searchsorted(at, at)
        # states that own no end may start where another does, but their part of the array is empty then
        self.owners = np.empty(len(at), dtype=np.int32)
        self.owners[at + repeat] = owners[order]
        self.start, self.total = start, total

    def _count_words(self) -> None:
        """For each item its different words with their numbers; and for each word the items of whose rarest words it is one: so many that a passage with SHARE of an item's words can't lack them all."""
        item = np.repeat(np.arange(len(self.sizes)), self.sizes)
        width = max(1, len(self.number))
        key, n = np.unique(item * width + self.words, return_counts=True)
        self.bag_item, self.bag_word, self.bag_n = key // width, key % width, n
        self.bag_bounds = np.searchsorted(self.bag_item, np.arange(len(self.sizes) + 1))
        spread = np.bincount(self.bag_word, minlength=width)[self.bag_word]
        order = np.lexsort((spread, self.bag_item))
        reached = np.cumsum(n[order])
        before = reached - n[order] - np.concatenate([[0], reached])[self.bag_bounds[self.bag_item[order]]]
        size = self.sizes[self.bag_item[order]]
        rare = order[before <= size - np.ceil(SHARE * size - 1e-9)]
        by_word = np.argsort(self.bag_word[rare], kind="stable")
        self.rare_items = self.bag_item[rare][by_word]
        self.rare_bounds = np.searchsorted(self.bag_word[rare][by_word], np.arange(width + 1))
        self.counts = np.zeros(width, dtype=np.int64)
        self.filled = np.flatnonzero(self.sizes)
        self.filled_bounds, self.enough = self.bag_bounds[self.filled], SHARE * self.sizes[self.filled]

    def _next(self, state: int, symbol: int) -> int:
        if self.word[state] == symbol:
            return self.to[state]
        table = self.more.get(state)
        return -1 if table is None else table.get(symbol, -1)

    def _lead(self, state: int, symbol: int, to: int) -> None:
        if self.word[state] in (-1, symbol):
            self.word[state], self.to[state] = symbol, to
        else:
            self.more.setdefault(state, {})[symbol] = to

    def _state(self, length: int, link: int) -> int:
        self.word.append(-1)
        self.to.append(-1)
        self.link.append(link)
        self.length.append(length)
        return len(self.length) - 1

    def _split(self, p: int, q: int, symbol: int) -> int:
        """A copy of q for the runs that are no longer than p's with symbol behind."""
        copy = self._state(self.length[p] + 1, self.link[q])
        self.word[copy], self.to[copy] = self.word[q], self.to[q]
        if q in self.more:
            self.more[copy] = dict(self.more[q])
        self.link[q] = copy
        while p != -1 and self._next(p, symbol) == q:
            self._lead(p, symbol, copy)
            p = self.link[p]
        return copy

    def _extend(self, last: int, symbol: int) -> int:
        q = self._next(last, symbol)
        if q != -1:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, symbol)
        new = self._state(self.length[last] + 1, 0)
        p = last
        while p != -1 and (q := self._next(p, symbol)) == -1:
            self._lead(p, symbol, new)
            p = self.link[p]
        if p != -1:
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, symbol)
        return new

    def stream(self, symbols: list[int]) -> Iterator[tuple[int, int, int]]:
        """(place, length, state): the longest run of any item that ends at each place, where it has WORDS words or more. A symbol of -1 is in no item."""
        word, to, link, lengths, more = self.word, self.to, self.link, self.length, self.more
        state, matched = 0, 0
        for place, symbol in enumerate(symbols):
            if symbol < 0:
                state = matched = 0
                continue
            while True:
                if word[state] == symbol:
                    state = to[state]
                    matched += 1
                    break
                table = more.get(state)
                if table is not None and symbol in table:
                    state = table[symbol]
                    matched += 1
                    break
                if not state:
                    break
                state = link[state]
                matched = lengths[state]
            if matched >= WORDS:
                yield place, matched, state

    def items_at(self, state: int) -> np.ndarray:
        """The items that the runs of a state occur in."""
        return np.unique(self.owners[self.start[state] : self.start[state] + self.total[state]])

    def at_length(self, state: int, length: int) -> int:
        """The state of the last `length` words of a run that ends in state."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def leaked(self, text: str) -> dict[int, tuple[int, int, int, int]]:
        """item number -> (most consecutive words, most words in order, first word, last word) of each leaked item."""
        number = self.number
        symbols = [number.get(w, -1) for w in words_of(text, number)]
        runs: dict[int, tuple[int, int]] = {}
        for place, matched, state in self.stream(symbols):
            # items that share only a shorter end of the run have WORDS words in common too
            whole = set(self.items_at(state).tolist())
            for k in self.items_at(self.at_length(state, WORDS)).tolist():
                longest = matched if k in whole else WORDS
                if longest > runs.get(k, (0, 0))[0]:
                    runs[k] = (longest, place)
        found: dict[int, tuple[int, int, int, int]] = {}
        met = np.array(symbols, dtype=np.int64)
        covered = set(self._covered(met).tolist())
        for k in sorted(covered | runs.keys()):
            n = int(self.sizes[k])
            order, first, last = self._passage(k, met) if k in covered else (0, 0, 0)
            if k in runs:
                longest, end = runs[k]
                if order < SHARE * n:
                    first, last = end - longest + 1, end
                found[k] = (longest, max(order, longest), first, last)
            elif order >= SHARE * n:
                found[k] = (0, order, first, last)
        return found

    def _covered(self, symbols: np.ndarray) -> np.ndarray:
        """The items of whose words the text has SHARE, wherever they stand: all are counted where they're few, else those with one of their rarest words in the text."""
        if len(self.bag_word) <= _FEW:
            if not len(self.filled):
                return self.filled
            held = np.minimum(np.bincount(symbols[symbols >= 0], minlength=len(self.counts))[self.bag_word], self.bag_n)
            return self.filled[np.add.reduceat(held, self.filled_bounds) >= self.enough]
        known, n = np.unique(symbols[symbols >= 0], return_counts=True)
        if not len(known):
            return known
        lo, hi = self.rare_bounds[known], self.rare_bounds[known + 1]
        size = hi - lo
        if not size.any():
            return known[:0]
        at = np.arange(size.sum()) + np.repeat(lo - (np.cumsum(size) - size), size)
        items = np.unique(self.rare_items[at])
        lo, size = self.bag_bounds[items], self.bag_bounds[items + 1] - self.bag_bounds[items]
        first = np.cumsum(size) - size
        at = np.arange(size.sum()) + np.repeat(lo - first, size)
        self.counts[known] = n
        common = np.add.reduceat(np.minimum(self.counts[self.bag_word[at]], self.bag_n[at]), first)
        self.counts[known] = 0
        return items[common >= SHARE * self.sizes[items]]

    def _passage(self, k: int, symbols: np.ndarray) -> tuple[int, int, int]:
        """(words in order, first, last) of the best window: longest common subsequences, a row of bits at a time. A passage of up to STRETCH times the item's length lies in a window whole; windows that hold too few of the item's words can't be one."""
        item = self.words[self.bounds[k] : self.bounds[k + 1]].tolist()
        n = len(item)
        where: dict[int, int] = {}
        for i, symbol in enumerate(item):
            where[symbol] = where.get(symbol, 0) | 1 << i
        step = max(1, n // 8)
        size = int(n * STRETCH) + step
        full = (1 << n) - 1
        masks = [where.get(s, 0) for s in symbols.tolist()]
        held = np.concatenate([[0], np.cumsum([m > 0 for m in masks])])
        starts = np.arange(max(1, len(masks) - size + 1))
        enough = held[np.minimum(starts + size, len(masks))] - held[starts] >= SHARE * n
        best, tried = (0, 0, 0), -step

        def common(lo: int, hi: int) -> int:
            row = full
            for mask in masks[lo:hi]:
                if mask:
                    u = row & mask
                    row = (row + u | row - u) & full
            return n - row.bit_count()

        # a text that hasn't so many of the words in order has no window that does
        if not enough.any() or common(int(enough.argmax()), len(masks)) < SHARE * n:
            return best
        for start in np.flatnonzero(enough).tolist():
            # each run of windows is tried at every step, and at its end
            if start - tried < step and start + 1 < len(enough) and enough[start + 1]:
                continue
            tried = start
            end = min(len(masks), start + size)
            in_order = common(start, end)
            if in_order > best[0]:
                best = (in_order, start, end - 1)
                if in_order == n:
                    break
        return best


FOUND = "doc_id long, item_id long, longest int, in_order int, item_words int, start_pos int, end_pos int"
#: The automaton of the block that this worker was sent last, by the list it came as.
_LATEST: list = []


def _positions(text: str, number: dict[str, int]) -> list[tuple[int, int]]:
    """Start and end of each word of words_of."""
    out = []
    for m in TOKEN.finditer(text):
        if m[1]:
            if m[2] and _clean(m[1]) + _clean(m[2]) in number:
                out.append((m.start(1), m.end(2)))
            else:
                out.append((m.start(1), m.end(1)))
                if m[2]:
                    out.append((m.start(2), m.end(2)))
    return out


def _search(sent):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not _LATEST or _LATEST[0] is not sent.value:
            _LATEST[:] = sent.value, SuffixAutomaton(sent.value)
        automaton = _LATEST[1]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = automaton.leaked(text)
                if found:
                    at = _positions(text, automaton.number)
                    rows += [(doc_id, automaton.ids[k], longest, order, int(automaton.sizes[k]), at[a][0] + 1, at[b][1]) for k, (longest, order, a, b) in found.items()]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = [pa.int64(), pa.int64(), *[pa.int32()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "item_id", "longest", "in_order", "item_words", "start_pos", "end_pos"])

    return search


def _blocks(items: Iterator) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for r in items:
        block.append((r.item_id, r.text))
        size += len(r.text) // 4
        if size >= MAX_BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """FOUND: which documents hold a passage of which items, the longest run of consecutive words, the most words in order, and where the passage is in the text (from 1).

    Null or blank texts of either side hold nothing; a null doc_id or item_id stays null; items of fewer words than a leak needs can
    leak only whole, by order; items of equal text leak together. Repeated documents are reported once each by doc_id. Empty tables
    give an empty result, other columns are ignored. The items are read in blocks of bounded size; each block is one narrow pass
    over the corpus, so there's no limit on their number and nothing is shuffled but the hits.
    """
    spark = documents.sparkSession
    docs = strip_clash(documents, {"doc_id": "doc_id", "text": "text"}).filter(F.length("text") > 0)
    parts = []
    for block in _blocks(strip_clash(items, {"item_id": "item_id", "text": "text"}).filter(F.length("text") > 0).distinct().toLocalIterator()):
        parts.append(docs.mapInArrow(_search(spark.sparkContext.broadcast(block)), FOUND))
    if not parts:
        return spark.createDataFrame([], FOUND)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.dropDuplicates(["doc_id", "item_id"])
