"""A trigram index over the texts of an Arrow batch, and the trigrams that a regular expression requires.

A batch is an index segment: its postings are a bit for each text and needed trigram, found by looking every position of the
UTF-8 buffer up in one table. Conditions of regular expressions are evaluated on the postings; nothing is shuffled.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser

import numpy as np
import pyarrow as pa

#: A condition is a set of clauses, all of which must hold; a clause is a set of alternatives, one of which must; an alternative
#: is a set of trigrams, all of which must occur.
Condition = frozenset[frozenset[frozenset[bytes]]]
#: A part of a pattern counts as a set of literals up to this many; a longer set is cut into the parts it is made of.
MAX_LITERALS = 256


def _grams(literal: str) -> frozenset[bytes]:
    b = literal.lower().encode()
    return frozenset(b[i : i + 3] for i in range(len(b) - 2))


def _characters(members) -> set[str] | None:
    """The characters of a class, in lower case, if they are few."""
    out: set[str] = set()
    for op, arg in members:
        if op is C.LITERAL:
            out.add(chr(arg).lower())
        elif op is C.RANGE and arg[1] - arg[0] < 4:
            out |= {chr(c).lower() for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 and all(c.isascii() for c in out) else None


def _ways(literals: set[str] | None, clauses: set[frozenset[frozenset[bytes]]]) -> frozenset[frozenset[bytes]]:
    """What one branch of an alternative requires, as alternatives; none if nothing."""
    if literals is not None:
        options = frozenset(map(_grams, literals))
        return options if all(options) else frozenset()
    sure = frozenset(g for clause in clauses if len(clause) == 1 for alt in clause for g in alt)
    return frozenset([sure]) if sure else min((c for c in clauses), key=len, default=frozenset())


def _walk(items) -> tuple[set[str] | None, set[frozenset[frozenset[bytes]]]]:
    """The literals that a pattern may be, if they are few, else None; and the clauses that hold besides."""
    clauses: set[frozenset[frozenset[bytes]]] = set()
    run, whole = {""}, True

    def flush() -> None:
        nonlocal run, whole
        options = frozenset(map(_grams, run))
        if all(options):
            clauses.add(options)
        run, whole = {""}, False

    for op, arg in items:
        options: set[str] | None = None
        if op is C.LITERAL:
            options = {chr(arg).lower()} if arg < 128 else None
        elif op is C.IN:
            options = _characters(arg)
        elif op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            continue
        elif op is C.SUBPATTERN:
            options, inner = _walk(arg[-1])
            if options is None:
                clauses |= inner
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            inner_options, inner = _walk(arg[2])
            if inner_options is not None and arg[1] == 1:
                options = inner_options | ({""} if arg[0] == 0 else set())
            elif arg[0] >= 1:
                clauses |= inner
                if inner_options and all(map(_grams, inner_options)):
                    clauses.add(frozenset(map(_grams, inner_options)))
        elif op is C.BRANCH:
            branches = [_walk(b) for b in arg[1]]
            if all(o is not None for o, _ in branches):
                options = set().union(*(o for o, _ in branches))
            else:
                ways = [_ways(o, c) for o, c in branches]
                if all(ways) and sum(map(len, ways)) <= MAX_LITERALS:
                    clauses.add(frozenset().union(*ways))
        if options is None:
            flush()
        elif len(run) * len(options) <= MAX_LITERALS:
            run = {a + b for a in run for b in options}
        else:
            flush()
            run = options if len(options) <= MAX_LITERALS else {""}
    if whole:
        return run, clauses
    flush()
    return None, clauses


def literals_of(pattern: str) -> set[str]:
    """The literals, in lower case, of a pattern that is nothing but a choice of them; what has to stand around them is left out."""
    literals, _ = _walk(parser.parse(pattern))
    if not literals:
        raise ValueError("not a choice of literals")
    return literals


def required_trigrams(pattern: str) -> Condition:
    """What texts that match the pattern must contain, in lower case. An empty condition means that any text may match.

    Each part of the pattern is either a small set of literals, and such parts side by side are multiplied out, or it has clauses
    of its own if it occurs at least once. A finished set of literals is a clause with an alternative for each literal. Case is
    folded for all of it, which only makes conditions weaker.
    """

    literals, clauses = _walk(parser.parse(pattern))
    if literals and all(map(_grams, literals)):
        clauses.add(frozenset(map(_grams, literals)))
    return frozenset(clauses)


class GramTable:
    """The trigrams that a set of conditions needs, numbered; one byte for each possible trigram says which."""

    def __init__(self, conditions: list[Condition]) -> None:
        self.conditions = conditions
        self.grams = sorted({g for c in conditions for clause in c for alt in clause for g in alt})
        if len(self.grams) > 60_000:
            raise ValueError("too many trigrams")
        self.number = {g: i for i, g in enumerate(self.grams)}
        self.table = np.zeros(1 << 24, dtype=np.uint16)
        for g, i in self.number.items():
            self.table[g[0] << 16 | g[1] << 8 | g[2]] = i + 1
        self.lower = np.arange(256, dtype=np.uint32)
        self.lower[65:91] += 32

    def postings(self, texts: pa.Array, block: int = 4 << 20) -> np.ndarray:
        """A row for each text and a column for each trigram: whether it occurs. Works through the buffer block by block, so its memory doesn't follow the length of texts."""
        texts = texts.cast(pa.large_string())
        n = len(texts)
        out = np.zeros((n, len(self.grams) + 1), dtype=bool)
        if not n or texts.buffers()[2] is None:
            return out[:, 1:]
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + n + 1]
        data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)
        for lo in range(int(offsets[0]), int(offsets[-1]), block):
            hi = min(lo + block + 2, int(offsets[-1]))
            low = self.lower[data[lo:hi]]
            if len(low) < 3:
                break
            codes = low[:-2] << 16
            codes |= low[1:-1] << 8
            codes |= low[2:]
            found = self.table[codes]
            at = np.flatnonzero(found)
            row = np.searchsorted(offsets, at + lo, side="right") - 1
            inside = at + lo + 3 <= offsets[row + 1]
            out[row[inside], found[at[inside]]] = True
        return out[:, 1:]

    def candidates(self, posted: np.ndarray, condition: Condition) -> np.ndarray:
        """The texts whose postings meet a condition: postings are intersected within alternatives and clauses, united between alternatives."""
        keep = np.ones(len(posted), dtype=bool)
        for clause in condition:
            some = np.zeros(len(posted), dtype=bool)
            for alt in clause:
                some |= posted[:, [self.number[g] for g in alt]].all(axis=1)
            keep &= some
        return keep
