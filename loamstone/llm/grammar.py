"""Re-Pair grammars of many token sequences at once.

Sequences are runs of one array, so a round is a few passes of numpy over all of them: count each pair inside its sequence,
replace those that occur again and are more frequent than the pairs they overlap, repeat. A symbol is the hash of what it stands
for, so equal text has equal symbols in all sequences, tasks and runs. That makes a rule of one repository the same rule in another.
"""

from __future__ import annotations

import numpy as np

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

# classes of bytes
SPACE, NEWLINE, WORD, DIGIT, SIGN = 0, 1, 2, 3, 4
_CLASS = np.full(256, SIGN, dtype=np.uint8)
_CLASS[[9, 11, 12, 13, 32]] = SPACE
_CLASS[10] = NEWLINE
_CLASS[48:58] = DIGIT
for _lo, _hi in ((65, 91), (97, 123), (128, 256)):
    _CLASS[_lo:_hi] = WORD
_CLASS[95] = WORD
_BASE = np.uint64(0x100000001B3)
NEWLINE_SYMBOL = np.uint64(10)
#: Rounds of pairing of lines; a rule spans some (3/2) ** rounds lines.
RULE_ROUNDS = 4


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M2
        x = (x ^ (x >> np.uint64(27))) * _M3
        return x ^ (x >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The symbol of the rule a b."""
    with np.errstate(over="ignore"):
        return mix(a * _M1 + mix(b + _M2))


def tokenize(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, exact, start, length) of the tokens of UTF-8 bytes: words, numbers, signs one by one, line breaks. Other space parts tokens and is none. All numbers are one symbol, and digits don't count in words, so that numbered names are equal; exact has the digits."""
    if not len(data):
        none = np.empty(0, dtype=np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    kind = _CLASS[data]
    wordy = (kind == WORD) | (kind == DIGIT)
    first = np.empty(len(data), dtype=bool)
    first[0] = kind[0] != SPACE
    first[1:] = (kind[1:] != SPACE) & ~(wordy[1:] & wordy[:-1])
    start = np.flatnonzero(first)
    if not len(start):
        return start.astype(np.uint64), start.astype(np.uint64), start, start
    ends = np.append(start[1:], len(data))
    lead = np.zeros(start[0], dtype=np.int32)
    place = np.arange(len(data), dtype=np.int32) - np.concatenate([lead, np.repeat(start.astype(np.int32), ends - start)])
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(place.max()) + 1, _BASE, dtype=np.uint64))
        value = data * powers[place]
        value[kind == SPACE] = 0
        whole = np.add.reduceat(value, start)
        value[kind == DIGIT] = 0
        symbol = np.add.reduceat(value, start)
    number = kind[start] == DIGIT
    symbol[number] = 48
    sign = ~wordy[start]
    symbol[sign] = whole[sign] = data[start[sign]]
    words = ~(number | sign)
    symbol[words] = mix(symbol[words] + _M1)
    whole[~sign] = mix(whole[~sign] + _M1)
    length = np.add.reduceat((kind != SPACE).astype(np.int64), start)
    return symbol, whole, start, length


def _buckets(hashes: np.ndarray) -> tuple[np.ndarray, int]:
    bits = max(10, len(hashes).bit_length() + 1)
    return (hashes >> np.uint64(64 - bits)).astype(np.int64), 1 << bits


def counts(hashes: np.ndarray) -> np.ndarray:
    """How often the value at each place occurs. One value owns each bucket of a table and is counted there; those that lost their bucket are sorted."""
    bucket, size = _buckets(hashes)
    holder = np.zeros(size, dtype=np.uint64)
    holder[bucket] = hashes
    lost = holder[bucket] != hashes
    bucket[lost] = size
    n = np.bincount(bucket, minlength=size + 1)[bucket]
    if lost.any():
        _, inverse, few = np.unique(hashes[lost], return_inverse=True, return_counts=True)
        n[lost] = few[inverse]
    return n


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Places that hold each value once, by the same table."""
    bucket, size = _buckets(hashes)
    at = np.arange(len(hashes))
    holder = np.zeros(size, dtype=np.int64)
    holder[bucket] = at
    held = holder[bucket]
    lost = np.flatnonzero(hashes[held] != hashes)
    return np.concatenate([np.flatnonzero(held == at), lost[np.unique(hashes[lost], return_index=True)[1]]])


def repair(symbols: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(grammar size, rules) of each of n sequences. owner: the sequence of each symbol, ascending. The size is the length of what is left plus two for each rule of the sequence. A sequence is done when no pair of it occurs twice, whatever the others do."""
    rules, left_over = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    s, o = symbols, owner
    while len(s) > 1:
        apart = np.flatnonzero(o[1:] != o[:-1])
        key = pair(s[:-1], s[1:])
        with np.errstate(over="ignore"):
            own = key ^ (o[:-1].astype(np.uint64) * _M1)
        own[apart] = np.arange(len(apart), dtype=np.uint64)  # no pair, and no two alike in practice
        often = counts(own)
        often[apart] = 0
        # in a run of one symbol pairs overlap their like: every other one of them may be replaced
        first = np.concatenate([[True], own[1:] != own[:-1]])
        starts = np.flatnonzero(first)
        odd = ((np.arange(len(own)) - starts[np.cumsum(first) - 1]) & 1).astype(bool) if len(starts) < len(own) else None
        # of other overlapping pairs the more frequent is replaced; equals go by symbol
        at = np.flatnonzero((often >= 2) & ~odd) if odd is not None else np.flatnonzero(often >= 2)
        if not len(at):
            break
        here, mine = often[at], key[at]
        left, right = np.maximum(at - 1, 0), np.minimum(at + 1, len(key) - 1)
        over = lambda near: (here > often[near]) | (here == often[near]) & (mine >= key[near])
        chosen = at[over(left) & over(right)]
        chosen = chosen[counts(own[chosen]) >= 2]  # a rule that is used once makes no grammar smaller
        size = np.bincount(o, minlength=n)
        going = np.bincount(o[chosen], minlength=n) > 0
        left_over += np.where(going, 0, size)
        rules += np.bincount(o[chosen[distinct(own[chosen])]], minlength=n)
        s = s.copy()
        s[chosen] = key[chosen]
        keep = going[o]
        keep[chosen + 1] = False
        s, o = s[keep], o[keep]
    return left_over + np.bincount(o, minlength=n) + 2 * rules, rules


def line_symbols(symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, owner, tokens) of each line that has a token: the rule that spells it. Space doesn't count."""
    if not len(symbols):
        return symbols, owner, owner
    broken = symbols == NEWLINE_SYMBOL
    line = np.cumsum(broken) + np.concatenate([[0], np.cumsum(owner[1:] != owner[:-1])])
    body = ~broken
    s, o, line = symbols[body], owner[body], line[body]
    if not len(s):
        return s, o, line
    first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    sizes = np.diff(np.append(first, len(s)))
    place = np.arange(len(s)) - np.repeat(first, sizes)
    with np.errstate(over="ignore"):
        spelled = np.add.reduceat(mix(s + place.astype(np.uint64) * _M1), first)
    return mix(spelled), o[first], sizes


def corpus_rules(lines: np.ndarray, owner: np.ndarray, tokens: np.ndarray, rounds: int = RULE_ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, owner, tokens) of the rules that the lines of each sequence are pairs of pairs of in a grammar that all sequences of a corpus share.

    Re-Pair over the whole corpus would replace pairs by how often the corpus has them, which no sequence knows. Here each pair has
    a rank that is the same everywhere (its own symbol), and in each round the pairs that outrank both pairs they overlap are
    replaced. So equal runs of lines become equal rules wherever they occur, a changed line changes only the rules that hold it or
    end beside it, and which rules are of use (held by several sequences) is counted over the corpus afterwards.
    """
    s, o, w = lines, owner, tokens
    for _ in range(rounds):
        if len(s) < 2:
            break
        key = pair(s[:-1], s[1:])
        inside = o[1:] == o[:-1]
        rank = np.where(inside, key, np.uint64(0))
        below, above = np.concatenate([[np.uint64(0)], rank[:-1]]), np.concatenate([rank[1:], [np.uint64(0)]])
        chosen = np.flatnonzero(inside & (rank > below) & (rank >= above))
        s, w = s.copy(), w.copy()
        s[chosen] = key[chosen]
        w[chosen] += w[chosen + 1]
        keep = np.ones(len(s), dtype=bool)
        keep[chosen + 1] = False
        s, o, w = s[keep], o[keep], w[keep]
    return s, o, w
