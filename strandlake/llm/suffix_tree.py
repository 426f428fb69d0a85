"""A probabilistic suffix tree over word symbols, as sorted arrays of grams and their counts.

Symbols are 16-bit numbers. A context is a run of up to DEPTH = 2 symbols, a gram a context with the symbol behind it, in a
64-bit key: the nearest context symbol highest, then the one before it, then the next symbol. So a context's grams lie
side by side in order of key, and all contexts with the same nearest symbol are one run.

A context is retained if its next-symbol distribution diverges from its suffix's by a test on its own occurrences: each is
predicted from the others, smoothed with the suffix's distribution, and the sum of the log ratios to that distribution has
to be positive. One that was seen with different next symbols each time is no evidence and fails. A retained distribution is
(count + types * suffix's probability) / (total + types), with ``types`` the number of different next symbols; any other is its
suffix's. The root is smoothed in the same way with the uniform distribution. All of them sum to one over the symbols.
"""

from __future__ import annotations

import numpy as np

DEPTH, SYMBOLS = 2, 1 << 16


def contexts(symbols: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """The key of each symbol's gram; texts lie end to end, ``end`` stands before each."""
    start = np.zeros(len(symbols), dtype=bool)
    heads = np.cumsum(lengths) - lengths
    start[heads[lengths > 0]] = True
    x = symbols.astype(np.uint64)
    one = np.empty_like(x)
    one[1:], one[start] = x[:-1], end
    two = np.empty_like(x)
    two[1:], two[start] = one[:-1], end
    return one << np.uint64(32) | two << np.uint64(16) | x


def root(counts: np.ndarray, alphabet: int) -> np.ndarray:
    """P(symbol) of all SYMBOLS numbers, of which ``alphabet`` are symbols; the others are never asked for."""
    types = int((counts > 0).sum())
    return (counts + types / alphabet) / (counts.sum() + types) if types else np.full(len(counts), 1 / alphabet)


def tested(first: np.ndarray, count: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(total, types, retained) of each context, whose grams start at ``first``; parent: the next symbols' probabilities under its suffix."""
    if not len(first):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
    sizes = np.diff(np.append(first, len(count)))
    total, types = np.add.reduceat(count, first), np.add.reduceat((count > 0).astype(np.int64), first)
    others = np.repeat(types, sizes) - (count == 1)
    rest = np.repeat(total, sizes) - 1 + others
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = (np.maximum(count - 1, 0) / parent + others) / rest
        gain = np.where((count > 0) & (rest > 0), count * np.log(ratio), 0.0)
    return total, types, (total > 1) & (np.add.reduceat(gain, first) > 0)


def smoothed(count: np.ndarray, total: np.ndarray, types: np.ndarray, kept: np.ndarray, parent: np.ndarray) -> np.ndarray:
    return np.where(kept, (count + types * parent) / np.maximum(total + types, 1), parent)


def heads(names: np.ndarray) -> np.ndarray:
    """Where runs of equal names start."""
    return np.flatnonzero(np.r_[True, names[1:] != names[:-1]]) if len(names) else np.zeros(0, dtype=np.int64)


class Grams:
    """The tree below some nearest symbols, from all their grams (sorted distinct ``key`` with ``count``).

    ``pairs`` (sorted key of nearest and next symbol, count) are the first level's where the grams of a nearest symbol are
    only a share of all.
    """

    def __init__(self, key: np.ndarray, count: np.ndarray, base: np.ndarray, pairs: tuple[np.ndarray, np.ndarray] | None = None):
        pair = (key >> np.uint64(32)) << np.uint64(16) | (key & np.uint64(0xFFFF))
        if pairs is None:
            names, at = np.unique(pair, return_inverse=True)
            n = np.bincount(at, weights=count, minlength=len(names)).astype(np.int64)
        else:
            names = np.union1d(pairs[0], pair)
            n = np.zeros(len(names), dtype=np.int64)
            n[np.searchsorted(names, pairs[0])] = pairs[1]
            at = np.searchsorted(names, pair)
        own = names >> np.uint64(16)
        first = heads(own)
        self.nearest = own[first].astype(np.int64)
        below = base[(names & np.uint64(0xFFFF)).astype(np.int64)]
        self.total, self.types, self.kept = tested(first, n, below)
        which = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(n))))
        parent = smoothed(n, self.total[which], self.types[which], self.kept[which], below)[at]
        #: Of each gram: the count of its nearest and next symbol; and of its whole context, where that is retained, (total, types, count).
        self.pair_count = n[at]
        first = heads(key >> np.uint64(16))
        total, types, kept = tested(first, count, parent)
        which = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(count))))
        self.deep = kept[which]
        self.deep_total, self.deep_types, self.count = total[which], types[which], count


def probabilities(key: np.ndarray, base: np.ndarray, level: tuple[np.ndarray, np.ndarray, np.ndarray], pair_count: np.ndarray, deep: np.ndarray, deep_total: np.ndarray, deep_types: np.ndarray, count: np.ndarray) -> np.ndarray:
    """P(next symbol | longest retained suffix) of each gram; level: (total, types, retained) of every symbol as a context."""
    near, x = (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFF)).astype(np.int64)
    total, types, kept = level
    p = smoothed(pair_count, total[near], types[near], kept[near], base[x])
    p[deep] = (count + deep_types * p[deep]) / (deep_total + deep_types)
    return p
