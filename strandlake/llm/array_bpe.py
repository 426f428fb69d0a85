"""Exact byte-pair merging of many words at once, over arrays.

All words of one byte length form a matrix of symbols. In each round every word merges its leftmost pair of lowest rank,
which is the order in which a merge list is to be applied; a word without a known pair leaves the matrix.
"""

from __future__ import annotations

import json

import numpy as np

NONE = np.int32(2**31 - 1)


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return [chr(b) if b in set(own) else chr(256 + rest.index(b)) for b in range(256)]


class ArrayBPE:
    """The merges of a byte-level tokenizer file. merge() gives packed little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, self.suffix = model["vocab"], model["end_of_word_suffix"] or ""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right, out = (np.array(x, dtype=np.int64) for x in zip(*((vocab[a], vocab[b], vocab[a + b]) for a, b in pairs), strict=True))
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), out.astype(np.int32)
        letters = byte_alphabet()
        self.inner = np.array([vocab[c] for c in letters], dtype=np.int32)
        self.final = np.array([vocab[c + self.suffix] for c in letters], dtype=np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, which is one pre-token."""
        out: list[bytes] = [b""] * len(words)
        if not words:
            return out
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        order = np.argsort(sizes, kind="stable")
        ends = np.flatnonzero(np.diff(sizes[order], append=-1)) + 1
        for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True):
            if b > a and (size := int(sizes[order[a]])):
                chosen = order[a:b].tolist()
                raw = np.frombuffer(b"".join([words[i] for i in chosen]), dtype=np.uint8).reshape(-1, size)
                self._merge_equal(raw, chosen, out)
        return out

    def _merge_equal(self, raw: np.ndarray, chosen: list[int], out: list[bytes]) -> None:
        symbols = self.inner[raw]
        symbols[:, -1] = self.final[raw[:, -1]]
        ids, size = np.array(chosen), symbols.shape[1]
        ranks = self.rank(symbols[:, :-1], symbols[:, 1:])
        while True:
            if size > 1:
                at = ranks.argmin(axis=1)
                best = ranks[np.arange(len(ranks)), at]
                done = best == NONE
            else:
                done = np.ones(len(ids), dtype=bool)
            if done.any():
                packed, width = np.ascontiguousarray(symbols[done], dtype="<u4").tobytes(), 4 * size
                for k, i in enumerate(ids[done].tolist()):
                    out[i] = packed[k * width : (k + 1) * width]
                if done.all():
                    return
                keep = ~done
                symbols, ranks, ids, at, best = symbols[keep], ranks[keep], ids[keep], at[keep], best[keep]
            rows, behind = np.arange(len(ids)), np.arange(size - 1)[None, :] > at[:, None]
            symbols[rows, at] = self.made[best]
            symbols = np.where(behind, symbols[:, 1:], symbols[:, :-1])
            size -= 1
            if size > 1:
                ranks = np.where(behind[:, :-1], ranks[:, 1:], ranks[:, :-1])
                before, after = at > 0, at < size - 1
                ranks[rows[before], at[before] - 1] = self.rank(symbols[rows[before], at[before] - 1], symbols[rows[before], at[before]])
                ranks[rows[after], at[after]] = self.rank(symbols[rows[after], at[after]], symbols[rows[after], at[after] + 1])
