"""A minimal acyclic transducer from words to token ids.

Sorted words are added one by one; a state that can't change any more is replaced by an equal one that exists already, so
words share suffixes as well as prefixes. Each edge carries how many words precede those behind it; along a word's path
these add up to its number, which is where the output array has its ids. The frozen form is a few flat arrays in one
byte string, that a worker maps into memory from an unlinked temporary file.
"""

from __future__ import annotations

import tempfile

import numpy as np

FIELDS = (("keys", "<i8"), ("targets", "<i4"), ("skips", "<i4"), ("final", "|u1"), ("starts", "<i8"), ("ids", "<u4"))


def build(entries: dict[bytes, bytes]) -> bytes:
    """The frozen transducer of words and their packed ids; as many states at most as the words have bytes, and one."""
    words = sorted(w for w in entries if w)
    edges: list[dict[int, int]] = [{}]
    final = [False]
    known: dict[tuple, int] = {}
    path = [0]

    def settle(depth: int, word: bytes) -> None:
        while len(path) - 1 > depth:
            state, parent, label = path.pop(), path[-1], word[len(path) - 1]
            same = known.setdefault((final[state], *edges[state].items()), state)
            edges[parent][label] = same

    last = b""
    for word in words:
        common = next((i for i, (a, b) in enumerate(zip(last, word, strict=False)) if a != b), min(len(last), len(word)))
        settle(common, last)
        for label in word[common:]:
            edges.append({})
            final.append(False)
            edges[path[-1]][label] = len(edges) - 1
            path.append(len(edges) - 1)
        final[path[-1]] = True
        last = word
    settle(0, last)

    number, order, stack = {0: 0}, [0], [0]
    while stack:
        for target in edges[stack.pop()].values():
            if target not in number:
                number[target] = len(order)
                order.append(target)
                stack.append(target)
    counts: dict[int, int] = {}
    todo = [(0, False)]
    while todo:  # a state's count follows its targets'
        state, ready = todo.pop()
        if ready:
            counts[state] = final[state] + sum(counts[t] for t in edges[state].values())
        elif state not in counts:
            todo.append((state, True))
            todo.extend((t, False) for t in edges[state].values() if t not in counts)
    rows = []
    for state in order:
        skip = int(final[state])
        for label, target in sorted(edges[state].items()):
            rows.append((number[state] << 8 | label, number[target], skip))
            skip += counts[target]
    rows.sort()
    keys, targets, skips = zip(*rows, strict=True) if rows else ((), (), ())
    packed = [entries[w] for w in words]
    arrays = (keys, targets, skips, [final[s] for s in order], np.cumsum([0, *(len(p) // 4 for p in packed)]), np.frombuffer(b"".join(packed), dtype="<u4"))
    flat = [np.asarray(a, dtype=kind) for a, (_, kind) in zip(arrays, FIELDS, strict=True)]
    return np.array([len(a) for a in flat], dtype="<i8").tobytes() + b"".join(a.tobytes() for a in flat)


class Lexicon:
    def __init__(self, frozen: bytes):
        with tempfile.TemporaryFile() as f:
            f.write(frozen)
            f.flush()
            mapped = np.memmap(f, mode="r")
        sizes, at = mapped[: 8 * len(FIELDS)].view("<i8"), 8 * len(FIELDS)
        for (name, kind), size in zip(FIELDS, sizes.tolist(), strict=True):
            width = np.dtype(kind).itemsize
            setattr(self, name, np.frombuffer(mapped, dtype=kind, count=size, offset=at))
            at += size * width

    def find(self, words: list[bytes]) -> list[bytes | None]:
        """The packed ids of each word; None where it isn't in the lexicon."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        order = np.argsort(-sizes, kind="stable")
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        starts = (np.cumsum(sizes) - sizes)[order]
        left = sizes[order]
        state, index = np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        alive = np.ones(len(words), dtype=bool) if len(self.keys) else np.zeros(len(words), dtype=bool)
        for step in range(int(left[0]) if len(words) else 0):
            rows = np.flatnonzero(alive[: np.searchsorted(-left, -step, side="left")])
            if not len(rows):
                break
            key = state[rows] << 8 | flat[starts[rows] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            alive[rows] = hit
            state[rows] = self.targets[at]
            index[rows] += self.skips[at]
        found = alive & (left > 0)
        found[found] = self.final[state[found]] == 1
        out: list[bytes | None] = [None] * len(words)
        hits = index[found]
        for i, a, b in zip(order[found].tolist(), self.starts[hits].tolist(), self.starts[hits + 1].tolist(), strict=True):
            out[i] = self.ids[a:b].tobytes()
        return out
