"""Whole-text BPE ids, equal to the tokenizers library's, from the distinct pre-tokens of a run of texts.

The bytes of a run are classed (letters, digits, marks, white space), and pre-tokens are cut where the tokenizer's own rules cut
them: all in arrays. Arrow's dictionary encoding leaves the distinct ones, a bounded memo has the ids of most, and a take puts
the texts together again. New pre-tokens are merged by the merge list of the library's file in array form; every 64th is
checked against the library, and a difference is an error.

A segment is a run of white space with what follows up to the next one; no pre-token spans two segments. One with a byte whose
class isn't certain from the bytes alone (an apostrophe, a control character, letters beyond Latin-1, what may spell a special
token) goes to the library as a whole; a text whose segments have other white space inside goes there as a text.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from strandlake.llm.array_bpe import ArrayBPE

#: Pre-tokens in each of the two generations of the memo; some 200 bytes each.
MEMO = 250_000
#: Of the merged pre-tokens, one in so many is held against the library.
CHECKED = 64
#: Longer pre-tokens are merged by the library, whose time grows less with their length.
LONGEST = 64
#: Anything that either Python or the library may take for white space.
SPACES = re.compile("[\\s\x1c-\x1f\x85᠎​⁠﻿]")
ASCII_SPACE = " \t\n\x0b\x0c\r"
UNCERTAIN = re.compile(rb"['|\x00-\x08\x0e-\x1f\x7f\xc2\xc4-\xff]|\xc3[\x97\xb7]")
LETTER, DIGIT, MARK, WHITE, HARD = range(1, 6)


def byte_classes() -> np.ndarray:
    """The class of each byte; the two bytes of a Latin-1 letter are letters."""
    out = np.full(256, HARD, dtype=np.uint8)
    for b in range(33, 127):
        c = chr(b)
        out[b] = HARD if c in "'|" else LETTER if c.isalpha() else DIGIT if c.isdigit() else MARK
    out[[ord(c) for c in ASCII_SPACE]] = WHITE
    out[0x80:0xC0] = out[0xC3] = LETTER
    return out


CLASSES = byte_classes()


def packed(ids) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


class Memo:
    """Pre-token to ids in two generations: once the young one is full it becomes the old one."""

    def __init__(self, size: int = MEMO):
        self.size, self.young, self.old = size, {}, {}

    def absent(self, pieces: list[bytes]) -> list[bytes]:
        """Those of ``pieces`` without an entry; the others are young afterwards."""
        out, young, old = [], self.young, self.old
        for p in pieces:
            if p not in young:
                if p in old:
                    young[p] = old[p]
                else:
                    out.append(p)
        return out

    def shrink(self) -> None:
        if len(self.young) > self.size:
            self.old, self.young = self.young, {}


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings end to end, null as empty, and the len + 1 bounds of its values."""
    column = pc.fill_null(column, "").cast(pa.string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return whole[bounds[0] : bounds[-1]], bounds - bounds[0]


class PieceBPE:
    """The encoder of one tokenizer file; subclasses say where pre-tokens start."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.arrays, self.memo = Tokenizer.from_file(path), ArrayBPE(path), Memo()

    def whole(self, text: str) -> bytes:
        return packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def starts(self, data: np.ndarray, kind: np.ndarray, white: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Where pre-tokens start; ``last``: bytes that end a text."""
        raise NotImplementedError

    def raw(self, piece: bytes) -> bytes:
        """The bytes of a pre-token that are merged."""
        return piece

    def merged(self, words: list[bytes]) -> list[bytes]:
        return self.arrays.merge(words)

    def cut(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """The bounds of all pre-tokens."""
        kind = CLASSES[data]
        at = np.flatnonzero(data[:-1] == 0xC3)
        kind[at[(data[at + 1] == 0x97) | (data[at + 1] == 0xB7)]] = HARD  # signs of multiplication and division
        white = kind == WHITE
        first, last = np.zeros(len(data), dtype=bool), np.zeros(len(data), dtype=bool)
        inner = bounds[:-1][bounds[:-1] < bounds[1:]]
        first[inner] = True
        last[bounds[1:][bounds[:-1] < bounds[1:]] - 1] = True
        found = self.starts(data, kind, white, last) | first
        hard = kind == HARD
        if hard.any():
            heads = white.copy()
            heads[1:] &= ~white[:-1]
            heads = np.flatnonzero(heads | first)
            inside = np.repeat(np.logical_or.reduceat(hard, heads), np.diff(np.append(heads, len(data))))
            found &= ~inside
            found[heads] = True
        return np.append(np.flatnonzero(found), len(data))

    def fill(self, pieces: list[bytes]) -> None:
        """Entries for new pre-tokens; None for one with white space of other kinds inside."""
        plain, young = [], self.memo.young
        for piece in pieces:
            if UNCERTAIN.search(piece):
                text = piece.decode()
                young[piece] = None if SPACES.search(text.lstrip(ASCII_SPACE)) else self.whole(text)
            elif len(piece) > LONGEST:
                young[piece] = self.whole(piece.decode())
            else:
                plain.append(piece)
        young.update(zip(plain, self.merged([self.raw(p) for p in plain]), strict=True))
        for piece in plain[::CHECKED]:
            if young[piece] != self.whole(piece.decode()):
                raise ValueError(f"merging {piece!r} gives other ids than the tokenizers library")

    def units(self, column: pa.Array) -> tuple[list[bytes | None], pa.Array, np.ndarray]:
        """(ids of the distinct pre-tokens, their numbers in order, bounds of each text in these)."""
        data, bounds = text_bytes(column)
        if not len(data):
            return [], pa.array([], pa.int32()), np.zeros(len(column) + 1, dtype=np.int64)
        cuts = self.cut(data, bounds)
        pieces = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(data)])
        coded = pieces.dictionary_encode()
        names = coded.dictionary.to_pylist()
        self.fill(self.memo.absent(names))
        ids = list(map(self.memo.young.__getitem__, names))
        self.memo.shrink()
        return ids, coded.indices, np.searchsorted(cuts, bounds)

    @staticmethod
    def assembled(values: list[bytes] | pa.Array, numbers: pa.Array, bounds: np.ndarray) -> list[bytes]:
        """The values by ``numbers``, joined text by text."""
        taken = (values if isinstance(values, pa.Array) else pa.array(values, pa.binary())).take(numbers)
        if not len(taken):
            return [b""] * (len(bounds) - 1)
        at = np.frombuffer(taken.buffers()[1], dtype=np.int32)[bounds].tolist()
        data = memoryview(taken.buffers()[2] or b"")
        return [bytes(data[a:b]) for a, b in zip(at, at[1:], strict=False)]

    def encode_column(self, column: pa.Array) -> list[bytes]:
        """Each text's ids as packed little-endian unsigned 32-bit integers; of null, those of an empty text."""
        ids, numbers, bounds = self.units(column)
        out = self.assembled([v or b"" for v in ids], numbers, bounds)
        for i in self.unknown(ids, numbers, bounds):
            out[i] = self.whole(column[i].as_py())
        return out

    @staticmethod
    def unknown(ids: list[bytes | None], numbers: pa.Array, bounds: np.ndarray) -> list[int]:
        """The texts with a pre-token that has no ids."""
        lacking = [i for i, v in enumerate(ids) if v is None]
        if not lacking:
            return []
        at = np.flatnonzero(np.isin(numbers.to_numpy(), lacking))
        return np.unique(np.searchsorted(bounds, at, side="right") - 1).tolist()

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        return self.encode_column(pa.array(texts, pa.string()))


class ByteBPE(PieceBPE):
    """One space leads what follows it; of a longer run of white space all but the last character is a pre-token, at a text's end all of it."""

    def starts(self, data: np.ndarray, kind: np.ndarray, white: np.ndarray, last: np.ndarray) -> np.ndarray:
        out = np.ones(len(data), dtype=bool)
        out[1:] = kind[1:] != kind[:-1]
        out[1:] &= white[1:] | (data[:-1] != 0x20)
        out[1:-1] |= white[1:-1] & white[:-2] & ~white[2:] & ~last[1:-1]
        return out


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBPE:
    """One encoder for each Python worker."""
    return ByteBPE(path)


def text_runs(column: pa.Array, most: int = 4_000_000):
    """(start, part) of the parts of an Arrow column of about ``most`` bytes, one text at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + most, side="right")))
        yield start, column.slice(start, stop - start)
        start = stop
