"""Word shingles as hashed sets, and circulant MinHash signatures of them."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: White space of str.split() that is not among the separators of WORDS.
OTHER_SPACE = re.compile(r"[^\S\x20\x09-\x0D]")
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def words(text: str | None) -> list[str]:
    """Maximal runs without ASCII white space, A-Z lower-cased."""
    text = (text or "").translate(ASCII_LOWER)
    return WORDS.findall(text) if OTHER_SPACE.search(text) else text.split()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of the 64-bit integers that scatters them."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, bounded: the table starts anew once it is full."""

    def __missing__(self, word: str) -> int:
        if len(self) > 60_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(tokens: list[str], size: int, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of a document's shingles: of ``size`` words, or of all its words where it has fewer."""
    if not tokens:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(hashes.__getitem__, tokens), dtype=np.uint64, count=len(tokens))
    width = min(size, len(h))
    out = np.full(len(h) - width + 1, np.uint64(width), dtype=np.uint64)
    for k in range(width):  # a polynomial in the words' hashes, mixed at each step, so that order counts
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - width + 1 + k])
    return np.unique(out)


class CirculantMinHash:
    """Signatures from two permutations: the first scatters shingles over ``bins`` places, the second ranks the places.

    Coordinate k is the smallest rank among the document's places after shifting the second permutation circularly by k.
    The ranks are laid out once and again behind their end, so that the ranks of one place under all shifts lie side by
    side in memory.
    """

    def __init__(self, coordinates: int, bins: int = 1 << 20, seed: int = 11):
        ranks = np.random.default_rng(seed).permutation(bins).astype(np.uint32)
        self.coordinates, self.bins = coordinates, np.uint64(bins)
        self.rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([ranks, ranks[:coordinates]]), coordinates)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        places = np.unique(mixed(shingles + MIX[1]) % self.bins)
        out = np.full(self.coordinates, np.uint32(0xFFFFFFFF), dtype=np.uint32)
        for a in range(0, len(places), 2048):
            np.minimum(out, self.rows[places[a : a + 2048]].min(axis=0), out=out)
        return out


def bands_of(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit value for each band of ``rows`` coordinates."""
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for k in range(rows):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + signature[: bands * rows].reshape(bands, rows)[:, k].astype(np.uint64))
    return out.view(np.int64)
