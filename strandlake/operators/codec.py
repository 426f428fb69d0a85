"""Integer codes of blocks: Rice and minimal binary, then gzip, over NumPy arrays; and their exact sizes as aggregates.

Bits run from the most significant one of each 64-bit word on; words are little-endian on disk.
"""

from __future__ import annotations

import gzip
import zlib
from enum import Enum

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class EncodeError(ValueError):
    pass


class DecodeError(ValueError):
    pass


class Codec(Enum):
    RICE = "rice"
    MINIMAL_BINARY = "minimal_binary"


def to_words(bits: np.ndarray) -> np.ndarray:
    packed = np.packbits(np.pad(bits, (0, -len(bits) % 64)))
    return packed.view(">u8").astype("<u8")


def to_bits(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(words.astype(">u8").view(np.uint8))


def put(bits: np.ndarray, at: np.ndarray, values: np.ndarray, widths: np.ndarray) -> None:
    """Writes each value's low ``widths`` bits from ``at`` on, most significant first."""
    for k in range(int(widths.max(initial=0))):
        rows = np.flatnonzero(widths > k)
        bits[at[rows] + k] = values[rows] >> (widths[rows] - 1 - k).astype(values.dtype) & values.dtype.type(1)


def rice_parameter(ints: np.ndarray) -> int:
    """The smallest parameter of least total size."""
    return min(range(33), key=lambda b: (int((ints >> np.uint64(b)).sum()) + len(ints) * (1 + b), b)) if len(ints) else 0


def rice_encode(ints: np.ndarray) -> tuple[np.ndarray, int]:
    b = rice_parameter(ints)
    high = (ints >> np.uint64(b)).astype(np.int64)
    size = high + 1 + b
    at = np.cumsum(size) - size
    bits = np.zeros(int(size.sum()), dtype=np.uint8)
    bits[at + high] = 1
    put(bits, at + high + 1, ints, np.full(len(ints), b))
    return to_words(bits), b


def numbers(bits: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The numbers of ``width`` bits from each place on; behind the end all bits are 0."""
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(width):
        here = at + k
        out = out << np.uint64(1) | np.where(here < len(bits), bits[np.minimum(here, len(bits) - 1)], 0).astype(np.uint64) if len(bits) else out
    return out


def rice_decode(words: np.ndarray, n: int, b: int) -> np.ndarray:
    bits = to_bits(words)
    ones = np.append(np.flatnonzero(bits), len(bits))
    # The next one from each place on; only the walk from value to value is a loop.
    following = memoryview(ones[np.searchsorted(ones, np.arange(len(bits) + 1))])
    at, stops, end = 0, np.empty(n, dtype=np.int64), len(bits)
    for i in range(n):
        if at >= end or (stop := following[at]) >= end:
            raise DecodeError("a Rice stream ends early")
        stops[i] = stop
        at = stop + 1 + b
    if at > end:
        raise DecodeError("a Rice stream ends early")
    starts = np.append(0, stops[:-1] + 1 + b) if n else stops
    return (stops - starts).astype(np.uint64) << np.uint64(b) | numbers(bits, stops + 1, b)


def bound(ints: np.ndarray) -> int:
    """Upper bound of the values plus one."""
    return int(ints.max(initial=0)) + 2


def minimal_binary_encode(ints: np.ndarray) -> tuple[np.ndarray, int]:
    u = bound(ints)
    low = u.bit_length() - 1
    limit = np.uint64((2 << low) - u)
    v = ints + np.uint64(1)
    long = v >= limit
    widths = np.where(long, low + 1, low)
    at = np.cumsum(widths) - widths
    bits = np.zeros(int(widths.sum()), dtype=np.uint8)
    put(bits, at, np.where(long, v + limit, v), widths)
    return to_words(bits), u


def minimal_binary_decode(words: np.ndarray, n: int, u: int) -> np.ndarray:
    bits = to_bits(words)
    low = u.bit_length() - 1
    limit = (2 << low) - u
    short = numbers(bits, np.arange(len(bits)), low)
    longer = memoryview((short >= np.uint64(limit)).view(np.uint8))
    at, starts, end = 0, np.empty(n, dtype=np.int64), len(bits)
    for i in range(n):
        if at + low > end or (low and at >= end):
            raise DecodeError("a minimal binary stream ends early")
        starts[i] = at
        at += low + longer[at] if at < end else low
    if at > end:
        raise DecodeError("a minimal binary stream ends early")
    if not len(bits):
        return np.zeros(n, dtype=np.uint64)
    value = short[np.minimum(starts, end - 1)]
    return np.where(value >= np.uint64(limit), (value << np.uint64(1) | numbers(bits, starts + low, 1)) - np.uint64(limit), value) - np.uint64(1)


def deflate(data: bytes) -> bytes:
    return gzip.compress(data, mtime=0)


def inflate(data: bytes) -> bytes:
    try:
        return gzip.decompress(data)
    except (OSError, EOFError, zlib.error) as e:
        raise DecodeError(f"a payload can't be inflated: {e}") from e


def compress(ints: np.ndarray, codec: Codec) -> tuple[bytes, int, int]:
    """(payload, number of words, parameter); an empty stream is legal."""
    words, parameter = (rice_encode if codec is Codec.RICE else minimal_binary_encode)(ints.astype(np.uint64))
    return deflate(words.astype("<u8").tobytes()), len(words), parameter


def decompress(payload: bytes, n: int, n_words: int, parameter: int, codec: Codec) -> np.ndarray:
    words = np.frombuffer(inflate(payload), dtype="<u8")
    if len(words) != n_words:
        raise DecodeError(f"{len(words)} words where the header has {n_words}")
    return (rice_decode if codec is Codec.RICE else minimal_binary_decode)(words, n, parameter)


def rice_sizes(values: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, param, bits): the exact size of each group's stream under its best Rice parameter."""
    sums = values.groupBy(group).agg(F.count("*").alias("n"), *(F.sum(F.shiftright(F.col(value).cast("long"), b)).alias(f"s{b}") for b in range(33)))
    sizes = F.array(*(F.struct((F.col(f"s{b}") + F.col("n") * (1 + b)).alias("bits"), F.lit(b).alias("param")) for b in range(33)))
    best = F.array_min(sizes)
    return sums.select(group, "n", best["param"].alias("param"), best["bits"].alias("bits"))


def minimal_binary_sizes(values: DataFrame, group: str, value: str) -> DataFrame:
    """(group, n, param, bits): the exact size of each group's stream in minimal binary; param is the bound."""
    bounds = values.groupBy(group).agg((F.max(value) + 2).cast("long").alias("param"))
    low = (F.length(F.bin("param")) - 1).cast("int")
    widths = values.join(bounds, group).select(group, "param", (low + ((F.col(value) + 1) >= F.expr("shiftleft(2L, cast(length(bin(param)) - 1 as int))") - F.col("param")).cast("int")).alias("w"))
    return widths.groupBy(group, "param").agg(F.count("*").alias("n"), F.sum("w").alias("bits")).select(group, "n", "param", "bits")
