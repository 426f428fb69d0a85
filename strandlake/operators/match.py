"""Lookups in the index: exact k-mers, suffix intervals, and k-bounded matching statistics of reads.

The index is cut into blocks of consecutive ranks, whose reversed k-mers are a sorted array in the task that has the block.
Read positions find their block by the blocks' first keys. An interval that crosses a block's edge is put together from the
parts that the blocks at its ends report: no more than 2 k of a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.sequences import IUPAC, LITERAL_BASES
from strandlake.storage import spread

#: Ranks of a block at least; what is sent to all tasks is one key and 2 k prefixes of each of MOST_BLOCKS blocks at most.
BLOCK_ROWS, MOST_BLOCKS = 65_536, 16_384
#: Read positions of a block in one task, about; positions made at once.
SALT_ROWS, CHUNK = 200_000, 100_000

POSITIONS = "block int, salt int, record_no long, pos int, q binary"
STATS = "record_no long, pos int, ms int, lo long, hi long, unique boolean, tail long"
#: Four-bit codes of bases, by byte; anything else reads as N.
CODES = np.full(256, IUPAC.index("N"), dtype=np.int64)
CODES[np.frombuffer(IUPAC.encode(), dtype=np.uint8)] = np.arange(len(IUPAC))


def search(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(kmer, rank) of the queries that are in the index."""
    return queries.join(index.where("not is_dummy").select("kmer", "rank"), "kmer")


def misses(index: DataFrame, queries: DataFrame) -> DataFrame:
    return queries.join(index.where("not is_dummy").select("kmer"), "kmer", "left_anti")


def access(index: DataFrame, ranks: DataFrame) -> DataFrame:
    """(rank, kmer) of each rank."""
    return ranks.join(index.select("rank", "kmer"), "rank")


def fixed(column: pa.ChunkedArray, k: int) -> np.ndarray:
    """A column of strings of k bytes as a NumPy array of them."""
    column = column.cast(pa.binary()).combine_chunks()
    if not len(column):
        return np.empty(0, dtype=f"S{k}")
    start = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8, count=len(column) * k, offset=start).view(f"S{k}")


def matrix(keys: np.ndarray, k: int) -> np.ndarray:
    return keys.view(np.uint8).reshape(-1, k)


def shared_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading bytes the rows of two matrices share."""
    same = np.logical_and.accumulate(a == b, axis=1)
    return same.sum(axis=1)


def leading(keys: np.ndarray, wide: int, k: int) -> np.ndarray:
    """The first k bytes of keys of ``wide``."""
    return keys if wide == k else np.ascontiguousarray(matrix(keys, wide)[:, :k]).view(f"S{k}").ravel()


def prefixes(keys: np.ndarray, lengths: np.ndarray, k: int, fill: int = 0) -> np.ndarray:
    """The keys' first bytes, filled up to k."""
    return np.where(np.arange(k)[None] < lengths[:, None], matrix(keys, k), np.uint8(fill)).view(f"S{k}").ravel()


def block_intervals(keys: np.ndarray, rank: int, k: int, lengths: range) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, rows, first, behind) of the runs of keys with one prefix of that length; prefixes with padding are left out."""
    m = matrix(keys, k)
    same = np.append(0, shared_prefix(m[1:], m[:-1]))
    pad = np.where((m == ord("$")).any(axis=1), (m == ord("$")).argmax(axis=1), k)
    for n in lengths:
        first = np.flatnonzero((same < n) | (np.arange(len(keys)) == 0))
        behind = np.append(first[1:], len(keys))
        real = pad[first] >= n
        yield n, first[real], first[real] + rank, behind[real] + rank


def intervals(index: DataFrame, shortest: int, longest: int, only_edges: bool = False, rows: int = BLOCK_ROWS) -> DataFrame:
    """(reversed, lo, hi): the half-open range of ranks below each suffix of a length in range; no padding inside.

    ``only_edges``: of those alone that a block's first or last key has, but for the parts that other blocks have.
    """

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by("rank")
        width = len(block.column("rkmer")[0].as_py())
        keys, rank = fixed(block.column("rkmer"), width), block.column("rank")[0].as_py()
        out: list = [[], [], [], []]
        for n, at, lo, hi in block_intervals(keys, rank, width, range(shortest, min(longest, width) + 1)):
            edge = (lo == rank) | (hi == rank + len(keys))
            keep = edge if only_edges else np.ones(len(at), dtype=bool)
            raw = np.ascontiguousarray(matrix(keys, width)[at[keep], :n])
            names = pa.Array.from_buffers(pa.string(), len(raw), [None, pa.py_buffer((np.arange(len(raw) + 1) * n).astype(np.int32)), pa.py_buffer(raw)])
            for column, values in zip(out, (names, pa.array(lo[keep]), pa.array(hi[keep]), pa.array(edge[keep])), strict=True):
                column.append(values)
        kinds = pa.string(), pa.int64(), pa.int64(), pa.bool_()
        return pa.table([pa.chunked_array(c, t) for c, t in zip(out, kinds, strict=True)], names=["reversed", "lo", "hi", "edge"])

    found = index.select("rank", "rkmer").groupBy(F.expr(f"rank div {rows}").alias("block")).applyInArrow(run, "reversed string, lo long, hi long, edge boolean")
    joined = found.where("edge").groupBy("reversed").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return joined if only_edges else found.where("not edge").drop("edge").unionAll(joined)


def windows(reads: pa.RecordBatch, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(record numbers, positions, the last k bases up to each, reversed) of all positions of reads (record_no, seq), some at a time."""
    column = reads.column(1).cast(pa.string()).fill_null("")
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[bounds[0] : bounds[-1]]
    sizes, numbers = np.diff(bounds)[::-1], reads.column(0).to_numpy()[::-1]
    read = np.repeat(np.arange(len(sizes)), sizes)
    line = np.zeros(len(data) + k * (len(sizes) + 1), dtype=np.uint8)  # reads back to front, nothing behind each
    at = np.arange(len(data)) + k * read
    line[at] = data[::-1]
    pos = np.repeat(np.cumsum(sizes), sizes) - 1 - np.arange(len(data))
    every = np.lib.stride_tricks.sliding_window_view(line, k) if len(data) else None
    for a in range(0, len(data), CHUNK):
        part = slice(a, a + CHUNK)
        yield numbers[read[part]], pos[part], np.ascontiguousarray(every[at[part]]).view(f"S{k}").ravel()


class Lookup:
    """Matches of reversed windows in the sorted keys of a block, whose next block starts with ``behind``."""

    def __init__(self, keys: np.ndarray, rank: int, k: int, behind: np.ndarray):
        self.own, self.rank, self.k = len(keys), rank, k
        self.keys = np.concatenate([keys, behind])

    def find(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(matched length, first, behind): places of the keys below the match, in this block."""
        k, keys = self.k, self.keys
        at, own = np.searchsorted(keys, q), matrix(q, self.k)
        m = matrix(keys, k)
        below, above = shared_prefix(own, m[np.maximum(at - 1, 0)]), shared_prefix(own, m[np.minimum(at, len(keys) - 1)])
        ms = np.maximum(below, above) if len(keys) else np.zeros(len(q), dtype=np.int64)
        whole = keys[: self.own]
        lo = np.searchsorted(whole, prefixes(q, ms, k))
        return ms, lo, np.where(ms == k, lo + 1, np.searchsorted(whole, prefixes(q, ms, k, 0xFF)))


def matching_statistics(index: DataFrame, reads: DataFrame, k: int, unique: DataFrame | None = None) -> DataFrame:
    """(record_no, pos, ms, lo, hi, unique, tail) of each read position.

    ms: the longest suffix, of k bases at most, that the read up to pos shares with a node; lo and hi: its ranks; unique:
    whether it is a node in ``unique`` (rank); tail: the last LITERAL_BASES bases up to pos in four bits each, the last one lowest.

    Positions are dealt out by blocks, a block with very many of them further by a salt; its keys go to each share.
    """
    n = index.count()
    rows = max(BLOCK_ROWS, -(-n // MOST_BLOCKS))
    spark, blocks = index.sparkSession, max(1, -(-n // rows))
    firsts = np.array([r[0].encode() for r in index.where(F.pmod("rank", F.lit(rows)) == 0).orderBy("rank").select("rkmer").collect()], dtype=f"S{k}")
    edges: dict[bytes, tuple[int, int]] = {}
    if blocks > 1:
        edges = {r["reversed"].encode(): (r["lo"], r["hi"]) for r in intervals(index, 1, k, only_edges=True, rows=rows).collect()}
    reads = spread(reads.select(F.col("record_no").cast("long"), "seq").where("length(seq) > 0"))
    sent = spark.sparkContext.broadcast((firsts, edges))
    wide = max(k, LITERAL_BASES)

    def block_of(q: np.ndarray) -> np.ndarray:
        return np.maximum(np.searchsorted(sent.value[0], leading(q, wide, k), side="right") - 1, 0)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(blocks, dtype=np.int64)
        for batch in batches:
            for _, _, q in windows(batch, wide):
                total += np.bincount(block_of(q), minlength=blocks)
        yield pa.record_batch([pa.array(np.flatnonzero(total).astype(np.int32)), pa.array(total[total > 0])], names=["block", "n"])

    if blocks > 1:
        loads = {r["block"]: r["n"] for r in reads.mapInArrow(counts, "block int, n long").groupBy("block").agg(F.sum("n").alias("n")).collect()}
    else:
        loads = {0: reads.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()[0]}
    shares = np.array([max(1, -(-loads.get(b, 0) // SALT_ROWS)) for b in range(blocks)])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for record, pos, q in windows(batch, wide):
                block = block_of(q)
                salt = (record * 1_000_003 + pos // 256) % shares[block]
                raw = pa.Array.from_buffers(pa.binary(), len(q), [None, pa.py_buffer((np.arange(len(q) + 1) * wide).astype(np.int32)), pa.py_buffer(q.view(np.uint8))])
                yield pa.record_batch([pa.array(block.astype(np.int32)), pa.array(salt.astype(np.int32)), pa.array(record), pa.array(pos.astype(np.int32)), raw], names=[f.split()[0] for f in POSITIONS.split(", ")])

    marked = index.select("rank", "rkmer") if unique is None else index.select("rank", "rkmer").join(unique.select("rank", F.lit(True).alias("unique")), "rank", "left")
    keys = marked.select("rank", "rkmer", F.lit(False).alias("unique") if unique is None else F.coalesce("unique", F.lit(False)).alias("unique"), F.expr(f"cast(rank div {rows} as int)").alias("block"))
    salts = spark.createDataFrame([(b, s) for b in loads for s in range(int(shares[b]))], "block int, salt int")
    salted = keys.join(F.broadcast(salts), "block")

    def run(asked: pa.Table, own: pa.Table) -> pa.Table:
        firsts, edges = sent.value
        if not len(asked):
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())], names=[f.split()[0] for f in STATS.split(", ")])
        own = own.sort_by("rank")
        block, flags = asked.column("block")[0].as_py(), own.column("unique").to_numpy()
        start = own.column("rank")[0].as_py() if len(own) else 0
        lookup, q = Lookup(fixed(own.column("rkmer"), k), start, k, firsts[block + 1 : block + 2]), fixed(asked.column("q"), wide)
        parts: list = [[] for _ in range(5)]
        for a in range(0, len(q), CHUNK):
            part = leading(q[a : a + CHUNK], wide, k)
            ms, lo, hi = lookup.find(part)
            single = np.zeros(len(ms), dtype=bool)
            exact = ms == k
            single[exact] = flags[lo[exact]]
            if edges:
                open_ = np.flatnonzero((ms > 0) & (((lo == 0) & (block > 0)) | ((hi == lookup.own) & (block + 1 < len(firsts)))))
                names = prefixes(part[open_], ms[open_], k).tolist()
                lo, hi = lo + start, hi + start
                for i, name in zip(open_.tolist(), names, strict=True):
                    if name in edges:
                        lo[i], hi[i] = edges[name]
            else:
                lo, hi = lo + start, hi + start
            codes, tail = CODES[matrix(q[a : a + CHUNK], wide)[:, :LITERAL_BASES]], np.zeros(len(ms), dtype=np.int64)
            for i in range(codes.shape[1]):
                tail |= codes[:, i] << 4 * i
            for column, values in zip(parts, (ms, lo, hi, single, tail), strict=True):
                column.append(values)
        ms, lo, hi, single, tail = map(np.concatenate, parts)
        none = ms == 0
        columns = [asked.column("record_no"), asked.column("pos"), pa.array(ms.astype(np.int32)), pa.array(lo, mask=none), pa.array(hi, mask=none), pa.array(single), pa.array(tail)]
        return pa.table(columns, names=[f.split()[0] for f in STATS.split(", ")])

    return reads.mapInArrow(dealt, POSITIONS).groupBy("block", "salt").cogroup(salted.groupBy("block", "salt")).applyInArrow(run, STATS)
