"""Hierarchical residual packing of documents into sequences of bounded length.

A document's ids with the end id form one item; a longer one is cut into pieces of ``capacity`` tokens, the first of which
may be shorter. Each input partition packs its items by best fit, largest first. Bins of at least ``full`` of the capacity
are final. The others go up a tree as items: ``fan_in`` partitions at a time meet in one task, which packs the residual bins
again by best fit, until one partition is left. Texts and members never move up; a bin there is its size and the bins in it.

What goes up is bounded without loss. After best fit no two bins of a node fit together, so at most one of them is half full
or less, and of two bins that fit together one is. So all over the tree no more than as many bins as it has leaves look for
another one to go into, and a node need not pass on more bins than that besides its emptiest: any that fits into a fuller one
fits into an emptier one. The other bins are final.

Cases: a null or empty text is the end id alone. Rows are independent: null or repeated doc_ids stay as they are. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import cut
from strandlake.llm.memo_bpe import byte_bpe, packed, text_runs

MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])
MEMBER_DDL = "array<struct<doc_id:bigint,piece:int,start:bigint,length:bigint,ids_crc32:bigint,offset:bigint>>"
#: A bin within another one: the leaf's bin, and where it starts there.
PART = pa.struct([("bin", pa.int64()), ("shift", pa.int64())])
LEAF_DDL, NODE_DDL = f"bin long, size long, final boolean, members {MEMBER_DDL}", "size long, final boolean, parts array<struct<bin:bigint,shift:bigint>>"


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of item numbers: largest item first, each into the fullest bin that it fits, else a new one."""
    bins: list[list[int]] = []
    room: dict[int, list[int]] = {}  # residual -> bins
    levels: list[int] = []  # residuals that occur, ascending
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[item]
        at = bisect_left(levels, size)
        if at < len(levels):
            left = levels[at]
            chosen = room[left].pop()
            if not room[left]:
                del room[left], levels[at]
            bins[chosen].append(item)
        else:
            left, chosen = capacity, len(bins)
            bins.append([item])
        left -= size
        if left:
            if left not in room:
                room[left] = []
                insort(levels, left)
            room[left].append(chosen)
    return bins


def joined(items: list[tuple[int, list[dict]]], capacity: int, at: str) -> list[tuple[int, list[dict]]]:
    """Items (size, members) packed into bins of the same form, emptiest first; a member's ``at`` counts from the bin's start."""
    out = []
    for chosen in best_fit([size for size, _ in items], capacity):
        start, members = 0, []
        for i in chosen:
            members += [m | {at: m[at] + start} for m in items[i][1]]
            start += items[i][0]
        out.append((start, members))
    return sorted(out, key=lambda b: b[0])


def pieces(doc_id, ids: bytes, capacity: int) -> Iterator[dict]:
    n = len(ids) // 4
    first = n - (n - 1) // capacity * capacity
    for k, start in enumerate([0, *range(first, n, capacity)]):
        stop = first if k == 0 else start + capacity
        yield {"doc_id": doc_id, "piece": k, "start": start, "length": stop - start, "ids_crc32": zlib.crc32(ids[4 * start : 4 * stop]), "offset": 0}


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, full: float = 0.99, fan_in: int = 8) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each document."""

    def local(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, items = byte_bpe(tokenizer), []
        for batch in rows:
            ids = batch.column(0).to_pylist()
            for a, texts in text_runs(batch.column(1)):
                for doc_id, coded in zip(ids[a : a + len(texts)], bpe.encode_column(texts), strict=True):
                    items += [(p["length"], [p]) for p in pieces(doc_id, coded + packed([end_id]), capacity)]
        number, bins = TaskContext.get().partitionId() << 32, joined(items, capacity, "offset")
        for a in range(0, len(bins), 5_000):
            part = bins[a : a + 5_000]
            final = [i >= leaves or size >= full * capacity for i, (size, _) in enumerate(part, a)]
            columns = [pa.array(np.arange(a, a + len(part)) + number), pa.array([size for size, _ in part], pa.int64()), pa.array(final), pa.array([m for _, m in part], pa.list_(MEMBER))]
            yield pa.record_batch(columns, names=["bin", "size", "final", "members"])

    def merged(last: bool):
        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = [(size, parts) for batch in rows for size, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            bins = joined(items, capacity, "shift")
            final = [last or i >= leaves or size >= full * capacity for i, (size, _) in enumerate(bins)]
            yield pa.record_batch([pa.array([size for size, _ in bins], pa.int64()), pa.array(final, pa.bool_()), pa.array([p for _, p in bins], pa.list_(PART))], names=["size", "final", "parts"])

        return run

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    leaves = n = rows.rdd.getNumPartitions()
    leaf = cut(rows.mapInArrow(local, LEAF_DDL))
    level, done = leaf.where("not final").select("size", F.array(F.struct("bin", F.lit(0).cast("long").alias("shift"))).alias("parts")), None
    while done is None or n > 1:
        n = -(-n // fan_in)
        merged_bins = cut(level.coalesce(max(n, 1)).mapInArrow(merged(n <= 1), NODE_DDL))
        level, final = merged_bins.where("not final").select("size", "parts"), merged_bins.where("final").select("parts")
        done = final if done is None else done.unionAll(final)
    # A sequence is named after the first leaf bin in it.
    moved = done.select(F.element_at("parts", 1)["bin"].alias("sequence_id"), F.explode("parts").alias("p")).select("sequence_id", F.col("p.bin").alias("bin"), F.col("p.shift").alias("shift"))
    whole = leaf.where("final").select(F.col("bin").alias("sequence_id"), F.lit(0).cast("long").alias("shift"), "members")
    parts = leaf.where("not final").join(moved, "bin").select("sequence_id", "shift", "members")
    member = whole.unionAll(parts).select("sequence_id", "shift", F.explode("members").alias("m"))
    return member.select("m.doc_id", "m.piece", "m.start", "m.length", "m.ids_crc32", "sequence_id", (F.col("m.offset") + F.col("shift")).alias("offset"))
