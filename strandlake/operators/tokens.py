"""Reads as tokens: greedy parse from the right into references to the index and short literals.

A token is (record_no, tok_no, pos, len, ms, rank, is_literal, first, literal). Token 0 covers the end of the read. ``rank``
is the first rank of the interval matched at ``pos``; a token longer than k continues along unique predecessors.

Positions are dealt out by read once, and streamed twice in order: to the right for how far matches extend, to the left for the
parse. What is carried from batch to batch is a few numbers, whatever the length of a read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import sequences as S
from strandlake.operators.index import predecessors
from strandlake.operators.match import STATS, matching_statistics

RUNS = f"{STATS}, run int, tok_len int"
TOKENS = "record_no long, tok_no int, pos int, len int, ms int, rank long, is_literal boolean, first boolean, literal string"


def names(ddl: str) -> list[str]:
    return [f.split()[0] for f in ddl.split(", ")]


def extension_runs(index: DataFrame, reads: DataFrame, k: int, preds: DataFrame | None = None) -> DataFrame:
    """The statistics of all positions with (run, tok_len), sorted by read and position within partitions.

    run: how many positions in a row, up to this one, extend a match by its k-mer's only predecessor. tok_len: the length of the
    token that would end here, below the longest that a packed token holds; an unmatched base is a token of its own.
    """
    unique = (predecessors(index, k) if preds is None else preds).where("indeg = 1").select("rank")
    stats = matching_statistics(index, reads, k, unique)
    most = (S.TOKEN_BASES - 1) // k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record, before, stop = None, 0, 0  # of the last row: its read, ms, and the last position that doesn't extend
        for batch in batches:
            if not len(batch):
                continue
            rec, pos, ms = (batch.column(i).to_numpy() for i in range(3))
            unique = batch.column(5).to_numpy(zero_copy_only=False)
            last = np.append(before if rec[0] == record else -1, ms[:-1])
            extends = (pos >= k + 1) & (ms == k) & (last == k) & unique
            at = np.maximum.accumulate(np.where(extends, -1, np.arange(len(rec))))  # position 0 never extends
            stops = np.where(at >= 0, pos[at], stop)
            runs = pos - stops
            long = (ms == k) & (pos >= k + 1)
            lengths = np.where(long, np.minimum((runs + k - 1) // k, most) * k + 1, np.maximum(ms, 1))
            record, before, stop = rec[-1], ms[-1], stops[-1]
            yield pa.record_batch([*batch.columns, pa.array(runs.astype(np.int32)), pa.array(lengths.astype(np.int32))], names=names(RUNS))

    return stats.repartition("record_no").sortWithinPartitions("record_no", "pos").mapInArrow(run, RUNS)


def literals(tail: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The last ``lengths`` bases of four-bit tails."""
    chars = np.frombuffer(S.IUPAC.encode(), dtype=np.uint8)[(tail[:, None] >> 4 * np.arange(S.LITERAL_BASES - 1, -1, -1)[None]) & 15]
    inside = np.arange(S.LITERAL_BASES)[None] >= S.LITERAL_BASES - lengths[:, None]
    offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(tail), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(chars[inside]))])


def parse(runs: DataFrame) -> DataFrame:
    """TOKENS of reads whose positions are together in a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        record, skip, tok = None, 0, 0  # the read of the last row, rows of it that a token covers still, its next token's number
        for batch in batches:
            if not len(batch):
                continue
            rec, pos, ms, lo, tail, length = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 3, 6, 8))
            heads = np.flatnonzero(np.append(True, rec[1:] != rec[:-1])).tolist()
            steps, taken, numbers = memoryview(np.ascontiguousarray(length)), [], []
            for a, b in zip(heads, [*heads[1:], len(rec)], strict=True):
                if rec[a] != record:
                    record, skip, tok = rec[a], 0, 0
                i, start = a + skip, len(taken)
                while i < b:
                    taken.append(i)
                    i += steps[i]
                skip = i - b
                numbers.append(np.arange(tok, tok + len(taken) - start))
                tok += len(taken) - start
            at, number = np.array(taken, dtype=np.int64), np.concatenate(numbers)
            sizes = length[at].astype(np.int64)
            literal = sizes <= S.LITERAL_BASES
            text = literals(tail[at], np.where(literal, sizes, 0))
            text = pa.Array.from_buffers(pa.string(), len(at), [pa.array(literal).buffers()[1], *text.buffers()[1:]]) if len(at) else text
            rank = pa.array(np.nan_to_num(lo[at]).astype(np.int64), mask=literal)
            yield pa.record_batch([pa.array(rec[at]), pa.array(number.astype(np.int32)), pa.array(pos[at]), pa.array(sizes.astype(np.int32)), pa.array(ms[at]), rank, pa.array(literal), pa.array(number == 0), text], names=names(TOKENS))

    return runs.sortWithinPartitions("record_no", F.desc("pos")).mapInArrow(run, TOKENS)


def tokenize(index: DataFrame, reads: DataFrame, k: int, preds: DataFrame | None = None) -> DataFrame:
    """The tokens of reads (record_no, seq). An empty read is one literal token without bases; preds: the index's ``predecessors``, if at hand."""
    tokens = parse(extension_runs(index, reads, k, preds))
    none, no = F.lit(None), F.lit(0)
    empty = reads.where("length(coalesce(seq, '')) = 0").select("record_no", no.alias("tok_no"), F.lit(-1).alias("pos"), no.alias("len"), no.alias("ms"), none.cast("long").alias("rank"), F.lit(True).alias("is_literal"), F.lit(True).alias("first"), F.lit("").alias("literal"))
    return tokens.unionAll(empty)


def pack(tokens: DataFrame) -> DataFrame:
    """(record_no, tok_no, word). A literal of other codes than A, C, G and T is escaped; what has no packed form is an error."""
    word = S.pack_token(F.col("is_literal"), F.col("rank"), F.col("len"), F.col("first"), F.col("literal"))
    told = F.concat_ws(" ", F.lit("no packed form of a token:"), F.coalesce(F.col("rank").cast("string"), F.lit("no rank")), F.col("len").cast("string"), F.coalesce("literal", F.lit("no literal")))
    return tokens.select("record_no", "tok_no", F.when(word.isNull(), F.raise_error(told)).otherwise(word).alias("word"))


def split_streams(packed: DataFrame) -> DataFrame:
    """(record_no, tok_no, flags, rank, length, literal) of packed tokens; rank and length null for literals."""
    word = F.col("word")
    literal = S.token_flags(word).bitwiseAND(2) == 2
    return packed.select("record_no", "tok_no", S.token_flags(word).alias("flags"), F.when(~literal, S.token_rank(word)).alias("rank"), F.when(~literal, S.token_length(word)).alias("length"), F.when(literal, S.token_literal(word)).alias("literal"))


def check(tokens: DataFrame, reads: DataFrame) -> DataFrame:
    """(record_no, bases, covered, longest): token lengths against read lengths."""
    sums = tokens.groupBy("record_no").agg(F.sum("len").alias("covered"), F.max("len").alias("longest"))
    return reads.select("record_no", F.length("seq").cast("long").alias("bases")).join(sums, "record_no", "left")
