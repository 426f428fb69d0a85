"""Blocks of records: packed tokens split in four streams, coded one by one; a block is one row.

Layout: stream 1 ranks of references, minimal binary; 2 their lengths, Rice; 3 the flag byte of every token, Rice;
4 the literals' bases end to end in words of 31, minimal binary. A header stands before each stream.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import sequences as S
from strandlake.functions.sequences import LITERAL_BASES, WORD_BASES
from strandlake.operators.codec import Codec, DecodeError, EncodeError, compress, decompress

#: Records of a block, the file header's and block header's layouts, and the exponent that headers carry.
RECORDS = 65_536
FILE_HEADER = struct.Struct("<4Q")
BLOCK_HEADER = struct.Struct("<4IQBBIH")
EXPONENT = 8
STREAMS = (Codec.MINIMAL_BINARY, Codec.RICE, Codec.RICE, Codec.MINIMAL_BINARY)
WORDS = "block_id long, record_no long, tok_no int, word long"


class Header(NamedTuple):
    block_size: int
    num_records: int
    num_u64: int
    encoded_size: int
    param: int
    exponent: int = EXPONENT


def encode_file_header(fingerprint: int = 0) -> bytes:
    """A file's header; the index's fingerprint is 0 where none is known."""
    return FILE_HEADER.pack(0, 0, 0, fingerprint)


def decode_file_header(data: bytes) -> tuple[int, int, int, int]:
    if len(data) != FILE_HEADER.size:
        raise DecodeError("a file header is cut off")
    return FILE_HEADER.unpack(data)


def encode_block_header(h: Header) -> bytes:
    return BLOCK_HEADER.pack(h.block_size, h.num_records, h.num_u64, h.encoded_size, h.param, h.exponent, 0, 0, 0)


def decode_block_header(data: bytes) -> Header:
    if len(data) != BLOCK_HEADER.size:
        raise DecodeError("a block header is cut off")
    return Header(*BLOCK_HEADER.unpack(data)[:6])


def with_block(df: DataFrame, records: int = RECORDS) -> DataFrame:
    """``df`` with block_id; records count from 1."""
    return df.withColumn("block_id", F.expr(f"(record_no - 1) div {records}"))


def literal_sizes(flags: np.ndarray) -> np.ndarray:
    """How many two-bit digits literals have: one for each base, or two if they are escaped."""
    return ((flags >> np.uint64(2) & np.uint64(15)) << (flags >> np.uint64(6) & np.uint64(1))).astype(np.int64)


def streams(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    flags = words >> np.uint64(56)
    literal = flags & np.uint64(2) == 2
    refs = words[~literal]
    sizes, own, most = literal_sizes(flags[literal]), words[literal], 2 * LITERAL_BASES
    bases = np.concatenate([(own[:, None] >> np.arange(0, 2 * most, 2, dtype=np.uint64)[None] & np.uint64(3))[np.arange(most)[None] < sizes[:, None]], np.zeros(0, dtype=np.uint64)])
    chunks = np.pad(bases, (0, -len(bases) % WORD_BASES)).reshape(-1, WORD_BASES)
    packed = (chunks << np.arange(0, 2 * WORD_BASES, 2, dtype=np.uint64)[None]).sum(axis=1, dtype=np.uint64)
    return refs & np.uint64(0xFFFFFFFF), refs >> np.uint64(32) & np.uint64(0xFFFFFF), flags, packed


def zipped(ranks: np.ndarray, lengths: np.ndarray, flags: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """The packed tokens again."""
    literal = flags & np.uint64(2) == 2
    if len(ranks) != len(lengths) or len(ranks) != int((~literal).sum()):
        raise DecodeError("streams of different lengths")
    out = flags << np.uint64(56)
    out[~literal] |= ranks | lengths << np.uint64(32)
    sizes = literal_sizes(flags[literal])
    bases = (packed[:, None] >> np.arange(0, 2 * WORD_BASES, 2, dtype=np.uint64)[None] & np.uint64(3)).ravel()
    if len(bases) < sizes.sum():
        raise DecodeError("a literal stream ends early")
    starts, own = np.cumsum(sizes) - sizes, out[literal]
    for k in range(int(sizes.max(initial=0))):
        rows = np.flatnonzero(sizes > k)
        own[rows] |= bases[starts[rows] + k] << np.uint64(2 * k)
    out[literal] = own
    return out


def encode_block(words: np.ndarray, records: int) -> bytes:
    if not len(words):
        raise EncodeError("a block without tokens")
    out = []
    for ints, codec in zip(streams(words), STREAMS, strict=True):
        payload, n_words, parameter = compress(ints, codec)
        out += [encode_block_header(Header(len(payload), records, len(ints), n_words, parameter)), payload]
    return b"".join(out)


def decode_block(data: bytes) -> np.ndarray:
    at, found, records = 0, [], set()
    for codec in STREAMS:
        header = decode_block_header(data[at : at + BLOCK_HEADER.size])
        at += BLOCK_HEADER.size
        payload = data[at : at + header.block_size]
        if len(payload) != header.block_size:
            raise DecodeError("a payload is cut off")
        at += header.block_size
        records.add(header.num_records)
        found.append(decompress(payload, header.num_u64, header.encoded_size, header.param, codec))
    words = zipped(*found)
    if records != {int((words >> np.uint64(56) & np.uint64(1)).sum())}:
        raise DecodeError("a block has another number of records than its headers say")
    return words


def write_blocks(packed: DataFrame, records: int = RECORDS) -> DataFrame:
    """(block_id, num_records, payload) from packed tokens (record_no, tok_no, word)."""

    def encode(table: pa.Table) -> pa.Table:
        table = table.sort_by([("record_no", "ascending"), ("tok_no", "ascending")])
        words = table.column("word").to_numpy().view(np.uint64)
        n = len(np.unique(table.column("record_no").to_numpy()))
        return pa.table({"block_id": table.column("block_id").slice(0, 1), "num_records": pa.array([n], pa.int64()), "payload": pa.array([encode_block(words, n)], pa.binary())})

    return with_block(packed, records).groupBy("block_id").applyInArrow(encode, "block_id long, num_records long, payload binary")


def read_blocks(blocks: DataFrame, records: int = RECORDS, before: str = "0") -> DataFrame:
    """(block_id, record_no, tok_no, word) from blocks (block_id, payload); ``before``: an expression, how many records precede block 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload, earlier in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                words = decode_block(payload)
                first = words >> np.uint64(56) & np.uint64(1) == 1
                number = np.cumsum(first)
                starts = np.flatnonzero(first)
                tok = np.arange(len(words)) - starts[number - 1]
                yield pa.record_batch([pa.array(np.full(len(words), block)), pa.array(earlier + number), pa.array(tok.astype(np.int32)), pa.array(words.view(np.int64))], names=["block_id", "record_no", "tok_no", "word"])

    return blocks.select("block_id", "payload", F.expr(f"cast(block_id * {records} + {before} as long)").alias("earlier")).mapInArrow(run, WORDS)


def zipped_streams(packed: DataFrame, records: int = RECORDS) -> DataFrame:
    """(record_no, tok_no, word): each block's tokens taken apart into whole streams and put together from them again."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("record_no", "ascending"), ("tok_no", "ascending")])
        words = zipped(*streams(table.column("word").to_numpy().view(np.uint64)))
        return table.select(["record_no", "tok_no"]).append_column("word", pa.array(words.view(np.int64)))

    return with_block(packed, records).groupBy("block_id").applyInArrow(run, "record_no long, tok_no int, word long")


def as_tokens(packed: DataFrame) -> DataFrame:
    """Packed tokens as ``decode.decode`` takes them."""
    word = F.col("word")
    literal = S.token_flags(word).bitwiseAND(2) == 2
    return packed.select("record_no", "tok_no", S.token_length(word).alias("len"), F.when(~literal, S.token_rank(word)).alias("rank"), literal.alias("is_literal"), F.when(literal, S.token_literal(word)).alias("literal"))


def file_bytes(blocks: list[bytes]) -> bytes:
    return encode_file_header() + b"".join(blocks)


def file_blocks(data: bytes) -> Iterator[bytes]:
    """The blocks of an encoded file; a cut-off one is an error."""
    decode_file_header(data[: FILE_HEADER.size])
    at = FILE_HEADER.size
    while at < len(data):
        start = at
        for _ in STREAMS:
            header = decode_block_header(data[at : at + BLOCK_HEADER.size])
            at += BLOCK_HEADER.size + header.block_size
        if at > len(data):
            raise DecodeError("a block is cut off")
        yield data[start:at]
