"""Stored forms: index tables, encoded blocks as Parquet or as one file, FASTA text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators.blocks import encode_file_header


def save_index(index: DataFrame, prefix: str, k: int) -> None:
    """The nodes in order of rank, k, and a fingerprint of all nodes."""
    spark = index.sparkSession
    marks = index.agg(F.expr("bit_xor(xxhash64(rank, kmer))")).first()[0] or 0
    index.repartitionByRange("rank").sortWithinPartitions("rank").write.parquet(f"{prefix}/nodes")
    spark.range(1).select(F.lit(k).alias("k"), F.lit(marks & (1 << 63) - 1).alias("fingerprint")).coalesce(1).write.json(f"{prefix}/properties")


def save_blocks(blocks: DataFrame, path: str, fingerprint: int = 0) -> None:
    """Blocks as Parquet, written by the tasks that made them, with the index's fingerprint (0 where none is known) in each row."""
    blocks.withColumn("fingerprint", F.lit(fingerprint).cast("long")).write.parquet(path)


def save_encoded(blocks: DataFrame, path: str, fingerprint: int = 0) -> None:
    """One file in the byte layout, on the driver's disk; blocks pass through the driver one at a time."""
    with open(path, "wb") as out:
        out.write(encode_file_header(fingerprint))
        for row in blocks.orderBy("block_id").select("payload").toLocalIterator():
            out.write(bytes(row["payload"]))


def fasta(reads: DataFrame) -> DataFrame:
    """(record_no, value): each record's two lines, numbered from 1."""
    return reads.select("record_no", F.format_string(">seq.%d\n%s", F.col("record_no").cast("long"), F.col("seq")).alias("value"))


def save_fasta(reads: DataFrame, path: str) -> None:
    fasta(reads).repartitionByRange("record_no").sortWithinPartitions("record_no").select("value").write.text(path)
