"""Encoding of an unbounded stream of reads: each micro-batch becomes blocks of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandlake.operators.blocks import read_blocks, write_blocks
from strandlake.operators.index import ranked
from strandlake.operators.tokens import pack, tokenize


def encode_stream(index: DataFrame, reads: DataFrame, k: int, path: str, checkpoint: str) -> StreamingQuery:
    """Appends (batch_id, block_id, num_records, payload) under ``path``; reads: a stream of (name, seq).

    Records are numbered by name within their batch. A repeated batch overwrites its own folder, so that each read is
    encoded once.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        numbered = ranked(batch.select("name", "seq"), "name", "record_no").selectExpr("record_no + 1 as record_no", "seq")
        write_blocks(pack(tokenize(index, numbered, k))).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return reads.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load_stream(spark: SparkSession, path: str) -> DataFrame:
    """(record_no, tok_no, word) of all batches under ``path``, records numbered on from batch to batch.

    One count for each batch meets in one place and is sent to all executors; they grow with the batches, not the reads.
    """
    stored = spark.read.parquet(path)
    counts = stored.groupBy("batch_id").agg(F.sum("num_records").alias("n"))
    earlier = Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("batch_id", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return read_blocks(stored.join(F.broadcast(before), "batch_id"), before="before").drop("block_id")
