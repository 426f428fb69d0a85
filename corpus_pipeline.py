"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and reads
it again for the next one. All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import language_id, line_dedup, near_dedup, packing
from strandlake.llm.common import shared_path, table
from strandlake.llm.queries import vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, in none of the labelled languages, or without one that evidence favours go.

    Null and empty texts go; rows with a null doc_id stay. Labels train the model; a row's own label is no evidence for it.
    """
    return language_id.accepted(docs, language_id.fit(docs, train_rows=4000), least=0.34)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five or more documents share stay in the last of them only; n_chars follows the text.

    Null texts stay null; rows with a null doc_id keep all lines; rows that share a doc_id count as one document.
    """
    kept = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, min_chars=40, min_docs=5))
    n_chars = F.when(F.col("n_dropped") > 0, F.char_length("row.text")).otherwise(F.col("row.n_chars")).cast("long")
    return kept.select(F.col("row").withField("n_chars", n_chars).alias("row")).select("row.*")


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates at a similarity of 0.8 stays: that of the smallest doc_id.

    Documents without words and rows with a null doc_id stay; of rows with equal doc_id and text one.
    """
    return near_dedup.distinct(docs, percent=80, size=5)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, one row for each piece of a document. A null or empty text is the end token alone."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), capacity=2048, end_id=0)


STAGES = [("language_id", identify_language), ("line_dedup", dedup_lines), ("minhash_near_dedup", dedup_near), ("best_fit_packing", pack)]

#: Tokenisation and language models can't be said in SQL; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    where = shared_path(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
    return docs
