"""Sequence files as DataFrames: FASTA, FASTQ, lists of paths, stored indexes and encoded files. gzip is read as it is."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlake.functions.sequences import normalize
from strandlake.operators.blocks import FILE_HEADER, decode_file_header, file_blocks, read_blocks
from strandlake.storage import materialised


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` numbered from 1 in their order in the input, whole files and file splits one after the other.

    ``order`` holds the path and split columns, then a column that grows within a split. Only counts of splits meet in
    one place.
    """
    *split, within = order
    kept = materialised(rows)
    counts = kept.groupBy(*split).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select(*split, before.alias("__before")))
    at = F.row_number().over(Window.partitionBy(*split).orderBy(within))
    return kept.withColumn("__at", at).join(offsets, split).withColumn(name, F.col("__before") + F.col("__at")).drop("__before", "__at", "__n")


def _placed(lines: DataFrame) -> DataFrame:
    meta = {"path": F.col("_metadata.file_path"), "split": F.col("_metadata.file_block_start"), "at": F.monotonically_increasing_id()}
    return lines.select("value", *(c.alias(n) for n, c in meta.items()))


def _fasta(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, split, at, name, seq): a record is a header line and the lines behind it; sequences normalised."""
    records = _placed(spark.read.option("lineSep", "\n>").text(paths)).withColumn("value", F.regexp_replace("value", "^>", ""))
    head = F.regexp_replace(F.substring_index("value", "\n", 1), "\r$", "")
    body = F.when(F.instr("value", "\n") > 0, F.expr("substr(value, instr(value, '\n') + 1)")).otherwise(F.lit(""))
    return records.where(F.trim("value") != "").select("path", "split", "at", head.alias("name"), normalize(body).alias("seq"))


def _fastq(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, split, at, name, seq) of four-line records; qualities are checked for their length, then dropped."""
    lines = _placed(spark.read.text(paths)).withColumn("value", F.regexp_replace("value", "\r$", ""))
    per_file = numbered(lines, ["path", "split", "at"], "line_no")
    first = per_file.groupBy("path").agg(F.min("line_no").alias("__first"))
    placed = per_file.join(F.broadcast(first), "path").withColumn("__k", F.col("line_no") - F.col("__first"))
    part = lambda i: F.max(F.when(F.pmod("__k", F.lit(4)) == i, F.col("value")))
    groups = placed.groupBy("path", F.expr("__k div 4").alias("__r")).agg(F.min("line_no").alias("at"), part(0).alias("head"), part(1).alias("s"), part(2).alias("plus"), part(3).alias("quality"))
    whole = groups.where("not (head = '' and s is null)")
    bad = ~(F.coalesce(F.left("head", F.lit(1)) == "@", F.lit(False)) & F.coalesce(F.left("plus", F.lit(1)) == "+", F.lit(False)) & F.coalesce(F.length("s") == F.length("quality"), F.lit(False)))
    seq = F.when(bad, F.raise_error(F.concat(F.lit("a malformed FASTQ record in "), F.col("path")))).otherwise(normalize(F.col("s")))
    return whole.select("path", F.lit(0).cast("long").alias("split"), "at", F.expr("substr(head, 2)").alias("name"), seq.alias("seq"))


def _in_order(spark: SparkSession, found: DataFrame, files: list[str]) -> DataFrame:
    """(record_no, name, seq) of records, file by file."""
    one_form = F.regexp_replace("path", "^file:/+", "file:/")  # of local files, which have two
    order = spark.createDataFrame([(f, i) for i, f in enumerate(files)], "path string, file long").withColumn("path", one_form)
    found = found.withColumn("path", one_form)
    return numbered(found.join(F.broadcast(order), "path").drop("path"), ["file", "split", "at"], "record_no").select("record_no", "name", "seq")


def files_of(spark: SparkSession, paths: list[str]) -> list[str]:
    """The files of paths in the order given; those of a folder or pattern by name. A file given twice is read once."""
    return list(dict.fromkeys(f for p in paths for f in sorted(spark.read.text(p).inputFiles())))


def read_fasta(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(record_no, name, seq) of FASTA files in the order given."""
    return _in_order(spark, _fasta(spark, paths), files_of(spark, paths))


def read_fastq(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(record_no, name, seq) of FASTQ files in the order given."""
    return _in_order(spark, _fastq(spark, paths), files_of(spark, paths))


def first_character(spark: SparkSession, file: str) -> str:
    """A file's first character, read through the file system that Spark reads it with; of a gzip file, that inside."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        c = jvm.java.util.zip.GZIPInputStream(stream).read() if file.endswith(".gz") else stream.read()
    finally:
        stream.close()
    return chr(c) if c >= 0 else ""


def read_sequences(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """Records of FASTA and FASTQ files, told apart by their first character, numbered in the order of the files given."""
    files = files_of(spark, list(paths))
    kinds = {f: first_character(spark, f) for f in files}
    for f, c in kinds.items():
        if c not in (">", "@", ""):
            raise ValueError(f"neither FASTA nor FASTQ: {f}")
    parts = [read(spark, chosen) for mark, read in ((">", _fasta), ("@", _fastq)) if (chosen := [f for f in files if kinds[f] == mark])]
    if not parts:
        return spark.createDataFrame([], "record_no long, name string, seq string")
    return _in_order(spark, parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), files)


def read_input_list(spark: SparkSession, path: str) -> DataFrame:
    """(name, path) of a tab-separated list without header; a single column is both."""
    rows = spark.read.schema("name string, path string").csv(path, sep="\t", header=False)
    return rows.select("name", F.coalesce("path", "name").alias("path"))


def read_all(spark: SparkSession, files: list[str], listed: str | None = None) -> DataFrame:
    """Files given by name and by a list, one after the other."""
    more = [r["path"] for r in read_input_list(spark, listed).collect()] if listed else []
    return read_sequences(spark, [*files, *more])


def load_index(spark: SparkSession, prefix: str) -> tuple[DataFrame, int]:
    """(index, k); columns that a plan doesn't use aren't read."""
    return spark.read.parquet(f"{prefix}/nodes"), spark.read.json(f"{prefix}/properties").first()["k"]


def stored_fingerprint(spark: SparkSession, prefix: str) -> int:
    return spark.read.schema("k int, fingerprint long").json(f"{prefix}/properties").first()["fingerprint"] or 0


def check_fingerprint(path: str, fingerprint: int) -> None:
    """An error if an encoded file was made with another index; files without a fingerprint pass."""
    with open(path, "rb") as f:
        stored = decode_file_header(f.read(FILE_HEADER.size))[3]
    if stored and fingerprint and stored != fingerprint:
        raise ValueError(f"{path} was encoded with another index")


def load_blocks(spark: SparkSession, path: str, records: int, fingerprint: int = 0) -> DataFrame:
    """Packed tokens of blocks stored as Parquet; an error if they were made with another index, as far as both are known."""
    stored = spark.read.parquet(path)
    if fingerprint and stored.where(~F.col("fingerprint").isin(0, fingerprint)).limit(1).count():
        raise ValueError(f"{path} was encoded with another index")
    return read_blocks(stored, records)


def read_encoded(spark: SparkSession, path: str, records: int) -> DataFrame:
    """Packed tokens of an encoded file in the byte layout; its blocks are decoded one by one."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                for number, block in enumerate(file_blocks(content)):
                    yield pa.record_batch([pa.array([number], pa.int64()), pa.array([block], pa.binary())], names=["block_id", "payload"])

    blocks = spark.read.format("binaryFile").load(path).select("content").mapInArrow(split, "block_id long, payload binary")
    return read_blocks(materialised(blocks).repartition("block_id"), records)


