"""Token files: each document's ids compressed on its own under one shared zstandard dictionary.

The dictionary is trained on the serialised ids of a bounded sample (``sample_docs`` documents of smallest doc_id hash, of each
the first SAMPLE_CHARS characters at most). Where that is too little to train on, the sampled ids themselves are the dictionary;
the stored ``how`` says which it is.
Documents are range-partitioned and sorted by doc_id, encoded, and written as a Parquet table of blocks; a block holds the
frames of some documents end to end, the offset index into them, the documents' ids and token counts, the partition's
token count before it, its smallest and largest doc_id, and the dictionary's hash. The dictionary lies beside the blocks under
that hash. A short document is read by Parquet's statistics of the blocks' doc_id bounds and one slice of the frames. Spark's writer commits the files, so lost executors and
repeated attempts leave one whole copy.

Ids are serialised as unsigned 16-bit integers where the vocabulary fits, else as 32-bit ones.

Cases: a null or empty text is the end id alone. Null doc_ids sort first; rows that share a doc_id follow each other in the
order of their texts. An empty table gives an empty file set and result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm.memo_bpe import byte_bpe, packed, text_runs

BLOCKS = "part int, before long, block_tokens long, first_id long, last_id long, dictionary string, doc_ids array<bigint>, offsets array<int>, n_tokens array<int>, frames binary"
DICTIONARY_BYTES, LEVEL = 65_536, 3
#: Of a sampled document, so many characters at most.
SAMPLE_CHARS = 65_536


def narrow(ids: bytes, kind: str) -> bytes:
    return np.frombuffer(ids, dtype="<u4").astype(kind).tobytes()


def train_dictionary(docs: DataFrame, path: str, end_id: int, kind: str, sample_docs: int) -> tuple[str, bytes]:
    """(how, dictionary) from a bounded sample: ``trained``, else ``content`` of the sampled ids, else ``none`` without documents."""
    import zstandard

    order = F.xxhash64("doc_id"), F.col("doc_id")
    chosen = [r[0] for r in docs.where("doc_id is not null").select("doc_id").distinct().orderBy(*order).limit(sample_docs).collect()]
    if not chosen:
        return "none", b""
    text = F.left("text", F.lit(SAMPLE_CHARS)).alias("text")
    texts = [r["text"] for r in docs.where(F.col("doc_id").isin(chosen)).select("doc_id", text).orderBy(*order, "text").limit(sample_docs).collect()]
    coded = [narrow(ids + packed([end_id]), kind) for ids in byte_bpe(path).encode_batch(texts)]
    try:
        return "trained", zstandard.train_dictionary(DICTIONARY_BYTES, coded).as_bytes()
    except zstandard.ZstdError:  # too little to train on: the ids themselves, which serves as a dictionary too
        return "content", b"".join(coded)[-DICTIONARY_BYTES:]


def dictionary(how: str, data: bytes):
    """The dictionary as compressors and decompressors take it."""
    import zstandard

    kinds = {"trained": zstandard.DICT_TYPE_FULLDICT, "content": zstandard.DICT_TYPE_RAWCONTENT}
    return zstandard.ZstdCompressionDict(data, dict_type=kinds[how]) if how in kinds else None


def write(docs: DataFrame, tokenizer: str, to: str, end_id: int = 2, sample_docs: int = 512) -> None:
    """Writes the token files of ``docs`` (doc_id, text) under the path ``to``."""
    import zstandard

    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    kind = "<u2" if byte_bpe(tokenizer).tokenizer.get_vocab_size() <= 65_536 else "<u4"
    how, trained = train_dictionary(docs, tokenizer, end_id, kind, sample_docs)
    name = hashlib.sha256(trained).hexdigest()
    spark.createDataFrame([(name, kind, how, trained)], "dictionary string, kind string, how string, bytes binary").coalesce(1).write.parquet(f"{to}/dictionary")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, before = byte_bpe(tokenizer), TaskContext.get().partitionId(), 0
        shared = dictionary(how, trained)
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_dict_id=False)
        for batch in rows:
            ids = batch.column(0)
            for a, texts in text_runs(batch.column(1)):
                coded = [c + packed([end_id]) for c in bpe.encode_column(texts)]
                frames = [pack.compress(narrow(c, kind)) for c in coded]
                tokens = [len(c) // 4 for c in coded]
                offsets = np.cumsum([0, *map(len, frames)])
                own = ids.slice(a, len(texts))
                least = pc.min_max(own).as_py()
                columns = [[part], [before], [sum(tokens)], [least["min"]], [least["max"]], [name], [own.to_pylist()], [offsets], [tokens], [b"".join(frames)]]
                types = [pa.int32(), *[pa.int64()] * 4, pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in BLOCKS.split(", ")])
                before += sum(tokens)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, BLOCKS).write.option("compression", "uncompressed").parquet(f"{to}/blocks")


def read(spark: SparkSession, where: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of each document, from the files under ``where``."""
    import zstandard

    _, kind, how, trained = spark.read.parquet(f"{where}/dictionary").first()
    trained, blocks = bytes(trained), spark.read.schema(BLOCKS).parquet(f"{where}/blocks")
    # One sum for each written partition: as many rows as the writer had tasks.
    sums = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("block_tokens").alias("n")).collect())
    bases, total = {}, 0
    for part, n in sums:
        bases[part] = total
        total += n
    ddl = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = dictionary(how, trained)
        unpack = zstandard.ZstdDecompressor(dict_data=shared)
        for batch in rows:
            for block in batch.to_pylist():
                if block["dictionary"] != hashlib.sha256(trained).hexdigest():
                    raise ValueError("a block was written under another dictionary")
                start, frames, offsets = bases[block["part"]] + block["before"], block["frames"], block["offsets"]
                out: list = [[], [], [], [], []]
                for doc, a, b, n in zip(block["doc_ids"], offsets[:-1], offsets[1:], block["n_tokens"], strict=True):
                    ids = np.frombuffer(unpack.decompress(frames[a:b]), dtype=kind).astype("<u4")
                    if len(ids) != n:
                        raise ValueError(f"document {doc} has {len(ids)} ids; its index says {n}")
                    for column, value in zip(out, (doc, start, n, zlib.crc32(ids), ids.astype("<i4")), strict=True):
                        column.append(value)
                    start += n
                types = [pa.int64()] * 4 + [pa.list_(pa.int32())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(out, types, strict=True)][: 4 + with_ids], names=names[: 4 + with_ids])

    return blocks.mapInArrow(run, ddl)


def read_document(spark: SparkSession, where: str, doc_id: int) -> list[list[int]]:
    """The ids of the documents of one id: only the blocks that hold it are unpacked, and of those only its frames."""
    import zstandard

    _, kind, how, trained = spark.read.parquet(f"{where}/dictionary").first()
    unpack = zstandard.ZstdDecompressor(dict_data=dictionary(how, bytes(trained)))
    at = F.explode(F.filter(F.sequence(F.lit(1), F.size("doc_ids")), lambda i: F.element_at("doc_ids", i) == doc_id)).alias("i")
    found = spark.read.schema(BLOCKS).parquet(f"{where}/blocks").where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).select("frames", "offsets", at)
    start, stop = F.element_at("offsets", F.col("i")), F.element_at("offsets", F.col("i") + 1)
    return [np.frombuffer(unpack.decompress(bytes(r[0])), dtype=kind).tolist() for r in found.select(F.substring("frames", start + 1, stop - start)).collect()]
