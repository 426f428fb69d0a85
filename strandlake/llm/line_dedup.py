"""Line deduplication over range-partitioned line hashes, with DataFrame expressions only.

Every line's key (trimmed, ASCII lower-cased) of at least ``min_chars`` code points becomes a 128-bit hash. The
occurrences are range-partitioned by hash, then document and position, and sorted within partitions; since document and
position belong to the range, a key that holds a third of all lines spreads over many partitions. The sorted run is stored.
Each partition streams it into one partial (documents, last document) per key; the partials of a key that spans partitions
are merged, and keys of at least ``min_docs`` documents remain. They go back to the run where it lies: all of them, up to
SENT_KEYS, are sent to its partitions. Of more, those with so many documents that they would weigh on one task are sent, and
the others are joined by a shuffle. Texts take no part until a caller applies the bitmaps.

The result is one compressed bitmap of kept positions per document: a map from 32-line word to its mask, without the words of
which all lines are kept.

Cases: a null or empty text is one empty line. A row with a null ``doc_id`` takes no part and keeps all its lines. Rows
that share a ``doc_id`` count as one document. Repeated lines in the document that keeps the key all stay. An empty
table gives an empty result. Other columns, whatever their names, are ignored, or passed on by ``apply_bitmaps``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import cut

#: Up to so many keys, of three longs each, are sent to all executors.
SENT_KEYS = 500_000
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def version(text):
    """Tells rows apart that share a doc_id but not their text."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """(h1, h2, doc, ver, pos) for each line whose key is long enough; a narrow transformation."""
    rows = docs.where("doc_id is not null").select(F.col("doc_id").alias("doc"), version(F.col("text")).alias("ver"), F.posexplode(lines(F.col("text"))).alias("pos", "line"))
    trimmed = rows.withColumn("line", F.btrim("line", F.lit(SPACE))).where(F.char_length("line") >= min_chars)
    key = trimmed.withColumn("line", F.translate("line", UPPER, LOWER))
    return key.select(F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), "line").alias("h2"), "doc", "ver", "pos")


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, sent_keys: int = SENT_KEYS) -> DataFrame:
    """(doc_id, ver, n_dropped, keeps map<int,bigint>) for each document that loses a line; bit i of word w is line 32 w + i."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # Stored before it is dealt out, which reads it twice: lines are cut and hashed once.
    found = cut(occurrences(docs, min_chars))
    run = cut(found.repartitionByRange(parts, "h1", "h2", "doc").sortWithinPartitions("h1", "h2", "doc", "pos"))
    # A document's occurrences of a key are adjacent in the run; one row of them stands for the document.
    per_doc = run.groupBy("h1", "h2", "doc").agg(F.count("*").alias("lines"))
    keys = per_doc.groupBy("h1", "h2").agg(F.count("*").alias("docs"), F.sum("lines").alias("lines"), F.max("doc").alias("keeper")).where(F.col("docs") >= min_docs)
    keys = cut(keys.select("h1", "h2", "lines", "keeper"))
    if keys.count() <= sent_keys:
        known = run.join(F.broadcast(keys.drop("lines")), ["h1", "h2"])
    else:  # no more than 8 times as many keys as partitions have an eighth of a partition's lines each
        heavy = F.col("lines") >= max(1, run.count() // (8 * parts))
        hot, cold = keys.where(heavy).drop("lines"), keys.where(~heavy).drop("lines")
        rest = run.join(F.broadcast(hot.select("h1", "h2")), ["h1", "h2"], "left_anti").join(cold, ["h1", "h2"])
        known = run.join(F.broadcast(hot), ["h1", "h2"]).unionByName(rest)
    dropped = known.where(F.col("doc") != F.col("keeper"))
    masks = dropped.select("doc", "ver", F.shiftright("pos", 5).alias("word"), F.expr("shiftleft(1L, pos & 31)").alias("bit")).groupBy("doc", "ver", "word").agg(F.bit_or("bit").alias("mask"))
    keeps = F.map_from_entries(F.collect_list(F.struct("word", F.bitwise_not("mask").bitwiseAND(0xFFFFFFFF).alias("keep"))))
    return masks.groupBy(F.col("doc").alias("doc_id"), "ver").agg(F.sum(F.bit_count("mask")).alias("n_dropped"), keeps.alias("keeps"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(row, n_lines, n_dropped): each row of ``docs`` as a struct, its text reduced to the kept lines."""
    rows = docs.select(F.struct("*").alias("row")).select("row", F.col("row.doc_id").alias("doc_id"), version(F.col("row.text")).alias("ver"))
    joined = rows.join(bitmaps, ["doc_id", "ver"], "left")
    plain = F.coalesce("row.text", F.lit(""))
    kept = F.expr(r"filter(split(coalesce(row.text, ''), '\n', -1), (l, i) -> (coalesce(try_element_at(keeps, shiftright(i, 5)), -1L) & shiftleft(1L, i & 31)) != 0)")
    n_lines = (F.char_length(plain) - F.char_length(F.replace(plain, F.lit("\n"), F.lit(""))) + 1).cast("long")
    text = F.when(F.col("keeps").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    return joined.select(F.col("row").withField("text", text).alias("row"), n_lines.alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Each row's doc_id, kept text, n_lines and n_dropped."""
    docs = docs.select("doc_id", "text")
    kept = apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs))
    return kept.select("row.doc_id", F.coalesce("row.text", F.lit("")).alias("text"), "n_lines", "n_dropped")
