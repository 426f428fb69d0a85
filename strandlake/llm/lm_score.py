"""Language-model scores of documents from a probabilistic suffix tree over words, with a smoothed unigram score beside them.

Training documents are those whose crc32(doc_id as text) mod 7 is not 2. Texts are dealt into pieces of some PIECE_BYTES; a
piece is one row of arrays: its documents, the 64-bit hashes of its distinct words, and each token as a number into these.
Two exchanges follow, in both of which a piece sends each bucket one row of sorted, delta-coded keys with their training counts
and gets as many counts back, in the same order:

* words, dealt out by hash: each word's count over all training documents, the number of words and of distinct ones;
* grams of three symbols (``suffix_tree``), dealt out by the nearest context symbol, so that a bucket has all longer contexts
  that end in it and tests them. A symbol with more than ``grams`` occurrences is dealt out further by the symbol before it; its
  first level is then counted beforehand, pair by pair.

Symbols are the ``common_words`` most frequent words (those of some count or more), and CLASSES classes of all others, by hash. A
token's probability is its symbol's under the longest retained suffix of the two before it, times its own in its class:
(c + 1) / (C + V + 1) with the class's training tokens C and distinct words V. All unknown words of a class are one event, the
one more. So probabilities sum to one over the known words, the end and an unknown word of each class.

No number of contexts, words or documents is cut. The driver gets one row a bucket, the counts of CLASSES classes and of the
common words, and sends out arrays of 65,536 symbols.

Cases: a null or empty text is the end token alone. A row with a null doc_id is a training row. Rows are independent:
repeated ones count twice in training and get equal scores. Without training rows all counts are 0. An empty table gives
an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm import suffix_tree
from strandlake.llm.common import shared_path
from strandlake.llm.memo_bpe import CLASSES as BYTE_CLASSES
from strandlake.llm.memo_bpe import WHITE, text_bytes, text_runs

#: Bytes of text of a piece, one document at least.
PIECE_BYTES = 12_000_000
#: Words and grams of a bucket, about.
WORDS, GRAMS = 1_000_000, 1_000_000
#: Classes of words that are no symbols of their own, in powers of two; the symbols below the first class are for words.
CLASS_BITS = 14
CLASSES = 1 << CLASS_BITS
FIRST_CLASS = suffix_tree.SYMBOLS - CLASSES
#: The end token is an empty word.
END = xxhash.xxh3_64_intdigest(b"")

PIECES = "piece long, doc_ids array<bigint>, lengths array<int>, hashes binary, words binary, n_words long"
SENT = "bucket int, piece long, keys binary, counts binary"
BACK = "kind int, piece long, bucket int, blob binary, a long, b long"
REPLY, TABLE, SUMS, CLASS, LEVEL = range(5)


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def shrunk(a: np.ndarray, kind: str = "<u8") -> bytes:
    """An array's bytes plane by plane, compressed: small numbers cost little."""
    import zstandard

    raw = np.ascontiguousarray(a, dtype=kind)
    return zstandard.ZstdCompressor(level=1).compress(raw.view(np.uint8).reshape(-1, raw.itemsize).T.tobytes())


def grown(blob: bytes, kind: str = "<u8") -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def shrunk_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences."""
    return shrunk(np.diff(keys, prepend=np.uint64(0)))


def grown_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(grown(blob), dtype=np.uint64)


def batch(ddl: str, *columns) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    fields = [f.split() for f in ddl.split(", ")]
    return pa.record_batch([pa.array(c, types[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct hashes, each token's number, tokens of each text) of a column; A-Z are lower-cased, an end follows each text."""
    data, bounds = text_bytes(texts)
    lower = np.where((data >= 0x41) & (data <= 0x5A), data + np.uint8(0x20), data)
    white = BYTE_CLASSES[data] == WHITE
    cuts = np.ones(len(data) + 1, dtype=bool)
    cuts[1:-1] = white[1:] != white[:-1]
    cuts[bounds] = True
    at = np.flatnonzero(cuts)
    real = ~white[at[:-1]] if len(data) else np.zeros(0, dtype=bool)
    runs = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(lower))])
    coded = runs.filter(pa.array(real)).dictionary_encode()
    digest = xxhash.xxh3_64_intdigest
    found = np.fromiter((digest(w) for w in coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    hashes = np.unique(np.append(found, np.uint64(END)))
    number = np.searchsorted(hashes, found)[coded.indices.to_numpy()].astype(np.uint32)
    seen = np.append(0, np.cumsum(real))[np.searchsorted(at, bounds)]
    return hashes, np.insert(number, seen[1:], np.searchsorted(hashes, np.uint64(END))), np.diff(seen) + 1


def pieces(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) as PIECES, stored: all numbers are fixed from here on."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, waiting, size = TaskContext.get().partitionId() << 32, [], 0

        def row() -> pa.RecordBatch:
            hashes, numbers, lengths = tokens(pa.concat_arrays([t for _, t in waiting]))
            ids = [i for part, _ in waiting for i in part.to_pylist()]
            return batch(PIECES, [piece], [ids], [lengths], [shrunk_keys(hashes)], [shrunk(numbers, "<u4")], [len(hashes)])

        for own in rows:
            for a, texts in text_runs(own.column(1), PIECE_BYTES):
                waiting.append((own.column(0).slice(a, len(texts)), pc.fill_null(texts, "").cast(pa.string())))
                size += pc.sum(pc.binary_length(waiting[-1][1])).as_py() or 0
                if size >= PIECE_BYTES // 2:
                    yield row()
                    piece, size = piece + 1, 0
                    waiting.clear()
        if waiting:
            yield row()

    return stored(docs.mapInArrow(run, PIECES), "pieces")


def stored(df: DataFrame, what: str) -> DataFrame:
    """``df`` as Parquet in the shared folder."""
    to = shared_path(df.sparkSession, what)
    df.write.option("compression", "uncompressed").parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)


def trained(ids: list, lengths: np.ndarray) -> np.ndarray:
    """1 for the tokens of training documents, else 0."""
    return np.repeat(np.array([not held_out(i) for i in ids], dtype=np.uint8), lengths)


def sent(piece: int, bucket: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """Rows of SENT from keys in order of bucket."""
    first = suffix_tree.heads(bucket)
    parts = list(zip(first.tolist(), [*first[1:].tolist(), len(bucket)], strict=True))
    return batch(SENT, bucket[first], [piece] * len(parts), [shrunk_keys(keys[a:b]) for a, b in parts], [shrunk(counts[a:b], "<u4") for a, b in parts])


def received(rows: pa.Table) -> tuple[list[int], list[np.ndarray], np.ndarray, np.ndarray]:
    """(pieces, each one's slice of ``keys``' numbers, keys, counts) of a bucket's rows from pieces."""
    names = rows.column("piece").to_pylist()
    keys = [grown_keys(b.as_py()) for b in rows.column("keys")]
    counts = np.concatenate([grown(b.as_py(), "<u4") for b in rows.column("counts")])
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    return names, np.split(at, np.cumsum([len(k) for k in keys])[:-1]), every, np.bincount(at, weights=counts, minlength=len(every)).astype(np.int64)


def back(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([batch(BACK, *(list(c) for c in zip(*rows, strict=True)))])


def word_counts(dealt: DataFrame, bits: int) -> DataFrame:
    """BACK rows of the words' exchange over 2^bits buckets: replies, tables of words, sums, and classes' sums."""

    def send(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in rows:
            for r in own.to_pylist():
                hashes, numbers = grown_keys(r["hashes"]), grown(r["words"], "<u4")
                n = np.bincount(numbers, weights=trained(r["doc_ids"], r["lengths"]), minlength=len(hashes))
                yield sent(r["piece"], (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), dtype=np.int64), hashes, n)

    def count(rows: pa.Table) -> pa.Table:
        bucket = rows.column("bucket")[0].as_py()
        names, parts, hashes, n = received(rows)
        known, own = n > 0, hashes >> np.uint64(64 - CLASS_BITS)
        first = suffix_tree.heads(own)
        out = [(REPLY, piece, bucket, shrunk(n[at]), None, None) for piece, at in zip(names, parts, strict=True)]
        out.append((TABLE, None, bucket, shrunk_keys(hashes[known]), None, None))
        out.append((SUMS, None, bucket, shrunk(n[known]), int(n.sum()), int(known.sum())))
        sums = np.add.reduceat(n, first), np.add.reduceat(known.astype(np.int64), first)
        out += [(CLASS, int(c), bucket, None, int(a), int(b)) for c, a, b in zip(own[first], *sums, strict=True)]
        return back(out)

    return stored(dealt.select("piece", "doc_ids", "lengths", "hashes", "words").mapInArrow(send, SENT).groupBy("bucket").applyInArrow(count, BACK), "words")


def steps(n: np.ndarray) -> np.ndarray:
    """Counts in 64 steps within each power of two; exact below 64."""
    power = np.floor(np.log2(n)).astype(np.int64)
    power -= (n >> power) == 0
    return power << 6 | (n - (1 << power) << 6 >> power)


def frequent(counted: DataFrame, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, counts) of the words that reach some step of counts, ``limit`` at most."""
    tables = counted.where(F.col("kind").isin(TABLE, SUMS)).groupBy("bucket").agg(F.max(F.when(F.col("kind") == TABLE, F.col("blob"))).alias("keys"), F.max(F.when(F.col("kind") == SUMS, F.col("blob"))).alias("counts"))

    def histogram(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in rows:
            for blob in own.column(0).to_pylist():
                step, n = np.unique(steps(grown(blob).astype(np.int64)), return_counts=True)
                yield batch("step long, n long", step, n)

    def chosen(least: int):
        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for own in rows:
                for keys, counts in zip(*(c.to_pylist() for c in own.columns), strict=True):
                    hashes, n = grown_keys(keys), grown(counts).astype(np.int64)
                    keep = steps(n) >= least
                    yield batch("h long, n long", hashes[keep].view(np.int64), n[keep])

        return run

    sums = counted.where(F.col("kind") == SUMS).select("blob").mapInArrow(histogram, "step long, n long")
    taken, least = 0, None
    for r in sorted(sums.groupBy("step").agg(F.sum("n").alias("n")).collect(), key=lambda r: -r["step"]):
        taken += r["n"]
        if taken > limit:
            break
        least = r["step"]
    if least is None:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    found = tables.select("keys", "counts").mapInArrow(chosen(least), "h long, n long").toArrow()
    hashes, n = found.column("h").to_numpy().view(np.uint64), found.column("n").to_numpy()
    order = np.argsort(hashes)
    return hashes[order], n[order]


def symbols(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The symbol of each word."""
    out = FIRST_CLASS + (hashes >> np.uint64(64 - CLASS_BITS)).astype(np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        out = np.where(common[at] == hashes, at, out)
    return out.astype(np.uint16)


def buckets(load: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(first bucket, number of buckets) of each symbol; loads of up to ``size`` share a bucket."""
    shares = np.maximum(-(-load // size), 1)
    hot = shares > 1
    first = np.cumsum(np.where(hot, 0, load)) // size
    plain = int(first[-1]) + 1
    first[hot] = plain + np.cumsum(shares[hot]) - shares[hot]
    return first, shares


def piece_grams(row: dict, common: np.ndarray, first: np.ndarray, shares: np.ndarray) -> tuple:
    """(keys in order of bucket, their buckets, the order of the sorted keys that makes, numbers of each token's, hashes, token numbers)."""
    hashes, numbers = grown_keys(row["hashes"]), grown(row["words"], "<u4")
    own = symbols(hashes, common)
    keys, at = np.unique(suffix_tree.contexts(own[numbers], np.array(row["lengths"]), int(symbols(np.array([END], dtype=np.uint64), common)[0])), return_inverse=True)
    near, before = (keys >> np.uint64(32)).astype(np.int64), (keys >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.int64)
    bucket = first[near] + before * 40_503 % 65_536 % shares[near]
    order = np.argsort(bucket, kind="stable")
    return keys[order], bucket[order], order, at, hashes, numbers


def tree_counts(dealt: DataFrame, common: np.ndarray, dealing: tuple[np.ndarray, np.ndarray], base: np.ndarray) -> DataFrame:
    """BACK rows of the grams' exchange: replies, and first-level contexts."""
    first, shares = dealing
    hot = np.flatnonzero(shares > 1)
    shared = dealt.sparkSession.sparkContext.broadcast((common, first, shares, base))

    def send(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in rows:
            for r in own.to_pylist():
                keys, bucket, order, at, _, _ = piece_grams(r, *shared.value[:3])
                n = np.bincount(at, weights=trained(r["doc_ids"], r["lengths"]), minlength=len(keys))
                yield sent(r["piece"], bucket, keys, n[order])

    def pairs(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in rows:
            for r in own.to_pylist():
                keys, _, order, at, _, _ = piece_grams(r, *shared.value[:3])
                n = np.bincount(at, weights=trained(r["doc_ids"], r["lengths"]), minlength=len(keys))[order]
                chosen = (n > 0) & np.isin(keys >> np.uint64(32), hot.astype(np.uint64))
                pair, at = np.unique((keys[chosen] >> np.uint64(32)) << np.uint64(16) | keys[chosen] & np.uint64(0xFFFF), return_inverse=True)
                yield batch("pair long, n long", pair.view(np.int64), np.bincount(at, weights=n[chosen], minlength=len(pair)).astype(np.int64))

    def level(rows: pa.Table) -> pa.Table:
        symbol = rows.column("symbol")[0].as_py()
        pair = rows.column("pair").to_numpy()
        order = np.argsort(pair)
        keys, counts = shrunk_keys(pair[order].view(np.uint64)), shrunk(rows.column("n").to_numpy()[order])
        own = range(int(first[symbol]), int(first[symbol] + shares[symbol]))
        return pa.Table.from_batches([batch(SENT, list(own), [None] * len(own), [keys] * len(own), [counts] * len(own))])

    def count(rows: pa.Table) -> pa.Table:
        bucket, base = rows.column("bucket")[0].as_py(), shared.value[3]
        whole = rows.filter(pc.is_null(rows.column("piece")))
        given = (grown_keys(whole.column("keys")[0].as_py()), grown(whole.column("counts")[0].as_py()).astype(np.int64)) if len(whole) else None
        mine = rows.filter(pc.is_valid(rows.column("piece")))
        if len(mine):
            names, parts, keys, n = received(mine)
        else:
            names, parts, keys, n = [], [], np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        tree, out = suffix_tree.Grams(keys, n, base, given), []
        for piece, at in zip(names, parts, strict=True):
            deep = tree.deep[at]
            kept = at[deep]
            blobs = [shrunk(tree.pair_count[at]), shrunk(deep, "u1"), *(shrunk(x[kept]) for x in (tree.deep_total, tree.deep_types, tree.count))]
            out.append((REPLY, piece, bucket, np.array([len(b) for b in blobs], dtype="<i8").tobytes() + b"".join(blobs), None, None))
        levels = np.stack([tree.nearest, tree.total, tree.types, tree.kept.astype(np.int64)])
        if given is None or bucket == int(first[int(tree.nearest[0])]):
            out.append((LEVEL, None, bucket, shrunk(levels.ravel()), None, None))
        return back(out or [(LEVEL, None, bucket, shrunk(levels[:, :0].ravel()), None, None)])

    dealt = dealt.select("piece", "doc_ids", "lengths", "hashes", "words")
    rows = dealt.mapInArrow(send, SENT)
    if len(hot):
        counted = dealt.mapInArrow(pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        rows = rows.unionAll(counted.withColumn("symbol", F.shiftright("pair", 16)).groupBy("symbol").applyInArrow(level, SENT))
    return stored(rows.groupBy("bucket").applyInArrow(count, BACK), "grams")


def score(docs: DataFrame, common_words: int = FIRST_CLASS, words: int = WORDS, grams: int = GRAMS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each row."""
    dealt = pieces(docs.select(F.col("doc_id").cast("long"), "text"))
    sizes = dealt.agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("w")).first()
    counted = word_counts(dealt, max(0, (int(sizes["w"]) // words).bit_length()))
    n, v = counted.where(F.col("kind") == SUMS).agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).first()
    common, common_n = frequent(counted, min(common_words, FIRST_CLASS))
    tokens_of, words_of = np.zeros(CLASSES, dtype=np.int64), np.zeros(CLASSES, dtype=np.int64)
    for r in counted.where(F.col("kind") == CLASS).groupBy("piece").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect():
        tokens_of[r["piece"]], words_of[r["piece"]] = r["a"], r["b"]
    own = (common >> np.uint64(64 - CLASS_BITS)).astype(np.int64)
    tokens_of -= np.bincount(own, weights=common_n, minlength=CLASSES).astype(np.int64)
    words_of -= np.bincount(own, minlength=CLASSES)
    counts = np.zeros(suffix_tree.SYMBOLS, dtype=np.int64)
    counts[: len(common)], counts[FIRST_CLASS:] = common_n, tokens_of
    base = suffix_tree.root(counts, len(common) + CLASSES)
    first, shares = buckets(counts * 7 // 6 + 1, grams)  # of seven documents six train
    replies = tree_counts(dealt, common, (first, shares), base)
    level = np.zeros((3, suffix_tree.SYMBOLS), dtype=np.int64)
    for r in replies.where(F.col("kind") == LEVEL).select("blob").toLocalIterator():
        nearest, *found = grown(bytes(r["blob"])).astype(np.int64).reshape(4, -1)
        level[:, nearest] = found
    shared = docs.sparkSession.sparkContext.broadcast((common, first, shares, base, level, tokens_of + words_of + 1))
    ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(mine: pa.Table, answers: pa.Table) -> pa.Table:
        common, first, shares, base, level, class_size = shared.value
        row = mine.to_pylist()[0]
        keys, _, order, at, hashes, numbers = piece_grams(row, common, first, shares)
        sorted_rows = sorted(zip(answers.column("of_words").to_pylist(), answers.column("bucket").to_pylist(), answers.column("blob"), strict=True), key=lambda a: a[:2])
        c = np.concatenate([grown(b.as_py()) for of_words, _, b in sorted_rows if of_words]).astype(np.int64)
        parts: list = [[] for _ in range(5)]
        for of_words, _, blob in sorted_rows:
            if not of_words:
                data = blob.as_py()
                ends = 40 + np.cumsum(np.frombuffer(data[:40], dtype="<i8"))
                for part, a, b, kind in zip(parts, [40, *ends[:-1]], ends, ("<u8", "u1", "<u8", "<u8", "<u8"), strict=True):
                    part.append(grown(data[a:b], kind))
        pair_count, deep, *rest = (np.concatenate(p) for p in parts)
        p = np.empty(len(keys))
        p[order] = suffix_tree.probabilities(keys, base, (level[0], level[1], level[2] > 0), pair_count.astype(np.int64), deep > 0, *(x.astype(np.int64) for x in rest))
        within = np.zeros(len(hashes))
        of_class = symbols(hashes, common) >= FIRST_CLASS
        within[of_class] = np.log10((c[of_class] + 1) / class_size[(hashes[of_class] >> np.uint64(64 - CLASS_BITS)).astype(np.int64)])
        lengths = np.array(row["lengths"], dtype=np.int64)
        heads = np.cumsum(lengths) - lengths
        sums = lambda x: np.add.reduceat(x, heads)
        base_logs, known = np.log10((c + 1) / (n + v + 1)), (c > 0).astype(np.int64)
        return pa.Table.from_batches([batch(ddl, row["doc_ids"], [held_out(i) for i in row["doc_ids"]], lengths, sums(known[numbers]), [int(n)] * len(lengths), sums(base_logs[numbers]), sums(np.log10(p)[at] + within[numbers]))])

    answers = counted.where(F.col("kind") == REPLY).select("piece", F.lit(True).alias("of_words"), "bucket", "blob")
    answers = answers.unionAll(replies.where(F.col("kind") == REPLY).select("piece", F.lit(False).alias("of_words"), "bucket", "blob"))
    return dealt.select("piece", "doc_ids", "lengths", "hashes", "words").groupBy("piece").cogroup(answers.groupBy("piece")).applyInArrow(run, ddl)
