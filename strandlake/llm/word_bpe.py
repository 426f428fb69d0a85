"""Encoding and decoding of whole texts with a word-level BPE, frequent words through a transducer lexicon.

All documents' plain words are counted; the ``lexicon_words`` most frequent ones are compiled, with the ids that merging
gives them, into a minimal acyclic transducer (``lexicon``). Its frozen form is some megabytes, bounded by that parameter,
and is broadcast. Workers map it into memory and send every new word through it; words that it lacks are merged exactly
(``array_bpe``). The tokenizer drops white space, so that no token spans a space or line feed.

Cases: a null or empty text has no tokens. Any other text encodes as the tokenizers library encodes it, texts that spell
special tokens included. Rows are independent: null or repeated doc_ids stay as they are. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm import lexicon
from strandlake.llm.common import cut
from strandlake.llm.memo_bpe import ASCII_SPACE, CLASSES, DIGIT, LETTER, UNCERTAIN, PieceBPE, text_bytes, text_runs

#: Longer words are merged; bounds the lexicon's size together with the number of words.
MAX_WORD = 64


class WordBPE(PieceBPE):
    """White space is dropped: it is cut off with what follows it. Each digit is a pre-token."""

    def __init__(self, path: str, frozen: bytes | None = None):
        super().__init__(path)
        self.lexicon = lexicon.Lexicon(frozen) if frozen else None
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.tokens = pa.array([(self.tokenizer.id_to_token(i) or "").encode() + b" " for i in range(size)], pa.binary())

    def starts(self, data: np.ndarray, kind: np.ndarray, white: np.ndarray, last: np.ndarray) -> np.ndarray:
        out = np.ones(len(data), dtype=bool)
        out[1:] = ~white[:-1] & ((kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
        return out

    def raw(self, piece: bytes) -> bytes:
        return piece.decode().lstrip(ASCII_SPACE).lower().encode()

    def merged(self, words: list[bytes]) -> list[bytes]:
        if not self.lexicon:
            return self.arrays.merge(words)
        found = self.lexicon.find(words)
        rest = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(rest, self.arrays.merge([words[i] for i in rest]), strict=True):
            found[i] = ids
        return found

    def strings(self, ids: list[bytes]) -> pa.Array:
        """The strings of each entry's tokens, a space behind each."""
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        taken = self.tokens.take(pa.array(flat.astype(np.int32)))
        ends = np.cumsum([0, *(len(i) // 4 for i in ids)])
        offsets = np.frombuffer(taken.buffers()[1], dtype=np.int32)[ends] if len(flat) else np.zeros(len(ids) + 1, dtype=np.int32)
        return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets), taken.buffers()[2] or pa.py_buffer(b"")])

    def encode_decoded(self, column: pa.Array) -> tuple[list[bytes], list[bytes]]:
        """Each text's ids, and the text in UTF-8 as the tokenizers library decodes them without a decoder: token strings between spaces."""
        ids, numbers, bounds = self.units(column)
        known = [v or b"" for v in ids]
        out = self.assembled(known, numbers, bounds)
        decoded = self.assembled(self.strings(known), numbers, bounds)
        for i in self.unknown(ids, numbers, bounds):
            out[i] = self.whole(column[i].as_py())
            decoded[i] = self.strings([out[i]])[0].as_py()
        return out, [d[:-1] for d in decoded]


def frequent_words(docs: DataFrame, limit: int) -> list[str]:
    """The most frequent lower-cased words of plain letters over all documents: all that some count or more is reached by, if ``limit`` at most.

    The count is found from a histogram of 64 powers of two and one of 1024 steps within one of them, so that the driver gets
    no more than ``limit`` words, and no task a list of all.
    """

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def flush():
            out = pa.record_batch({"word": pa.array([w.decode() for w in total], pa.string()), "n": pa.array(list(total.values()), pa.int64())})
            total.clear()
            return out

        for batch in rows:
            for _, texts in text_runs(batch.column(0)):
                names, times = letter_runs(texts)
                for name, n in zip(names, times, strict=True):
                    total[name] += n
                if len(total) > 400_000:
                    yield flush()
        if total:
            yield flush()

    counted = cut(docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    power = F.length(F.bin("n")) - 1
    found = {r["p"]: r["words"] for r in counted.groupBy(power.alias("p")).agg(F.count("*").alias("words")).collect()}
    taken, least = 0, None
    for p in sorted(found, reverse=True):
        if taken + found[p] > limit:
            step = max(1, (1 << p) >> 10)
            steps = counted.where(power == p).groupBy(F.expr(f"n div {step}").alias("s")).agg(F.count("*").alias("words")).collect()
            for r in sorted(steps, key=lambda r: -r["s"]):
                if taken + r["words"] > limit:
                    break
                taken, least = taken + r["words"], r["s"] * step
            break
        taken, least = taken + found[p], 1 << p
    return [] if least is None else sorted(r["word"] for r in counted.where(F.col("n") >= least).select("word").collect())


def letter_runs(texts: pa.Array) -> tuple[list[bytes], list[int]]:
    """The distinct lower-cased runs of letters of a column, of MAX_WORD bytes at most, and how often each occurs."""
    data, bounds = text_bytes(texts)
    kind = CLASSES[data]
    lower = np.where((data >= 0x41) & (data <= 0x5A), data + np.uint8(0x20), data)
    behind = np.flatnonzero(data[:-1] == 0xC3) + 1
    lower[behind] += np.where((data[behind] >= 0x80) & (data[behind] <= 0x9E) & (data[behind] != 0x97), np.uint8(0x20), np.uint8(0))
    cuts = np.ones(len(data) + 1, dtype=bool)
    cuts[1:-1] = (kind[1:] == LETTER) != (kind[:-1] == LETTER)
    cuts[bounds] = True
    at = np.flatnonzero(cuts)
    runs = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(lower))])
    chosen = (kind[at[:-1]] == LETTER) & (np.diff(at) <= MAX_WORD) if len(data) else np.zeros(0, dtype=bool)
    found = runs.filter(pa.array(chosen)).value_counts()
    pairs = [(w, n) for w, n in zip(found.field(0).to_pylist(), found.field(1).to_pylist(), strict=True) if not UNCERTAIN.search(w) and valid(w)]
    return [w for w, _ in pairs], [n for _, n in pairs]


def valid(word: bytes) -> bool:
    """Whether a run of letter bytes is whole characters: it isn't next to a character beyond Latin-1."""
    try:
        word.decode()
    except UnicodeDecodeError:
        return False
    return True


def freeze(path: str, words: list[str]) -> bytes:
    """The frozen lexicon of ``words``."""
    raw = [w.encode() for w in words]
    return lexicon.build(dict(zip(raw, WordBPE(path).arrays.merge(raw), strict=True)))


_workers: dict[tuple, WordBPE] = {}


def worker(path: str, key: str, frozen) -> WordBPE:
    """One encoder for each Python worker and lexicon."""
    if (path, key) not in _workers:
        _workers.clear()
        _workers[path, key] = WordBPE(path, frozen.value)
    return _workers[path, key]


def encode(docs: DataFrame, path: str, lexicon_words: int = 65_536, with_ids: bool = False, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens and, as asked, ids array<int> with decoded string, or ids_sha256 with decoded_sha256."""
    docs = docs.select("doc_id", "text")
    frozen = freeze(path, frequent_words(docs, lexicon_words))
    key, shared = hashlib.sha256(frozen).hexdigest(), docs.sparkSession.sparkContext.broadcast(frozen)
    fields = [pa.field("doc_id", pa.int64()), pa.field("n_tokens", pa.int64())]
    fields += [pa.field("ids", pa.list_(pa.int32())), pa.field("decoded", pa.string())] * with_ids
    fields += [pa.field("ids_sha256", pa.string()), pa.field("decoded_sha256", pa.string())] * digests
    schema = pa.schema(fields)
    ddl = "doc_id long, n_tokens long" + ", ids array<int>, decoded string" * with_ids + ", ids_sha256 string, decoded_sha256 string" * digests

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker(path, key, shared)
        for batch in rows:
            ids = batch.column(0)
            for a, texts in text_runs(batch.column(1)):
                coded, decoded = bpe.encode_decoded(texts)
                out = {"doc_id": ids.slice(a, len(texts)), "n_tokens": [len(c) // 4 for c in coded]}
                if with_ids:
                    out |= {"ids": [np.frombuffer(c, dtype="<i4") for c in coded], "decoded": [d.decode() for d in decoded]}
                if digests:
                    out |= {"ids_sha256": [hashlib.sha256(c).hexdigest() for c in coded], "decoded_sha256": [hashlib.sha256(d).hexdigest() for d in decoded]}
                yield pa.record_batch([pa.array(out[f.name], f.type) if not isinstance(out[f.name], pa.Array) else out[f.name].cast(f.type) for f in schema], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, ddl)
