import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandlake.llm import lexicon, packing, token_files, word_bpe
from strandlake.llm.memo_bpe import ByteBPE

BYTES, WORDS = str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("word_bpe_49k.json"))
ALPHABET = ["a", "B", "the", "'s", " ", "  ", "\n", ".", ",", "1", "é", "\t", "<|endoftext|>", "'", "日", "́", "\x85", "\x1c", "\0", "ß", "İ"]


def odd_texts(n=3000):
    rng = random.Random(1)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize(("path", "kind"), [(BYTES, ByteBPE), (WORDS, word_bpe.WordBPE)])
def test_pieces_equal_the_library(path, kind):
    library, own, texts = Tokenizer.from_file(path), kind(path), odd_texts()
    for text, ids in zip(texts, own.encode_batch(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_memo_stays_bounded():
    own = ByteBPE(BYTES)
    own.memo.size = 50
    texts = odd_texts(400)
    for i in range(0, 400, 20):
        own.encode_batch(texts[i : i + 20])
        assert len(own.memo.young) <= 50


def test_lexicon_is_a_minimal_map():
    words = {b"walked": b"\1\0\0\0", b"talked": b"\2\0\0\0\3\0\0\0", b"talk": b"\4\0\0\0", b"walk": b"", "é".encode(): b"\5\0\0\0"}
    frozen = lexicon.build(words)
    own = lexicon.Lexicon(frozen)
    assert own.find([*words, b"", b"wal", b"talks", b"zzz"]) == [*words.values(), None, None, None, None]
    # w and t lead to one and the same state: the root, 4 and 2 more for the first letter's and k's, e, d; 2 for the accent.
    assert len(own.final) == 1 + 6 + 1
    assert lexicon.Lexicon(lexicon.build({})).find([b"a"]) == [None]


def test_word_encoding_of_awkward_rows(awkward, awkward_rows, nothing):
    library = Tokenizer.from_file(WORDS)
    out = word_bpe.encode(awkward, WORDS, lexicon_words=50, with_ids=True, digests=True).collect()
    want = Counter()
    for doc_id, text, *_ in awkward_rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want[doc_id, len(ids), tuple(ids), decoded, hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_tokens"], tuple(r["ids"]), r["decoded"], r["ids_sha256"], r["decoded_sha256"]) for r in out) == want
    assert word_bpe.encode(nothing, WORDS).collect() == []


def test_frequent_words_count_all_documents(spark):
    docs = spark.createDataFrame([(1, "Aa bb, aa. cc\nAA"), (2, "bb cc! dd 1x"), (3, None)], "doc_id long, text string")
    assert word_bpe.frequent_words(docs, 3) == ["aa", "bb", "cc"]


def test_token_files(spark, awkward, awkward_rows, nothing, tmp_path):
    library, where = Tokenizer.from_file(BYTES), f"file://{tmp_path}/tokens"
    token_files.write(awkward, BYTES, where, end_id=2)
    out = token_files.read(spark, where, with_ids=True).collect()
    start = 0
    by_order = sorted(awkward_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    for row, (doc_id, text, *_) in zip(sorted(out, key=lambda r: r["start"]), by_order, strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids"]) == (doc_id, start, len(ids), ids)
        assert row["ids_crc32"] == zlib.crc32(np.array(ids, dtype="<u4").tobytes())
        start += len(ids)
    assert token_files.read_document(spark, where, 3) == [[*library.encode("one two").ids, 2]]
    assert token_files.read_document(spark, where, 999) == []
    token_files.write(nothing, BYTES, f"file://{tmp_path}/none")
    assert token_files.read(spark, f"file://{tmp_path}/none").collect() == []


def test_token_files_have_a_trained_dictionary(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma delta", "epsilon"]) + str(rng.randint(0, 99)) for _ in range(200))) for i in range(300)]
    where = f"file://{tmp_path}/trained"
    token_files.write(spark.createDataFrame(rows, "doc_id long, text string"), BYTES, where, sample_docs=200)
    name, _, how, trained = spark.read.parquet(f"{where}/dictionary").first()
    assert how == "trained" and len(trained) > 1000 and hashlib.sha256(trained).hexdigest() == name
    assert {r[0] for r in spark.read.parquet(f"{where}/blocks").select("dictionary").distinct().collect()} == {name}
    assert token_files.read(spark, where).count() == 300


def test_token_files_of_few_documents_have_a_dictionary(spark, tmp_path):
    where = f"file://{tmp_path}/few"
    token_files.write(spark.createDataFrame([(1, "one two three"), (2, "three"), (2, "four")], "doc_id long, text string"), BYTES, where)
    how, content = spark.read.parquet(f"{where}/dictionary").select("how", "bytes").first()
    assert how == "content" and len(content)
    assert sorted(r["n_tokens"] for r in token_files.read(spark, where).collect()) == [2, 2, 4]


def check_packing(out, rows, capacity):
    library = Tokenizer.from_file(BYTES)
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append(r)
    for members in bins.values():
        at = 0
        for m in sorted(members, key=lambda m: m["offset"]):
            assert m["offset"] == at
            at += m["length"]
        assert at <= capacity
    want, total = Counter(), 0
    for doc_id, text, *_ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        first = len(ids) - (len(ids) - 1) // capacity * capacity
        for k, a in enumerate([0, *range(first, len(ids), capacity)]):
            part = ids[a : first if k == 0 else a + capacity]
            want[doc_id, k, a, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    return len(bins), -(-total // capacity)


def test_packing(awkward, awkward_rows, nothing):
    used, least = check_packing(packing.pack(awkward, BYTES, capacity=64).collect(), awkward_rows, 64)
    assert used <= 1.1 * least + 1
    assert packing.pack(nothing, BYTES).collect() == []


def test_packing_goes_up_the_tree(spark):
    rng = random.Random(4)
    rows = [(i, "a " * rng.choice([5, 9, 14, 22, 31])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(20)
    used, least = check_packing(packing.pack(docs, BYTES, capacity=64, fan_in=4).collect(), rows, 64)
    assert used <= 1.25 * least


@pytest.mark.parametrize("seed", range(3))
def test_bins_that_stay_below_would_not_be_used(seed):
    """A tree whose nodes pass on as many bins as it has leaves uses no more sequences than one whose nodes pass on all."""
    rng = random.Random(seed)
    leaves = [[(rng.randint(1, 64), [{"shift": 0}]) for _ in range(rng.randint(1, 60))] for _ in range(16)]

    def tree(kept):
        level, used = [packing.joined(items, 64, "shift") for items in leaves], 0
        while len(level) > 1:
            used += sum(max(0, len(bins) - kept) for bins in level)
            level = [packing.joined([b for bins in level[i : i + 4] for b in bins[:kept]], 64, "shift") for i in range(0, len(level), 4)]
        return used + len(level[0])

    assert tree(len(leaves)) == tree(10**9)


def test_best_fit_takes_the_fullest_bin_that_fits():
    assert packing.best_fit([5, 7, 3, 2], 10) == [[1, 2], [0, 3]]
    assert packing.best_fit([], 10) == []
    for seed in range(20):
        rng = random.Random(seed)
        sizes = [rng.randint(1, 10) for _ in range(60)]
        bins = packing.best_fit(sizes, 10)
        assert sorted(i for b in bins for i in b) == list(range(60))
        assert all(sum(sizes[i] for i in b) <= 10 for b in bins)
