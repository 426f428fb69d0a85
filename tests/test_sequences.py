import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from reference_model import model_index, model_ms, model_tokens, revcomp

from strandlake.functions import sequences as S
from strandlake.operators import blocks, codec, decode, index, match, tokens
from strandlake.sources import fastx, sinks


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def frame(spark, seqs):
    return spark.createDataFrame([(i + 1, s) for i, s in enumerate(seqs)], "record_no long, seq string")


def sequence(rng, n):
    return "".join(rng.choice("ACGT") for _ in range(n))


@pytest.mark.parametrize(("raw", "want"), [("acgu", "ACGT"), ("A c\nG\tt", "ACGT"), ("a.~-", "A---"), ("xé!", "NNN"), ("ryswkmbdhvn", "RYSWKMBDHVN"), ("", "")])
def test_normalize(spark, raw, want):
    assert one(spark, raw, S.normalize) == want


def test_two_bits(spark):
    assert one(spark, "GATT", S.pack_2bit) == 242
    assert one(spark, "T" * 31, S.pack_2bit) == 2**62 - 1
    assert one(spark, "", S.pack_2bit) == 0
    assert one(spark, "T" * 32, S.pack_2bit) is None
    assert one(spark, "GANT", S.pack_2bit) is None
    for s in ("", "A", "ACGT", "TTTA", "T" * 31):
        assert one(spark, s, lambda x: S.unpack_2bit(S.pack_2bit(x), F.length(x))) == s


def test_sql_functions(spark):
    S.register(spark)
    row = spark.sql("select seq_revcomp('AACG') a, seq_pack2('GATT') b, seq_unpack2(242L, 4) c, seq_normalize('ac u.x') d").first()
    assert tuple(row) == ("CGTT", 242, "GATT", "ACT-N")


def test_rechunk(spark):
    assert one(spark, "A" * 62, S.rechunk) == ["A" * 31, "A" * 31]
    assert one(spark, "A" * 32, S.rechunk) == ["A" * 31, "A"]
    assert one(spark, "", S.rechunk) == []


@pytest.mark.parametrize("k", [4, 11])
def test_index_and_matching_equal_a_plain_version(spark, k):
    rng = random.Random(k)
    refs = [sequence(rng, n) for n in (0, k - 1, k, 60, 90)]
    reads = [sequence(rng, 40), refs[3], revcomp(refs[4]), refs[4][5:30] + "N" + refs[3][:20], "", "A"]
    nodes, real = model_index(refs, k)
    built = index.build(frame(spark, refs), k)
    assert [r["kmer"] for r in built.orderBy("rank").collect()] == nodes
    assert [r["rank"] for r in built.orderBy("rank").collect()] == list(range(len(nodes)))
    lcs = [r["lcs"] for r in index.with_lcs(built, k).orderBy("rank").collect()]
    shared = lambda a, b: next((i for i in range(k) if a[-1 - i] != b[-1 - i]), k)
    assert lcs == [0, *(shared(a, b) for a, b in zip(nodes, nodes[1:], strict=False))]
    stats = match.matching_statistics(built, frame(spark, reads), k)
    got = {(r["record_no"], r["pos"]): r["ms"] for r in stats.collect()}
    assert got == {(i + 1, p): m for i, s in enumerate(reads) for p, m in enumerate(model_ms(nodes, s, k))}
    found = tokens.tokenize(built, frame(spark, reads), k)
    lens = {}
    for r in found.orderBy("record_no", "tok_no").collect():
        lens.setdefault(r["record_no"], []).append(r["len"])
    assert lens == {i + 1: model_tokens(nodes, real, s, k) or [0] for i, s in enumerate(reads)}
    assert {r["record_no"]: r["seq"] for r in decode.decode(found, built, k).collect()} == {i + 1: s for i, s in enumerate(reads)}


def test_random_contigs_round_trip_through_blocks(spark):
    rng, k = random.Random(20250731), 255
    contigs = [sequence(rng, rng.randrange(2000)) for _ in range(7)]
    built = index.build(frame(spark, contigs), k)
    stored = blocks.write_blocks(tokens.pack(tokens.tokenize(built, frame(spark, contigs), k)), 3)
    assert sorted(r["num_records"] for r in stored.collect()) == [1, 3, 3]
    out = decode.decode(blocks.as_tokens(blocks.read_blocks(stored, 3)), built, k)
    assert [r["seq"] for r in out.orderBy("record_no").collect()] == contigs


def test_one_unambiguous_path_is_two_tokens(spark):
    read = sequence(random.Random(3), 1000)
    for k, want in ((255, [766, 234]), (31, [993, 7])):
        built = index.build(frame(spark, [read]), k)
        found = tokens.tokenize(built, frame(spark, [read]), k).orderBy("tok_no").collect()
        assert [r["len"] for r in found] == want
        assert [r["is_literal"] for r in found] == [n <= 11 for n in want]


def test_a_read_of_one_kmer_and_one_without_matches(spark):
    ref = sequence(random.Random(4), 31)
    built = index.build(frame(spark, [ref]), 31)
    reads = frame(spark, [ref, "ACG", revcomp(ref)])
    found = tokens.tokenize(built, reads, 31)
    whole = found.where("record_no != 2").collect()
    assert [(r["len"], r["is_literal"]) for r in whole] == [(31, False)] * 2
    stored = blocks.write_blocks(tokens.pack(found), 1)
    out = decode.decode(blocks.as_tokens(blocks.read_blocks(stored, 1)), built, 31)
    assert [r["seq"] for r in out.orderBy("record_no").collect()] == [ref, "ACG", revcomp(ref)]


def test_extension_stops_where_two_paths_meet(spark):
    k, tail = 6, "GATTACAGGCATCC"
    built = index.build(frame(spark, ["ACCCTT" + tail, "CTTTGA" + tail]), k, add_revcomp=False)
    preds = {r["rank"]: r["indeg"] for r in index.predecessors(built, k).collect()}
    ranks = {r["kmer"]: r["rank"] for r in built.collect()}
    assert preds[ranks[tail[:k]]] == 2
    assert tokens.tokenize(built, frame(spark, ["ACCCTT" + tail]), k).agg(F.sum("len")).first()[0] == 20


def test_other_codes_are_escaped_in_packed_tokens(spark):
    built = index.build(frame(spark, ["ACGTACGTTGCA"]), 4)
    reads = ["ACGNACG", "RYSWKMBDHV-NN", "N", ""]
    packed = tokens.pack(tokens.tokenize(built, frame(spark, reads), 4))
    assert decode.decode(blocks.as_tokens(packed), built, 4).orderBy("record_no").select("seq").collect() == [(s,) for s in reads]
    stored = blocks.write_blocks(packed, 2)
    out = decode.decode(blocks.as_tokens(blocks.read_blocks(stored, 2)), built, 4)
    assert [r["seq"] for r in out.orderBy("record_no").collect()] == reads


@pytest.mark.parametrize(("rank", "length", "fits"), [(2**32 - 1, 2**24 - 1, True), (2**32, 30, False), (5, 2**24, False), (-1, 30, False), (None, 30, False)])
def test_ranks_and_lengths_beyond_their_fields_are_errors(spark, rank, length, fits):
    found = spark.createDataFrame([(1, 0, length, rank, False, True, None)], "record_no long, tok_no int, len int, rank long, is_literal boolean, first boolean, literal string")
    if fits:
        assert tokens.split_streams(tokens.pack(found)).first()[2:5] == (1, rank, length)
    else:
        with pytest.raises(Exception, match="no packed form"):
            tokens.pack(found).collect()


def test_matching_over_many_blocks_and_shares(spark, monkeypatch):
    """Blocks of 16 ranks and shares of some positions give what one block gives."""
    rng, k = random.Random(12), 9
    refs = [sequence(rng, 300), "ACACACACAC" * 6, "A" * 40]
    reads = [sequence(rng, 70), refs[0][40:120] + "N" + refs[1][:30], "A" * 50, "ACAC" * 9, "TTG", ""]
    built = index.build(frame(spark, refs), k)
    whole = [match.matching_statistics(built, frame(spark, reads), k).orderBy("record_no", "pos").collect(), tokens.tokenize(built, frame(spark, reads), k).orderBy("record_no", "tok_no").collect(), sorted(match.intervals(built, 1, k).collect())]
    monkeypatch.setattr(match, "BLOCK_ROWS", 16)
    monkeypatch.setattr(match, "SALT_ROWS", 10)
    cut = [match.matching_statistics(built, frame(spark, reads), k).orderBy("record_no", "pos").collect(), tokens.tokenize(built, frame(spark, reads), k).orderBy("record_no", "tok_no").collect(), sorted(match.intervals(built, 1, k, rows=16).collect())]
    assert built.count() > 300 and cut == whole
    suffixes = {(p, i) for i, r in enumerate(built.orderBy("rank").collect()) for n in range(1, k + 1) if "$" not in (p := r["rkmer"][:n])}
    want = {}
    for p, i in suffixes:
        lo, hi = want.get(p, (i, i))
        want[p] = min(lo, i), max(hi, i)
    assert {r["reversed"]: (r["lo"], r["hi"]) for r in whole[2]} == {p: (lo, hi + 1) for p, (lo, hi) in want.items()}


def test_small_batches_carry_reads_on(spark):
    rng, k = random.Random(13), 7
    refs = [sequence(rng, 400)]
    reads = [refs[0][30:390], sequence(rng, 100), refs[0][:200] + "N" + refs[0][100:]]
    built = index.build(frame(spark, refs), k)
    whole = tokens.tokenize(built, frame(spark, reads), k).orderBy("record_no", "tok_no").collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert tokens.tokenize(built, frame(spark, reads), k).orderBy("record_no", "tok_no").collect() == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("seed", range(4))
def test_integer_codes(seed):
    rng = np.random.default_rng(seed)
    for n in (0, 1, 31, 500):
        ints = rng.geometric(0.02, n).astype(np.uint64) * np.uint64(rng.integers(1, 1000))
        words, b = codec.rice_encode(ints)
        assert (codec.rice_decode(words, n, b) == ints).all()
        words, u = codec.minimal_binary_encode(ints)
        assert (codec.minimal_binary_decode(words, n, u) == ints).all()


@pytest.mark.parametrize("bases", [0, 1, 30, 31, 32, 62])
def test_literal_streams_of_any_length(bases):
    rng = np.random.default_rng(bases)
    sizes = [11] * (bases // 11) + ([bases % 11] if bases % 11 or not bases else [])
    words = np.array([int(rng.integers(0, 4**n)) | (2 + (i == 0) | n << 2) << 56 for i, n in enumerate(sizes)], dtype=np.uint64)
    assert (blocks.decode_block(blocks.encode_block(words, 1)) == words).all()


def test_damaged_blocks_are_errors():
    data = blocks.encode_block(np.array([(3 | 4 << 2) << 56 | 242, 1 << 56 | 40 << 32 | 7], dtype=np.uint64), 2)
    for bad in (data[:-1], data[:20], data[:44] + bytes([data[44] ^ 255]) + data[45:]):
        with pytest.raises(codec.DecodeError):
            blocks.decode_block(bad)
    with pytest.raises(codec.EncodeError):
        blocks.encode_block(np.empty(0, dtype=np.uint64), 0)
    words = np.array([3 << 56 | i % 4 << 58 | i % 4 for i in range(50)], dtype=np.uint64)
    coded, b = codec.rice_encode(words >> np.uint64(56))
    with pytest.raises(codec.DecodeError):
        codec.rice_decode(coded[:-1], 50, b)
    coded, u = codec.minimal_binary_encode(words >> np.uint64(50))
    with pytest.raises(codec.DecodeError):
        codec.minimal_binary_decode(coded[:-1], 50, u)
    assert len(blocks.encode_file_header()) == blocks.BLOCK_HEADER.size == 32


def test_sizes_equal_the_codes(spark):
    rng = np.random.default_rng(1)
    values = rng.geometric(0.05, 300)
    df = spark.createDataFrame([(1, int(v)) for v in values], "g int, v long")
    words, b = codec.rice_encode(values.astype(np.uint64))
    row = codec.rice_sizes(df, "g", "v").first()
    assert (row["param"], -(-row["bits"] // 64)) == (b, len(words))
    words, u = codec.minimal_binary_encode(values.astype(np.uint64))
    row = codec.minimal_binary_sizes(df, "g", "v").first()
    assert (row["param"], -(-row["bits"] // 64)) == (u, len(words))


def test_sequence_files(spark, tmp_path):
    import gzip

    (tmp_path / "a.fa").write_text(">one x\nAC\nGT\n>two\nacgu\n>three\n\n>four\nTT")
    with gzip.open(tmp_path / "b.fa.gz", "wt") as f:
        f.write(">five\r\nGG\r\nCC\r\n")
    (tmp_path / "c.fq").write_text("@r1 d\nACGT\n+\n@III\n@r2\nGG\n+r2\nII\n")
    got = fastx.read_fasta(spark, [str(tmp_path / "a.fa")]).orderBy("record_no").collect()
    assert [tuple(r) for r in got] == [(1, "one x", "ACGT"), (2, "two", "ACGT"), (3, "three", ""), (4, "four", "TT")]
    assert [tuple(r) for r in fastx.read_fasta(spark, [str(tmp_path / "b.fa.gz")]).collect()] == [(1, "five", "GGCC")]
    assert [tuple(r) for r in fastx.read_fastq(spark, [str(tmp_path / "c.fq")]).orderBy("record_no").collect()] == [(1, "r1 d", "ACGT"), (2, "r2", "GG")]
    (tmp_path / "list.tsv").write_text(f"{tmp_path}/a.fa\nlast\t{tmp_path}/c.fq\n")
    assert [r["name"] for r in fastx.read_input_list(spark, str(tmp_path / "list.tsv")).collect()] == [f"{tmp_path}/a.fa", "last"]
    both = fastx.read_all(spark, [], str(tmp_path / "list.tsv")).orderBy("record_no").collect()
    assert [r["record_no"] for r in both] == [1, 2, 3, 4, 5, 6]
    mixed = fastx.read_sequences(spark, [str(tmp_path / f) for f in ("c.fq", "b.fa.gz", "a.fa")]).orderBy("record_no").collect()
    assert [r["name"] for r in mixed] == ["r1 d", "r2", "five", "one x", "two", "three", "four"]
    (tmp_path / "bad.fq").write_text("@r1\nACGT\n+\nII\n")
    with pytest.raises(Exception, match="malformed"):
        fastx.read_fastq(spark, [str(tmp_path / "bad.fq")]).collect()
    with pytest.raises(ValueError, match="neither"):
        (tmp_path / "x.txt").write_text("hello\n")
        fastx.read_sequences(spark, [str(tmp_path / "x.txt")])


def test_command_line_round_trip(spark, tmp_path):
    from strandlake import cli

    rng = random.Random(9)
    ref = sequence(rng, 400)
    reads = [ref[10:120], revcomp(ref[200:390]), "ACGTNACGT", ref[:50]]
    (tmp_path / "ref.fa").write_text(f">ref\n{ref}\n")
    (tmp_path / "reads.fa").write_text("".join(f">r{i}\n{s}\n" for i, s in enumerate(reads)))
    cli.main(["build", str(tmp_path / "ref.fa"), "-o", str(tmp_path / "ix"), "-k", "21"], spark)
    cli.main(["encode", str(tmp_path / "reads.fa"), "-i", str(tmp_path / "ix"), "-o", str(tmp_path / "out.dat")], spark)
    cli.main(["decode", str(tmp_path / "out.dat"), "-i", str(tmp_path / "ix"), "-o", str(tmp_path / "fa")], spark)
    text = "".join(p.read_text() for p in sorted((tmp_path / "fa").glob("part-*")))
    assert text == "".join(f">seq.{i + 1}\n{s}\n" for i, s in enumerate(reads))
    cli.main(["encode", str(tmp_path / "reads.fa"), "-i", str(tmp_path / "ix"), "-o", str(tmp_path / "blocks"), "--blocks"], spark)
    cli.main(["decode", str(tmp_path / "blocks"), "-i", str(tmp_path / "ix"), "-o", str(tmp_path / "fc"), "--blocks"], spark)
    assert "".join(p.read_text() for p in sorted((tmp_path / "fc").glob("part-*"))) == text
    (tmp_path / "other.fa").write_text(f">ref\n{ref[::-1]}\n")
    cli.main(["build", str(tmp_path / "other.fa"), "-o", str(tmp_path / "iy"), "-k", "21"], spark)
    with pytest.raises(ValueError, match="another index"):
        cli.main(["decode", str(tmp_path / "out.dat"), "-i", str(tmp_path / "iy"), "-o", str(tmp_path / "fb")], spark)
    with pytest.raises(ValueError, match="another index"):
        cli.main(["decode", str(tmp_path / "blocks"), "-i", str(tmp_path / "iy"), "-o", str(tmp_path / "fd"), "--blocks"], spark)
    with pytest.raises(SystemExit):
        cli.main(["build", "-o", str(tmp_path / "none")], spark)


def test_stream_of_reads(spark, tmp_path):
    from strandlake.streaming.encode import encode_stream, load_stream

    built = index.build(frame(spark, ["ACGTTGCATTGACCA"]), 5)
    (tmp_path / "in").mkdir()
    spark.createDataFrame([("a", "ACGTTG"), ("b", "TTGACCA")], "name string, seq string").coalesce(1).write.mode("overwrite").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("name string, seq string").json(str(tmp_path / "in"))
    encode_stream(built, stream, 5, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "out"))
    out = decode.decode(blocks.as_tokens(blocks.read_blocks(stored)), built, 5)
    assert [r["seq"] for r in out.orderBy("record_no").collect()] == ["ACGTTG", "TTGACCA"]
    spark.createDataFrame([("a", "CATTG"), ("c", "")], "name string, seq string").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    encode_stream(built, stream, 5, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    both = decode.decode(blocks.as_tokens(load_stream(spark, str(tmp_path / "out"))), built, 5)
    assert [tuple(r) for r in both.select("record_no", "seq").orderBy("record_no").collect()] == [(1, "ACGTTG"), (2, "TTGACCA"), (3, "CATTG"), (4, "")]


def test_index_round_trip_and_fasta(spark, tmp_path):
    built = index.build(frame(spark, ["ACGTTGCATT"]), 4)
    sinks.save_index(built, str(tmp_path / "ix"), 4)
    loaded, k = fastx.load_index(spark, str(tmp_path / "ix"))
    assert k == 4 and loaded.orderBy("rank").collect() == built.select(loaded.columns).orderBy("rank").collect()
    assert [r["value"] for r in sinks.fasta(frame(spark, ["AC", ""])).collect()] == [">seq.1\nAC", ">seq.2\n"]
