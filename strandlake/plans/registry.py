"""The sequence engine's queries over the test tables, and the SQL that says the same.

Reads are the base letters of all ``documents``, numbered by doc_id; references those of all ``benchmark`` and ``pages``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import sequences as S
from strandlake.operators import blocks, codec, decode, index, match, tokens
from strandlake.sources import sinks
from strandlake.storage import materialised, table

K = 15


def reads(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select((F.col("doc_id") + 1).alias("record_no"), S.letters_as_bases(F.col("text")).alias("seq"))


def references(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "benchmark").select(S.letters_as_bases(F.col("text")).alias("seq"))
    return own.unionAll(table(spark, d, "pages").select(S.letters_as_bases(F.col("html")).alias("seq")))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return index.build(references(spark, d), K)


def read_kmers(spark: SparkSession, d: str) -> DataFrame:
    return index.kmers(reads(spark, d), K).distinct()


def parsed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(index, tokens, predecessors)."""
    built = nodes(spark, d)
    preds = materialised(index.predecessors(built, K))
    return built, materialised(tokens.tokenize(built, reads(spark, d), K, preds)), preds


def seq_normalize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(S.normalize(F.col("text"))).alias("seq_md5"))


def seq_revcomp(spark, d):
    return reads(spark, d).select("record_no", S.reverse_complement(F.col("seq")).alias("revcomp"))


def chunks(spark, d):
    """Whole reads in pieces of WORD_BASES; an empty read has none."""
    return reads(spark, d).select("record_no", F.posexplode(S.rechunk(F.col("seq"))).alias("chunk", "bases"))


def pack_2bit(spark, d):
    return chunks(spark, d).select("record_no", "chunk", S.pack_2bit(F.col("bases")).alias("word"))


def unpack_2bit(spark, d):
    packed = chunks(spark, d).select("record_no", "chunk", S.pack_2bit(F.col("bases")).alias("word"), F.length("bases").alias("n"))
    pieces = packed.select("record_no", F.struct("chunk", S.unpack_2bit(F.col("word"), F.col("n")).alias("bases")).alias("piece"))
    joined = pieces.groupBy("record_no").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    whole = joined.select("record_no", F.array_join(F.transform("pieces", lambda x: x["bases"]), "").alias("bases"))
    return whole.unionAll(reads(spark, d).where("seq = ''").select("record_no", F.col("seq").alias("bases")))


def suffix_slice(spark, d):
    return read_kmers(spark, d).select("kmer", S.suffix(F.col("kmer"), F.lit(7)).alias("suffix"))


def input_union(spark, d):
    return references(spark, d).groupBy(F.length("seq").alias("bases")).agg(F.count("*").alias("n"))


def kmer_distinct(spark, d):
    return index.kmer_set(references(spark, d), K)


def dummy_nodes(spark, d):
    return index.dummies(index.kmer_set(references(spark, d), K), K)


def colex_rank(spark, d):
    return nodes(spark, d).select("rank", "kmer", "is_dummy")


def lcs_array(spark, d):
    return index.with_lcs(nodes(spark, d), K).select("rank", "lcs")


def kmer_search(spark, d):
    return match.search(nodes(spark, d), read_kmers(spark, d))


def kmer_miss(spark, d):
    return match.misses(nodes(spark, d), read_kmers(spark, d))


def access_kmer(spark, d):
    built = nodes(spark, d)
    return match.access(built, built.where("not is_dummy").select("rank"))


def suffix_interval(spark, d):
    return match.intervals(nodes(spark, d), 1, K).select(F.reverse("reversed").alias("suffix"), "lo", "hi")


def in_degree(spark, d):
    return index.predecessors(nodes(spark, d), K).select("rank", "indeg")


def unique_pred(spark, d):
    return index.predecessors(nodes(spark, d), K).where("pred is not null").select("rank", "pred")


def left_extend(spark, d):
    return index.hops(index.predecessors(nodes(spark, d), K), K).select("rank", "to")


def matching_statistics(spark, d):
    return match.matching_statistics(nodes(spark, d), reads(spark, d), K).select("record_no", "pos", "ms", "lo", "hi")


def ext_run(spark, d):
    return tokens.extension_runs(nodes(spark, d), reads(spark, d), K).select("record_no", "pos", "run")


def token_len(spark, d):
    return tokens.extension_runs(nodes(spark, d), reads(spark, d), K).select("record_no", "pos", "tok_len")


def tokenize(spark, d):
    return parsed(spark, d)[1].select("record_no", "tok_no", "pos", "len", "rank", "is_literal", "first", "literal")


def token_pack(spark, d):
    return tokens.pack(parsed(spark, d)[1])


def split_streams(spark, d):
    return tokens.split_streams(tokens.pack(parsed(spark, d)[1]))


def literal_rechunk(spark, d):
    literal = parsed(spark, d)[1].where("is_literal")
    ordered = F.sort_array(F.collect_list(F.struct("tok_no", "literal")))
    joined = literal.groupBy("record_no").agg(F.array_join(F.transform(ordered, lambda x: x["literal"]), "").alias("bases"))
    return joined.select("record_no", F.posexplode(S.rechunk(F.col("bases"))).alias("chunk", "bases")).select("record_no", "chunk", S.pack_2bit(F.col("bases")).alias("word"))


def block_assign(spark, d):
    return blocks.with_block(reads(spark, d), 256).groupBy("block_id").agg(F.count("*").alias("records"), F.sum(F.length("seq")).alias("bases"))


def rice_param_size(spark, d):
    refs = blocks.with_block(parsed(spark, d)[1].where("not is_literal"), 256)
    return codec.rice_sizes(refs, "block_id", "len")


def minbin_size(spark, d):
    refs = blocks.with_block(parsed(spark, d)[1].where("not is_literal"), 256)
    return codec.minimal_binary_sizes(refs, "block_id", "rank")


def zip_streams(spark, d):
    return blocks.zipped_streams(tokens.pack(parsed(spark, d)[1]), 256)


def token_check(spark, d):
    return tokens.check(parsed(spark, d)[1], reads(spark, d))


def legacy_token_view(spark, d):
    return decode.token_view(tokens.pack(parsed(spark, d)[1])).select("record_no", F.to_json("tokens").alias("tokens"))


def decode_tokens(spark, d):
    built, found, preds = parsed(spark, d)
    return decode.decode(found, built, K, preds)


def roundtrip(spark, d):
    built, found, preds = parsed(spark, d)
    stored = materialised(blocks.write_blocks(tokens.pack(found), 256))
    return decode.decode(blocks.as_tokens(blocks.read_blocks(stored, 256)), built, K, preds)


def fasta_render(spark, d):
    built, found, preds = parsed(spark, d)
    return sinks.fasta(decode.decode(found, built, K, preds))


def gzip_roundtrip(spark, d):
    texts = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = [codec.inflate(codec.deflate(t.encode())).decode() for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return texts.mapInArrow(run, "doc_id long, text string")


def random_nucleotide(spark, d):
    """Uniform bases from a seed, one row of 1000 for each nation."""
    base = lambda i: F.element_at(F.array(*map(F.lit, "ACGT")), (F.pmod(F.xxhash64("n_nationkey", i), F.lit(4)) + 1).cast("int"))
    return table(spark, d, "nation").select("n_nationkey", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1000)), base), "").alias("seq"))


QUERIES = (
    *(seq_normalize, seq_revcomp, pack_2bit, unpack_2bit, suffix_slice, input_union),
    *(kmer_distinct, dummy_nodes, colex_rank, lcs_array, kmer_search, kmer_miss, access_kmer, suffix_interval),
    *(in_degree, unique_pred, left_extend, matching_statistics, ext_run, token_len),
    *(tokenize, token_pack, split_streams, literal_rechunk, block_assign, rice_param_size, minbin_size, zip_streams, token_check),
    *(legacy_token_view, decode_tokens, roundtrip, fasta_render, gzip_roundtrip, random_nucleotide),
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return tokenize(spark, d)


BASE_LETTERS = "upper(regexp_replace(lower(coalesce({c}, '')), '[^acgt]', '', 'g'))"
WITH = f"""with recursive reads as materialized (select doc_id + 1 as record_no, {BASE_LETTERS.format(c='text')} as seq from documents),
refs as materialized (select {BASE_LETTERS.format(c='text')} as seq from benchmark union all select {BASE_LETTERS.format(c='html')} from pages),
strands as (select seq from refs union all select translate(reverse(seq), 'ACGT', 'TGCA') from refs),
kset as materialized (select distinct unnest(list_transform(range(1, length(seq) - {K} + 2), lambda p: substr(seq, p, {K}))) as kmer from strands where length(seq) >= {K}),
src as (select kmer from kset where left(kmer, {K - 1}) not in (select right(kmer, {K - 1}) from kset)),
dum as (select distinct lpad(left(kmer, i), {K}, '$') as kmer from src, range(0, {K}) t(i) union select repeat('$', {K})),
idx as materialized (select row_number() over (order by reverse(kmer)) - 1 as rank, kmer, reverse(kmer) as rkmer, is_dummy from (select kmer, false as is_dummy from kset union all select kmer, true from dum)),
rk as (select distinct unnest(list_transform(range(1, length(seq) - {K} + 2), lambda p: substr(seq, p, {K}))) as kmer from reads where length(seq) >= {K}),
prec as materialized (select a.rank, count(b.rank) as indeg, min(b.rank) as p from idx a left join idx b on not b.is_dummy and right(b.kmer, {K - 1}) = left(a.kmer, {K - 1}) where not a.is_dummy group by a.rank),
iv as materialized (select left(rkmer, n) as r, min(rank) as lo, max(rank) + 1 as hi from idx, range(1, {K + 1}) t(n) where not contains(left(rkmer, n), '$') group by 1),
pos as (select record_no, p - 1 as pos, reverse(substr(seq, greatest(p - {K - 1}, 1), least(p, {K}))) as q from (select record_no, seq, unnest(range(1, length(seq) + 1)) as p from reads)),
best as (select record_no, pos, max(n) as ms from (select record_no, pos, q, unnest(range(1, length(q) + 1)) as n from pos) where left(q, n) in (select r from iv) group by 1, 2),
stats as materialized (select pos.record_no, pos.pos, q, coalesce(ms, 0) as ms from pos left join best using (record_no, pos)),
ext as (select s.*, coalesce(s.pos >= {K + 1} and s.ms = {K} and lag(s.ms) over w = {K} and u.rank is not null, false) as e
    from stats s left join (select i.rkmer, i.rank from idx i join prec on prec.rank = i.rank and indeg = 1) u on u.rkmer = s.q window w as (partition by s.record_no order by s.pos)),
runs as (select *, pos - max(case when not e then pos end) over (partition by record_no order by pos rows unbounded preceding) as run from ext),
lens as materialized (select *, cast(case when ms = {K} and pos >= {K + 1} then {K} * ((run + {K - 1}) // {K}) + 1 else greatest(ms, 1) end as int) as tok_len from runs),
walk(record_no, tok_no, pos) as (select record_no, 0, length(seq) - 1 from reads where seq <> ''
    union all select w.record_no, w.tok_no + 1, w.pos - l.tok_len from walk w join lens l on l.record_no = w.record_no and l.pos = w.pos where w.pos - l.tok_len >= 0),
toks as materialized (select w.record_no, w.tok_no, w.pos, l.tok_len as len, l.ms, case when l.tok_len > 11 then iv.lo end as rank, l.tok_len <= 11 as is_literal, w.tok_no = 0 as first,
        case when l.tok_len <= 11 then substr(r.seq, w.pos - l.tok_len + 2, l.tok_len) end as literal
    from walk w join lens l on l.record_no = w.record_no and l.pos = w.pos join reads r on r.record_no = w.record_no left join iv on iv.r = left(l.q, l.ms)
    union all select record_no, 0, -1, 0, 0, null, true, true, '' from reads where seq = ''),
words as (select *, (case when is_literal then ((first::bigint + 2) | (len << 2)) << 56 else (first::bigint << 56) | (len::bigint << 32) | rank end)
        | (case when is_literal then coalesce(list_sum(list_transform(range(0, len), lambda i: (instr('ACGT', substr(literal, i + 1, 1)) - 1)::bigint << (2 * i)))::bigint, 0) else 0 end) as word from toks)
"""
DECODED = f"select doc_id + 1 as record_no, {BASE_LETTERS.format(c='text')} as seq from documents"


def packed_sql(column: str) -> str:
    return f"coalesce(list_sum(list_transform(range(0, length({column})), lambda i: (instr('ACGT', substr({column}, i + 1, 1)) - 1)::bigint << (2 * i)))::bigint, 0)"


def oracle_sql() -> dict[str, str]:
    return {
        "seq_normalize": r"""select doc_id, md5(regexp_replace(translate(regexp_replace(text, '[\t-\r ]', '', 'g'),
            'abcdefghijklmnopqrstuvwxyzU.~', 'ABCDEFGHIJKLMNOPQRSTTVWXYZT--'), '[^ACGTNBDHVRYSWKM-]', 'N', 'g')) as seq_md5 from documents""",
        "seq_revcomp": WITH + "select record_no, translate(reverse(seq), 'ACGT', 'TGCA') as revcomp from reads",
        "pack_2bit": WITH + f", c as (select record_no, unnest(range(0, (length(seq) + 30) // 31)) as chunk, seq from reads) select record_no, chunk, {packed_sql('substr(seq, 31 * chunk + 1, 31)')} as word from c",
        "unpack_2bit": WITH + "select record_no, seq as bases from reads",
        "suffix_slice": WITH + "select kmer, right(kmer, 7) as suffix from rk",
        "input_union": WITH + "select length(seq) as bases, count(*) as n from refs group by 1",
        "kmer_distinct": WITH + "select kmer from kset",
        "dummy_nodes": WITH + "select kmer from dum",
        "colex_rank": WITH + "select rank, kmer, is_dummy from idx",
        "lcs_array": WITH + f"select a.rank, coalesce(len(list_filter(range(1, {K + 1}), lambda i: left(a.rkmer, i) = left(a.before, i))), 0) as lcs from (select rank, rkmer, lag(rkmer) over (order by rank) as before from idx) a",
        "kmer_search": WITH + "select kmer, rank from rk join idx using (kmer) where not is_dummy",
        "kmer_miss": WITH + "select kmer from rk where kmer not in (select kmer from kset)",
        "access_kmer": WITH + "select rank, kmer from idx where not is_dummy",
        "suffix_interval": WITH + "select reverse(r) as suffix, lo, hi from iv",
        "in_degree": WITH + "select rank, indeg from prec",
        "unique_pred": WITH + "select rank, p as pred from prec where indeg = 1",
        "left_extend": WITH + f", hop(rank, here, n) as (select rank, p, 1 from prec where indeg = 1 union all select h.rank, p.p, h.n + 1 from hop h join prec p on p.rank = h.here and p.indeg = 1 where h.n < {K}) select rank, here as \"to\" from hop where n = {K}",
        "matching_statistics": WITH + "select record_no, pos, ms, lo, hi from stats left join iv on r = left(q, ms)",
        "ext_run": WITH + "select record_no, pos, run from runs",
        "token_len": WITH + "select record_no, pos, tok_len from lens",
        "tokenize": WITH + "select record_no, tok_no, pos, len, rank, is_literal, first, literal from toks",
        "token_pack": WITH + "select record_no, tok_no, word from words",
        "split_streams": WITH + "select record_no, tok_no, case when is_literal then first::int + 2 + 4 * len else first::int end as flags, rank, case when not is_literal then len end as length, literal from toks",
        "literal_rechunk": WITH + f", j as (select record_no, string_agg(literal, '' order by tok_no) as b from toks where is_literal group by 1), c as (select record_no, unnest(range(0, (length(b) + 30) // 31)) as chunk, b from j) select record_no, chunk, {packed_sql('substr(b, 31 * chunk + 1, 31)')} as word from c",
        "block_assign": WITH + "select (record_no - 1) // 256 as block_id, count(*) as records, sum(length(seq))::bigint as bases from reads group by 1",
        "rice_param_size": WITH + ", v as (select (record_no - 1) // 256 as block_id, len from toks where not is_literal), s as (select block_id, b, count(*) as n, (sum(len::bigint >> b) + count(*) * (1 + b))::bigint as bits from v, range(0, 33) t(b) group by 1, 2) select block_id, any_value(n) as n, arg_min(b, bits * 64 + b) as param, min(bits) as bits from s group by 1",
        "minbin_size": WITH + ", v as (select (record_no - 1) // 256 as block_id, rank, max(rank) over (partition by (record_no - 1) // 256) + 2 as param from toks where not is_literal), l as (select *, length(bin(param)) - 1 as low from v) select block_id, count(*) as n, any_value(param) as param, sum(low + (rank + 1 >= (2::bigint << low) - param)::int)::bigint as bits from l group by 1",
        "zip_streams": WITH + "select record_no, tok_no, word from words",
        "token_check": WITH + "select reads.record_no, length(seq)::bigint as bases, covered, longest from reads left join (select record_no, sum(len)::bigint as covered, max(len) as longest from toks group by 1) t on t.record_no = reads.record_no",
        "legacy_token_view": WITH + "select record_no, '[' || string_agg('{\"len\":' || len || ',\"rank\":' || rank || ',\"first\":' || first::varchar || '}', ',' order by tok_no) || ']' as tokens from toks where not is_literal group by 1",
        "decode_tokens": DECODED,
        "roundtrip": DECODED,
        "fasta_render": f"select record_no, '>seq.' || record_no || chr(10) || seq as value from ({DECODED})",
        "gzip_roundtrip": "select doc_id, coalesce(text, '') as text from documents",
    }
