"""Tokens back into reads: segments by rank, long tokens by hops along unique predecessors, then ordered concatenation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import sequences as S
from strandlake.operators.index import doubled, hops, predecessors
from strandlake.storage import materialised


def long_pieces(tokens: DataFrame, preds: DataFrame, k: int) -> DataFrame:
    """(record_no, tok_no, part, rank): the k-mers that tokens longer than k are made of, part 0 being the stored one.

    A token of k q + 1 bases has q whole k-mers, k unique predecessors apart. Their ranks are found by halving: with
    hops of 2^i k-mers a run is split in two, from the largest power down, so rounds grow with the logarithm of the
    longest token.
    """
    runs = tokens.where((F.col("len") > k) & ~F.col("is_literal")).select("record_no", "tok_no", F.lit(0).alias("part"), "rank", F.floor((F.col("len") - 1) / k).cast("int").alias("n"))
    most = runs.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    if most <= 1:
        return runs.drop("n")
    powers = [hops(preds, k)]
    while 2 << (len(powers) - 1) < most:
        powers.append(materialised(doubled(powers[-1])))
    for i in range(len(powers) - 1, -1, -1):
        step = 1 << i
        cuts = runs.where(F.col("n") > step).join(powers[i], "rank")
        right = cuts.select("record_no", "tok_no", (F.col("part") + step).alias("part"), F.col("to").alias("rank"), (F.col("n") - step).alias("n"))
        runs = materialised(runs.withColumn("n", F.least("n", F.lit(step))).unionAll(right))  # else each round would double the plan
    return runs.drop("n")


def segments(tokens: DataFrame, index: DataFrame, k: int, preds: DataFrame | None = None) -> DataFrame:
    """(record_no, tok_no, segment): the bases of each token; preds: the index's ``predecessors``, if they are at hand."""
    preds = materialised(predecessors(index, k)) if preds is None else preds
    tokens = materialised(tokens)  # it has four uses; packed blocks would be decoded for each
    literal = tokens.where("is_literal").select("record_no", "tok_no", F.col("literal").alias("segment"))
    kmer = index.select("rank", "kmer")
    short = tokens.where((F.col("len") <= k) & ~F.col("is_literal")).join(kmer, "rank").select("record_no", "tok_no", F.right("kmer", F.col("len")).alias("segment"))
    pieces = long_pieces(tokens, preds, k)
    # Before the last whole k-mer stands one base: that of its only predecessor's k-mer.
    ends = pieces.groupBy("record_no", "tok_no").agg(F.max_by("rank", "part").alias("rank"), (F.max("part") + 1).alias("part"))
    heads = ends.join(preds.where("pred is not null").select("rank", "pred"), "rank").select("record_no", "tok_no", "part", F.col("pred").alias("rank"))
    whole = pieces.join(kmer, "rank").select("record_no", "tok_no", "part", F.col("kmer").alias("s"))
    head = heads.join(kmer, "rank").select("record_no", "tok_no", "part", F.left("kmer", F.lit(1)).alias("s"))
    ordered = F.sort_array(F.collect_list(F.struct("part", "s")), asc=False)
    long = whole.unionAll(head).groupBy("record_no", "tok_no").agg(F.array_join(F.transform(ordered, lambda x: x["s"]), "").alias("segment"))
    return literal.unionAll(short).unionAll(long)


def decode(tokens: DataFrame, index: DataFrame, k: int, preds: DataFrame | None = None) -> DataFrame:
    """(record_no, seq) of all records, from the right-to-left tokens."""
    ordered = F.sort_array(F.collect_list(F.struct("tok_no", "segment")), asc=False)
    return segments(tokens, index, k, preds).groupBy("record_no").agg(F.array_join(F.transform(ordered, lambda x: x["segment"]), "").alias("seq"))


def token_view(packed: DataFrame) -> DataFrame:
    """(record_no, tokens array<struct<len, rank, first>>) of the reference tokens of packed records."""
    word = F.col("word")
    refs = packed.where(S.token_flags(word).bitwiseAND(2) == 0)
    entry = F.struct("tok_no", S.token_length(word).alias("len"), S.token_rank(word).alias("rank"), (S.token_flags(word).bitwiseAND(1) == 1).alias("first"))
    return refs.groupBy("record_no").agg(F.transform(F.sort_array(F.collect_list(entry)), lambda t: F.struct(t["len"].alias("len"), t["rank"].alias("rank"), t["first"].alias("first"))).alias("tokens"))
