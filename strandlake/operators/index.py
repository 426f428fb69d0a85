"""The k-mer index: distinct k-mers of both strands, padding nodes, colexicographic ranks, suffix lengths, graph columns.

A row is (rank, kmer, rkmer, is_dummy); ``rkmer`` is the k-mer reversed, so that colexicographic order is its plain order
and a suffix of the k-mer is a prefix of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions.sequences import common_prefix, reverse_complement
from strandlake.storage import materialised, spread

PAD = "$"


def both_strands(refs: DataFrame) -> DataFrame:
    seqs = refs.select("seq").where("seq is not null")
    return seqs.unionAll(seqs.select(reverse_complement(F.col("seq")).alias("seq")))


def kmers(seqs: DataFrame, k: int) -> DataFrame:
    """(kmer) of every position; windows with anything but bases are left out."""
    seqs = spread(seqs.select("seq"))
    runs = seqs.select(F.explode(F.split("seq", "[^ACGT]+")).alias("run")).where(F.length("run") >= k)
    at = runs.select("run", F.explode(F.sequence(F.lit(1), F.length("run") - k + 1)).alias("p"))
    return at.select(F.substring("run", F.col("p"), F.lit(k)).alias("kmer"))


def kmer_set(refs: DataFrame, k: int, add_revcomp: bool = True) -> DataFrame:
    return kmers(both_strands(refs) if add_revcomp else refs, k).distinct()


def sources(nodes: DataFrame, k: int) -> DataFrame:
    """The k-mers that no other one leads to."""
    reached = nodes.select(F.right("kmer", F.lit(k - 1)).alias("link")).distinct()
    return nodes.join(reached, F.left("kmer", F.lit(k - 1)) == F.col("link"), "left_anti")


def dummies(nodes: DataFrame, k: int) -> DataFrame:
    """Padded prefixes of all sources, and the root."""
    prefix = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.lpad(F.left("kmer", i), F.lit(k), F.lit(PAD)))
    root = nodes.sparkSession.range(1).select(F.lit(PAD * k).alias("kmer"))
    return sources(nodes, k).select(F.explode(prefix).alias("kmer")).unionAll(root).distinct()


def ranked(df: DataFrame, order: str, name: str = "rank") -> DataFrame:
    """A dense number from 0 in the order of a column, without gathering rows in one task.

    Rows are range-partitioned and sorted; a row's number in its partition is added to the sum of the partitions before
    it. The driver sees one count for each partition.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(parts, order).sortWithinPartitions(order).withColumn("__at", F.monotonically_increasing_id())
    placed = materialised(placed)
    part = F.shiftright("__at", 33)
    before, offsets = 0, []
    for row in sorted(placed.groupBy(part.alias("p")).count().collect(), key=lambda r: r["p"]):
        offsets.append((row["p"], before))
        before += row["count"]
    firsts = df.sparkSession.createDataFrame(offsets, "__part long, __before long")
    joined = placed.withColumn("__part", part).join(F.broadcast(firsts), "__part")
    return joined.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1)).drop("__at", "__part", "__before")


def build(refs: DataFrame, k: int, add_revcomp: bool = True) -> DataFrame:
    """(rank, kmer, rkmer, is_dummy) of all nodes."""
    real = materialised(kmer_set(refs, k, add_revcomp))  # else each of its four uses would count k-mers anew
    nodes = real.withColumn("is_dummy", F.lit(False)).unionAll(dummies(real, k).withColumn("is_dummy", F.lit(True)))
    return ranked(materialised(nodes.withColumn("rkmer", F.reverse("kmer"))), "rkmer").select("rank", "kmer", "rkmer", "is_dummy")


def with_lcs(index: DataFrame, k: int) -> DataFrame:
    """How long a suffix each node shares with the one before it."""
    before = index.select((F.col("rank") + 1).alias("rank"), F.col("rkmer").alias("__before"))
    return index.join(before, "rank", "left").withColumn("lcs", common_prefix(F.col("rkmer"), F.col("__before"), k)).drop("__before")


def predecessors(index: DataFrame, k: int) -> DataFrame:
    """(rank, indeg, pred): how many k-mers lead to each k-mer, and the one where there is one only."""
    real = index.where("not is_dummy")
    before = real.select(F.right("kmer", F.lit(k - 1)).alias("link"), F.col("rank").alias("p"))
    found = before.groupBy("link").agg(F.count("*").alias("n"), F.min("p").alias("p"))
    joined = real.select("rank", F.left("kmer", F.lit(k - 1)).alias("link")).join(found, "link", "left")
    return joined.select("rank", F.coalesce("n", F.lit(0)).cast("int").alias("indeg"), F.when(F.col("n") == 1, F.col("p")).alias("pred"))


def doubled(hops: DataFrame) -> DataFrame:
    """(rank, to) of twice as many steps."""
    return hops.join(hops.select(F.col("rank").alias("to"), F.col("to").alias("__further")), "to").select("rank", F.col("__further").alias("to"))


def hops(preds: DataFrame, steps: int) -> DataFrame:
    """(rank, to): where ``steps`` unique predecessors lead; rows whose path ends before have none."""
    power, out, n = preds.where("pred is not null").select("rank", F.col("pred").alias("to")), None, steps
    while True:
        if n & 1:
            out = power if out is None else out.join(power.select(F.col("rank").alias("to"), F.col("to").alias("__further")), "to").select("rank", F.col("__further").alias("to"))
        n >>= 1
        if not n:
            return materialised(out)
        power = materialised(doubled(power))
