"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import cut


#: A side of up to so many nodes, 16 bytes each, is sent to all executors; larger ones meet by a shuffle.
SENT_NODES = 500_000


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a long, b long): root is the smallest node reachable.

    A large-star round ties each node's larger neighbours to the smallest node around it, a small-star round the smaller
    ones; the links end up as one star for each component, after a number of rounds that grows with the logarithm of the
    number of nodes. Smallest neighbours are found by partial aggregation, so a node with very many links is no hot spot
    there; nor in the join back, for which the smallest neighbours of up to SENT_NODES nodes are sent to all executors. With
    more, the join is one that Spark can split. Each round is materialised in the shared folder. Null ends and loops are
    ignored.
    """
    ends = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = cut(ends.where("u is not null and v is not null and u != v").distinct())
    mark = seen = edges.agg(F.count("*"), F.lit(None)).first()
    for _ in range(rounds):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        small_side = F.broadcast if 2 * seen[0] <= SENT_NODES else lambda df: df
        large = both.join(small_side(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_side(low), "u").select("v", "m").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v")))
        edges = cut(small.distinct())
        seen = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("components() has not settled")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
