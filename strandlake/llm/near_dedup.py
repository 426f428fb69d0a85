"""Near-duplicate groups by circulant MinHash, banding and verification on whole shingle sets.

1. One pass over the texts gives each document's shingle count, a 128-bit hash of its word sequence and the hashes of its
   signature's bands. Documents of one word sequence are copies; the smallest doc_id stands for them from here on.
2. Representatives that share a band value are tied to the smallest of them (a star, not all pairs), and components of
   these ties are families. Two documents at the threshold share none of the 38 bands of 5 coordinates with a probability
   below 1e-9 at 0.85 and 3e-7 at 0.8.
3. Members of families with more than one member get their shingle sets in a second pass. In each family members are
   compared exactly, by counting shared shingles over postings. A large family is first compared with a few pivots, and is
   dealt out to tasks by pairs of blocks of members, but for pairs whose sizes rule a link out and those that pivots connect
   already. A task returns a spanning forest of the links that it finds, so output stays linear in the members.
4. Components of these links are the groups.

Links: 100 * intersection >= percent * union of the distinct shingles. A document with fewer words than a shingle has is
one shingle; one without words has none and is linked with nothing, not even its copies.

Cases: a null text has no words. A row with a null doc_id takes part in nothing; its component is null and it is kept.
Rows that share a doc_id and a text are one document twice; ones with different texts join both texts' groups, but a row
without words among them is linked with nothing. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import cut
from strandlake.llm.components import components
from strandlake.llm.shingles import CirculantMinHash, WordHashes, bands_of, shingle_set, words

BANDS, ROWS = 38, 5
#: Members of a block of a family, and bytes of their sets; two blocks are one task's input.
BLOCK, BLOCK_BYTES = 2048, 32 << 20
#: Postings that are counted at once.
POSTINGS = 4_000_000
#: Members of a class of sizes in a large family that all members of it are compared with first.
PIVOTS = 4
#: Up to so many members of families, 8 bytes each, are sent to all executors; more are joined by a shuffle.
SENT_IDS = 500_000

_worker: dict = {}


def _tools() -> tuple[WordHashes, CirculantMinHash]:
    if not _worker:
        _worker["tools"] = WordHashes(), CirculantMinHash(BANDS * ROWS)
    return _worker["tools"]


def signed(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, copy binary, bands array<long>) of each row; no bands without words."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, minhash = _tools()
        for batch in rows:
            ids, counts, copies, bands = batch.column(0), [], [], []
            for text in batch.column(1):
                tokens = words(text.as_py())
                shingles = shingle_set(tokens, size, hashes)
                counts.append(len(shingles))
                copies.append(xxhash.xxh3_128_digest(" ".join(tokens)))
                bands.append(bands_of(minhash.signature(shingles), BANDS, ROWS) if len(shingles) else None)
            yield pa.record_batch([ids, pa.array(counts, pa.int64()), pa.array(copies, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "copy", "bands"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, copy binary, bands array<bigint>")


def shingled(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, shingles binary): the sorted 64-bit hashes of each row's set."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, _ = _tools()
        for batch in rows:
            sets = [shingle_set(words(t.as_py()), size, hashes).tobytes() for t in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.binary())], names=["doc_id", "shingles"])

    return docs.mapInArrow(run, "doc_id long, shingles binary")


def linked(ids: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between documents ``left`` and ``right`` (numbers into ids and sets)."""
    used = np.union1d(left, right)
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate([sets[i] for i in used])
    _, codes, counts = np.unique(flat, return_inverse=True, return_counts=True)
    cuts = np.cumsum(sizes[used])[:-1]
    coded = dict(zip(used.tolist(), np.split(codes, cuts), strict=True))
    owners = np.concatenate([np.full(sizes[i], k) for k, i in enumerate(right.tolist())])
    flat_right = np.concatenate([coded[i] for i in right.tolist()])
    order = np.argsort(flat_right, kind="stable")
    postings, starts = owners[order], np.searchsorted(flat_right[order], np.arange(len(counts) + 1))
    parent = {i: i for i in used.tolist()}

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i in left.tolist():
        mine = coded[i][counts[coded[i]] > 1]
        first, n = starts[mine], starts[mine + 1] - starts[mine]
        shared = np.zeros(len(right), dtype=np.int64)
        ends = np.cumsum(n)
        a = 0
        while a < len(mine):  # as many of its shingles at a time as have POSTINGS postings, one at least
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + POSTINGS, side="right")))
            part = n[a:b]
            at = np.repeat(first[a:b] - np.cumsum(part) + part, part) + np.arange(part.sum())
            shared += np.bincount(postings[at], minlength=len(right))
            a = b
        for j in right[100 * shared >= percent * (sizes[i] + sizes[right] - shared)].tolist():
            if (p := root(i)) != (q := root(j)):
                parent[max(p, q)] = min(p, q)
                out.append((int(ids[i]), int(ids[j])))
    return out


def size_class(percent: int):
    """The class of a set's size: sizes of a link are of one class or of neighbouring ones, as the smaller is at least ``percent`` of the larger."""
    size = F.length("shingles") / 8
    if percent <= 0:
        return F.lit(0)
    # A width a little above the largest ratio's logarithm keeps rounding from parting such sizes by two classes.
    return F.floor(F.log(size) / (math.log(100 / percent) * (1 + 1e-9))).cast("int") if percent < 100 else size.cast("int")


def verified(dealt: DataFrame, percent: int, *keys: str) -> DataFrame:
    """(a, b): links of the rows marked ``left`` with those marked ``right`` in each group; dealt: (keys, node, shingles, left, right)."""

    def verify(table: pa.Table) -> pa.Table:
        ids = table.column("node").to_numpy()
        sets = [np.frombuffer(s.as_py(), dtype=np.uint64) for s in table.column("shingles")]
        left, right = (np.flatnonzero(table.column(side).to_pylist()) for side in ("left", "right"))
        found = linked(ids, sets, left, right, percent) if len(left) and len(right) else []
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return dealt.groupBy(*keys).applyInArrow(verify, "a long, b long")


def pivots(members: DataFrame, bands: DataFrame, small_side) -> DataFrame:
    """(family, class, node): of each of PIVOTS hash shares of a class the member whose bands agree most with the class's commonest."""
    banded = members.select("family", "class", "node").join(bands, "node")
    counts = banded.select("family", "class", F.posexplode("bands").alias("band", "value")).groupBy("family", "class", "band", "value").count()
    common = counts.groupBy("family", "class", "band").agg(F.max_by("value", F.struct("count", "value")).alias("value"))
    modes = common.groupBy("family", "class").agg(F.sort_array(F.collect_list(F.struct("band", "value")))["value"].alias("modes"))
    agreed = F.size(F.filter(F.zip_with("bands", "modes", lambda x, y: x == y), lambda same: same))
    share = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(PIVOTS)).alias("share")
    best = banded.join(small_side(modes), ["family", "class"]).groupBy("family", "class", share).agg(F.max_by("node", F.struct(agreed, "node")).alias("node"))
    return best.select("family", "class", "node")


def family_links(members: DataFrame, bands: DataFrame, percent: int, sent: bool = False) -> DataFrame:
    """(a, b): links that connect what is connected in each family; members: (node, family, shingles), bands: (node, bands).

    A family of one block is compared whole. A larger one is cut by classes of sizes; sets of classes that are not the same
    or neighbours are too unlike in size to link. Its members are first compared with a few pivots of these classes. Members
    that links to pivots connect are one cluster already and need not meet each other: after that, clusters and what is left
    are cut into blocks, and a pair of blocks of like sizes is one task unless both are of one cluster.
    ``sent``: the families are so few that their sizes go to all executors, and no family's members meet before they are dealt out.
    """
    needed = lambda n, size: F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")
    small_side = F.broadcast if sent else lambda df: df
    # A doc_id with several texts may have one without words, which is linked with nothing.
    members = members.where(F.length("shingles") > 0)
    sizes = members.groupBy("family").agg(needed(F.count("*"), F.sum(F.length("shingles"))).alias("whole"))
    large = cut(sizes.where("whole > 1").select("family"))
    inside = members.join(small_side(large), "family", "left_anti").withColumns({"left": F.lit(True), "right": F.lit(True)})
    links = verified(inside, percent, "family")
    if large.isEmpty():
        return links
    members = members.join(small_side(large), "family", "left_semi").withColumn("class", size_class(percent))
    weight = needed(F.count("*"), F.sum(F.length("shingles")))
    blocks = cut(members.groupBy("family", "class").agg(weight.alias("n")))
    block = F.pmod(F.xxhash64("node"), F.col("n")).cast("int").alias("block")
    own = members.join(small_side(blocks), ["family", "class"]).select("family", "class", block, "node", "shingles", F.lit(False).alias("left"), F.lit(True).alias("right"))
    chosen = members.join(small_side(pivots(members, bands, small_side)), ["family", "class", "node"], "left_semi")
    beside = chosen.select("family", F.explode(F.array(*(F.col("class") + step for step in (-1, 0, 1)))).alias("class"), "node", "shingles")
    everywhere = beside.join(small_side(blocks), ["family", "class"]).select("family", "class", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("block"), "node", "shingles", F.lit(True).alias("left"), F.lit(False).alias("right"))
    near = cut(verified(own.unionAll(everywhere), percent, "family", "class", "block"))
    clusters = components(near).select("node", F.col("root").alias("cluster"))
    tagged = members.join(small_side(clusters), "node", "left")
    cells = tagged.groupBy("family", "class", "cluster").agg(weight.alias("n"))
    known = cells.groupBy("family").agg(F.collect_list(F.struct("class", "cluster", "n")).alias("cells"))
    placed = tagged.join(small_side(known), "family")
    mine = lambda x: (x["class"] == F.col("class")) & x["cluster"].eqNullSafe(F.col("cluster"))
    cell = lambda x, i: F.struct(x["class"].alias("class"), x["cluster"].alias("cluster"), i.cast("int").alias("i"))
    meets = lambda x: (F.abs(x["class"] - F.col("class")) <= 1) & F.coalesce(x["cluster"] != F.col("cluster"), F.lit(True))
    home = F.filter("cells", mine)[0]
    others = F.flatten(F.transform(F.filter("cells", meets), lambda x: F.transform(F.sequence(F.lit(1), x["n"]), lambda i: cell(x, i - 1))))
    pairs = placed.select("family", "node", "shingles", cell(home, F.pmod(F.xxhash64("node"), home["n"])).alias("cell"), F.explode(others).alias("other"))
    # Each member goes to the tasks of its block with every other block that it may link to; a pair of blocks is one task, in one order.
    x, y = F.least("cell", "other"), F.greatest("cell", "other")
    dealt = pairs.select("family", x.alias("x"), y.alias("y"), "node", "shingles", (F.col("cell") == x).alias("left"), (F.col("cell") == y).alias("right"))
    return links.unionAll(near).unionAll(verified(dealt, percent, "family", "x", "y"))


def groups(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    rows = cut(signed(docs, size))
    real = rows.where("doc_id is not null and bands is not null")
    # Only one of the copies needs its bands; they are equal.
    copies = cut(real.groupBy("copy").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands")))
    banded = copies.select("node", F.posexplode("bands").alias("band", "value"))
    buckets = banded.groupBy("band", "value").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").select("band", "value", "a")
    ties = banded.join(buckets, ["band", "value"]).where("node != a").select("a", F.col("node").alias("b"))
    families = cut(components(ties).select("node", F.col("root").alias("family")))
    n = families.count()
    chosen = families if n > SENT_IDS else F.broadcast(families)
    # A doc_id may stand for several texts; all of them are compared under it.
    sets = shingled(docs.join(chosen.select(F.col("node").alias("doc_id")), "doc_id", "left_semi"), size)
    members = cut(sets.select(F.col("doc_id").alias("node"), "shingles").join(chosen, "node").select("node", "family", "shingles"))
    # A node that several texts share has one of their lists of bands; that only bears on which members are pivots.
    bands = copies.groupBy("node").agg(F.first("bands").alias("bands"))
    found = components(family_links(members, bands, percent, sent=n <= SENT_IDS))
    roots = copies.select("copy", "node").join(found, "node", "left").select("copy", F.coalesce("root", "node").alias("component_id"))
    joined = rows.select("doc_id", "n_shingles", F.when(F.col("bands").isNotNull() & F.col("doc_id").isNotNull(), F.col("copy")).alias("copy")).join(roots, "copy", "left")
    component = F.coalesce("component_id", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def distinct(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """The rows of ``docs`` but for those in a group of another, smaller doc_id; of rows that share doc_id and text, one.

    The doc_ids that go are sent to all executors up to SENT_IDS of them, else joined by a shuffle. Documents without words
    are no duplicates of anything and stay, as do rows with a null doc_id.
    """
    found = cut(groups(docs, percent, size))
    gone = found.where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    if gone.count() <= SENT_IDS:
        gone = F.broadcast(gone)
    rest = docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
    repeated = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count()
    return rest.where("doc_id is null").unionAll(rest.where("doc_id is not null").dropDuplicates(["doc_id", "text"])) if repeated else rest
