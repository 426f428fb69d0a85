"""Approximate nearest neighbours: anisotropic four-bit product quantisation, table scans, exact reranking.

Vectors are cut into parts of ``width`` coordinates; each part is coded in four bits. Codebooks and codes minimise the score-aware
loss of a vector x with residual r: |r|^2 + (eta - 1) (r . x/|x|)^2. For scores q . x above a share ``threshold`` of their
norms the residual's part along x costs eta = (d - 1) t^2 / (1 - t^2) times one across it. Codebooks are fitted on a
bounded sample (``train_rows`` of smallest hash); every vector is coded. Two more stages code what
those before leave in the same way, so that the members of a dense cluster, whose first codes are alike, still differ.

A search scans codes by a table of 16 inner products for each query and part. Smallest Euclidean distance is largest
2 q . x - |x|^2, so the exact norm, kept beside the codes, makes the inner product the only estimate. Queries and vectors
meet in a grid of blocks of bounded size, into which vectors are dealt by hash. Of a shortlist of s vectors a block of b
has some s / b; each returns so many of a query's best and six standard deviations and six more (the shortlist, if that is
less). The best of these over all blocks are joined with the original vectors, and their distances are computed in double
precision.

Equal vectors are coded once, with the ``k + 1`` smallest of their ids: no more can be among k neighbours of a query that
is one of them. So a vector that a third of all rows share neither crowds the shortlists nor one task.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no part, neither do rows with a null
vec_id. Vectors meet only those of their own length. Ties go to the smaller vec_id. Rows of one vec_id with one vector are
one row; with several vectors they are several candidates, and as many queries' worth of results under one id. Fewer
candidates than k give fewer rows. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import cut

CODES = 16
#: Rows of a block of vectors at least; the number of blocks stays below MAX_BLOCKS until blocks reach MOST_ROWS.
LEAST_ROWS, MAX_BLOCKS, MOST_ROWS = 8192, 4096, 1 << 20
QUERIES = 16_384


class Quantiser:
    """``stages`` codebooks of shape (parts, 16, width), each for what those before leave."""

    def __init__(self, sample: np.ndarray, width: int = 1, stages: int = 3, threshold: float = 0.2, rounds: int = 8, seed: int = 5):
        self.dim, self.width, self.stages = sample.shape[1], width, []
        self.eta = max(1.0, (self.dim - 1) * threshold**2 / (1 - threshold**2))
        x, unit = self.parts(sample), self.parts(sample / np.linalg.norm(sample, axis=1, keepdims=True))
        rng = np.random.default_rng(seed)
        for _ in range(stages):
            books = np.stack([x[rng.choice(len(x), CODES, replace=len(x) < CODES), m] for m in range(x.shape[1])])
            books += rng.normal(0, 1e-6 * np.abs(sample).mean(), books.shape)
            for _ in range(rounds):
                self._fit(books, x, unit, self._codes(books, x, unit, sweeps=1))
            self.stages.append(books)
            x = x - self._chosen(books, self._codes(books, x, unit, sweeps=2))

    def parts(self, vectors: np.ndarray) -> np.ndarray:
        padded = np.pad(vectors, ((0, 0), (0, -vectors.shape[1] % self.width)))
        return padded.reshape(len(vectors), -1, self.width)

    def _chosen(self, books: np.ndarray, codes: np.ndarray) -> np.ndarray:
        return books[np.arange(len(books))[None], codes]

    def _codes(self, books: np.ndarray, x: np.ndarray, unit: np.ndarray, sweeps: int) -> np.ndarray:
        """Coordinate descent from the nearest codes."""
        codes = np.stack([((x[:, m, None] - books[m][None]) ** 2).sum(axis=2).argmin(axis=1) for m in range(x.shape[1])], axis=1)
        along = ((x - self._chosen(books, codes)) * unit).sum(axis=2)
        total = along.sum(axis=1)
        for _ in range(sweeps):
            for m in range(x.shape[1]):
                rest = total - along[:, m]
                left = x[:, m, None] - books[m][None]
                part = (left * unit[:, m, None]).sum(axis=2)
                best = ((left**2).sum(axis=2) + (self.eta - 1) * (rest[:, None] + part) ** 2).argmin(axis=1)
                codes[:, m], along[:, m] = best, np.take_along_axis(part, best[:, None], axis=1)[:, 0]
                total = rest + along[:, m]
        return codes

    def _fit(self, books: np.ndarray, x: np.ndarray, unit: np.ndarray, codes: np.ndarray) -> None:
        """Each centre's minimum of the loss with all other codes fixed, part by part."""
        along = ((x - self._chosen(books, codes)) * unit).sum(axis=2)
        total = along.sum(axis=1)
        for m in range(x.shape[1]):
            rest, u = total - along[:, m], unit[:, m]
            weight = (self.eta - 1) * u[:, :, None] * u[:, None, :] + np.eye(self.width)
            aim = x[:, m] + (self.eta - 1) * u * (rest + (x[:, m] * u).sum(axis=1))[:, None]
            left, right = np.zeros((CODES, self.width, self.width)), np.zeros((CODES, self.width))
            np.add.at(left, codes[:, m], weight)
            np.add.at(right, codes[:, m], aim)
            used = np.bincount(codes[:, m], minlength=CODES) > 0
            books[m][used] = np.linalg.solve(left[used], right[used][:, :, None])[:, :, 0]
            part = ((x[:, m] - books[m][codes[:, m]]) * u).sum(axis=1)
            total += part - along[:, m]

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """Packed codes of all stages, two of a byte."""
        x, unit, all_codes = self.parts(vectors), self.parts(vectors / np.linalg.norm(vectors, axis=1, keepdims=True)), []
        for books in self.stages:
            all_codes.append(self._codes(books, x, unit, sweeps=2))
            x = x - self._chosen(books, all_codes[-1])
        codes = np.concatenate(all_codes, axis=1).astype(np.uint8)
        codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
        return codes[:, ::2] << 4 | codes[:, 1::2]

    def scan(self, queries: np.ndarray, packed: np.ndarray) -> np.ndarray:
        """Estimated inner products (queries, vectors): sums of table entries."""
        tables = np.concatenate([np.einsum("qmd,mcd->mqc", self.parts(queries), books) for books in self.stages]).astype(np.float32)
        codes = np.empty((packed.shape[1] * 2, len(packed)), dtype=np.intp)
        codes[::2], codes[1::2] = (packed >> 4).T, (packed & 15).T
        out, entries = np.zeros((len(queries), len(packed)), dtype=np.float32), np.empty((len(queries), len(packed)), dtype=np.float32)
        for own, table in zip(codes, tables, strict=False):
            np.take(table, own, axis=1, out=entries, mode="clip")
            out += entries
        return out


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("v", lambda x: x != 0.0))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(rep, ids, v): each vector once, with its k + 1 smallest ids."""
    ranked = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    return ranked.groupBy("v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")).select(F.xxhash64("v", F.element_at("ids", 1)).alias("rep"), "ids", "v", F.size("v").alias("dim"))


def candidates(unique: DataFrame, queries: DataFrame, dim: int, shortlist: int, train_rows: int, width: int) -> DataFrame:
    """(query_id, qv, rep): each query's shortlist among the vectors of ``dim`` components."""
    unique, queries = unique.where(F.col("dim") == dim), queries.where(F.size("qv") == dim)
    sample = np.array([r[0] for r in unique.orderBy("rep").limit(train_rows).select("v").collect()])
    quantiser = Quantiser(sample, width)
    n, n_queries = unique.count(), queries.count()
    blocks = max(min(MAX_BLOCKS, -(-n // LEAST_ROWS)), -(-n // MOST_ROWS))
    query_blocks = max(1, -(-n_queries // QUERIES))

    share = min(shortlist, math.ceil(shortlist / blocks + 6 * math.sqrt(shortlist / blocks) + 6))

    def encode(batches):
        for batch in batches:
            v = batch.column(1).flatten().to_numpy().reshape(-1, dim)
            yield pa.record_batch([batch.column(0), pa.array([c.tobytes() for c in quantiser.encode(v)], pa.binary()), pa.array((v**2).sum(axis=1), pa.float64())], names=["rep", "code", "norm"])

    coded = unique.select("rep", "v").mapInArrow(encode, "rep long, code binary, norm double")
    left = coded.withColumn("x", F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    right = queries.withColumn("y", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def scan(vectors: pa.Table, asked: pa.Table) -> pa.Table:
        ids, reps, scores = [], [], []
        if len(vectors) and len(asked):
            own = vectors.column("rep").to_numpy()
            order = np.argsort(own)  # so that equal estimates have one order
            own, norm = own[order], vectors.column("norm").to_numpy()[order].astype(np.float32)
            packed = np.frombuffer(b"".join(vectors.column("code").to_pylist()), dtype=np.uint8).reshape(len(own), -1)[order]
            q = asked.column("qv").combine_chunks().flatten().to_numpy().reshape(-1, dim)
            keep, names = min(shortlist, len(own)), asked.column("query_id").to_pylist()
            step = max(1, 500_000 // len(own))
            for a in range(0, len(q), step):
                estimate = 2 * quantiser.scan(q[a : a + step], packed) - norm
                best = np.argpartition(-estimate, keep - 1, axis=1)[:, :keep]
                ids += names[a : a + step]
                reps += list(own[best])
                scores += list(np.take_along_axis(estimate, best, axis=1))
        return pa.table({"query_id": pa.array(ids, pa.int64()), "reps": pa.array(reps, pa.list_(pa.int64())), "scores": pa.array(scores, pa.list_(pa.float32()))})

    grid = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInArrow(scan, "query_id long, reps array<bigint>, scores array<float>")
    flat = grid.select("query_id", F.explode(F.arrays_zip("reps", "scores")).alias("c")).select("query_id", F.col("c.reps").alias("rep"), F.col("c.scores").alias("estimate"))
    best = Window.partitionBy("query_id").orderBy(F.desc("estimate"), "rep")
    return flat.withColumn("r", F.row_number().over(best)).where(F.col("r") <= shortlist).select("query_id", "rep")


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, shortlist: int = 100, train_rows: int = 8192, width: int = 1) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of ``vectors`` to each row of ``queries``, itself excepted."""
    unique = cut(distinct_vectors(usable(vectors), k))
    asked = cut(usable(queries).select(F.col("vec_id").alias("query_id"), F.col("v").alias("qv")).distinct())
    parts = [candidates(unique, asked, r["dim"], shortlist, train_rows, width) for r in unique.groupBy("dim").count().orderBy("dim").collect()]
    empty = asked.where("false").select("query_id", F.lit(0).cast("long").alias("rep"))
    found = empty
    for part in parts:
        found = found.unionAll(part)
    pairs = found.join(unique.select("rep", "ids", "v"), "rep").join(asked, "query_id").where(F.size("qv") == F.size("v"))
    squares = F.aggregate(F.zip_with("qv", "v", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    near = pairs.select("query_id", F.sqrt(squares).alias("score"), F.explode("ids").alias("vec_id")).where(F.col("vec_id") != F.col("query_id"))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
