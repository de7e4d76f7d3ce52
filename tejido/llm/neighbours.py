"""Nearest neighbours by randomly rotated one-bit codes.

A vector is taken relative to its nearest centroid, scaled to length one and rotated at random; the signs of its
coordinates are its code, packed in bits. Beside the code stand two scalars: the vector's distance from the centroid and
the inner product between the scaled vector and its code's own direction. From these a query's inner product with the
vector is estimated without the vector, and the estimate's error is bounded with high probability by a margin that the
second scalar gives. In each block of codes the best estimates set a distance to beat; every vector whose lower bound
beats it is ranked again by its exact distance.

Equal vectors are one class with its smallest ids (no more than an answer can show), so a hot vector is one code. All
queries meet all codes in blocks: a block of codes and a chunk of queries make one task of bounded size, and a block
answers with its best few for each query. Centroids are fitted on a bounded sample (`SAMPLE` vectors); every row is indexed.

Meeting all codes is the choice that keeps recall: probing lists by centroid was measured, and half of the lists gave nine
tenths of the neighbours at best (README).

Vectors that are null, zero, or hold null or non-finite components take no part. Vectors of different lengths have no distance;
each length is searched on its own, one job for each. Repeated rows (same id and vector) count once; where an id has several vectors, each is a candidate and the
smallest in array order is the query. An empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SAMPLE, CENTROIDS = 4096, 16
BLOCK, LEAST_BLOCKS, CHUNK = 65_536, 12, 4_096
#: Standard deviations of the estimate that its error bound allows for.
EPSILON = 3.0


class Codes:
    """Rotation and centroids: what is needed to encode a vector or to prepare a query."""

    def __init__(self, sample: np.ndarray, centroids: int = CENTROIDS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        self.bits = -(-self.dim // 64) * 64
        self.rotation = np.linalg.qr(rng.standard_normal((self.bits, self.bits)))[0][: self.dim]
        c = sample[rng.permutation(len(sample))[:centroids]]
        for _ in range(8):
            near = self._nearest(sample, c)
            c = np.array([sample[near == k].mean(axis=0) if (near == k).any() else c[k] for k in range(len(c))])
        self.centroids = c

    @staticmethod
    def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return ((c * c).sum(axis=1) - 2 * (x @ c.T)).argmin(axis=1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Centroid number, packed code, distance from the centroid, inner product of direction and code."""
        near = self._nearest(x, self.centroids)
        rest = x - self.centroids[near]
        norm = np.sqrt((rest * rest).sum(axis=1))
        turned = (rest / np.where(norm > 0, norm, 1)[:, None]) @ self.rotation
        signs = turned > 0
        inner = np.where(norm > 0, np.abs(turned).sum(axis=1) / np.sqrt(self.bits), 1.0)
        return near, np.packbits(signs, axis=1), norm, inner

    def search(self, q: np.ndarray, near: np.ndarray, code: np.ndarray, norm: np.ndarray, inner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated squared distances from one query to all codes, and their lower bounds."""
        estimate, margin = np.empty(len(norm)), np.empty(len(norm))
        for k, c in enumerate(self.centroids):
            at = np.flatnonzero(near == k)
            if not len(at):
                continue
            rest = q - c
            far = float(rest @ rest)
            turned = rest @ self.rotation
            # Twice the sum over set bits less the sum over all gives the inner product with the code's signs.
            dot = (2 * (np.unpackbits(code[at], axis=1).astype(np.float32) @ turned.astype(np.float32)) - turned.sum()) / np.sqrt(self.bits)
            f = np.maximum(inner[at], 1e-6)
            estimate[at] = norm[at] ** 2 + far - 2 * norm[at] * dot / f
            margin[at] = 2 * norm[at] * np.sqrt(far) * np.sqrt(np.maximum(1 - f * f, 0)) / f * EPSILON / np.sqrt(max(self.bits - 1, 1))
        return estimate, estimate - margin


def valid(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    v = F.col(vector_column)
    numbers = v.cast("array<double>")
    fit = v.isNotNull() & F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(numbers, lambda x: x != 0)
    return rows.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & fit)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def search(rows: DataFrame, k: int = 10, every: int = 100, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose id is divisible by `every`, by Euclidean distance."""
    good = valid(rows, id_column, vector_column)
    lengths = sorted(r["d"] for r in good.select(F.size("v").alias("d")).distinct().collect())
    found = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for i, d in enumerate(lengths):
        one = _search(good.where(F.size("v") == d).dropDuplicates(["id", "v"]), d, k, every)
        found = found.unionByName(one) if i else one
    return found


def _search(good: DataFrame, dim: int, k: int, every: int) -> DataFrame:
    """The search among distinct (id, v) of one length."""
    schema = "query_id long, ids array<long>, score double"
    # Only the k+1 smallest ids of a class can show in an answer; the limit works before the shuffle as well.
    low = good.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    classes = written(low.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vector-classes")
    queries = written(good.where(F.col("id") % every == 0).groupBy("id").agg(F.min("v").alias("v")), "vector-queries")
    n_classes, n_queries = classes.count(), queries.count()
    sample = np.array([r["v"] for r in classes.select("v", F.xxhash64(F.col("ids")[0]).alias("h"), F.col("ids")[0].alias("i")).orderBy("h", "i").limit(SAMPLE).collect()], float)
    codes = Codes(sample)
    blocks, chunks = max(LEAST_BLOCKS, -(-n_classes // BLOCK)), max(1, -(-n_queries // CHUNK))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near, code, norm, inner = codes.encode(_matrix(b.column("v"), dim))
            yield pa.RecordBatch.from_arrays([b.column("ids"), b.column("v"), pa.array(near, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(norm), pa.array(inner)], ["ids", "v", "near", "code", "norm", "inner"])

    kind = classes.schema["v"].dataType.simpleString()
    index = written(classes.select("ids", "v").mapInArrow(encode, f"ids array<long>, v {kind}, near int, code binary, norm double, inner double"), "vector-codes")
    block_of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    dealt = index.withColumn("block", block_of(F.col("ids")[0], blocks)).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    asked = queries.withColumn("chunk", block_of(F.col("id"), chunks)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        found: tuple[list, list, list] = ([], [], [])
        if left.num_rows and right.num_rows:
            left = left.combine_chunks()
            x = _matrix(left["v"].combine_chunks(), dim)
            near, norm, inner = (left[c].to_numpy() for c in ("near", "norm", "inner"))
            code = np.frombuffer(b"".join(left["code"].to_pylist()), np.uint8).reshape(len(x), -1)
            ids = left["ids"].to_pylist()
            first = np.array([i[0] for i in ids])
            exact = lambda at, q: np.sqrt(((x[at] - q) ** 2).sum(axis=1))
            for name, q in zip(right["id"].to_pylist(), _matrix(right["v"].combine_chunks(), dim)):
                estimate, lower = codes.search(q, near, code, norm, inner)
                best = np.argpartition(estimate, k)[: k + 1] if len(x) > k + 1 else np.arange(len(x))
                beat = exact(best, q).max() if len(x) > k + 1 else np.inf
                again = np.flatnonzero(lower <= beat * beat)
                again = np.union1d(again, best)
                d = exact(again, q)
                for j in np.lexsort((first[again], d))[: k + 1]:
                    found[0].append(name), found[1].append(ids[again[j]]), found[2].append(d[j])
        return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.list_(pa.int64())), pa.array(found[2], pa.float64())], ["query_id", "ids", "score"])

    near = dealt.groupBy("block", "chunk").cogroup(asked.groupBy("block", "chunk")).applyInArrow(meet, schema)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        near.select("query_id", F.explode("ids").alias("vec_id"), "score")
        .where("query_id <> vec_id")
        .dropDuplicates(["query_id", "vec_id", "score"])
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
