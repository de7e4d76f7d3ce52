"""An index of vectors for exact cosine neighbours under any filter.

Directions are dealt to lists around centroids (k-means on a bounded sample; every row is dealt). A list is a partition of the
stored table, so reading some lists is partition pruning, and a list of any size is spread over files of a bounded size. Of each list the least and greatest distance
of its members from the centroid are kept: by the triangle inequality they bound how near to a query any member can be.
Lists are read in order of that bound (best_first.py).

The whole of a product is stored beside its vector, so that filters and joins hold on what a list holds. Rows whose vector is
null, empty, zero or holds what isn't a finite number are left out, as they are from the scan.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.similarity import cosine_distance, dot, literal_vector
from . import search as S
from .best_first import Found, best_first

#: What rounding may take from a bound.
SLACK = 1e-6


@dataclass(frozen=True)
class VectorIndex:
    """centroids: one row for each list; near, far: least and greatest distance of its members from it; size: their number."""

    path: str
    vector: str
    schema: StructType
    lists: np.ndarray
    centroids: np.ndarray
    near: np.ndarray
    far: np.ndarray
    size: np.ndarray

    def bounds(self, query) -> np.ndarray:
        """The least cosine distance from the query that a member of each list can have."""
        if not len(self.lists):
            return np.zeros(0)
        q = np.asarray(query, np.float64)
        away = np.linalg.norm(self.centroids - q / np.linalg.norm(q), axis=1)
        gap = np.maximum(0, np.maximum(away - self.far, self.near - away) - SLACK)
        return gap**2 / 2

    def nearest(self, spark: SparkSession, query, k: int, tie: str, filtered: Callable[[DataFrame], DataFrame] = lambda rows: rows, keys=(), dedupe=None) -> Found:
        """The k nearest rows (see best_first); filtered: joins and conditions on the stored rows."""
        bounds = self.bounds(query)
        order = np.argsort(bounds, kind="stable")
        stored = spark.read.schema(self.schema).parquet(f"{self.path}/rows")
        distance = cosine_distance(F.col(self.vector), literal_vector(query))

        def read(parts: list[int]) -> DataFrame:
            rows = stored.where(F.col("_list").isin([int(self.lists[order[p]]) for p in parts])).drop("_list")
            return filtered(rows).withColumn("distance", distance)

        return best_first(bounds[order].tolist(), read, k, tie, keys, dedupe)


def usable(vector: Column) -> Column:
    """Whether a vector has a direction."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.when(finite, dot(vector, vector) > 0), F.lit(False))


def _centroids(rows: DataFrame, vector: str, lists: int, sample: int, seed: int) -> np.ndarray:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer

    n = rows.count()
    if not n:
        return np.zeros((0, 0))
    norm = F.sqrt(dot(F.col(vector), F.col(vector)))
    units = rows.select(norm.alias("norm"), F.col(vector).alias("v")).select(array_to_vector(F.transform("v", lambda x: x / F.col("norm"))).alias("features"))
    part = units.sample(sample / n, seed) if n > sample else units
    if min(lists, n) < 2:  # which k-means doesn't take
        return np.array([part.select(Summarizer.mean(F.col("features"))).first()[0].toArray()])
    return np.array(KMeans(k=min(lists, n), seed=seed, maxIter=10).fit(part).clusterCenters())


def build(rows: DataFrame, path: str, vector: str = "embedding", lists: int = 64, sample: int = 50_000, seed: int = 1) -> VectorIndex:
    """Writes the index of rows to a folder. sample: rows that k-means is fitted on, at most (about); all rows are dealt to lists."""
    spark = rows.sparkSession
    rows = rows.where(usable(F.col(vector)))
    centroids = _centroids(rows, vector, lists, sample, seed)

    @F.pandas_udf("struct<list:int,away:double>")
    def dealt(vectors: pd.Series) -> pd.DataFrame:
        x = np.stack(vectors.to_numpy()).astype(np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        square = np.maximum(0, (centroids**2).sum(axis=1) - 2 * x @ centroids.T + 1)
        at = square.argmin(axis=1)
        # Not from the squares, which lose digits where they are small.
        return pd.DataFrame({"list": at.astype(np.int32), "away": np.linalg.norm(x - centroids[at], axis=1)})

    placed = rows.withColumn("_d", dealt(vector)).withColumns({"_list": F.col("_d.list"), "_away": F.col("_d.away")}).drop("_d")
    # Rebalancing by list lets Spark split a large list over tasks and put small ones together.
    placed.hint("rebalance", "_list").write.mode("overwrite").partitionBy("_list").parquet(f"{path}/rows")
    # The lists come last: an index without them was not finished.
    bound = spark.read.schema(placed.schema).parquet(f"{path}/rows").groupBy("_list").agg(F.min("_away").alias("near"), F.max("_away").alias("far"), F.count("*").alias("size"))
    center = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "_list int, centroid array<double>")
    spark.createDataFrame([(vector, placed.schema.json())], "vector string, schema string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
    bound.join(center, "_list").coalesce(1).write.mode("overwrite").parquet(f"{path}/lists")
    return opened(spark, path)


def opened(spark: SparkSession, path: str) -> VectorIndex:
    """An index that has been built. Its lists are as many as were asked for at most, however many rows there are."""
    found = spark.read.parquet(f"{path}/lists").orderBy("_list").collect()
    about = spark.read.parquet(f"{path}/about").first()
    column = lambda c, kind: np.array([r[c] for r in found], kind)
    centroids = np.stack([r["centroid"] for r in found]) if found else np.zeros((0, 0))
    return VectorIndex(path, about["vector"], StructType.fromJson(json.loads(about["schema"])), column("_list", int), centroids, column("near", float), column("far", float), column("size", int))


def search(index: VectorIndex, stores: DataFrame, filters: S.Filters, embedding, limit: int = 12, offset: int = 0) -> DataFrame:
    """What search.search() gives for an embedding, by the index."""
    S._checked(limit, offset)
    conditions = S._all([*S.hard_conditions(filters), *S.soft_conditions(filters).values()])
    found = index.nearest(
        stores.sparkSession, embedding, limit + offset, "product_uid", lambda rows: S.with_store(rows.drop("_away"), stores).where(conditions), ("title_normalized", "brand"), S.best_per_title
    )
    return S.shaped(S.page(found.rows, limit, offset))
