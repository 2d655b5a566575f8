"""Approximate nearest rows: locality-sensitive hashing and an inverted file of centroids."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .search import RESULT, Asked, by_distance, largest_k, nearest_hits, portions_of, top_k


def lsh_topk(base: DataFrame, queries: DataFrame, bucket: float | None = None, tables: int = 8, radius: float = float("inf"), seed: int = 11, sample: int = 1000) -> DataFrame:
    """Rows that share a random-projection bucket with the query, filtered by the pattern.

    bucket is the width of a bucket; by default a quarter of the mean norm of at most `sample`
    vectors, so that a projection of a unit vector has about 8 buckets at any scale of the data.
    Queries are shipped to the rows, in portions, and meet them under their buckets there: only
    pairs that share a bucket get a distance, and neither pairs nor strings are shuffled, only
    each task's k nearest hits of a query.
    """
    if bucket is None:
        zero = F.lit(0.0).cast("double")
        norm = F.sqrt(F.aggregate("v", zero, lambda a, x: a + x.cast("double") * x.cast("double")))
        some = base.where("v IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(sample)
        bucket = 0.25 * (some.agg(F.avg(norm)).first()[0] or 4.0) or 1.0
    left = base.where("v IS NOT NULL").select("id", "s", "v", array_to_vector("v").alias("x"))
    right = queries.where("qv IS NOT NULL").select("qid", "p", "qv", "k", array_to_vector("qv").alias("x"))
    model = BucketedRandomProjectionLSH(inputCol="x", outputCol="h", bucketLength=bucket, numHashTables=tables, seed=seed).fit(left)
    keys = F.array(*[vector_to_array(F.col("h")[i])[0] for i in range(tables)]).alias("keys")
    filed, asked = model.transform(left).select("id", "s", "v", keys), model.transform(right).select("qid", "p", "qv", "k", keys)
    out = base.sparkSession.createDataFrame([], RESULT)
    most = largest_k(queries)
    for portion in portions_of(asked, 32 * most + 8 * tables):
        shipped = AskedByBucket(portion)
        if len(shipped):
            out = out.unionAll(top_k(hits_by_bucket(filed, shipped, radius), F.col("k"), most))
    return out


class AskedByBucket(Asked):
    """Queries with their buckets, a line a table."""

    def fill(self, rows: list) -> None:
        super().fill(rows)
        self.keys = np.array([r.keys for r in rows], np.float64).reshape(len(rows), -1).T


def hits_by_bucket(filed: DataFrame, asked: AskedByBucket, radius: float) -> DataFrame:
    """(qid, k, id, dist): for each query and task, the k nearest rows that share a bucket and contain the pattern.

    Buckets are compared for a block of rows and queries at a time, so a task holds no list of all its pairs.
    """
    shipped = filed.sparkSession.sparkContext.broadcast(asked.keys)

    def allowed() -> Callable:
        keys = shipped.value

        def met(rows: pa.RecordBatch) -> Callable:
            own = np.array(rows.column("keys").to_pylist(), np.float64).reshape(rows.num_rows, len(keys)).T

            def of(part: slice) -> np.ndarray:
                out = np.zeros((part.stop - part.start, rows.num_rows), bool)
                for q, r in zip(keys[:, part], own):
                    out |= q[:, None] == r
                return out

            return of

        return met

    return nearest_hits(filed, asked, ("keys",), allowed, radius=radius)


class InvertedFile:
    """Rows by nearest centroid; a query probes the cells of its nearest centroids."""

    def __init__(self, cells: DataFrame, centroids: DataFrame):
        self.cells, self.centroids = cells, centroids

    @staticmethod
    def build(base: DataFrame, n_cells: int = 16, sample: int = 100_000, seed: int = 11) -> InvertedFile:
        """Centroids are fitted on at most `sample` rows; every row is filed."""
        x = base.where("v IS NOT NULL").withColumn("features", array_to_vector("v"))
        some = x.select("id", "features").orderBy(F.xxhash64("id")).limit(sample)
        model = KMeans(k=n_cells, seed=seed, maxIter=10).fit(some)
        rows = [(i, [float(z) for z in c]) for i, c in enumerate(model.clusterCenters())]
        cells = model.transform(x).withColumnRenamed("prediction", "cell").drop("features")
        return InvertedFile(cells, base.sparkSession.createDataFrame(rows, "cell int, center array<double>"))

    def search(self, queries: DataFrame, n_probe: int = 4) -> DataFrame:
        """Queries are shipped to the rows, in portions: neither pairs nor strings are shuffled, only each task's k nearest hits of a query."""
        centroids = self.centroids.orderBy("cell").collect()  # as many as cells
        out = self.cells.sparkSession.createDataFrame([], RESULT)
        most = largest_k(queries)
        for portion in portions_of(queries, 32 * most + 9 * len(centroids)):
            shipped = AskedByCell(portion, centroids, n_probe)
            if len(shipped):
                out = out.unionAll(top_k(hits_by_cell(self.cells, shipped), F.col("k"), most))
        return out


class AskedByCell(Asked):
    """Queries with the cells that they probe: probes[query, cell]."""

    def __init__(self, queries: DataFrame, centroids: list, n_probe: int):
        super().__init__(queries)
        self.probes = np.zeros((len(self), 1 + max([r.cell for r in centroids], default=-1)), bool)
        far = np.zeros((len(self), len(centroids)))
        for j, r in enumerate(centroids if len(self) else ()):
            for d, c in enumerate(r.center):  # from left to right, as l2
                far[:, j] += np.square(self.vectors[:, d] - c)
        near = np.argsort(by_distance(np.sqrt(far)), axis=1, kind="stable")[:, : max(0, n_probe)]
        np.put_along_axis(self.probes, np.array([r.cell for r in centroids], np.int64)[near], True, axis=1)


def hits_by_cell(cells: DataFrame, asked: AskedByCell) -> DataFrame:
    """(qid, k, id, dist): for each query and task, the k nearest rows of the probed cells that contain the pattern."""
    shipped = cells.sparkSession.sparkContext.broadcast(asked.probes)

    def allowed() -> Callable:
        probes = shipped.value

        def met(rows: pa.RecordBatch) -> Callable:
            own = rows.column("cell").to_numpy()
            return lambda part: probes[part][:, own]

        return met

    return nearest_hits(cells, asked, ("cell",), allowed)
