"""Centroid clustering of integer vectors with block-norm screening.

A vector's components become floor(scale * x). Each is stored beside its compressed form: the
norms of its segments of SEGMENT components. By Cauchy-Schwarz a product is at most the
product of the compressed forms, so |x|^2 + |c|^2 - 2 * (that product) bounds the squared
distance from below. A vector's centroids are taken in order of that bound, and from where it
lies above the nearest distance found so far, none is looked at; the others receive their
exact distance in integers.

Vectors are staged once, a row each. A round ships the centroids, a fixed number, to every
task; a task gives back one row of sums for each centroid, added up in the cluster. Nothing
else moves between rounds.

Cases: vectors that are null, of another dimension, or hold null or non-finite components take
no part; a component beyond 2 ** 27 after scaling is an error, as distances must fit 64 bits;
a null id counts as an empty one for the choice of the first centroids; of rows with one id,
those come first whose components are the smaller bytes (little-endian, 32 bits each); ties of
distance go to the smaller centroid number; fewer vectors than centroids give fewer centroids;
repeated rows count each; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, stage

SEGMENT = 2  # components; the fewer, the closer the bound
LARGEST = 1 << 27  # of a component
AT_ONCE = 4096  # vectors


@dataclass(frozen=True)
class Settings:
    dim: int = 64
    scale: float = 256.0
    clusters: int = 40
    rounds: int = 5
    salt: str = "2:"  #: before the id, in the hash that chooses the first centroids


def usable(vector: str, dim: int):
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return (F.size(x) == dim) & ~bad


def segment_norms(x: np.ndarray) -> np.ndarray:
    """The compressed form of each row of integers."""
    return np.sqrt(np.square(x.astype(np.float64)).reshape(len(x), -1, SEGMENT).sum(2))


def prepared(df: DataFrame, s: Settings) -> DataFrame:
    """(vec_id, x, norms): integers and compressed forms, as bytes, of the vectors that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.floor(s.scale * b.column(1).flatten().to_numpy().reshape(b.num_rows, s.dim))
            if len(x) and np.abs(x).max() > LARGEST:
                raise ValueError(f"a component of {np.abs(x).max()} after scaling; the largest is {LARGEST}")
            rows = [[r.tobytes() for r in y] for y in (x.astype("<i4"), segment_norms(x).astype("<f8"))]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(r, pa.binary()) for r in rows]], names=["vec_id", "x", "norms"])

    kept = df.where(usable("v", s.dim)).select("vec_id", F.col("v").cast("array<double>").alias("v"))
    return stage(kept.mapInArrow(run, "vec_id long, x binary, norms binary"), "vectors")


def matrix(column: pa.Array, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def nearest(x: np.ndarray, norms: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, squared distance, exact distances computed) of each row of integers."""
    square, other = np.square(x).sum(1).astype(np.float64), np.square(centroids).sum(1).astype(np.float64)
    least = square[:, None] + other[None, :]
    least = least * (1 - 1e-12) - 2 * (norms @ segment_norms(centroids).T) - 1  # less what rounding may add
    order = np.argsort(least, axis=1)
    least = np.take_along_axis(least, order, 1)
    best, found, exact = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64), 0
    rows = np.arange(len(x))
    for r in range(len(centroids)):
        rows = rows[least[rows, r] <= best[rows]]
        if not len(rows):
            break
        c = order[rows, r]
        d = np.square(x[rows] - centroids[c]).sum(1)
        exact += len(rows)
        better = (d < best[rows]) | (d == best[rows]) & (c < found[rows])
        best[rows[better]], found[rows[better]] = d[better], c[better]
    return found, best, exact


def assigned(vectors: DataFrame, centroids: np.ndarray, s: Settings) -> Iterator:
    """A function for mapInArrow over prepared() rows: (ids, integers, centroid, distance, exact distances) of some at a time."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for whole in batches:
            for start in range(0, whole.num_rows, AT_ONCE):
                b = whole.slice(start, AT_ONCE)
                x = matrix(b.column("x"), "<i4", s.dim).astype(np.int64)
                yield b.column("vec_id"), x, *nearest(x, matrix(b.column("norms"), "<f8", s.dim // SEGMENT), centroids)

    return each


def sums(vectors: DataFrame, centroids: np.ndarray, s: Settings) -> tuple[dict[int, tuple[int, list[int]]], int]:
    """(number and componentwise sum of the vectors of each centroid that has some, exact distances computed)."""
    each = assigned(vectors, centroids, s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, exact = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), s.dim), np.int64), 0
        for _, x, c, _, looked in each(batches):
            n += np.bincount(c, minlength=len(n))
            order = np.argsort(c, kind="stable")
            own, start = np.unique(c[order], return_index=True)
            total[own] += np.add.reduceat(x[order], start, axis=0)
            exact += looked
        some = np.nonzero(n)[0]
        if len(some):
            spread = np.zeros(len(some), np.int64)
            spread[0] = exact
            columns = [some, n[some], spread, *total[some].T]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["cluster", "n", "exact", *[f"s{i}" for i in range(s.dim)]])

    fields = ["n", "exact", *[f"s{i}" for i in range(s.dim)]]
    parts = vectors.mapInArrow(run, ", ".join(f"{f} long" for f in ["cluster", *fields]))
    rows = parts.groupBy("cluster").agg(*[F.sum(f).alias(f) for f in fields]).collect()  # one a centroid
    return {r.cluster: (r.n, list(r[3:])) for r in rows}, sum(r.exact for r in rows)


def first_centroids(vectors: DataFrame, s: Settings) -> np.ndarray:
    order = F.sha2(F.concat(F.lit(s.salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.select(order.alias("h"), "x").orderBy("h", "x").limit(s.clusters).collect()
    return np.array([np.frombuffer(r.x, "<i4") for r in rows], np.int64).reshape(len(rows), s.dim)


def fit(vectors: DataFrame, s: Settings) -> tuple[np.ndarray, list[int]]:
    """(centroids after all rounds, exact distances computed in each round)"""
    centroids, looked = first_centroids(vectors, s), []
    for _ in range(s.rounds):
        means, exact = sums(vectors, centroids, s)
        looked.append(exact)
        for c, (n, total) in means.items():
            centroids[c] = [t // n for t in total]
    return centroids, looked


def cluster(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings | None = None) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid) of every vector that takes part; centroid is an array of integers."""
    s = settings or Settings()
    vectors = prepared(pick(df, id_col, vector_col).toDF("vec_id", "v").withColumn("vec_id", F.col("vec_id").cast("long")), s)
    centroids, _ = fit(vectors, s)
    each = assigned(vectors, centroids, s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, c, d, _ in each(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(c.astype(np.int32)), pa.array(d)], names=["vec_id", "cluster", "distance"])

    filed = stage(vectors.mapInArrow(run, "vec_id long, cluster int, distance long"), "clusters")
    inertia = {r.cluster: r.t for r in filed.groupBy("cluster").agg(F.sum("distance").alias("t")).collect()}  # one a centroid
    rows = [(c, t, sum(inertia.values()), centroids[c].tolist()) for c, t in inertia.items()]
    about = df.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return filed.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()
