"""Centroid clustering against plain integer arithmetic."""

import hashlib
import math
import random

import numpy as np
import pytest

from lodestring.llm import centroids

S = centroids.Settings(dim=4, clusters=3, rounds=4)


def plain(rows, s):
    kept = [(i, [math.floor(s.scale * x) for x in v]) for i, v in rows if v is not None and len(v) == s.dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{s.salt}{'' if r[0] is None else r[0]}".encode()).hexdigest(), np.array(r[1], "<i4").tobytes()))
    c = [list(v) for _, v in first[: s.clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m)), k) for k, m in enumerate(c))
    for _ in range(s.rounds):
        own = [near(v)[1] for _, v in kept]
        for k in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own) if o == k]
            if mine:
                c[k] = [sum(x) // len(mine) for x in zip(*mine)]
    found = [(i, *near(v)) for i, v in kept]
    total = sum(d for _, d, _ in found)
    return sorted(((i is not None, i or 0), k, d, sum(e for _, e, o in found if o == k), total, tuple(c[k])) for i, d, k in found)


def result(df, s):
    return sorted(((r.vec_id is not None, r.vec_id or 0), r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in centroids.cluster(df, settings=s).collect())


SCHEMA = "vec_id long, embedding array<double>, cluster string"


def test_against_plain(spark):
    r = random.Random(4)
    rows = [(i, [r.choice([-1.5, -0.001, 0.0, 0.25, 1.0, r.gauss(0, 1)]) for _ in range(4)]) for i in range(150)]
    rows += [(3, rows[7][1]), (3, rows[7][1]), (None, [0.1, 0.2, 0.3, 0.4]), (900, None), (901, [1.0, None, 2.0, 3.0]), (902, [1.0, 2.0]), (903, [math.nan, 0.0, 0.0, 0.0]), (904, [math.inf, 0.0, 0.0, 0.0]), (905, [])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    assert result(df, S) == plain(rows, S)
    assert result(df.repartition(7), S) == plain(rows, S)


def test_few_or_no_vectors(spark):
    rows = [(5, [1.0, 0.0, 0.0, 0.0]), (6, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    assert result(df, S) == plain(rows, S)
    assert result(df.limit(0), S) == []
    with pytest.raises(Exception, match="the largest is"):
        result(spark.createDataFrame([(1, [1e300, 0.0, 0.0, 0.0], "x")], SCHEMA), S)


def test_screening_is_exact_and_saves_work():
    r = np.random.default_rng(1)
    middle = r.integers(-300, 300, (40, 64))
    x = middle[r.integers(0, 40, 3000)] + r.integers(-20, 20, (3000, 64))
    c = np.concatenate([middle[:39], middle[:1]])  # two equal centroids: the smaller number
    found, d, exact = centroids.nearest(x, centroids.segment_norms(x), c)
    every = np.square(x[:, None, :] - c[None, :, :]).sum(2)
    assert (found == every.argmin(1)).all() and (d == every.min(1)).all()
    assert exact < 0.5 * every.size


def test_float_vectors(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    s = centroids.Settings(clusters=7, rounds=2)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert result(df, s) == plain(rows, s)
