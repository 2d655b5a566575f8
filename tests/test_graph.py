"""The neighbour graph: recall, rows scored, bounded lists, search width."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestring.operators import graph, search
from lodestring.operators.graph import NeighbourGraph, graph_topk


@pytest.fixture(scope="module")
def clustered(spark):
    r = np.random.default_rng(3)
    middle = r.normal(size=(40, 12))
    x = middle[r.integers(0, 40, 2500)] + 0.25 * r.normal(size=(2500, 12))
    rows = [(i, "abc"[i % 3] * 3, v.tolist()) for i, v in enumerate(x)]
    base = spark.createDataFrame([*rows, (9000, "aaa", None)], "id long, s string, v array<double>")
    return base, NeighbourGraph.build(base, degree=12, rounds=4, sample=128), x


def test_lists_are_bounded(clustered):
    _, graph, x = clustered
    n = graph.edges.groupBy("a").count().agg(F.min("count"), F.max("count"), F.count("*")).first()
    assert n[0] >= 12 and n[1] <= 24 + 4 and n[2] == len(x)


def test_rows_find_themselves(spark, clustered):
    _, graph, x = clustered
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 2500, 25)], "qid long, qv array<double>").selectExpr("qid", "'' AS p", "qv", "1 AS k")
    for ef, least in ((16, 85), (64, 97)):
        assert graph.nearest(asked, ef).where("rank = 1 AND id = qid AND dist = 0").count() >= least  # of 100


def test_recall_and_rows_scored(spark, clustered):
    base, graph, x = clustered
    r = np.random.default_rng(4)
    qv = x[r.integers(0, len(x), 60)] + 0.1 * r.normal(size=(60, 12))
    asked = spark.createDataFrame([(i, "", v.tolist(), 10) for i, v in enumerate(qv)], "qid long, p string, qv array<double>, k int")
    truth = {(t.qid, t.id) for t in search.exact_topk_batch(base, asked).collect()}
    shares = {}
    for ef in (10, 40):
        seen = graph.explore(asked, ef)
        shares[ef] = seen.count() / (60 * len(x))
        found = {(t.qid, t.id) for t in search.top_k(seen.select("qid", "id", "dist"), 10, 10).collect()}
        shares[ef, "recall"] = len(found & truth) / len(truth)
        assert seen.select("qid", "id").distinct().count() == seen.count()
    assert shares[40, "recall"] >= 0.95 and shares[40, "recall"] >= shares[10, "recall"]
    assert shares[10] < shares[40] < 0.2


def test_filtered(spark, clustered, tmp_path):
    base, graph, x = clustered
    asked = spark.createDataFrame([(1, "a", x[3].tolist(), 5), (2, "bb", x[4].tolist(), 3), (3, "zz", x[5].tolist(), 3), (4, "", x[6].tolist(), 0), (5, "", None, 2)], "qid long, p string, qv array<double>, k int")
    graph.save(str(tmp_path / "graph"))
    got = graph_topk(NeighbourGraph.load(spark, str(tmp_path / "graph")), base, asked, ef=48).collect()
    want = {(t.qid, t.rank, t.id) for t in search.postfilter_topk(base, asked, ef=48).collect()}
    assert len({(t.qid, t.rank, t.id) for t in got} & want) >= 0.85 * len(want)
    assert {t.qid for t in got} == {1, 2}


def test_few_rows(spark):
    rows = [(i, "a", [float(i), 0.0]) for i in range(3)]
    for n in (0, 1, 3):
        base = spark.createDataFrame(rows[:n], "id long, s string, v array<double>")
        asked = spark.createDataFrame([(7, "a", [0.0, 0.0], 2)], "qid long, p string, qv array<double>, k int")
        got = graph_topk(NeighbourGraph.build(base, rounds=1), base, asked)
        assert [(t.rank, t.id) for t in got.orderBy("rank").collect()] == [(1, 0), (2, 1)][:n]


def test_rounds_keep_the_nearest_alone(spark, clustered, monkeypatch):
    # all rows scored so far were written in every round
    _, built, x = clustered
    asked = spark.createDataFrame([(i, "", x[i].tolist(), 5) for i in range(0, 2500, 50)], "qid long, p string, qv array<double>, k int")
    written, write = [], graph.rewritten
    monkeypatch.setattr(graph, "rewritten", lambda s, df, *old: written.append((new := write(s, df, *old)).count()) or new)
    found = {(r.qid, r.id) for r in built.nearest(asked, 20).collect()}
    assert len(written) > 2 and max(written) == 50 * 20
    seen = built.explore(asked, 20)
    assert {(r.qid, r.id) for r in search.top_k(seen.where("opened").select("qid", "id", "dist"), 20, 20).collect()} == found
    assert {(r.qid, r.id) for r in search.top_k(seen.select("qid", "id", "dist"), 20, 20).collect()} == found
