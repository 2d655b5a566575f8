import numpy as np

from lodestring.llm import ann


def table(spark, n=3000, dim=16):
    r = np.random.default_rng(5)
    x = r.normal(size=(n, dim)).astype(np.float32) * r.uniform(0.5, 2, (n, 1)).astype(np.float32)
    x[100:400] = x[100]
    rows = [(i, [float(v) for v in x[i]], "extra") for i in range(n)]
    bad = [(n, None, "a"), (n + 20, [0.0] * dim, "b"), (n + 1, [1.0, None] + [0.0] * (dim - 2), "c"), (n + 40, [float("nan")] * dim, "d"), (n + 60, [1.0] * 3, "e"), (None, [1.0] * dim, "f")]
    return x, spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, score string").repartition(3)


def test_recall_ranks_and_ties(spark):
    x, df = table(spark)
    got = ann.search(df, k=20, s=ann.Settings(sample=2000, codebooks=8, rounds=3, entries=32, block_rows=60, block_queries=16, rerank=30)).collect()
    x64, hits, ids = x.astype(np.float64), 0, list(range(0, len(x), 20))
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert sorted(by) == ids
    for q in ids:
        rows = sorted(by[q], key=lambda r: r.rank)
        assert [r.rank for r in rows] == list(range(1, 21))
        exact = (x64 * x64[q]).sum(1)
        order = [i for i in np.lexsort((np.arange(len(x)), -exact)).tolist() if i != q][:20]
        assert [(r.score, -r.vec_id) for r in rows] == sorted([(r.score, -r.vec_id) for r in rows], reverse=True)
        assert all(abs(r.score - exact[r.vec_id]) < 1e-12 and r.vec_id != q for r in rows)
        hits += len({r.vec_id for r in rows} & set(order))
    assert hits >= 0.95 * 20 * len(ids)


def test_small_and_empty(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (2, [0.0, 3.0])], "vec_id long, embedding array<float>")
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.search(few).collect()) == [(0, 1, 1, 1.0), (0, 2, 2, 0.0), (0, 3, 2, 0.0)]
    assert ann.search(few.limit(0)).collect() == []
    assert ann.search(few.where("vec_id = 1")).collect() == []


def test_beam_search_beats_greedy():
    r = np.random.default_rng(2)
    x = ann.unit(r.normal(size=(1000, 16)).astype(np.float32))[0]
    s = ann.Settings(codebooks=4, rounds=3)
    books = ann.train(x, s)
    error = [np.square(x - sum(books[m][c[:, m]] for m in range(4))).sum() for c in (ann.encode(x, books, 1), ann.encode(x, books, 8))]
    assert error[1] < error[0]


def test_recall_on_the_tables_and_the_exact_way(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect() if r.embedding is not None]
    x = np.array([v for _, v in rows], np.float64)
    ids = np.array([i for i, _ in rows])
    want = {}
    for q in np.nonzero(ids % 20 == 0)[0]:
        exact = (x * x[q]).sum(1)
        exact[ids == ids[q]] = -np.inf
        want[int(ids[q])] = [int(ids[i]) for i in np.lexsort((ids, -exact))[:20]]
    for s, least in ((ann.Settings(), 0.9), (ann.Settings(visits=256, rerank=8192), 1.0)):
        got = {}
        for r in ann.search(df, s=s).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        share = sum(len(set(got[q]) & set(w)) for q, w in want.items()) / sum(map(len, want.values()))
        print("recall", share)
        assert share >= least and all(len(got[q]) == len(w) for q, w in want.items())


def test_least_usable_query_and_double_precision(spark):
    rows = spark.createDataFrame([(0, [0.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.vec_id, r.score) for r in ann.search(rows).orderBy("rank").collect()] == [(0, 1, 1.0), (0, 2, 0.0)]
    exact = spark.createDataFrame([(0, [0.1, 0.7]), (1, [0.2, 2.0]), (2, [1e39, 0.0])], "vec_id long, embedding array<double>")
    assert {(r.vec_id, r.score) for r in ann.search(exact).collect()} == {(1, 0.1 * 0.2 + 0.7 * 2.0), (2, 0.1 * 1e39)}


def test_exact_on_rows_unlike_the_sample_s_average(spark):
    r = np.random.default_rng(1)
    apart = r.normal(size=(9000, 16)) * 0.1 + 1
    apart[::20] = -r.normal(size=(450, 16))  # queries unlike the rows
    tight = r.normal(size=(6, 16))[np.arange(3000) % 6] + 1e-3 * r.normal(size=(3000, 16))  # groups that codes don't tell apart
    norms = r.normal(size=(3000, 16)) * np.exp(1.5 * r.normal(size=(3000, 1)))
    for x in (apart, tight, norms, norms[:60] * 1e-30):
        x = x.astype(np.float32)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
        got, x64 = {}, x.astype(np.float64)
        for row in ann.search(df).orderBy("query_id", "rank").collect():
            got.setdefault(row.query_id, []).append((row.vec_id, row.score))
        for q in range(0, len(x), 20):
            exact = (x64 * x64[q]).sum(1)
            exact[q] = -np.inf
            assert got[q] == [(i, exact[i]) for i in np.lexsort((np.arange(len(x)), -exact))[:20].tolist()]
