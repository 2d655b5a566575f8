import random

from lodestring import queries
from lodestring.operators import approximate, search

SMALL = {"qid", "k", "id", "dist", "rank", "near_rank", "place", "n", "ef_search", "hit"}


def frames(spark):
    r = random.Random(3)
    rows = [(i, r.choice([None, "", "an", "ab", "ban", "banana"]), [float(r.randint(0, 2)) for _ in range(3)] if i % 9 else None) for i in range(300)]
    rows += [(400, "ban", [1.0, float("nan"), 0.0]), (401, "ban", [float("nan")] * 3), (7, *rows[7][1:])]
    asked = [(q, r.choice(["a", "b", "an", "", "zz"]), [float(r.randint(0, 2)) for _ in range(3)], r.choice([-1, 0, 1, 4, 400])) for q in range(30)]
    return rows, asked, spark.createDataFrame(rows, "id long, s string, v array<float>").repartition(4), spark.createDataFrame(asked, "qid long, p string, qv array<float>, k int")


def brute(rows, asked, ef):
    out = []
    for q, p, qv, k in asked:
        near = sorted(((sum((a - b) ** 2 for a, b in zip(v, qv)) ** 0.5, i, s) for i, s, v in rows if v is not None), key=lambda x: (x[0] != x[0], x[0] if x[0] == x[0] else 0, x[1], x[2] or ""))
        hits = [(d, i) for d, i, s in near[: max(ef, k)] if s is not None and p in s][: max(0, k)]
        out += [(q, n + 1, i, d) for n, (d, i) in enumerate(hits)]
    return out


def in_order(df):
    return [tuple(map(str, r)) for r in sorted(map(tuple, df.collect()), key=lambda r: r[:2])]


def columns_between_tasks(df):
    """Names of the columns that joins and windows of a plan take in."""

    def walk(node):
        if any(x in node.nodeName() for x in ("Join", "Window")):
            for i in range(node.children().size()):
                yield from (node.children().apply(i).output().apply(j).name() for j in range(node.children().apply(i).output().size()))
        for i in range(node.children().size()):
            yield from walk(node.children().apply(i))

    return set(walk(df._jdf.queryExecution().sparkPlan()))


def test_rank_then_filter_is_exact_on_odd_rows(spark):
    rows, asked, base, queries = frames(spark)
    for ef in (0, 1, 20, 150, 1000):
        want = [tuple(map(str, r)) for r in brute(rows, asked, ef)]
        assert in_order(search.postfilter_topk(base, queries, ef)) == want, ef


def test_rank_then_filter_moves_no_strings(spark):
    _, _, base, queries = frames(spark)
    truth = spark.createDataFrame(search.exact_topk_batch(base, queries).collect(), search.RESULT)
    assert columns_between_tasks(search.postfilter_topk(base, queries, 20)) <= SMALL
    assert columns_between_tasks(search.ef_sweep(base, queries, truth, [5, 20])) <= SMALL


def test_block_kernel_equals_the_join(spark):
    _, _, base, queries = frames(spark)
    assert in_order(search.topk_in_blocks(base, queries)) == in_order(search.exact_topk_batch(base, queries))


def test_lsh_moves_no_strings_and_keeps_its_candidates(spark):
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    r = random.Random(4)
    base = spark.createDataFrame([(i, r.choice(["an", "ab", "ban"]), [r.gauss(0, 1) for _ in range(8)]) for i in range(300)], "id long, s string, v array<float>").repartition(3)
    queries = spark.createDataFrame([(q, r.choice(["a", "n", "b", "zz"]), [r.gauss(0, 1) for _ in range(8)], r.choice([0, 3, 400])) for q in range(20)], "qid long, p string, qv array<float>, k int")
    for bucket, radius in ((0.5, float("inf")), (0.5, 2.5), (4.0, float("inf"))):
        got = approximate.lsh_topk(base, queries, bucket, tables=2, radius=radius)
        assert columns_between_tasks(got) <= SMALL
        left, right = base.withColumn("x", array_to_vector("v")), queries.withColumn("x", array_to_vector("qv"))
        model = BucketedRandomProjectionLSH(inputCol="x", outputCol="h", bucketLength=bucket, numHashTables=2, seed=11).fit(left)
        near = model.approxSimilarityJoin(left, right, radius, "dist").selectExpr("datasetB.qid", "datasetB.p", "datasetB.k", "datasetA.id", "datasetA.s", "dist")
        want = search.top_k(near.where(F.contains("s", "p")), F.col("k"), 400)
        assert in_order(got) == in_order(want) and got.count() > 20


def test_registered_sweeps_move_no_strings(spark, sf_dir):
    for run in (queries.ef_sweep_recall, queries.best_operating_point, queries.postfilter_topk):
        assert columns_between_tasks(run(spark, sf_dir)) <= SMALL
