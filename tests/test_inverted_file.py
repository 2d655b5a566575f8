"""The inverted file by its block kernel against a join of its probes."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F
from test_block_search import SMALL, columns_between_tasks, in_order

from lodestring.functions import l2
from lodestring.operators import approximate, search


def test_moves_no_strings_and_keeps_its_candidates(spark):
    r = random.Random(6)
    rows = [(i, r.choice(["an", "ab", "ban", None]), [r.gauss(0, 1) for _ in range(8)]) for i in range(400)] + [(500, "an", None)]
    base = spark.createDataFrame(rows, "id long, s string, v array<float>").repartition(3)
    queries = spark.createDataFrame([(q, r.choice(["a", "n", "b", "", "zz"]), [r.gauss(0, 1) for _ in range(8)], r.choice([0, 3, 400])) for q in range(20)], "qid long, p string, qv array<float>, k int")
    index = approximate.InvertedFile.build(base, n_cells=8)
    for n_probe in (0, 1, 3, 20):
        got = index.search(queries, n_probe)
        assert columns_between_tasks(got) <= SMALL
        first = F.row_number().over(Window.partitionBy("qid").orderBy("far", "cell"))
        probes = queries.join(F.broadcast(index.centroids)).withColumn("far", l2(F.col("qv"), F.col("center"))).withColumn("r", first).where(F.col("r") <= n_probe)
        hits = index.cells.join(probes.select("qid", "p", "k", "qv", "cell"), "cell").where(F.contains("s", "p"))
        want = search.top_k(hits.select("qid", "k", "id", l2(F.col("v"), F.col("qv")).alias("dist")), F.col("k"), 400)
        assert in_order(got) == in_order(want) and (got.count() > 20) == (n_probe > 0)


def test_no_queries(spark):
    base = spark.createDataFrame([(i, "an", [float(i % 5), 1.0]) for i in range(40)], "id long, s string, v array<float>")
    none = spark.createDataFrame([(1, "a", None, 3)], "qid long, p string, qv array<float>, k int")
    assert approximate.InvertedFile.build(base, n_cells=3).search(none).collect() == []
