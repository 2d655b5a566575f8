"""The block kernel of exact search against plain loops, and what its plans move."""

import random

import numpy as np
from pyspark.sql import functions as F

from lodestring import queries as registered
from lodestring.operators import search
from test_block_search import SMALL, brute, columns_between_tasks, frames, in_order


def test_exact_batch_on_odd_rows(spark):
    rows, asked, base, queries = frames(spark)
    assert in_order(search.exact_topk_batch(base, queries)) == [tuple(map(str, r)) for r in brute(rows, asked, 10_000)]


def test_near_ties_and_rare_patterns(spark, monkeypatch):
    r = random.Random(8)
    centre = [r.gauss(0, 100) for _ in range(24)]
    rows = [(i, "".join(r.choice("abcd") for _ in range(30)), [c + r.choice([0.0, 1e-9, 1e-7]) for c in centre]) for i in range(1500)]
    asked = [(q, "".join(r.choice("abcd") for _ in range(r.choice([1, 3, 6]))), list(centre), 5) for q in range(700)]
    base = spark.createDataFrame(rows, "id long, s string, v array<double>").repartition(2)
    queries = spark.createDataFrame(asked, "qid long, p string, qv array<double>, k int")
    want = []
    for q, p, qv, k in asked:
        near = sorted((float(np.sqrt(np.cumsum(np.square(np.array(v) - np.array(qv)))[-1])), i) for i, s, v in rows if p in s)
        want += [(q, n + 1, i, d) for n, (d, i) in enumerate(near[:k])]
    assert sorted(map(tuple, search.exact_topk_batch(base, queries).collect())) == want


def test_registered_exact_searches_make_no_pairs(spark, sf_dir):
    for name in ("exact_topk_batch", "variable_k_batch", "ground_truth_lists", "recall_at_k", "merge_topk", "capped_topk"):
        assert columns_between_tasks(registered.queries()[name](spark, sf_dir)) <= SMALL | {"ids", "recall"}, name


def test_searches_by_keys_move_no_pairs(spark):
    from lodestring.operators.dictionary import SubstringDictionary
    from lodestring.operators.states import StateIndex
    from lodestring.plans.index import GramIndex

    r = random.Random(5)
    rows = [(i, "".join(r.choice("abc") for _ in range(r.randint(1, 8))), [r.gauss(0, 1) for _ in range(4)]) for i in range(80)]
    asked = [(q, "".join(r.choice("abc") for _ in range(r.choice([1, 2, 4]))), [r.gauss(0, 1) for _ in range(4)], 3) for q in range(40)]
    base = spark.createDataFrame(rows, "id long, s string, v array<double>").repartition(2)
    queries = spark.createDataFrame(asked, "qid long, p string, qv array<double>, k int")
    want = in_order(search.exact_topk_batch(base, queries))
    for got in (GramIndex.build(base, 2).search(queries, "prefilter"), GramIndex.build(base, 2).search(queries), SubstringDictionary.build(base).search(queries), StateIndex.build(base, threshold=5).search(queries)):
        assert in_order(got) == want
        assert not columns_between_tasks(got) & {"qid", "qv", "p"} - SMALL


def test_lsh_holds_no_list_of_all_pairs():
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    from lodestring.operators.approximate import AskedByBucket, hits_by_bucket

    class Rows:
        """A table that hands over the function given to its tasks."""

        def __init__(self):
            self.sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda x: SimpleNamespace(value=x)))

        def where(self, _):
            return self

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    asked = AskedByBucket.__new__(AskedByBucket)
    asked.fill([SimpleNamespace(qid=q, p="a", k=3, qv=[float(q), 0.0], keys=[0.0] * 8) for q in range(2000)])
    batch = pa.RecordBatch.from_pydict({"id": list(range(2048)), "s": ["a"] * 2048, "v": [[float(i), 0.0] for i in range(2048)], "keys": [[0.0] * 8] * 2048})
    tracemalloc.start()
    found = list(hits_by_bucket(Rows(), asked, float("inf"))(iter([batch])))
    assert sum(b.num_rows for b in found) == 6000 and tracemalloc.get_traced_memory()[1] < 150 << 20
    tracemalloc.stop()
