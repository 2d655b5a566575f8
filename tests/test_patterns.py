"""Many patterns in one pass, against the join."""

import random
import time

from lodestring.operators import patterns, search


def test_equals_the_join(spark):
    r = random.Random(9)
    rows = [(i, "".join(r.choice("abé") for _ in range(r.randrange(0, 30))), [r.choice([0.0, 1.0, 2.5]), r.random()]) for i in range(300)]
    rows += [rows[3], rows[3], (900, None, [0.0, 0.0]), (901, "ab", None)]
    base = spark.createDataFrame(rows, "id long, s string, v array<double>").repartition(3)
    asked = [(q, "".join(r.choice("abé") for _ in range(r.randrange(0, 5))), [r.random(), r.random()], r.choice([0, 1, 3, 500])) for q in range(60)]
    queries = spark.createDataFrame([*asked, (99, None, [0.0, 0.0], 2), (98, "zz", [0.0, 0.0], 2)], "qid long, p string, qv array<double>, k int")
    want = sorted(map(tuple, search.exact_topk_batch(base, queries).collect()))
    assert sorted(map(tuple, patterns.topk_by_patterns(base, queries).collect())) == want
    assert patterns.topk_by_patterns(base, queries.limit(0)).collect() == []
    assert patterns.topk_by_patterns(base.limit(0), queries).collect() == []


def test_time_is_nearly_flat_in_the_number_of_patterns():
    r = random.Random(2)
    words = ["".join(r.choice("abcdefgh") for _ in range(9)) for _ in range(4000)]
    strings = ["".join(r.choice("abcdefgh") for _ in range(2000)) for _ in range(200)]

    def seconds(n):
        made = patterns.PatternSet(words[:n])
        begun = time.perf_counter()
        made.matching(strings)
        return time.perf_counter() - begun

    assert min(seconds(4000) for _ in range(3)) < 10 * min(seconds(40) for _ in range(3))  # of a hundred times the patterns
