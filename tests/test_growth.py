"""Sizes and build times of indexes over growing shares of the rows."""

from lodestring.operators import evaluate
from lodestring.operators.dictionary import SubstringDictionary
from lodestring.plans.index import GramIndex


def test_growth(spark, tmp_path):
    base = spark.createDataFrame([(i, "abc" * (i % 5 + 1), [float(i)]) for i in range(60)], "id long, s string, v array<double>")
    rows = evaluate.growth(base, {"grams": lambda b: GramIndex.build(b, 2), "dictionary": SubstringDictionary.build}, str(tmp_path), (0, 50, 100)).collect()
    by = {(r.kind, r.percent): r for r in rows}
    assert len(by) == 6 and by["grams", 0].rows == by["grams", 0].string_chars == 0
    for name in ("grams", "dictionary"):
        assert 0 < by[name, 50].rows < by[name, 100].rows == 60 and by[name, 100].string_chars == sum(3 * (i % 5 + 1) for i in range(60))
        assert 0 < by[name, 50].bytes < by[name, 100].bytes and by[name, 100].build_us > 0
