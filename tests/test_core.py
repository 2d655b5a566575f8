"""The core library: golden rows, equal strategies, appends, edge cases."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestring.operators import evaluate, generate, postings, search, states
from lodestring.operators.dictionary import SubstringDictionary
from lodestring.operators.states import StateIndex
from lodestring.plans.index import GramIndex

BASE = "id long, s string, v array<float>"
ASKED = "qid long, p string, qv array<float>, k int"
STRINGS = ["banana", "anana", "nana", "ana", "na"]
GOLDEN = [("ana", 2, [3, 2]), ("nana", 2, [2, 1]), ("anana", 2, [1, 0]), ("banana", 2, [0])]


def golden_base(spark):
    return spark.createDataFrame([(i, s, [3 * i + 1.0, 3 * i + 2.0, 3 * i + 3.0]) for i, s in enumerate(STRINGS)], BASE)


def golden_queries(spark, extra=()):
    rows = [(i, p, [9.0, 10.0, 11.0], k) for i, (p, k, _) in enumerate([*GOLDEN, *extra])]
    return spark.createDataFrame(rows, ASKED)


def lists(result):
    out = {}
    for r in result.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append(r.id)
    return out


STRATEGIES = {
    "scan": lambda b, q: search.exact_topk_batch(b, q),
    "prefilter": lambda b, q: GramIndex.build(b, 2).search(q, "prefilter"),
    "auto": lambda b, q: GramIndex.build(b, 3).search(q),
    "postfilter": lambda b, q: GramIndex.build(b, 2).search(q, "postfilter", ef=10_000),
    "dictionary": lambda b, q: SubstringDictionary.build(b).search(q),
    "full": lambda b, q: StateIndex.build(b, "full").search(q),
    "delta": lambda b, q: StateIndex.build(b, "delta", threshold=2).search(q),
}


@pytest.mark.parametrize("name", STRATEGIES)
def test_golden(spark, name):
    got = lists(STRATEGIES[name](golden_base(spark), golden_queries(spark)))
    assert got == {i: ids for i, (_, _, ids) in enumerate(GOLDEN)}


def test_golden_append(spark):
    new = spark.createDataFrame([(5, "ana", [12.0, 13.0, 14.0])], BASE)
    asked = spark.createDataFrame([(0, "ana", [9.0, 10.0, 11.0], 3)], ASKED)
    base = golden_base(spark)
    for index in (GramIndex.build(base, 3), SubstringDictionary.build(base), StateIndex.build(base, threshold=2)):
        assert lists(index.append(new).search(asked)) == {0: [3, 2, 5]}


def test_posting_goldens(spark):
    df = spark.createDataFrame([(1, "banana"), (2, "bandana"), (3, "ananas")], "id long, s string")
    got = {r.g: r.ids for r in postings.posting_lists(postings.gram_rows(df, 4)).collect()}
    assert (got["ana"], got["ban"], got["nana"], got["anas"], got.get("xyz")) == ([1, 2, 3], [1, 2], [1, 3], [3], None)


def random_base(spark, n=40, seed=1):
    r = random.Random(seed)
    rows = [(i, "".join(r.choice("abc") for _ in range(r.randint(1, 9))), [float(r.randint(0, 3)), float(r.randint(0, 3))]) for i in range(n)]
    return rows, spark.createDataFrame(rows, BASE).repartition(3)


def brute(rows, asked):
    out = {}
    for q, p, qv, k in asked:
        dist = sorted((float(np.hypot(v[0] - qv[0], v[1] - qv[1])), i) for i, s, v in rows if p in s)
        if dist[: max(0, k)]:
            out[q] = [i for _, i in dist[: max(0, k)]]
    return out


def test_all_strategies_agree(spark):
    rows, df = random_base(spark)
    r = random.Random(2)
    asked = [(i, p, [1.0, float(r.randint(0, 3))], k) for i, (p, k) in enumerate([("", 5), ("a", 0), ("a", -3), ("ab", 3), ("abc", 100), ("zz", 4), ("abcab", 2), ("bb", 1), ("c", 7), ("abcabcabcabc", 3)])]
    queries = spark.createDataFrame(asked, ASKED)
    want = brute(rows, asked)
    for name, run in STRATEGIES.items():
        assert lists(run(df, queries)) == want, name


def test_append_equals_rebuild(spark):
    strings = ["c", "ac", "bc", "aabc", "bcba", "ac"]
    base = spark.createDataFrame([(i, s, [float(i)]) for i, s in enumerate(strings)], BASE)
    new = spark.createDataFrame([(6, "cbaaa", [6.0])], BASE)
    asked = spark.createDataFrame([(0, "cba", [0.0], 10)], ASKED)
    assert lists(StateIndex.build(base, threshold=2).append(new, threshold=2).search(asked)) == {0: [4, 6]}
    assert lists(GramIndex.build(base, 2).append(new).search(asked, "prefilter")) == {0: [4, 6]}


def test_states_against_brute_force(spark):
    rows, df = random_base(spark, 12, 5)
    ends = {}
    for i, s, _ in rows:
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                ends.setdefault(s[a:b], set()).add((i, b))
    classes = {}
    for g, e in ends.items():
        classes.setdefault(frozenset(e), []).append(g)
    longest = {max(c, key=len): c for c in classes.values()}
    of = {g: name for name, c in longest.items() for g in c}
    got = {r.state: r for r in states.states(df).collect()}
    assert set(got) == set(longest)
    for name, c in longest.items():
        shortest = min(map(len, c))
        assert got[name].n_substrings == len(c) and got[name].len == len(name)
        assert got[name].link == of.get(name[len(name) - shortest + 1 :])


def test_delta_index_invariant(spark, tmp_path):
    _, df = random_base(spark, 60, 3)
    index = StateIndex.build(df, threshold=3)
    full = {}
    for r in states.state_rows(df).collect():
        full.setdefault(r.state, set()).add(r.id)
    local = {}
    for r in index.local.collect():
        local.setdefault(r.state, set()).add(r.id)
    layout = {r.state: r for r in index.layout.collect()}
    assert set(layout) == set(full)
    assert any(r.base for r in layout.values())
    for s, r in layout.items():
        own = local.get(s, set())
        assert r.n_local == len(own)
        if r.base is None:
            assert own == full[s]
        else:
            assert layout[r.base].base is None and layout[r.base].has_graph
            assert not own & local[r.base] and own | local[r.base] == full[s]
    stored, total = index.size_report().select("ids_stored", "ids_total").first()
    assert stored < total
    index.save(str(tmp_path / "i"))
    asked = spark.createDataFrame([(0, "ab", [0.0, 0.0], 9)], ASKED)
    assert lists(StateIndex.load(spark, str(tmp_path / "i")).search(asked)) == lists(search.exact_topk_batch(df, asked))


def test_postfilter_grows_with_ef(spark):
    rows, df = random_base(spark, 80, 8)
    asked = [(i, "ab", [1.0, 1.0], 5) for i in range(2)]
    queries = spark.createDataFrame(asked, ASKED)
    truth = search.exact_topk_batch(df, queries)
    sweep = {r.ef_search: r.recall for r in search.ef_sweep(df, queries, truth, [1, 5, 20, 80]).collect()}
    assert sweep[80] == 1.0 and sorted(sweep.values()) == [sweep[e] for e in (1, 5, 20, 80)]
    assert evaluate.recall(search.postfilter_topk(df, queries, 20), truth).first().recall == sweep[20]
    assert evaluate.recall(truth.limit(0), truth.limit(0)).first().recall is None


def test_nulls_dimensions_and_save(spark, tmp_path):
    df = golden_base(spark).unionAll(spark.createDataFrame([(8, None, [0.0] * 3), (9, "ana", None)], BASE))
    index = GramIndex.build(df, 2)
    path = str(tmp_path / "index")
    index.save(path)
    bad = spark.createDataFrame([(10, "ana", [1.0])], BASE)
    with pytest.raises(ValueError):
        index.append(bad)
    assert index.append(bad, "drop").base.count() == 5
    GramIndex.load(spark, path).save_append(path, spark.createDataFrame([(5, "ana", [12.0, 13.0, 14.0])], BASE))
    asked = spark.createDataFrame([(0, "ana", [9.0, 10.0, 11.0], 3)], ASKED)
    assert lists(GramIndex.load(spark, path).search(asked, "prefilter")) == {0: [3, 2, 5]}
    assert lists(GramIndex.load(spark, path).compact(str(tmp_path / "c")).search(asked)) == {0: [3, 2, 5]}
    with pytest.raises(ValueError):
        index.search(asked, "other")


def test_curves_and_points(spark):
    assert evaluate.clean_curve([(0.05, 900), (0.5, 500), (0.505, 400), (0.8, 450), (0.9, 300)]) == [(0.5, 500), (0.8, 450), (0.9, 300)]
    assert evaluate.clean_curve([(0.3, 500), (0.4, 400), (0.5, 600)]) == [(0.3, 500), (0.5, 600)]
    assert evaluate.clip_curve([(0.2, 9), (0.6, 5), (0.9, 1)], 0.5) == [(0.6, 5), (0.9, 1)]
    stats = spark.createDataFrame([(8, 5.0, 0.5), (16, 9.0, 0.9), (32, 7.0, 0.9), (64, 0.0, 0.1)], "ef_search int, time_us double, recall double")
    assert evaluate.best_point(stats).first().ef_search == 32
    assert sorted(r.qps for r in evaluate.with_qps(stats).collect())[-1] == 2e5


def test_generators(spark):
    x, want = (7 * 2654435761) & 0xFFFFFFFF, ""
    for _ in range(50):
        x = (1664525 * x + 1013904223) & 0xFFFFFFFF
        want += chr(97 + x % 26)
    assert spark.range(6, 7).select(generate.synthetic_string(F.col("id"))).first()[0] == want
    made = generate.synthetic_corpus(spark, 20, dim=4).collect()
    assert all(100 <= len(r.s) <= 500 and r.s.islower() and len(r.v) == 4 for r in made)
    rows, df = random_base(spark, 30, 4)
    for mixed in (False, True):
        for r in generate.generate_queries(df, 50, 3, k=4, mixed=mixed).collect():
            assert any(r.p in s for _, s, _ in rows) and r.k == 4 and (2 <= len(r.p) <= 4 if mixed else len(r.p) == 3)
    with pytest.raises(ValueError):
        generate.generate_queries(df, 5, 99)
    old, new = generate.split_inserts(df, 30)
    assert (old.count(), new.count()) == (21, 9)
