"""The suffix array and its states against plain sorts and the states of short strings."""

import random

import pytest

from lodestring.operators import search, states, suffixes

TEXTS = ["banana", "bananas", "ana", "banana", "x", "xx", "", None, "aaaaaaaa", "abcabcabcabc", "zbanana"]


def corpus(spark, texts, parts=3):
    return spark.createDataFrame(list(enumerate(texts)), "id long, s string").repartition(parts)


def long_texts(seed, n=14):
    r = random.Random(seed)
    passage = "".join(r.choice("abcd") for _ in range(150))
    out = [passage * r.choice([0, 1, 1, 2]) + "".join(r.choice("ab") for _ in range(r.randrange(60))) + passage[r.randrange(100) :] for _ in range(n)]
    return [*out, out[0], out[1], out[0] + "q", "q" + out[0], passage[:40] * 5, "a" * 90]


def plain_array(texts):
    first = {}
    for i, t in enumerate(texts):
        if t:
            first.setdefault(t, i)
    rows = sorted((t[:e][::-1], sid, e) for t, sid in first.items() for e in range(1, len(t) + 1))
    out = []
    for i, (x, sid, e) in enumerate(rows):
        y = rows[i - 1][0] if i else ""
        n = next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
        out.append((i, sid, e, n))
    return out


@pytest.mark.parametrize("texts", [TEXTS, long_texts(1), long_texts(2), [], ["a" * 70, "a" * 70 + "b", "b" + "a" * 70]])
@pytest.mark.parametrize("parts", [1, 7])
def test_array(spark, texts, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        strings, copies = suffixes.distinct_strings(corpus(spark, texts))
        got = suffixes.suffix_array(strings).orderBy("i").select("i", "sid", "end", "lcp").collect()
        assert sorted(r.id for r in copies.collect()) == [i for i, t in enumerate(texts) if t]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [tuple(r) for r in got] == plain_array(texts)


def all_states(spark, texts):
    strings, _ = suffixes.distinct_strings(corpus(spark, texts))
    array = suffixes.suffix_array(strings)
    short, long = suffixes.suffix_states(array)
    return array, short, long, strings


@pytest.mark.parametrize("texts", [TEXTS, [t[:120] for t in long_texts(3, 4)]])
def test_states_equal_those_of_all_substrings(spark, texts):
    base = corpus(spark, [t for t in texts if t])
    array, short, long, strings = all_states(spark, [t for t in texts if t])
    got = {r.state: (r.len, r.n_substrings, r.occurrences, r.ids) for r in suffixes.named_states(short, long, strings).collect()}
    rows = states.state_rows(base).groupBy("state").count().collect()
    ids = {r["state"]: r["count"] for r in rows}
    at = {r.g: r.n for r in states.occurrences(base).groupBy("g").agg({"id": "count"}).withColumnRenamed("count(id)", "n").collect()}
    want = {r.state: (r.len, r.n_substrings, at[r.state], ids[r.state]) for r in states.states(base).collect()}
    assert got == want
    lengths = {r.len: (r.states, r.substrings, r.occurrences, r.ids) for r in suffixes.state_lengths(array, short, long).collect()}
    distinct = {t[i:j] for t in texts if t for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    for n in {v[0] for v in want.values()}:
        own = [v for v in want.values() if v[0] == n]
        assert lengths.pop(n) == (len(own), sum(len(x) == n for x in distinct), sum(v[2] for v in own), sum(v[3] for v in own))
    assert not lengths


def test_search(spark, tmp_path):
    r = random.Random(5)
    texts = long_texts(4)
    base = spark.createDataFrame([(i, t, [r.random(), r.random()]) for i, t in enumerate(texts)] + [(90, None, [0.0, 0.0]), (91, "abc", None)], "id long, s string, v array<double>")
    pieces = [texts[i % len(texts)] for i in range(24)]
    asked = [(q, t[(a := r.randrange(max(1, len(t) - n))) : a + n], [r.random(), r.random()], r.choice([0, 1, 5])) for q, (t, n) in enumerate(zip(pieces, [1, 2, 3, 4, 5, 15, 16, 17, 40, 120, 7, 0] * 2))]
    queries = spark.createDataFrame([*asked, (99, "zzzzzzzz", [0.0, 0.0], 3)], "qid long, p string, qv array<double>, k int")
    want = sorted(map(tuple, search.exact_topk_batch(base, queries).collect()))
    index = suffixes.SuffixIndex.build(base)
    assert sorted(map(tuple, index.search(queries).collect())) == want
    index.save(str(tmp_path / "suffixes"))
    assert sorted(map(tuple, suffixes.SuffixIndex.load(spark, str(tmp_path / "suffixes")).search(queries).collect())) == want
