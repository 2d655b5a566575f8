import random

import corpus_pipeline
from lodestring.llm import near_copies as N
from lodestring.llm import simhash


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def brute(rows):
    """Of each row, the number of its component."""
    sets = [shingles(t) for _, t in rows]
    part = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if part[i] != part[j] and near(sets[i], sets[j]):
                old, new = part[i], part[j]
                part = [new if p == old else p for p in part]
    return part


def data():
    r = random.Random(8)
    rows = [(900, ""), (901, None), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one two three four"), (906, "one two three")]
    for d in range(60):
        words = [f"w{r.randint(0, 9000)}" for _ in range(r.choice([40, 120, 300]))]
        rows.append((d, " ".join(words)))
        for k in range(4):  # from nearly equal to under the limit, and chains
            words = [x if r.random() > 0.01 * (k + 1) else f"n{r.randint(0, 9000)}" for x in words]
            rows.append((1000 + 4 * d + k, " ".join(words).title()))
    return rows


def test_stage_finds_all_near_copies(spark, sf_dir):
    rows = data()
    df = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows], "doc_id long, text string, cls string, row string, n_chars long").repartition(3)
    first = {}
    for (d, _), p in zip(rows, brute(rows)):
        first[p] = min(first.get(p, d), d)
    got = corpus_pipeline.near_dedup(spark, df, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(first.values())
    assert {(r.doc_id, r.text) for r in got} <= set(rows)
    linked = {r.component_id for r in simhash.near_duplicates(df).collect()}
    assert len(linked) > len(first)  # four bits alone miss some
    assert corpus_pipeline.near_dedup(spark, df.limit(0), sf_dir).collect() == []


def test_null_ids_stay_and_link(spark):
    words = [f"w{i}" for i in range(60)]
    a, b, c = (" ".join([*words[k:], *[f"x{i}" for i in range(k)]]) for k in (0, 5, 10))
    df = spark.createDataFrame([(4, a), (None, b), (6, c), (6, c)], "doc_id long, text string")
    assert near(shingles(a), shingles(b)) and near(shingles(b), shingles(c)) and not near(shingles(a), shingles(c))
    assert sorted(map(tuple, N.keep_one(df).collect()), key=str) == [(4, a), (None, b)]


def test_rows_that_share_an_id(spark):
    one, two, three = (" ".join(f"{p}{i}" for i in range(40)) for p in "abc")
    df = spark.createDataFrame([(1, one), (1, two), (2, two), (3, three), (0, three), (3, "else " + two[:20])], "doc_id long, text string")
    assert sorted(map(tuple, N.keep_one(df).collect())) == sorted([(1, one), (1, two), (0, three), (3, "else " + two[:20])])
