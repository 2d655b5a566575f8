import random

import numpy as np
import xxhash

from lodestring.llm import simhash as S

WORDS = "the of and to in is it on at by an be or as he we so do go no".split()


def brute_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, ids):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 4:
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [least.get(root(i)) for i in range(len(fps))]


def rows():
    r = random.Random(3)
    out = [(None, None), (None, "Only here once"), (900, ""), (901, None), (902, " \n"), (903, "one"), (904, "ONE"), (905, "é É b")]
    for d in range(120):
        words = [r.choice(WORDS) + str(r.randint(0, 3000)) for _ in range(r.choice([1, 3, 4, 30, 150]))]
        out.append((d, " ".join(words)))
        if len(words) > 100:
            for k in range(3):
                words[r.randrange(len(words))] = f"new{k}"
                out.append((1000 + 4 * d + k, " ".join(words)))
    out += [out[9], out[9], (5000, out[9][1])]
    return out


def test_against_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([(d, t, 1, "c") for d, t in data], "doc_id long, text string, fp int, component_id string").repartition(3)
    got = S.near_duplicates(df).select("doc_id", S.as_hex(S.F.col("fp")).alias("fp"), "component_id").collect()
    fps = [brute_fingerprint(t) for _, t in data]
    want = sorted(((d, f"{f:016x}", c) for (d, _), f, c in zip(data, fps, brute_components(fps, [d for d, _ in data]))), key=str)
    assert sorted(map(tuple, got), key=str) == want
    assert len({c for _, _, c in want}) < len(want) - 20


def test_every_near_pair_meets():
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 64, 300, dtype=np.uint64)
    flips = base.copy()
    for k in range(4):
        flips ^= np.uint64(1) << r.integers(0, 64, 300, dtype=np.uint64)
    for classes in (10, 1 << 22, 1 << 30, 1 << 40):
        masks = S.band_masks(classes)
        for a, b in zip(base.tolist(), flips.tolist()):
            assert any((a ^ b) & m == 0 for m in masks)
    fp = np.concatenate([base, flips])
    links = S.links_under_keys(np.zeros(600, np.int64), fp)
    parent = {}
    for a, b in links:
        parent[S.find(parent, a)] = S.find(parent, b)
    for a, b in zip(base.view(np.int64).tolist(), flips.view(np.int64).tolist()):
        assert S.find(parent, a) == S.find(parent, b)


def test_long_chains(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 200), (300, 200), (7, 7)]
    got = dict(S.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert {n: got.get(n, n) for n in range(61)} == dict.fromkeys(range(61), 0)
    assert got == {**{n: 0 for n in range(1, 61)}, 200: 100, 300: 100}


def test_keep_one_and_empty(spark):
    df = spark.createDataFrame([(3, "a b c d e", "x"), (1, "A b c d e", "y"), (1, "A b c d e", "y"), (2, "other words stand here now", "z"), (None, "a b c d e", "n")], "doc_id long, text string, lang string")
    assert sorted(map(tuple, S.keep_one(df).collect()), key=str) == [(1, "A b c d e", "y"), (2, "other words stand here now", "z"), (None, "a b c d e", "n")]
    assert S.near_duplicates(df.limit(0)).collect() == []
