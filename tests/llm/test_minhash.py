"""MinHash near-duplicates against all pairs of plain sets."""

import random
import re

from lodestring.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain(rows):
    sets = [plain_set(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 85 * (len(a) + len(sets[j]) - both) and both:
                label[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    out = []
    for i, (d, _) in enumerate(rows):
        c = low.get(find(i)) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()), key=str)


def varied(r, base, share):
    return [w if r.random() > share else f"v{r.randrange(10**6)}" for w in base]


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PART", 5)  # lists of a large group are cut into many parts
    r = random.Random(8)
    passage = [f"p{i}" for i in range(80)]
    rows = [(0, None), (1, ""), (2, " \n "), (3, "one"), (4, "ONE"), (5, "two words"), (None, "two  words"), (None, "three little words"), (6, "É a b c d e"), (7, "é a b c d e")]
    for g in range(6):
        base = [f"g{g}w{r.randrange(4000)}" for _ in range(r.choice([30, 200, 900]))]
        for _ in range(12):
            rows.append((r.randrange(10, 10**6), " ".join(varied(r, base, r.choice([0, 0.005, 0.01, 0.02, 0.03])))))
    for i in range(40):  # one common passage, otherwise apart
        rows.append((2 * 10**6 + i, " ".join(passage + [f"x{r.randrange(10**6)}" for _ in range(60)])))
    base = [f"hot{i}" for i in range(300)]
    for i in range(60):
        rows.append((3 * 10**6 - i, " ".join(varied(r, base, 0.012)).upper()))
    rows += [rows[-1], rows[-1], (rows[-1][0], "another text under a used id here"), (77, "very " * 30000 + "end")]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, row int").repartition(5)
    assert result(df) == plain(rows)
    assert result(df.limit(0)) == []


def test_boundary_of_the_share(spark):
    for n, want in ((85, True), (84, False)):
        both = [f"a{i}" for i in range(n + 4)]  # n shingles in common, 100 in the union
        rows = [(1, " ".join(both)), (2, " ".join(both + [f"b{i}" for i in range(100 - n)]))]
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert (got[2] == 1) == want == (plain(rows)[1][2] == 1)


def test_chain_that_stars_break(spark):
    words = [f"c{i}" for i in range(700)]
    rows = [(i, " ".join(words[20 * i : 20 * i + 400])) for i in range(15)]  # each linked with its neighbours alone
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)
    assert {c for _, _, c, _ in plain(rows)} == {0}
