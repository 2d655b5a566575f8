import hashlib
import random

from lodestring.llm import substring_dedup as module
from lodestring.llm.substring_dedup import WINDOW, substring_dedup

SCHEMA = "doc_id long, text string, n_words string, KEPT_TEXT int, source string"


def brute(rows):
    first, words = {}, [(d, (t or "").encode().split()) for d, t in rows]
    low = -(1 << 63)
    for d, w in words:
        for i in range(len(w) - WINDOW + 1):
            at = (low if d is None else d, i)
            k = tuple(w[i : i + WINDOW])
            first[k] = min(first.get(k, at), at)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - WINDOW + 1):
            if first[tuple(w[i : i + WINDOW])] < (low if d is None else d, i):
                gone.update(range(i, i + WINDOW))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def cases():
    r = random.Random(7)
    word = lambda: r.choice("ab") * r.randint(1, 2) + r.choice(["", "é", "漢"])
    passage = [word() for _ in range(30)]
    rows = [(None, " ".join(passage)), (None, None), (5, ""), (6, None), (7, "\n\t "), (8, "x")]
    for d in range(60, 10, -1):
        w = [f"w{r.randint(0, 10**6)}" for _ in range(r.randint(0, 80))]
        if d % 3 == 0:
            w[5:5] = passage[: r.randint(15, 30)]
        if d % 7 == 0:
            w = w + w
        rows.append((d, r.choice([" ", "\n", "  ", "\x0b"]).join(w)))
    rows += [rows[-1], rows[-3], (20, "again " * 100), (20, "again " * 60), (21, " ".join(["loop"] * 500))]
    rows.append((9, " ".join(f"v{i % 4000}" for i in range(30000))))
    return rows


def test_against_brute_force(spark, monkeypatch):
    rows = cases()
    df = spark.createDataFrame([(d, t, "x", 1, None) for d, t in rows], SCHEMA).repartition(5)
    for size, entries in ((50, 2000), (400_000, 1 << 21)):
        monkeypatch.setattr(module, "SHARD_ENTRIES", entries)  # many shards, then one
        got = substring_dedup(df, block_words=size).collect()
        assert sorted(((x.doc_id, x.n_words, x.n_removed, hashlib.sha256(x.kept_text.encode()).hexdigest()) for x in got), key=str) == brute(rows)
        assert got[0].source is None


def test_empty(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
