"""States by waves of shards: the same counts, and tables of a few bytes a letter at any time."""

import random

import numpy as np

from lodestring.operators import suffix_blocks, suffixes
from lodestring.plans.storage import stored_bytes


def test_waves_keep_tables_small(spark, monkeypatch):
    # ranks of all places and the rows of every round lay there at once
    r = random.Random(3)
    passage = "".join(r.choices("abcdefghijklmnopqrst", k=4000))
    texts = ["".join(r.choices("abcdefghijklmnopqrst", k=3000)) + passage[r.randrange(2000) :] for _ in range(80)]
    strings, _ = suffixes.distinct_strings(spark.createDataFrame(list(enumerate(texts)), "id long, s string"))
    monkeypatch.setattr(suffix_blocks, "WAVE", 1 << 17, raising=False)
    held, staged = {}, suffix_blocks.SuffixBlocks.staged

    def spied(self, name, df):
        out = staged(self, name, df)
        held[name] = stored_bytes(self.spark, self.folder)
        return out

    monkeypatch.setattr(suffix_blocks.SuffixBlocks, "staged", spied)
    got = sorted(map(tuple, suffix_blocks.state_counts(strings).select("len", "states", "substrings", "occurrences").collect()))
    assert max(held.values()) < 4 * sum(map(len, texts)), held
    assert sum(name.startswith("wave") for name in held) > 2
    monkeypatch.setattr(suffix_blocks, "WAVE", 1 << 30)
    assert got == sorted(map(tuple, suffix_blocks.state_counts(strings).select("len", "states", "substrings", "occurrences").collect()))


def test_marks():
    letters, r = suffix_blocks.Letters(True), random.Random(4)
    strings = ["".join(r.choices("ab", k=n)) for n in (1, 2, 23, 24, 25, 400, 3)] + ["a" * 90]
    codes, lens = np.concatenate([letters.codes(s) for s in strings]), np.array([len(s) for s in strings], np.int32)
    far, (rest, _) = letters.marks(codes, lens), suffix_blocks.rest_of(lens)
    assert ((far > 0) == (rest >= letters.whole)).all() and far.max() <= letters.window
    begins = {}
    for i in np.nonzero(far)[0].tolist():  # places that begin alike have their marks equally far on
        assert begins.setdefault(codes[i : i + letters.whole].tobytes(), far[i]) == far[i]
    own = np.arange(len(codes))
    one, two = letters.pair(letters.fours(codes, np.nonzero(rest == 0)[0]), own, rest)
    assert (one == letters.packed(codes, rest, 0, letters.each)).all() and (two == letters.packed(codes, rest, letters.each, letters.each)).all()
