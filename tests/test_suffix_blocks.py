"""States counted from packed blocks: equal to those of the suffix array of rows, and no row a place."""

import numpy as np
import pytest
from test_suffixes import TEXTS, corpus, long_texts

import __spark_entry__
from lodestring.operators import suffix_blocks, suffixes


@pytest.mark.parametrize("texts", [TEXTS, [*long_texts(1), "A z" * 30, "z\u007fA" * 9], []])
def test_counts_equal_those_of_rows(spark, texts, monkeypatch):
    monkeypatch.setattr(suffix_blocks, "FEW_LETTERS", 300)
    monkeypatch.setattr(suffix_blocks, "FEW_PLACES", 200)
    strings, _ = suffixes.distinct_strings(corpus(spark, texts))
    got = suffix_blocks.state_counts(strings).collect()
    array = suffixes.suffix_array(strings)
    want = suffixes.state_lengths(array, *suffixes.suffix_states(array)).collect()
    assert {r.len: (r.states, r.substrings, r.occurrences) for r in got if r.states} == {r.len: tuple(r)[1:4] for r in want}
    assert sum(r.ids for r in got) == sum(r.ids for r in want)


def test_documents_without_rows_of_places(spark, sf_dir, monkeypatch):
    # both queries took a row a letter through each round
    monkeypatch.setattr(suffixes, "run_starts", None)
    queries = __spark_entry__.queries()
    by_length = queries["document_states"](spark, sf_dir).collect()
    assert len(by_length) == 13478
    (total,) = queries["document_total_ids"](spark, sf_dir).collect()
    assert total.states == sum(r.states for r in by_length) and total.occurrences > total.total_ids > total.states


def test_least():
    v = np.random.default_rng(1).integers(0, 9999, 3000)
    least, r = suffix_blocks.Least(v), np.random.default_rng(2)
    ends = np.sort(r.integers(0, 3000, (500, 2)), axis=1)
    assert least.of(ends[:, 0], ends[:, 1]).tolist() == [v[a : b + 1].min() for a, b in ends]
    assert suffix_blocks.smaller_before(v[:300]).tolist() == [max((j for j in range(i) if v[j] < v[i]), default=-1) for i in range(300)]
