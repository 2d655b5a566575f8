"""Appending to a state index against a rebuild."""

import random

import pytest

from lodestring.operators import states
from lodestring.operators.dictionary import SubstringDictionary
from lodestring.operators.states import StateIndex


def rows_of(df, *names):
    return sorted(map(tuple, df.select(*names).collect()), key=str)


def same(one, two):
    assert rows_of(one.substates, "g", "state", "h1", "h2", "h3", "n") == rows_of(two.substates, "g", "state", "h1", "h2", "h3", "n")
    assert rows_of(one.layout, "state", "base", "n", "n_local", "has_graph") == rows_of(two.layout, "state", "base", "n", "n_local", "has_graph")
    assert rows_of(one.local, "state", "id") == rows_of(two.local, "state", "id")


@pytest.mark.parametrize("mode", ["delta", "full"])
def test_append_equals_rebuild(spark, tmp_path, mode):
    r = random.Random(6)
    names = ["".join(r.choice("abc") for _ in range(r.randrange(1, 9))) for _ in range(25)]
    rows = [(i, r.choice(names), [r.random(), r.random()]) for i in range(90)] + [(90, "xab", [0.0, 0.0]), (91, "xab", [0.0, 1.0]), (92, "ab", [1.0, 0.0]), (93, "zz", [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, s string, v array<double>")
    index = StateIndex.build(df.where("id < 50"), mode, 4)
    for low, high in ((50, 92), (92, 94)):
        index = index.append(df.where(f"id >= {low} AND id < {high}"))
        index.save(str(tmp_path / f"{high}"))
        index = StateIndex.load(spark, str(tmp_path / f"{high}"))
    same(index, StateIndex.build(df, mode, 4))


def test_old_strings_are_not_read(spark):
    df = spark.createDataFrame([(i, s, [0.0]) for i, s in enumerate(["banana", "ananas", "nab"])], "id long, s string, v array<double>")
    index = StateIndex.build(df.where("id < 2"), threshold=2)
    gone = StateIndex(df.where("id < 2").selectExpr("id", "CAST(raise_error('read') AS STRING) AS s", "v"), index.substates, index.layout, index.local, "delta", 2)
    same(gone.append(df.where("id = 2")), StateIndex.build(df, threshold=2))


def test_dictionary_keeps_its_length(spark, tmp_path):
    long = spark.createDataFrame([(1, "ab" * 300, [0.0])], "id long, s string, v array<double>")
    SubstringDictionary.build(long.limit(0), max_length=700).save(str(tmp_path / "d"))
    loaded = SubstringDictionary.load(spark, str(tmp_path / "d"))
    assert loaded.max_length == 700 and loaded.append(long).size_report().first().substrings > 0
