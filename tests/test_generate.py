from contextlib import contextmanager

from lodestring.operators import generate


@contextmanager
def small_partitions(spark):
    """Exchanges are read in pieces by their bytes, so their pieces differ with the columns that are read."""
    conf = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4000b",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1000b",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def step(x):
    return (1664525 * x + 1013904223) & 0xFFFFFFFF


def test_generated_queries_are_those_of_the_numbers(spark):
    rows = [(7 * i, "".join(chr(97 + (i * j) % 26) for j in range(2 + i % 50)) * 40, [float(i)]) for i in range(1, 200)]
    df = spark.createDataFrame(rows, "id long, s string, v array<float>").repartition(5)
    want = []
    for q in range(60):
        a = step(((q + 1) * 2654435761) & 0xFFFFFFFF)
        b = step(a)
        s = rows[(a >> 8) % len(rows)][1]
        at = (b >> 8) % (len(s) - 2)
        want.append((q, s[at : at + 3], rows[(step(b) >> 8) % len(rows)][2], 10))
    with small_partitions(spark):
        got = sorted(map(tuple, generate.generate_queries(df, 60).collect()))
    assert got == want


def test_rows_that_share_an_id_are_drawn_one_by_one(spark):
    df = spark.createDataFrame([(1, "abc", [1.0]), (1, "abd", [2.0]), (2, "abe", [3.0])], "id long, s string, v array<float>")
    made = generate.generate_queries(df, 200).collect()
    assert len(made) == 200 and {r.p for r in made} == {"abc", "abd", "abe"} and {r.qv[0] for r in made} == {1.0, 2.0, 3.0}
