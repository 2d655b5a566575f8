"""File sources and sinks, the stream, the command line, the entry module."""

import struct
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestring import cli, queries, sources
from lodestring.functions import clean_email_body, escape_like, escape_wildcard, keep_letters, sanitize_name


def write(path, text):
    path.write_text(text)
    return str(path)


def test_text_corpus(spark, tmp_path):
    strings, vectors = write(tmp_path / "s", "banana\nanana\nnana\nana\n"), write(tmp_path / "v", "1 2 3\n4 5 6 \n7  8 9\n")
    rows = sources.load_corpus(spark, strings, vectors).orderBy("id").collect()
    assert [(r.id, r.s, r.v) for r in rows] == [(0, "banana", [1, 2, 3]), (1, "anana", [4, 5, 6]), (2, "nana", [7, 8, 9])]
    assert sources.load_corpus(spark, strings, vectors, data_size=2).count() == 2
    with pytest.raises(ValueError):
        sources.load_corpus(spark, strings, write(tmp_path / "w", "1 2\n1 2 3\n"))
    assert [r.s for r in sources.read_strings(spark, write(tmp_path / "t", "a b\n\nc\n"), tokens=True).orderBy("id").collect()] == ["a", "b", "c"]
    asked = sources.load_queries(spark, strings, vectors, write(tmp_path / "k", "2\n3\n"), 3).orderBy("qid").collect()
    assert [(r.qid, r.p, r.k) for r in asked] == [(0, "banana", 2), (1, "anana", 3)]


def test_truth_round_trip(spark, tmp_path):
    results = spark.createDataFrame([(0, 1, 7, 0.5), (0, 2, 3, 0.6), (2, 1, 9, 0.1)], "qid long, rank long, id long, dist double")
    asked = spark.createDataFrame([(0,), (1,), (2,)], "qid long")
    sources.write_ground_truth(results, asked, str(tmp_path / "truth"))
    assert [(r.qid, r.ids) for r in sources.read_ground_truth(spark, str(tmp_path / "truth")).orderBy("qid").collect()] == [(0, [7, 3]), (1, []), (2, [9])]


def test_fvecs(spark, tmp_path):
    data = b"".join(struct.pack("<i3f", 3, *v) for v in ((1, 2, 3), (4, 5, 6)))
    (tmp_path / "x.fvecs").write_bytes(data)
    assert [(r.id, r.v) for r in sources.read_fvecs(spark, str(tmp_path / "x.fvecs")).orderBy("id").collect()] == [(0, [1, 2, 3]), (1, [4, 5, 6])]
    (tmp_path / "many").mkdir()
    for name in ("a", "b"):
        (tmp_path / "many" / f"{name}.fvecs").write_bytes(data)
    assert [(r.id, r.v[0]) for r in sources.read_fvecs(spark, str(tmp_path / "many")).orderBy("id").collect()] == [(0, 1), (1, 4), (2, 1), (3, 4)]
    (tmp_path / "y.fvecs").write_bytes(data[:-1])
    with pytest.raises(Exception, match="size"):
        sources.read_fvecs(spark, str(tmp_path / "y.fvecs")).collect()


def test_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    sources.publish_table(spark.range(3), path)
    sources.publish_table(spark.range(5), path)
    assert spark.read.parquet(path).count() == 3
    sources.publish_table(spark.range(5), path, rebuild=True)
    assert spark.read.parquet(path).count() == 5


def test_text_functions(spark):
    df = spark.createDataFrame([("\u212aab-CD é", "a*b?\\", "50%_", "My Set #1", "Hi\n> quoted\nyou,  2")], "a string, b string, c string, d string, e string")
    row = df.select(keep_letters(F.col("a")), escape_wildcard(F.col("b")), escape_like(F.col("c")), sanitize_name(F.col("d")), clean_email_body(F.col("e"))).first()
    assert tuple(row) == ("abcd", "a\\*b\\?\\\\", "50\\%\\_", "my-set-1", "hi you 2")


def test_command_line(spark, tmp_path, capsys):
    files = [write(tmp_path / n, t) for n, t in (("s", "banana\nanana\nnana\nana\nna\n"), ("v", "1 2 3\n4 5 6\n7 8 9\n10 11 12\n13 14 15\n"), ("qs", "ana\nnana\nzzz\n"), ("qv", "9 10 11\n9 10 11\n9 10 11\n"), ("k", "2\n2\n2\n"))]
    for mode in cli.MODES:
        extra = [f"--statistics-file={tmp_path / mode}.csv", f"--write-ground-truth={tmp_path / mode}.truth", "--insert-percentage=40", "--set-min-build-threshold=2"]
        out = cli.main([*files, mode, *extra], spark)
        assert max(p["recall"] for p in out) == 1.0
        assert spark.read.option("header", True).csv(f"{tmp_path / mode}.csv").columns == ["ef_search", "time_us", "recall", "exact"]
        assert [r.ids for r in sources.read_ground_truth(spark, f"{tmp_path / mode}.truth").orderBy("qid").collect()] == [[3, 2], [2, 1], []]
    saved = f"--save-index={tmp_path / 'idx'}", f"--load-index={tmp_path / 'idx'}"
    for flag in saved:
        assert cli.main([*files, "delta", flag], spark)[0]["recall"] == 1.0


@pytest.mark.parametrize("name", ["exact_topk", "prefilter_topk", "planned_topk", "postfilter_topk", "stream_append_topk", "largest_successor", "state_classes", "query_generator"])
def test_queries_match_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = queries.queries()[name](spark, sf_dir)
    want = con.sql(queries.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(n) for n in names]
    assert sorted((tuple(r[n] for n in names) for r in df.collect()), key=str) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)


def test_core_does_not_need_the_text_operators():
    code = "import sys; sys.modules['lodestring.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert 'exact_topk' in q and not any(n.startswith('op') and n[2].isdigit() for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=sys.path[0])


def test_line_numbers_run_through_files_and_splits(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 50) for i in range(4000)]
    (tmp_path / "many").mkdir()
    for name, part in (("b", lines[100:]), ("a", lines[:100])):
        (tmp_path / "many" / name).write_text("\n".join(part) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = sources.read_lines(spark, str(tmp_path / "many"))
        assert got.rdd.getNumPartitions() > 1 and [(r.id, r.value) for r in got.orderBy("id").collect()] == list(enumerate(lines))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
