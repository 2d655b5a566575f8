"""Binary vector files: splits, round trips, what a failed write leaves."""

import struct

import pytest
from pyspark.sql import functions as F

from lodestring.sources import read_fvecs, write_fvecs
from lodestring.sources.fvecs import FvecsReader


def test_one_file_is_read_by_several_tasks(spark, tmp_path):
    path = str(tmp_path / "x.fvecs")
    with open(path, "wb") as f:
        f.write(b"".join(struct.pack("<i4f", 4, i, i + 0.5, -i, 0) for i in range(1000)))
    df = read_fvecs(spark, path, split_bytes=1000)
    parts = df.select("id", "v", F.spark_partition_id().alias("p")).orderBy("id").collect()
    assert [(r.id, r.v) for r in parts] == [(i, [i, i + 0.5, -i, 0]) for i in range(1000)]
    assert len({r.p for r in parts}) == 20
    assert read_fvecs(spark, f"file://{path}").count() == 1000


def test_places_beyond_two_gigabytes(tmp_path):
    path = tmp_path / "big.fvecs"
    with open(path, "wb") as f:
        f.write(struct.pack("<i3f", 3, 1, 2, 3))
        f.truncate(16 * 200_000_000)  # a hole: no bytes on the disk
        f.seek(16 * 199_999_999)
        f.write(struct.pack("<i3f", 3, 7, 8, 9))
    reader = FvecsReader(str(path), 1 << 30)
    splits = reader.partitions()
    assert len(splits) == 3 and sum(s.count for s in splits) == 200_000_000
    last = splits[-1]
    last.first, last.id, last.count = last.first + last.count - 1, last.id + last.count - 1, 1
    (batch,) = reader.read(last)
    assert batch.to_pydict() == {"id": [199_999_999], "v": [[7, 8, 9]]}


def test_round_trip(spark, tmp_path):
    rows = [(i, [float(i), 0.5 * i]) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(6)
    write_fvecs(df, str(tmp_path / "out"))
    got = read_fvecs(spark, str(tmp_path / "out"), split_bytes=500).orderBy("id").collect()
    assert [(r.id, r.v) for r in got] == rows
    write_fvecs(df.limit(0), str(tmp_path / "none"))
    assert read_fvecs(spark, str(tmp_path / "none")).collect() == []


def test_bad_files_and_failed_writes(spark, tmp_path):
    uneven = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id long, v array<double>").coalesce(1)
    with pytest.raises(Exception, match="one is needed"):
        write_fvecs(uneven, str(tmp_path / "uneven"))
    assert read_fvecs(spark, str(tmp_path / "uneven")).collect() == []
    for name, data, match in (("empty", b"", "empty"), ("short", b"\x01", "dimension"), ("two", struct.pack("<ifif", 1, 0, 2, 0), "several dimensions")):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception, match=match):
            read_fvecs(spark, str(tmp_path / name)).collect()
