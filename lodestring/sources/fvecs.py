"""fvecs files as a Spark data source that splits files by bytes.

A record is [int32 dimension][dimension x float32], little-endian, of one dimension in all
files. Records have one size, so a file of any size is cut at records, and ids are known from
sizes alone: they count through the files in order of path. Files are read and written through
pyarrow's file systems (local, hdfs, s3, gs), by ranges.

A write leaves a file a task under a hidden name; commit gives them their names when all tasks
are done, so a task that runs twice or a job that fails leaves nothing that a reader sees.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "id long, v array<float>"
AT_ONCE = 8192  # records of a batch


def opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))


def visible_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of a folder's files that aren't hidden, in order."""
    files, at = opened(path)
    about = files.get_file_info(at)
    if about.type == pyarrow.fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if about.is_file:
        return [(at, about.size)]
    found = files.get_file_info(pyarrow.fs.FileSelector(at))
    return sorted((f.path, f.size) for f in found if f.is_file and not f.base_name.startswith(("_", ".")))


@dataclass
class Split(InputPartition):
    path: str
    first: int  # record in the file
    count: int
    id: int  # of the first record
    dim: int


class FvecsReader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def partitions(self) -> list[Split]:
        files, _ = opened(self.path)
        out, upto, dims = [], 0, set()
        for path, size in visible_files(self.path):
            if not size:
                raise ValueError(f"empty fvecs file {path}")
            with files.open_input_file(path) as f:
                dim = int(np.frombuffer(f.read(4).ljust(4, b"\xff"), "<i4")[0])
            if dim <= 0 or size % (4 + 4 * dim):
                raise ValueError(f"fvecs size doesn't fit its dimension: {path}")
            dims.add(dim)
            if len(dims) > 1:
                raise ValueError(f"fvecs records of several dimensions: {sorted(dims)}")
            n, each = size // (4 + 4 * dim), max(1, self.split_bytes // (4 + 4 * dim))
            out += [Split(path, at, min(each, n - at), upto + at, dim) for at in range(0, n, each)]
            upto += n
        return out or [Split("", 0, 0, 0, 1)]

    def read(self, split: Split) -> Iterator[pa.RecordBatch]:
        if not split.count:
            return
        files, _ = opened(self.path)
        width = 4 + 4 * split.dim
        with files.open_input_file(split.path) as f:
            f.seek(split.first * width)
            for at in range(0, split.count, AT_ONCE):
                n = min(AT_ONCE, split.count - at)
                rows = np.frombuffer(f.read(n * width), "<i4").reshape(n, split.dim + 1)
                if (rows[:, 0] != split.dim).any():
                    raise ValueError(f"fvecs records of several dimensions: {split.path}")
                values = np.ascontiguousarray(rows[:, 1:]).view("<f4").ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, split.dim, dtype=np.int32)), pa.array(values))
                ids = np.arange(split.id + at, split.id + at + n)
                yield pa.RecordBatch.from_arrays([pa.array(ids), lists], names=["id", "v"])


@dataclass
class Written(WriterCommitMessage):
    hidden: str
    name: str


class FvecsWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        files, at = opened(self.path)
        context = TaskContext.get()
        name = f"part-{context.partitionId():06d}.fvecs"
        hidden = f"{at}/.{name}-{context.taskAttemptId()}"
        dim = None
        files.create_dir(at, recursive=True)
        with files.open_output_stream(hidden) as f:
            for b in batches:
                column = b.column(b.schema.get_field_index("v"))
                if not len(column):
                    continue
                sizes = np.unique(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False))
                dim = int(sizes[0]) if dim is None else dim
                if len(sizes) != 1 or sizes[0] != dim or dim <= 0:
                    raise ValueError(f"vectors of dimensions {sizes.tolist()}; one is needed")
                rows = np.empty((len(column), dim + 1), "<i4")
                rows[:, 0] = dim
                rows[:, 1:] = column.flatten().to_numpy(zero_copy_only=False).astype("<f4").view("<i4").reshape(len(column), dim)
                f.write(rows.tobytes())
        return Written(hidden, name if dim is not None else "")

    def commit(self, messages: list[Written | None]) -> None:
        files, at = opened(self.path)
        for m in messages:
            if m and m.name:
                files.move(m.hidden, f"{at}/{m.name}")
            elif m:
                files.delete_file(m.hidden)

    def abort(self, messages: list[Written | None]) -> None:
        files, _ = opened(self.path)
        for m in messages:
            if m:
                files.delete_file(m.hidden)


class FvecsSource(DataSource):
    """spark.read.format("fvecs").load(path); option split_bytes. Writing takes (id, v)."""

    @classmethod
    def name(cls) -> str:
        return "fvecs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FvecsReader:
        return FvecsReader(self.options["path"], int(self.options.get("split_bytes", 64 << 20)))

    def writer(self, schema: StructType, overwrite: bool) -> FvecsWriter:
        return FvecsWriter(self.options["path"])


def read_fvecs(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    """(id, v) of a file or a folder of files, several tasks a large file."""
    spark.dataSource.register(FvecsSource)
    return spark.read.format("fvecs").option("split_bytes", split_bytes).load(path)


def write_fvecs(rows: DataFrame, path: str) -> None:
    """Rows (id, v) in order of id, in files that follow each other; the folder must be new or empty."""
    rows.sparkSession.dataSource.register(FvecsSource)
    sorted_rows = rows.select("id", rows["v"].cast("array<float>").alias("v")).repartitionByRange("id").sortWithinPartitions("id")
    sorted_rows.write.format("fvecs").mode("append").save(path)
