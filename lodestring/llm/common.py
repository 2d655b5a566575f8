"""What the text operators share: reading columns, staging tables, appending columns.

Every operator first selects the columns it needs by name, so other columns, whatever
their names, never clash. Staged tables go to the folder that all executors share.
"""

from __future__ import annotations

import functools
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, as in the word pattern [^\x20\x09-\x0D]+; bytes.split() cuts at the same six bytes.
SPACES = b" \t\n\v\f\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset a local session gets one of this machine; a cluster must name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = own_folder(spark.sparkContext.applicationId)
    return folder


@functools.cache
def own_folder(application: str) -> str:
    """This machine's folder for one local application; Spark lets no session set spark.checkpoint.dir later."""
    return tempfile.mkdtemp(prefix="lodestring-")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestring/{name}-{uuid.uuid4().hex}"


_open = threading.local()


def note_staged(path: str, table: str | None = None) -> None:
    """Leaves a staged folder, and its table in the catalog, to the innermost scratch() of this thread."""
    if getattr(_open, "scratches", None):
        _open.scratches[-1].append((path, table))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what was staged inside; results that read it must be written by then."""
    _open.scratches = [*getattr(_open, "scratches", ()), []]
    try:
        yield
    finally:
        for path, table in _open.scratches.pop():
            if table:
                spark.sql(f"DROP TABLE IF EXISTS `{table}`")
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stage(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back; this cuts its lineage.

    Inside scratch() the table is removed at its end, unless it is lasting.
    """
    path = shared_path(df.sparkSession, name)
    if not lasting:
        note_staged(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pick(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.col(f"`{n}`") for n in names])


def append_columns(df: DataFrame, column: str, make: Callable[[], Callable[[list], dict]], fields: list[T.StructField], rows: int = 1024, keep: str | None = None) -> DataFrame:
    """df with columns computed from the values of one column, in one pass over Arrow batches.

    make() runs once a task and returns a function from a list of values to lists by field
    name. An input column with the name of a new one is replaced. With keep, the name of
    one of the boolean new columns, only rows where it is true stay, without new columns.
    """
    new = [f.name for f in fields]
    carried = df if keep else df.drop(*[n for n in new if n.lower() != column.lower()])
    if not keep and column.lower() in {n.lower() for n in new}:
        raise ValueError(f"a new column has the name of the column read: {column}")
    schema = T.StructType([*carried.schema.fields, *([] if keep else fields)])
    at = [f.name for f in carried.schema.fields].index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for start in range(0, whole.num_rows, rows):
                batch = whole.slice(start, rows)
                made = work(batch.column(at).to_pylist())
                if keep:
                    yield batch.filter(pa.array(made[keep], pa.bool_()))
                else:
                    columns = [*batch.columns, *[pa.array(made[f.name], arrow_type(f.dataType)) for f in fields]]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return carried.mapInArrow(run, schema)


def slices_by_bytes(batch: pa.RecordBatch, column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about so many bytes of text in one column; a longer text stands alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).tolist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def arrow_type(kind: T.DataType) -> pa.DataType:
    simple = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64(), T.FloatType(): pa.float32(), T.StringType(): pa.string(), T.BinaryType(): pa.binary(), T.BooleanType(): pa.bool_()}
    return pa.list_(arrow_type(kind.elementType)) if isinstance(kind, T.ArrayType) else simple[kind]


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, True)


def encoded(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""
