"""Tables in the shared folder."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpointed(spark: SparkSession, df: DataFrame) -> DataFrame:
    """df written to the folder in spark.checkpoint.dir and read back: no lineage to recompute."""
    path = f"{shared_dir(spark)}/lodestring/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def rewritten(spark: SparkSession, df: DataFrame, *old: DataFrame) -> DataFrame:
    """checkpointed(df), and the tables that it was made from, which nothing else reads, are removed."""
    new = checkpointed(spark, df)
    for table in old:
        for path in {x.rsplit("/", 1)[0] for x in table.inputFiles()}:
            remove(spark, path)
    return new


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


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of a path, as Spark's readers see it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a folder's files."""
    files, at = hadoop_path(spark, path)
    return int(files.getContentSummary(at).getLength())


def remove(spark: SparkSession, path: str) -> None:
    files, at = hadoop_path(spark, path)
    files.delete(at, True)
