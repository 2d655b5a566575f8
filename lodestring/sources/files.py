"""Text files: line i is row i."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.storage import checkpointed

BROADCAST_SPLITS = 1 << 18  # of files, whose first ids may be copied to every executor


def in_order(rows: DataFrame) -> DataFrame:
    """rows of files with ids from 0, in order of path and place.

    rows have the columns path and start of the split that each came from. A count for each
    split gives the first id of the next, so nothing is sorted, and no row leaves its task unless
    there are more than BROADCAST_SPLITS.
    """
    marked = rows.withColumn("at", F.monotonically_increasing_id())
    splits = marked.groupBy("path", "start").agg(F.count("*").alias("n"), F.min("at").alias("first"))  # a row a split
    earlier = Window.orderBy("path", "start").rowsBetween(Window.unboundedPreceding, -1)
    base = splits.select("path", "start", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    base = checkpointed(rows.sparkSession, base)
    return marked.join(F.broadcast(base) if base.count() <= BROADCAST_SPLITS else base, ["path", "start"]).withColumn("id", F.col("at") + F.col("shift")).drop("at", "shift", "path", "start")


def text_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, value) of every line, ids from 0 in order of the files and lines."""
    return in_order(text_rows(spark, path)).select("id", "value")


def read_strings(spark: SparkSession, path: str, tokens: bool = False) -> DataFrame:
    """(id, s): one string a line; with tokens, one a white-space token, blank lines skipped."""
    if not tokens:
        return read_lines(spark, path).select("id", F.rtrim("value").alias("s"))
    words = text_rows(spark, path).select(F.explode(F.split(F.trim("value"), r"\s+")).alias("s"), "path", "start").where("s <> ''")
    return in_order(words).select("id", "s")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(id, v): numbers apart by white space on each line."""
    return read_lines(spark, path).select("id", F.split(F.trim("value"), r"\s+").cast("array<float>").alias("v"))


def check_dimension(df: DataFrame, column: str = "v", expected: int | None = None) -> int:
    """The one dimension of a vector column; ValueError if there are several."""
    low, high = df.agg(F.min(F.size(column)), F.max(F.size(column))).first()
    if low != high or expected is not None and low is not None and low != expected:
        raise ValueError(f"vectors of dimensions {low} to {high}; one of {expected or low} is needed")
    return low or 0


def load_corpus(spark: SparkSession, strings: str, vectors: str, data_size: int | None = None, tokens: bool = False) -> DataFrame:
    """(id, s, v) of two aligned files, down to the shorter; rows with id < data_size."""
    df = read_strings(spark, strings, tokens).join(read_vectors(spark, vectors), "id")
    if data_size is not None:
        df = df.where(F.col("id") < data_size)
    check_dimension(df)
    return df.select("id", "s", "v")


def load_queries(spark: SparkSession, strings: str, vectors: str, ks: str, dim: int | None = None) -> DataFrame:
    """(qid, p, qv, k) of three aligned files, down to the shortest."""
    k = read_lines(spark, ks).select("id", F.trim("value").cast("int").alias("k"))
    df = read_strings(spark, strings).join(read_vectors(spark, vectors), "id").join(k, "id")
    check_dimension(df, "v", dim)
    return df.select(F.col("id").alias("qid"), F.col("s").alias("p"), F.col("v").alias("qv"), "k")


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(qid, ids): ids apart by spaces, nearest first; a blank line is a query without match."""
    words = F.filter(F.split("value", r"\s+"), lambda x: x != "")
    return read_lines(spark, path).select(F.col("id").alias("qid"), words.cast("array<bigint>").alias("ids"))
