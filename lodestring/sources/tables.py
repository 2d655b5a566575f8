"""Corpora of (id, s, v) and queries of (qid, p, qv, k) from Parquet tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keep_letters


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, s) of all documents; strings are letters alone, rows without any go."""
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), keep_letters(F.col("text")).alias("s")).where("s <> ''")


def part_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, s) of all part names: short strings."""
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), keep_letters(F.col("p_name")).alias("s")).where("s <> ''")


def with_vectors(strings: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return strings.join(vectors, "id").where("v IS NOT NULL")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have a vector of the same id."""
    return with_vectors(document_strings(spark, sf_dir), spark, sf_dir)


def part_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names that have a vector of the same id."""
    return with_vectors(part_strings(spark, sf_dir), spark, sf_dir)


def default_queries(base: DataFrame, length: int = 3, k: int = 10, every: int = 50, start: int = 5) -> DataFrame:
    """One query of every so many rows: a piece of its string, its vector."""
    chosen = base.where((F.col("id") % every == 0) & (F.length("s") >= start + length - 1))
    return chosen.select(F.col("id").alias("qid"), F.substring("s", start, length).alias("p"), F.col("v").alias("qv"), F.lit(k).alias("k"))
