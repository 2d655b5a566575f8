"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. run() writes every stage's
result as Parquet to the shared folder and gives it to the next stage as its docs.

Cases, in every stage: null and empty texts fail the quality rules, so they end there; rows
with a null doc_id stay on their own terms and stand alone in near-dedup; repeated rows are one
group there, of which one row stays; texts of any length go whole; extra columns of any name
are carried to the last stage, which returns its pieces; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestring.llm import near_copies, packing, quality, substring_dedup, toxicity
from lodestring.llm.common import read_table, scratch, stage
from lodestring.llm.queries import WORD_BPE


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without the lines that fail."""
    return quality.clean_documents(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; the classifier learns from the labelled ones among docs."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its five-word shingles: that of the smallest id.

    Candidates come from SimHash and, where its bits are too far apart, MinHash; an exact check follows.
    """
    return near_copies.keep_one(docs)


def substring_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without words that stand in an earlier repeated window; untouched ones keep their layout."""
    own = {c: f"own{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}  # so that none has the name of a new column
    done = substring_dedup.substring_dedup(docs.select(*[F.col(f"`{c}`").alias(own.get(c, c)) for c in docs.columns]))
    done = done.withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text")))
    n_chars = F.length("text").cast("long")
    return done.select(*[n_chars.alias(c) if c == "n_chars" else F.col(own.get(c, c)).alias(c) for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack(docs, WORD_BPE)


STAGES = [("quality rules", quality_rules), ("toxicity", toxicity_filter), ("SimHash near-dedup", near_dedup), ("substring dedup", substring_removal), ("packing", pack)]
#: Fitted classifiers and merges of ids can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, function in STAGES:
        with scratch(spark):  # what a stage stages goes once its result is written
            docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-"), lasting=True)
    return docs
