"""Posting tables: which rows hold which substring.

The physical table has a row (g, id) for each, sorted by g within files, so a lookup reads
few row groups, and no list ever grows with the corpus. Lists are made on demand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import all_grams, grams


def gram_rows(base: DataFrame, n_max: int, n_min: int = 1) -> DataFrame:
    """(g, id) of the distinct substrings of n_min to n_max characters of every row."""
    if n_min == 1:
        return base.select("id", F.explode(all_grams(F.col("s"), n_max)).alias("g")).select("g", "id")
    parts = F.array_distinct(F.flatten(F.array(*[grams(F.col("s"), n) for n in range(n_min, n_max + 1)])))
    return base.select("id", F.explode(parts).alias("g")).select("g", "id")


def gram_frequencies(postings: DataFrame) -> DataFrame:
    """(g, df): in how many rows each substring stands; at most 26 ** n_max rows."""
    return postings.groupBy("g").agg(F.count("*").alias("df"))


def counted_grams(base: DataFrame, n_max: int) -> DataFrame:
    """gram_frequencies(gram_rows(base, n_max)) without a row a gram and string: each task adds up its strings first.

    A gram of n characters is a number of 21 bits a character while it is counted, so n_max is at most 3.
    """
    if n_max > 3:
        raise ValueError("n_max is at most 3")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = [np.zeros(0, np.int64)] * n_max
        counts = [np.zeros(0, np.int64)] * n_max
        for b in batches:
            texts = [np.frombuffer(s.encode("utf-32-le"), "<u4").astype(np.int64) for s in b.column(0).to_pylist() if s]
            for n in range(1, n_max + 1):
                own = []
                for t in texts:
                    packed = sum(t[i : len(t) - n + 1 + i] << 21 * (n - 1 - i) for i in range(n)) if len(t) >= n else t[:0]
                    own.append(np.unique(packed))
                found, c = np.unique(np.concatenate([codes[n - 1], *own]), return_inverse=True)
                total = np.zeros(len(found), np.int64)
                np.add.at(total, c[: len(codes[n - 1])], counts[n - 1])
                total += np.bincount(c[len(codes[n - 1]) :], minlength=len(found))
                codes[n - 1], counts[n - 1] = found, total
        for n, (code, total) in enumerate(zip(codes, counts), 1):
            g = ["".join(chr(x >> 21 * (n - 1 - i) & 0x1FFFFF) for i in range(n)) for x in code.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array(total)], names=["g", "df"])

    return base.select("s").mapInArrow(run, "g string, df long").groupBy("g").agg(F.sum("df").alias("df"))


def posting_lists(postings: DataFrame) -> DataFrame:
    """(g, ids), ids ascending: for reports on small corpora."""
    return postings.groupBy("g").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def depth_statistics(base: DataFrame, n_max: int) -> DataFrame:
    """(n, n_substrings, median_df, avg_df): document frequency of the distinct substrings of n characters; n = 0 is the empty one."""
    counted = counted_grams(base, n_max) if n_max <= 3 else gram_frequencies(gram_rows(base, n_max))
    df = counted.select(F.length("g").cast("long").alias("n"), "df")
    empty = base.agg(F.count("*").alias("df")).select(F.lit(0).cast("long").alias("n"), "df")
    return df.unionAll(empty).groupBy("n").agg(F.count("*").alias("n_substrings"), F.median(F.col("df").cast("double")).alias("median_df"), F.avg("df").alias("avg_df"))


def total_ids(postings: DataFrame) -> DataFrame:
    return postings.agg(F.count("*").alias("total_ids"))


def pattern_keys(queries: DataFrame, n_max: int) -> DataFrame:
    """(qid, g): the substrings under which rows with a pattern must stand; none for an empty one."""
    n = F.length("p")
    keys = F.when(n <= n_max, F.array("p")).otherwise(F.array_distinct(grams(F.col("p"), n_max)))
    return queries.where(n > 0).select("qid", F.explode(keys).alias("g"))


def rarest(keys: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(qid, g, df): of each query's keys the one in the fewest rows; none if one is in no row."""
    counted = keys.join(frequencies, "g", "left").select("qid", "g", F.coalesce("df", F.lit(0)).alias("df"))
    first = F.row_number().over(Window.partitionBy("qid").orderBy("df", "g"))
    return counted.withColumn("r", first).where("r = 1 AND df > 0").drop("r")
