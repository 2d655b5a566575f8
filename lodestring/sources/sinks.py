"""Sinks: ground truth as text, statistics as CSV, tables with a rebuild or skip contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def result_lists(results: DataFrame) -> DataFrame:
    """(qid, ids) with the ids of results (qid, rank, id) nearest first; k bounds a list."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", "id")))
    return results.groupBy("qid").agg(F.transform(ordered, lambda x: x["id"]).alias("ids"))


def write_ground_truth(results: DataFrame, queries: DataFrame, path: str) -> None:
    """A line a query, in order of qid: its ids apart by spaces, blank without match."""
    lists = queries.select("qid").join(result_lists(results), "qid", "left")
    line = F.coalesce(F.array_join(F.col("ids").cast("array<string>"), " "), F.lit(""))
    lists.orderBy("qid").coalesce(1).select(line.alias("value")).write.mode("overwrite").text(path)


def write_statistics(stats: DataFrame, path: str) -> None:
    """ef_search, time_us, recall and exact, a row an operating point."""
    stats.select("ef_search", "time_us", "recall", "exact").coalesce(1).orderBy("ef_search").write.mode("overwrite").option("header", True).csv(path)


def publish_table(df: DataFrame, path: str, rebuild: bool = False) -> None:
    """Writes df; an existing table is replaced with rebuild and left alone without."""
    df.write.mode("overwrite" if rebuild else "ignore").parquet(path)
