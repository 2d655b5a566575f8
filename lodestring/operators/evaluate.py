"""Recall, operating points, curves, timing."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..plans.storage import checkpointed, stored_bytes


def recall(results: DataFrame, truth: DataFrame) -> DataFrame:
    """(recall): over queries with any true row, the mean share of it that was found; null without such queries."""
    sizes = truth.groupBy("qid").agg(F.count("*").alias("n"))
    hits = results.join(truth.select("qid", "id"), ["qid", "id"], "left_semi").groupBy("qid").agg(F.count("*").alias("hit"))
    return sizes.join(hits, "qid", "left").agg(F.avg(F.coalesce("hit", F.lit(0)) / F.col("n")).alias("recall"))


def best_point(stats: DataFrame) -> DataFrame:
    """The operating point with the largest recall, and of those the least time."""
    return stats.agg(F.max_by(F.struct(*stats.columns), F.struct("recall", -F.col("time_us"))).alias("x")).select("x.*")


def with_qps(stats: DataFrame) -> DataFrame:
    return stats.where("time_us > 0").withColumn("qps", 1e6 / F.col("time_us"))


def timed(query: Callable[[], DataFrame], n_queries: int) -> tuple[list, float]:
    """The rows of a query batch, and its mean time a query in microseconds."""
    begun = time.perf_counter()
    rows = query().collect()
    return rows, (time.perf_counter() - begun) * 1e6 / max(1, n_queries)


def clean_curve(points: list[tuple[float, float]], gain: float = 0.01, least: float = 0.1) -> list[tuple[float, float]]:
    """(recall, qps) points of a sweep, in its order, without those that show nothing.

    A point takes the place of the last one kept if it is at least as fast, and goes if it gains
    no more recall than `gain` over it. Then those of recall `least` or less go; sorted by recall.
    """
    kept: list[tuple[float, float]] = []
    for recall_, qps in points:
        if kept and qps >= kept[-1][1]:
            kept[-1] = (recall_, qps)
        elif not kept or recall_ > kept[-1][0] + gain:
            kept.append((recall_, qps))
    return sorted(p for p in kept if p[0] > least)


def clip_curve(points: list[tuple[float, float]], least: float) -> list[tuple[float, float]]:
    """Points of recall `least` or more, or the better half if those are fewer."""
    kept = [p for p in points if p[0] >= least]
    half = len(points) // 2
    return kept if len(kept) >= half or not kept else sorted(points)[-half:]


def growth(base: DataFrame, kinds: dict[str, Callable[[DataFrame], object]], folder: str, percents: tuple[int, ...] = (10, 25, 50, 75, 100)) -> DataFrame:
    """(kind, percent, rows, string_chars, build_us, bytes): size and build time of indexes over growing shares of the rows.

    kinds gives a builder a name; what it builds must have save(path). Rows and letters are
    observed while the share is written, so no pass is made for them. A share holds the rows
    whose id's hash is below it, so each holds those of the smaller ones.
    """
    spark, out = base.sparkSession, []
    for percent in percents:
        seen = Observation()
        share = base.where(F.pmod(F.xxhash64("id"), F.lit(100)) < percent).observe(seen, F.count("*").alias("rows"), F.coalesce(F.sum(F.length("s")), F.lit(0)).alias("chars"))
        rows = checkpointed(spark, share)
        for name, build in kinds.items():
            path = f"{folder}/{name}-{percent}"
            begun = time.perf_counter()
            build(rows).save(path)
            out.append((name, percent, seen.get["rows"], seen.get["chars"], (time.perf_counter() - begun) * 1e6, stored_bytes(spark, path)))
    return spark.createDataFrame(out, "kind string, percent int, rows long, string_chars long, build_us double, bytes long")
