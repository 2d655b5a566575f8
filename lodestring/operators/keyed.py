"""Searches by exact keys: rows with the keys that they hold meet queries with one key each.

A row's keys stand in a list beside its vector, and queries are shipped to the rows, so pairs of
rows and queries are made in tasks alone and only each task's k nearest leave it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.storage import checkpointed
from .search import RESULT, Asked, nearest_hits, portions_of, top_k


def topk_by_keys(rows: DataFrame, queries: DataFrame, most: int, sure: int | None = None) -> DataFrame:
    """(qid, rank, id, dist) of the rows (id, v, keys) that hold each query's key g, and its pattern.

    sure: the length of patterns that are keys themselves; rows need s for longer ones. None: all are.
    """
    out = rows.sparkSession.createDataFrame([], RESULT)
    for portion in portions_of(queries, 32 * most):
        asked = AskedByKey(portion)
        if len(asked):
            keyed = np.array([sure is None or len(p) <= sure for p in asked.patterns], bool)
            out = out.unionAll(top_k(nearest_hits(rows, asked, ("keys",), asked.rule(rows.sparkSession), keyed), F.col("k"), most))
    return out


def rows_of_keys(entries: DataFrame, needed: DataFrame, base: DataFrame, small: bool) -> DataFrame:
    """base with the needed keys (g) that each row holds by entries (g, id); rows without any go. small: needed is copied to the tasks."""
    spark = base.sparkSession
    listed = checkpointed(spark, needed.select("g", (F.row_number().over(Window.orderBy("g")) - 1).cast("int").alias("key")))  # the keys of queries
    met = entries.join(F.broadcast(listed) if small else listed, "g").select("id", "key")
    names = listed.agg(F.array_sort(F.collect_list(F.struct("key", "g")))["g"].alias("names"))
    held = grouped(met).join(F.broadcast(names))  # one row
    return base.join(held.select("id", F.transform("keys", lambda i: F.get("names", i)).alias("keys")), "id")


class AskedByKey(Asked):
    """Queries with the key of each."""

    def fill(self, rows: list) -> None:
        super().fill(rows)
        self.keys, self.key_of = np.unique(np.array([r.g for r in rows], object), return_inverse=True) if rows else ([], np.zeros(0, np.int64))

    def rule(self, spark: SparkSession) -> Callable:
        """For nearest_hits(): the pairs of rows and queries whose key the row holds."""
        shipped = spark.sparkContext.broadcast((list(self.keys), self.key_of))

        def allowed() -> Callable:
            keys, key_of = shipped.value
            known = pa.array(keys, pa.string())

            def met(rows: pa.RecordBatch) -> Callable:
                listed = rows.column("keys")
                key = pc.index_in(listed.flatten(), value_set=known).to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(rows.num_rows), pc.list_value_length(listed).to_numpy())
                kept = ~np.isnan(key)
                key, row = key[kept].astype(np.int64), row[kept]

                def of(part: slice) -> np.ndarray:
                    own, at = np.unique(key_of[part], return_inverse=True)
                    place = np.full(len(keys), -1)
                    place[own] = np.arange(len(own))
                    holds, held = np.zeros((len(own), rows.num_rows), bool), place[key]
                    holds[held[held >= 0], row[held >= 0]] = True
                    return holds[at]

                return of

            return met

        return allowed


def grouped(met: DataFrame) -> DataFrame:
    """(id, keys) from (id, key): a row's keys, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in chain(batches, [None]):
            ids, keys = (b.column(c).to_numpy() for c in ("id", "key")) if b is not None else (np.zeros(0, np.int64), np.zeros(0, np.int32))
            if held is not None:
                ids, keys = np.concatenate([held[0], ids]), np.concatenate([held[1], keys])
            if not len(ids):
                continue
            whole = len(ids) if b is None else int(np.searchsorted(ids, ids[-1]))  # the last row's may go on
            held = (ids[whole:], keys[whole:])
            ids, keys = ids[:whole], keys[:whole]
            if whole:
                once = np.concatenate(([True], (ids[1:] != ids[:-1]) | (keys[1:] != keys[:-1])))
                ids, keys = ids[once], keys[once]
                first = np.concatenate(([0], np.nonzero(ids[1:] != ids[:-1])[0] + 1))
                edges = pa.array(np.append(first, len(ids)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(ids[first]), pa.ListArray.from_arrays(edges, pa.array(keys))], names=["id", "keys"])

    return met.repartition("id").sortWithinPartitions("id", "key").mapInArrow(run, "id long, keys array<int>")
