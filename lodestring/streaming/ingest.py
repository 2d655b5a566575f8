"""Structured Streaming into a saved index: each micro-batch is an append."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.index import GramIndex


def append_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that appends a stream of (id, s, v) to the index saved at path.

    A batch that is delivered again after a failure is recognised by its ids and adds nothing
    twice; one that died half-way is added whole, as base is written last.
    """

    def put(batch: DataFrame, _: int) -> None:
        index = GramIndex.load(batch.sparkSession, path)
        low, high = batch.agg(F.min("id"), F.max("id")).first()
        if low is None:
            return
        known = index.base.where(F.col("id").between(low, high)).select("id")  # files of other ids aren't read
        new = batch.join(known, "id", "left_anti").select("id", "s", "v")
        index.save_append(path, new)

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
