"""Packing by power-of-two decomposition.

A document of n ids becomes its whole multiples of the longest sequence and then one piece
for each binary digit of what is left, longest first. Every piece is a sequence of its own,
so no sequence crosses documents, every length is a power of two and nothing is padded.
Sequences of one length stand together: ids of sequences run through the bucket of the
longest length first.

Cases: a null or empty text has its end id alone; a null doc_id stays null; repeated rows are
packed once each; a text of any length is cut whole; other columns aren't read; an empty
table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, slices_by_bytes, stage
from .tokens import encoder


def binary_lengths(n: int, longest: int) -> list[int]:
    """Powers of two that add up to n, none above longest, descending."""
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << b for b in reversed(range(longest.bit_length() - 1)) if rest >> b & 1]


def pack(df: DataFrame, path: str, longest: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and,
    with_ids, the piece's ids as little-endian unsigned 32-bit bytes.

    Pieces are written to the shared folder once. Their sequence ids are a prefix sum over
    the few counts (length, writing task), so the pieces themselves are never shuffled.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("the longest sequence must be a power of two")
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, task int, nth long" + (", ids binary" if with_ids else "")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, seen = encoder(path), TaskContext.get().partitionId(), Counter()
        for whole in batches:
            for batch in slices_by_bytes(whole, 1):
                rows, start, length, crc, total, nth, ids = [], [], [], [], [], [], []
                for row, data in enumerate(enc.packed(batch.column(1))):
                    data += end
                    s, n = 0, len(data) // 4
                    for size in binary_lengths(n, longest):
                        piece = data[4 * s : 4 * (s + size)]
                        rows.append(row)
                        start.append(s)
                        length.append(size)
                        crc.append(zlib.crc32(piece))
                        total.append(n)
                        nth.append(seen[size])
                        seen[size] += 1
                        if with_ids:
                            ids.append(piece)
                        s += size
                columns = [batch.column(0).take(pa.array(rows, pa.int32())), *[pa.array(x, pa.int64()) for x in (start, length, crc, total)], pa.array([task] * len(rows), pa.int32()), pa.array(nth, pa.int64())]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "nth"]
                if with_ids:
                    columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    pieces = stage(pick(df, id_col, text_col).mapInArrow(run, schema), "pieces")
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    totals = counts.groupBy("length").agg(F.sum("n").alias("total"))
    by_length = Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)  # a row a power of two
    base = totals.select("length", F.coalesce(F.sum("total").over(by_length), F.lit(0)).alias("base"))
    in_bucket = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.withColumn("before", F.coalesce(F.sum("n").over(in_bucket), F.lit(0))).join(base, "length").select("length", "task", (F.col("base") + F.col("before")).alias("first"))
    named = pieces.join(first, ["length", "task"])
    return named.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *(["ids"] if with_ids else []))
