"""Files of token ids in Simple-8b word-aligned coding.

A file row is one block of whole documents: 64-bit little-endian words, each a 4-bit
selector over 60 bits of payload. A selector says how many ids of which width the word
holds. An id too wide for the widest entry of the table is an escape: the selector ESCAPE
and the position of the id in the block's list of escapes. doc_ids and doc_tokens give each
document's offset in the block, so a block decodes by itself, vectorised by selector.

Rows stand in ascending doc_id: range partitions (shards) in order, blocks in order inside.

Cases: null and empty texts hold the end id alone; a null doc_id comes before all others;
rows with one doc_id stand in the order of a hash of their ids; a text of any length is
encoded whole and stands in one block; other columns aren't read; an empty table gives no
documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pick, shared_path, slices_by_bytes, stage
from .tokens import encoder

PAYLOAD = 60
#: Fixed values of the coding: how many ids a word of each selector holds; widths follow as PAYLOAD // count.
COUNTS = [240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2]
WIDTHS = [0, 0, *[PAYLOAD // c for c in COUNTS[2:]]]
ESCAPE = 15
BLOCK_IDS = 1 << 17
FILE_SCHEMA = "shard int, block int, first long, n_ids long, words binary, escapes binary, doc_ids array<bigint>, doc_tokens array<bigint>"


def encode_words(ids: np.ndarray) -> tuple[bytes, bytes]:
    """Words and escapes of unsigned ids; zeros alone use the two selectors of width 0."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return b"", b""
    value = ids
    need = np.frexp(ids.astype(np.float64))[1].astype(np.uint8)  # bits, or one more for ids over 2 ** 53
    selector = np.full(n, ESCAPE, np.uint8)
    wide = need > WIDTHS[-1]
    # most[c][i]: the widest of the c ids from i, by doubling
    most = {1: need}
    for s in reversed(range(len(COUNTS))):  # the fewest ids a word first: the last that fits stays
        count, width = COUNTS[s], WIDTHS[s]
        if count > n or not (need <= width).any():
            break
        half = max(c for c in most if c < count)
        while 2 * half < count:
            most[2 * half] = np.maximum(most[half][:-half], most[half][half:])
            half *= 2
        most[count] = np.maximum(most[half][: n - count + 1], most[half][count - half : count - half + n - count + 1])
        selector[: n - count + 1][most[count] <= width] = s
    step = np.array([*COUNTS, 1], np.int64)
    jump = step[selector].tolist()
    # an id that no word of two takes goes alone
    lone = (selector == ESCAPE) & ~wide
    starts, at = [], 0
    append = starts.append
    while at < n:
        append(at)
        at += jump[at]
    starts = np.array(starts, np.int64)
    chosen = selector[starts]
    words = chosen.astype(np.uint64) << np.uint64(PAYLOAD)
    for s in np.unique(chosen).tolist():
        rows = np.nonzero(chosen == s)[0]
        if s == ESCAPE:
            continue
        for k in range(COUNTS[s] if WIDTHS[s] else 0):
            words[rows] |= value[starts[rows] + k] << np.uint64(k * WIDTHS[s])
    rows = np.nonzero(chosen == ESCAPE)[0]
    alone = lone[starts[rows]]
    # payload of an escape word: the id itself with a low 1 bit if it fits, else its position with a low 0 bit
    escaped = value[starts[rows[~alone]]]
    words[rows[alone]] |= value[starts[rows[alone]]] << np.uint64(1) | np.uint64(1)
    words[rows[~alone]] |= np.arange(len(escaped), dtype=np.uint64) << np.uint64(1)
    return words.astype("<u8").tobytes(), escaped.astype("<u8").tobytes()


def decode_words(words: bytes, escapes: bytes) -> np.ndarray:
    w, out_of = np.frombuffer(words, "<u8"), np.frombuffer(escapes, "<u8")
    chosen = (w >> np.uint64(PAYLOAD)).astype(np.int64)
    count = np.array([*COUNTS, 1], np.int64)[chosen]
    starts = np.cumsum(count) - count
    ids = np.zeros(int(count.sum()), np.uint64)
    for s in np.unique(chosen).tolist():
        rows = chosen == s
        payload, at = w[rows] & np.uint64((1 << PAYLOAD) - 1), starts[rows]
        if s == ESCAPE:
            inline = payload & np.uint64(1) == 1
            ids[at[inline]] = payload[inline] >> np.uint64(1)
            ids[at[~inline]] = out_of[(payload[~inline] >> np.uint64(1)).astype(np.int64)]
            continue
        for k in range(COUNTS[s] if WIDTHS[s] else 0):
            ids[at + k] = payload >> np.uint64(k * WIDTHS[s]) & np.uint64((1 << WIDTHS[s]) - 1)
    return ids


def encoded_ids(df: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, h, ids) of every text: its ids and end_id as bytes, in 16 bits each where all fit, and a hash of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        kind = "<u2" if enc.narrow and end_id < 1 << 16 else "<u4"
        end = np.array([end_id], kind).tobytes()
        for whole in batches:
            for batch in slices_by_bytes(whole, 1):
                ids, ends = enc.encode(batch.column(1))
                data, cut = ids.astype(kind).tobytes(), (ends * int(kind[-1])).tolist()
                rows = [data[a:z] + end for a, z in zip([0, *cut[:-1]], cut, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([int(kind[-1])] * len(rows), pa.int32()), pa.array(rows, pa.binary())], names=["doc_id", "width", "ids"])

    docs = pick(df, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(run, "doc_id long, width int, ids binary").withColumn("h", F.xxhash64("ids"))


def write_ids(df: DataFrame, path: str, folder: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of every text, each document followed by end_id, in ascending doc_id.

    Texts are encoded where they stand; the ids are written once, so that finding the ranges
    and sorting into them reads and shuffles ids alone. Rows with one doc_id are spread by a
    hash of their ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        data, doc_ids, doc_tokens, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal block, first, held
            words, escapes = encode_words(np.concatenate(data))
            row = {"shard": shard, "block": block, "first": first, "n_ids": held, "words": words, "escapes": escapes, "doc_ids": doc_ids.copy(), "doc_tokens": doc_tokens.copy()}
            block, first, held = block + 1, first + held, 0
            for x in (data, doc_ids, doc_tokens):
                x.clear()
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types, strict=True)], names=list(row))

        for batch in batches:
            for doc, width, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data.append(np.frombuffer(ids, f"<u{width}"))
                doc_ids.append(doc)
                doc_tokens.append(len(data[-1]))
                held += doc_tokens[-1]
                if held >= BLOCK_IDS:
                    yield flush()
        if doc_ids:
            yield flush()

    ids = stage(encoded_ids(df, path, end_id, id_col, text_col), "ids")
    ordered = ids.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "width", "ids")
    ordered.mapInArrow(run, FILE_SCHEMA).write.option("compression", "zstd").parquet(folder)


def read_ids(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """One row a document of the files: doc_id, start, n_tokens, ids_crc32 and, with_ids, ids."""
    files = spark.read.schema(FILE_SCHEMA).parquet(folder)
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("ids_in_shard"))  # a row a shard
    base = totals.select("shard", F.coalesce(F.sum("ids_in_shard").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in ("shard", "first", "words", "escapes", "doc_ids", "doc_tokens")}
                ids = decode_words(row["words"], row["escapes"])
                raw = ids.astype("<u4").tobytes()
                n = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(n)
                crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), row["doc_tokens"], strict=True)]
                columns = [pa.array([row["shard"]] * len(n), pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(row["first"] + ends - n), pa.array(n), pa.array(crc, pa.int64())]
                names = ["shard", "doc_id", "local", "n_tokens", "ids_crc32"]
                if with_ids:
                    offsets = pa.array(np.concatenate(([0], ends)), pa.int32())
                    columns, names = [*columns, pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int64)))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    docs = files.mapInArrow(run, "shard int, doc_id long, local long, n_tokens long, ids_crc32 long" + (", ids array<bigint>" if with_ids else ""))
    return docs.join(base, "shard").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def store_and_read(df: DataFrame, path: str, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    folder = shared_path(df.sparkSession, "token-files")
    write_ids(df, path, folder, end_id)
    return read_ids(df.sparkSession, folder, with_ids)
