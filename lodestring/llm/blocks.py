"""Blocks of documents and the exchange between blocks and shards.

Operators that compare words or windows over a whole corpus don't shuffle them one by one. A
block holds some documents as one compressed row; each block sends every shard of the key
space one packed message, and every shard answers each block with one packed reply. Blocks
stand in a table bucketed by block, so a reply finds its block without moving the texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoded, note_staged, shared_path

BLOCK_SCHEMA = "block long, n_words long, docs binary"
BLOCK_BYTES = 64
#: ASCII white space, as a table by byte.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RNG = np.random.Generator(np.random.PCG64(20240229))
BYTE_KEY = _RNG.integers(1, 1 << 64, 256, dtype=np.uint64)
BYTE_KEY[IS_SPACE] = 0
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


FACTOR = np.uint64(0xD6E8FEB86659FD93)
INVERSE = np.uint64(pow(int(FACTOR), -1, 1 << 64))


def powers(x: np.uint64, n: int) -> np.ndarray:
    """x to the power of 0 to n - 1, modulo 2 ** 64."""
    out = np.full(n, x, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (splitmix64); salts give independent functions."""
    with np.errstate(over="ignore"):
        x = np.atleast_1d(x + (np.uint64(salt) + GOLDEN))
        for at in range(0, len(x), 1 << 13):  # some at a time stay in the cache
            part = x[at : at + (1 << 13)]
            part ^= part >> np.uint64(30)
            part *= np.uint64(0xBF58476D1CE4E5B9)
            part ^= part >> np.uint64(27)
            part *= np.uint64(0x94D049BB133111EB)
            part ^= part >> np.uint64(31)
        return x


class Words:
    """The words of some texts: byte bounds, document and 64-bit hash of each."""

    def __init__(self, texts: list[bytes]):
        self.data = b" ".join([b"", *texts, b""])
        b = np.frombuffer(self.data, np.uint8)
        space = IS_SPACE.take(b)
        edge = np.nonzero(space[1:] != space[:-1])[0] + 1  # a space stands first and last
        self.start, self.end = edge[0::2].copy(), edge[1::2].copy()
        size = np.array([len(t) for t in texts], np.int64) + 1
        self.doc_end = np.cumsum(size)  # position after each text, in data
        self.doc = np.searchsorted(self.doc_end, self.start, side="right")
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))  # first word of each text
        self.b = b

    def hashes(self) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, np.uint64)
        edge, at_once = np.append(self.start, len(self.b)), 1 << 13  # some words at a time stay in the cache
        bounds = edge[np.minimum(np.arange(0, len(edge) + at_once, at_once), len(edge) - 1)]
        power, inverse = (powers(x, int(np.diff(bounds).max())) for x in (FACTOR, INVERSE))
        h = np.empty(len(self.start), np.uint64)
        for at in range(0, len(h), at_once):
            own = edge[at : at + at_once + 1]
            first = own[:-1] - own[0]
            terms = BYTE_KEY.take(self.b[own[0] : own[-1]])
            terms *= power[: len(terms)]  # by place among these bytes, taken back for the whole word
            h[at : at + at_once] = np.add.reduceat(terms, first) * inverse.take(first)
        return mix(h + (self.end - self.start).astype(np.uint64))


def count_words(text: bytes) -> int:
    """Words of a text, for closing blocks and for the sizes that follow from their number."""
    if len(text) < 4096:
        return len(text.split())
    inside = ~IS_SPACE[np.frombuffer(text, np.uint8)]
    return int(inside[0]) + int(np.count_nonzero(inside[1:] & ~inside[:-1]))


def write_blocks(df: DataFrame, id_col: str, text_col: str, words: int = 400_000) -> DataFrame:
    """Writes df in blocks of about so many words, documents in order of id in each.

    A block is also closed at BLOCK_BYTES of a document's columns for each word it may hold.

    The table is bucketed by block in the shared folder. Its rows hold all of df's columns;
    the id is the first and the text the second column of a block's batch.
    """
    spark = df.sparkSession
    kept = df.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`"), *[F.col(f"`{c}`") for c in df.columns if c not in (id_col, text_col)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq, held, size, weight = TaskContext.get().partitionId(), 0, [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, size
            table = pa.Table.from_batches(held).combine_chunks()
            table = table.take(pa.compute.sort_indices(table, sort_keys=[(table.column_names[0], "ascending")], null_placement="at_start"))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=None)) as w:
                w.write_table(table)
            packed = zstandard.ZstdCompressor(level=5).compress(memoryview(sink.getvalue()))
            row = pa.RecordBatch.from_arrays([pa.array([task << 32 | seq]), pa.array([size]), pa.array([packed], pa.binary())], names=["block", "n_words", "docs"])
            held.clear()
            seq, size = seq + 1, 0
            return row

        import pyarrow.compute  # noqa: F401

        for whole in batches:
            start, n = 0, 0
            row_bytes = whole.nbytes // max(1, whole.num_rows)  # of columns that aren't the text, about
            for i, t in enumerate(whole.column(1)):
                text = encoded(t.as_py())
                n += count_words(text)
                weight += len(text) + row_bytes
                if size + n >= words or weight >= BLOCK_BYTES * words:
                    held.append(whole.slice(start, i + 1 - start))
                    size += n
                    yield flush()
                    start, n, weight = i + 1, 0, 0
            if start < whole.num_rows:
                held.append(whole.slice(start))
                size += n
        if held:
            yield flush()

    name = f"blocks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = kept.mapInArrow(run, BLOCK_SCHEMA)
    path = shared_path(spark, name)
    note_staged(path, name)
    rows.write.bucketBy(buckets, "block").option("path", path).saveAsTable(name)
    return spark.table(name)


def open_block(packed: bytes) -> pa.Table:
    """The documents of a block, in order of id, nulls first."""
    return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(packed)).read_all()


def ids_of(table: pa.Table) -> np.ndarray:
    """The ids of a block; a null counts as the smallest number."""
    return table.column(0).fill_null(-(1 << 63)).to_numpy().astype(np.int64)


def texts_of(table: pa.Table) -> list[bytes]:
    return [encoded(t) for t in table.column(1).to_pylist()]


def with_replies(blocks: DataFrame, replies: list[DataFrame] = ()) -> DataFrame:
    """The blocks, each with its replies as one list a DataFrame of replies."""
    joined = blocks
    for i, r in enumerate(replies):
        mine = r.groupBy("block").agg(F.collect_list(F.struct("kind", "shard", "packed")).alias(f"reply{i}"))  # one a shard and kind
        joined = joined.join(mine.hint("shuffle_hash"), "block", "left")
    return joined.select("block", "n_words", "docs", *[f"reply{i}" for i in range(len(replies))])


def each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(block, table, *replies) of the rows of with_replies(); a reply is a dict from (kind, shard) to bytes."""
    for batch in batches:
        for i in range(batch.num_rows):
            got = [{(x["kind"], x["shard"]): x["packed"] for x in batch.column(k)[i].as_py() or ()} for k in range(3, batch.num_columns)]
            yield batch.column(0)[i].as_py(), open_block(batch.column(2)[i].as_py()), *got


def per_block(blocks: DataFrame, work: Callable[..., pa.RecordBatch | None], schema: str, replies: list[DataFrame] = ()) -> DataFrame:
    """work(block, table, *replies) for every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in each_block(batches):
            made = work(*block)
            if made is not None:
                yield from made if isinstance(made, list) else [made]

    return with_replies(blocks, replies).mapInArrow(run, schema)


MESSAGE = "block long, kind int, shard int, packed binary"


def message_batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["block", "kind", "shard", "packed"])


def per_shard(messages: DataFrame, work: Callable[[int, int, list[int], list[bytes]], list[tuple]]) -> DataFrame:
    """work(kind, shard, blocks, packed) for every kind and shard gives rows like messages."""

    def run(table: pa.Table) -> pa.Table:
        kind, shard = table.column("kind")[0].as_py(), table.column("shard")[0].as_py()
        rows = work(kind, shard, table.column("block").to_pylist(), table.column("packed").to_pylist())
        return pa.Table.from_batches([message_batch(rows)])

    return messages.groupBy("kind", "shard").applyInArrow(run, MESSAGE)


def squeeze(*arrays: np.ndarray) -> bytes:
    """Columns of numbers, byte planes apart, compressed."""
    parts = []
    for a in arrays:
        whole = np.ascontiguousarray(a).view(f"<u{a.dtype.itemsize}")
        parts += [(whole >> whole.dtype.type(8 * k)).astype(np.uint8).tobytes() for k in range(a.dtype.itemsize)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unsqueeze(packed: bytes, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8)
    sizes = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(raw) // sum(sizes), 0, []
    for k, s in zip(kinds, sizes, strict=True):
        whole = np.empty((n, s), np.uint8)
        for i in range(s):
            whole[:, i] = raw[at : at + n]
            at += n
        out.append(whole.view(k).reshape(n))
    return out


def shares(values: np.ndarray, shards: int, bits: int) -> list[tuple[int, int, int]]:
    """(shard, start, end) of each shard that has some of these ascending unsigned values of so many bits."""
    if not len(values):
        return []
    if shards == 1:
        return [(0, 0, len(values))]
    own, start = np.unique(values >> np.uint64(bits - (shards.bit_length() - 1)), return_index=True)
    return list(zip(own.tolist(), start.tolist(), [*start[1:].tolist(), len(values)]))


def order_of(values: np.ndarray) -> np.ndarray:
    """The stable ascending order of unsigned 64-bit values: they are sorted with their places in the low bits."""
    low, width = len(values).bit_length(), int(values.max(initial=0)).bit_length()
    drop = np.uint64(max(0, width + low - 64))  # bits of the values that don't fit beside the place
    key = values >> drop << np.uint64(low) | np.arange(len(values), dtype=np.uint64)
    key.sort()
    order = (key & np.uint64((1 << low) - 1)).view(np.int64)
    if drop:
        found = values[order]
        late = np.nonzero(found[1:] < found[:-1])[0]
        if len(late):  # values that differ in those bits alone
            rest = found >> drop
            run = np.concatenate(([0], np.cumsum(rest[1:] != rest[:-1])))
            mixed = np.zeros(run[-1] + 1, bool)
            mixed[run[late]] = True
            at = np.nonzero(mixed[run])[0]
            order[at] = order[at[np.argsort(found[at], kind="stable")]]
    return order


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ascending distinct values, which of them each one is) of unsigned 64-bit values."""
    order = order_of(values)
    found = values[order]
    new = np.ones(len(values), bool)
    np.not_equal(found[1:], found[:-1], out=new[1:])
    back = np.empty(len(values), np.int64)
    back[order] = np.cumsum(new) - 1
    return found[new], back


def shard_count(entries: int, each: int) -> int:
    """A power of two of shards with about so many entries each."""
    return 1 << max(0, (max(1, entries) - 1) // each).bit_length()
