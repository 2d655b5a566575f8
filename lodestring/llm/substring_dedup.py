"""Substring dedup with a count-min prefilter.

A window is WINDOW consecutive words of one document. Pass one builds a count-min sketch of
all windows: every block sends, for each of the sketch's rows, the cells that its windows
fall in; the shards of a row merge the blocks' cells and answer which have two windows or
more. Its width follows the number of windows. Cells only ever overestimate, so every
repeated window is found. Pass two groups the windows estimated repeated, and only those, by
a 128-bit hash of their words, and finds each group's first place. Words under a window
that also starts earlier are removed.

Cases: a null text has no words; a null doc_id comes before all others; rows with one doc_id
hold places of the same document, so of equal places none is earlier than the other, and
copies of a row keep and lose the same words; texts under WINDOW words lose nothing; an empty
table gives no rows.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import MESSAGE, Words, ids_of, message_batch, mix, per_block, per_shard, shard_count, shares, squeeze, texts_of, unsqueeze, write_blocks
from .common import stage

WINDOW = 20
ROWS = 2
CELLS_PER_WINDOW = 8
SHARD_ENTRIES = 1 << 21
SALTS = (0x51ED270B, 0x2545F491)


def window_hashes(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, high hash, low hash) of every window."""
    h, n = words.hashes(), len(words.start) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    at = np.nonzero(words.doc[:n] == words.doc[WINDOW - 1 :])[0]
    out = []
    for salt in SALTS:
        g, acc = mix(h, salt), np.zeros(n, np.uint64)
        for k in range(WINDOW):
            acc *= np.uint64(0xF1357AEA2E62A9C5)
            acc += g[k : k + n]
        out.append(mix(acc[at], salt))
    return at, *out


def cells(high: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix(high, 0xA5A5 + 977 * row) >> np.uint64(64 - bits)


class Sketch:
    """The cells of one block in one row of the sketch: ascending, each once."""

    def __init__(self, high: np.ndarray, row: int, bits: int):
        self.cell, self.back, self.count = np.unique(cells(high, row, bits), return_inverse=True, return_counts=True)

    def estimated_repeated(self, replies: dict, row: int, shards: int, bits: int) -> np.ndarray:
        """By window: whether this row counts two or more in its cell."""
        often = self.count > 1
        for s, a, b in shares(self.cell, shards, bits):
            often[a:b] |= np.unpackbits(np.frombuffer(replies[row, s], np.uint8), count=b - a).astype(bool)
        return often[self.back]


def merge_cells(kind: int, shard: int, blocks: list[int], packed: list[bytes]) -> list[tuple]:
    """A shard of a sketch row: which cells of each block other blocks have too."""
    parts = [np.cumsum(unsqueeze(p, "<u4")[0].astype(np.uint64)) for p in packed]
    flat = np.concatenate(parts)
    _, back, count = np.unique(flat, return_inverse=True, return_counts=True)
    often, rows, at = count[back] > 1, [], 0
    for block, p in zip(blocks, parts, strict=True):
        rows.append((block, kind, shard, np.packbits(often[at : at + len(p)]).tobytes()))
        at += len(p)
    return rows


class Candidates:
    """The windows of a block that are estimated repeated, and the first place of each in it."""

    def __init__(self, table: pa.Table, sketch_replies: dict, shards: int, bits: int):
        self.ids = ids_of(table)
        self.words = Words(texts_of(table))
        at, high, low = window_hashes(self.words)
        keep = np.ones(len(at), bool)
        for row in range(ROWS):
            if len(at):
                keep &= Sketch(high, row, bits).estimated_repeated(sketch_replies, row, shards, bits)
        self.at, self.high, self.low = at[keep], high[keep], low[keep]
        doc = self.words.doc[self.at]
        self.doc_id, self.place = self.ids[doc], self.at - self.words.first[doc]
        order = np.lexsort((self.place, self.doc_id, self.low, self.high))
        new = np.ones(len(order), bool)
        if len(order):
            h, w = self.high[order], self.low[order]
            new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
        self.first = order[new]  # by group, ascending hashes
        self.group = np.zeros(len(order), np.int64)
        self.group[order] = np.cumsum(new) - 1


def merge_places(kind: int, shard: int, blocks: list[int], packed: list[bytes]) -> list[tuple]:
    """A shard of the exact groups: which of the blocks' first places is the first of all."""
    cols = [unsqueeze(p, "<u8", "<u8", "<i8", "<i4") for p in packed]
    high, low, doc, place = (np.concatenate(x) for x in zip(*cols, strict=True))
    order = np.lexsort((place, doc, low, high))
    h, w, d, p = high[order], low[order], doc[order], place[order]
    new = np.ones(len(order), bool)
    new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    lead = np.nonzero(new)[0][np.cumsum(new) - 1]
    is_first = np.zeros(len(order), bool)
    is_first[order] = (d == d[lead]) & (p == p[lead])
    rows, at = [], 0
    for block, c in zip(blocks, cols, strict=True):
        rows.append((block, kind, shard, np.packbits(is_first[at : at + len(c[0])]).tobytes()))
        at += len(c[0])
    return rows


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = 400_000) -> DataFrame:
    """df with n_words, n_removed and kept_text (the words left, joined by one space).

    Input columns with those names are replaced; the id and text columns come first.
    """
    new = ("n_words", "n_removed", "kept_text")
    df = df.drop(*[c for c in df.columns if c.lower() in new and c not in (id_col, text_col)])
    blocks = write_blocks(df, id_col, text_col, block_words)
    total = blocks.agg(F.sum("n_words")).first()[0] or 0
    bits = min(60, max(12, int(CELLS_PER_WINDOW * max(total, 1) - 1).bit_length()))
    shards = min(shard_count(total, SHARD_ENTRIES), 1 << (bits - 8))
    bits = min(bits, 31 + shards.bit_length() - 1)  # a shard's cells fit in 32 bits

    def sketch(block: int, table: pa.Table) -> pa.RecordBatch:
        _, high, _ = window_hashes(Words(texts_of(table)))
        rows = []
        for row in range(ROWS):
            cell = np.unique(cells(high, row, bits))
            for s, a, b in shares(cell, shards, bits):
                base = np.uint64(s << (bits - (shards.bit_length() - 1)))
                rows.append((block, row, s, squeeze(np.diff(cell[a:b], prepend=base).astype("<u4"))))
        return message_batch(rows)

    repeated_cells = stage(per_shard(per_block(blocks, sketch, MESSAGE), merge_cells), "cells")

    def places(block: int, table: pa.Table, cell_replies: dict) -> pa.RecordBatch:
        c = Candidates(table, cell_replies, shards, bits)
        f = c.first
        rows = []
        for s, a, b in shares(c.high[f], shards, 64):
            g = f[a:b]
            rows.append((block, 0, s, squeeze(c.high[g].astype("<u8"), c.low[g].astype("<u8"), c.doc_id[g].astype("<i8"), c.place[g].astype("<i4"))))
        return message_batch(rows)

    firsts = per_shard(per_block(blocks, places, MESSAGE, [repeated_cells]), merge_places)
    head = df.schema.fields
    by_name = {f.name: f.dataType.simpleString() for f in head}
    names = [id_col, text_col, *[f.name for f in head if f.name not in (id_col, text_col)]]
    schema = ", ".join([f"`{id_col}` long", *[f"`{n}` {by_name[n]}" for n in names[1:]], "n_words long", "n_removed long", "kept_text string"])

    def remove(block: int, table: pa.Table, cell_replies: dict, first_replies: dict) -> list[pa.RecordBatch]:
        c = Candidates(table, cell_replies, shards, bits)
        f = c.first
        lead = np.ones(len(f), bool)
        for s, a, b in shares(c.high[f], shards, 64):
            lead[a:b] = np.unpackbits(np.frombuffer(first_replies[0, s], np.uint8), count=b - a).astype(bool)
        own = f[c.group]
        later = (c.doc_id > c.doc_id[own]) | (c.place > c.place[own])
        gone = c.at[later | ~lead[c.group]]
        words = c.words
        edge = np.zeros(len(words.start) + 1, np.int32)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + WINDOW, -1)
        removed = np.cumsum(edge)[:-1] > 0
        kept_text, n_removed = [], []
        n_words = np.diff(words.first)
        bytes_of, ends = words.data, words.doc_end.tolist()
        for d in range(table.num_rows):
            a, b = words.first[d], words.first[d + 1]
            out = removed[a:b]
            k = int(out.sum())
            own_words = bytes_of[ends[d - 1] if d else 0 : ends[d]].split()
            kept_text.append((b" ".join(compress(own_words, (~out).tolist())) if k else b" ".join(own_words)).decode("utf-8", "surrogatepass"))
            n_removed.append(k)
        whole = table.append_column("n_words", pa.array(n_words, pa.int64())).append_column("n_removed", pa.array(n_removed, pa.int64())).append_column("kept_text", pa.array(kept_text, pa.string()))
        return whole.rename_columns([*names, *new]).combine_chunks().to_batches(max_chunksize=1024)

    return per_block(blocks, remove, schema, [repeated_cells, firsts])
