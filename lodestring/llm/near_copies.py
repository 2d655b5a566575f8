"""Near copies by SimHash, with an exact check by the Jaccard similarity of word shingles.

Two texts are near copies where their sets of SHINGLE words in a row (A–Z lower-cased) have a
Jaccard similarity of SHARE or more; a text of fewer words has one shingle, all of it.
Shingles are compared by 64-bit hashes. Texts with equal sets are one class.

Candidates are found by SimHash, as simhash does: fingerprints at DISTANCE bits or fewer meet
under keys of bands, and pivot distance tables discard pairs. Its 4 bits of 64 hold texts that
are nearly equal, and few at a similarity of 0.8, so MinHash adds to them: classes that agree
in all ROWS values of one of BANDS bands meet under that band's key. A pair at similarity 0.8
meets under none with a probability of (1 - 0.8^6)^36, 2 in 100,000, and less above.

Links of candidates are stars under each key; their components are found in the cluster. The
shingle sets of a component of candidates then come together, once a class, and every pair not
yet joined is compared exactly: a class leaves with the smallest class that it reaches over
near copies.

Cases are those of simhash: texts without words are one class; rows with a null id stay, and
link others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import Words, mix
from .common import append_columns, encoded, field, pick, stage
from .simhash import LOWER, components, fingerprints, keep_first, near_links

SHINGLE = 5
SHARE = (4, 5)  # as a fraction
ROWS, BANDS = 6, 36
PLACE = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64), 0x5E7) | np.uint64(1)
FACTOR = mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64), 0x3A1) | np.uint64(1)
FLIP = mix(np.arange(1, ROWS * BANDS + 1, dtype=np.uint64), 0x77C)
FILTER_BITS = 24  # of the filter for candidates: 2 MB


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending."""
    w = Words([encoded(t).translate(LOWER) for t in texts])
    h, n = w.hashes(), len(w.start)
    stop = w.first[1:][w.doc] if n else np.zeros(0, np.int64)  # the end of each word's text
    at, acc = np.arange(n), np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, n)):
        acc[: n - k] += np.where(at[: n - k] + k < stop[: n - k], h[k:] * PLACE[k], np.uint64(0))
    acc = mix(acc)
    bounds = w.first.tolist()
    return [np.unique(acc[a : max(b - SHINGLE + 1, a + 1)]) if b > a else acc[:0] for a, b in zip(bounds, bounds[1:])]


def class_of(shingles: np.ndarray) -> int:
    """A hash of the set; 0 for the empty one."""
    if not len(shingles):
        return 0
    both = np.array([np.bitwise_xor.reduce(shingles)], np.uint64) * FACTOR[:1] + shingles.sum(dtype=np.uint64)
    return int(mix(both).view(np.int64)[0])


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """By text and band, the key of its smallest hashes; sets must not be empty."""
    flat = np.concatenate(sets)
    start = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    keys = np.zeros((BANDS, len(sets)), np.uint64)
    for j in range(ROWS * BANDS):
        least = np.minimum.reduceat((flat ^ FLIP[j]) * FACTOR[j], start)
        keys[j // ROWS] = mix(keys[j // ROWS] + least, j)
    return keys.T.view(np.int64)


def marks(df: DataFrame) -> DataFrame:
    """(doc_id, cls, keys, fp) of rows (doc_id, text): class, MinHash keys and SimHash fingerprint."""

    def work(texts: list) -> dict:
        sets = shingle_sets(texts)
        some = [i for i, s in enumerate(sets) if len(s)]
        keys = [np.zeros(0, np.int64)] * len(sets)
        for i, k in zip(some, band_keys([sets[i] for i in some]) if some else ()):
            keys[i] = k
        return {"cls": [class_of(s) for s in sets], "keys": keys}

    marked = append_columns(fingerprints(df), "text", lambda: work, [field("cls", T.LongType()), field("keys", T.ArrayType(T.LongType()))], rows=64)
    return marked.select("doc_id", "cls", "keys", "fp")


def with_class(df: DataFrame) -> DataFrame:
    """df with the class cls of each text."""
    return append_columns(df, "text", lambda: lambda texts: {"cls": [class_of(s) for s in shingle_sets(texts)]}, [field("cls", T.LongType())], rows=64)


def near_fingerprints(marked: DataFrame) -> DataFrame:
    """Links (a, b) of classes whose SimHash fingerprints are equal or near; texts without words have none."""
    pairs = stage(marked.where(F.size("keys") > 0).select("fp", "cls").distinct(), "fingerprints")
    lows = pairs.groupBy("fp").agg(F.min("cls").alias("low"))
    same = pairs.join(lows, "fp").where("cls <> low").select(F.col("cls").alias("a"), F.col("low").alias("b"))
    links = stage(near_links(lows.select("fp")), "near")
    one, two = lows.select(F.col("fp").alias("a"), F.col("low").alias("x")), lows.select(F.col("fp").alias("b"), F.col("low").alias("y"))
    return same.unionAll(links.join(one, "a").join(two, "b").select("x", "y"))


def candidates(marked: DataFrame) -> DataFrame:
    """(cls, found): of each class that meets another by SimHash or MinHash, the smallest class of its candidates."""
    keyed = stage(marked.select(F.explode("keys").alias("key"), "cls").distinct(), "keys")
    met = keyed.groupBy("key").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low < high")
    under = keyed.join(met, "key").where("cls <> low").select(F.col("cls").alias("a"), F.col("low").alias("b"))
    roots = stage(components(near_fingerprints(marked).unionAll(under)), "candidates")
    return roots.select(F.col("node").alias("cls"), F.col("root").alias("found")).unionAll(roots.select("root", "root").distinct())


def place_in_filter(cls: np.ndarray) -> np.ndarray:
    return (mix(cls.view(np.uint64), 0xF17) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def filter_of(found: DataFrame) -> np.ndarray:
    """A bit for every hash of a class; of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for b in batches:
            bits[place_in_filter(b.column("cls").to_numpy())] = True
        yield pa.RecordBatch.from_arrays([pa.array([zstandard.ZstdCompressor(level=1).compress(np.packbits(bits).tobytes())], pa.binary())], names=["bits"])

    total = np.zeros(1 << FILTER_BITS >> 3, np.uint8)
    for r in found.select("cls").coalesce(8).mapInArrow(run, "bits binary").toLocalIterator():
        total |= np.frombuffer(zstandard.ZstdDecompressor().decompress(r.bits), np.uint8)
    return total


def sets_of(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(cls, shingles) of about the candidates' texts."""
    shipped = texts.sparkSession.sparkContext.broadcast(filter_of(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shipped.value, set()
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                out = {}
                for s in shingle_sets(whole.column(0).slice(start, 64).to_pylist()):
                    cls = class_of(s)
                    at = int(place_in_filter(np.array([cls], np.int64))[0])
                    if bits[at >> 3] >> (7 - (at & 7)) & 1 and cls not in seen:
                        out[cls] = s.tobytes()
                        seen.add(cls)
                if len(seen) > 1_000_000:  # later copies go out once more
                    seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.binary())], names=["cls", "shingles"])

    return texts.mapInArrow(run, "cls long, shingles binary")


def near_parts(sets: list[np.ndarray]) -> list[int]:
    """Of each set, the number of its component over pairs at SHARE or more."""
    part = [-1] * len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.cumsum(size) - size
    own = [code[a : a + n] for a, n in zip(start.tolist(), size.tolist())]
    mark = np.zeros(int(code.max(initial=-1)) + 1, bool)
    left = np.arange(len(sets))  # not reached yet, and their codes one after the other
    seeds = 0
    while len(left):
        reached, keep = [int(left[0])], np.arange(len(left)) > 0
        part[reached[0]] = seeds
        code, left = code[np.repeat(keep, size[left])], left[keep]
        while reached and len(left):
            x = reached.pop()
            mark[own[x]] = True
            n = size[left]
            both = np.add.reduceat(mark[code].astype(np.int64), np.cumsum(n) - n)
            mark[own[x]] = False
            near = both * sum(SHARE) >= SHARE[0] * (n + size[x])
            if near.any():
                for i in left[near].tolist():
                    part[i] = seeds
                    reached.append(i)
                code, left = code[np.repeat(~near, n)], left[~near]
        seeds += 1
    return part


def roots(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(cls, root) of the candidates, by exact similarity."""
    sets = sets_of(texts, found).groupBy("cls").agg(F.min("shingles").alias("shingles"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("cls")
        cls = table.column("cls").to_pylist()
        part = near_parts([np.frombuffer(s.as_py(), np.uint64) for s in table.column("shingles")])
        first = {}
        return pa.table({"cls": pa.array(cls, pa.int64()), "root": pa.array([first.setdefault(p, c) for c, p in zip(cls, part)], pa.int64())})

    return found.join(sets, "cls").select("found", "cls", "shingles").groupBy("found").applyInArrow(run, "cls long, root long")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of near copies, whole: that of the smallest id. Rows with a null id stay."""
    marked = stage(marks(pick(df, id_col, text_col).toDF("doc_id", "text")), "marks")
    exact = stage(roots(pick(df, text_col).toDF("text"), candidates(marked)), "roots")
    return keep_first(df, marked, exact, with_class, id_col, text_col)
