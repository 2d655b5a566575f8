"""SimHash near-duplicates with pivot distance tables.

A fingerprint has 64 bits by majority over the XXH64 values of a text's word shingles. Texts
with equal fingerprints are one class, so a large group of copies is one row from there on.

Classes that differ in at most DISTANCE bits agree in all but DISTANCE of any cut of the bits
into bands, so they meet under some choice of the other bands; the more classes there are,
the more bands a key takes. Under each key, a table of Hamming distances from every
fingerprint to PIVOTS reference fingerprints discards pairs: two fingerprints are at least as
far apart as their distances to any one pivot differ. Pairs whose maximum coordinate
difference is DISTANCE or less are verified. A key's verified pairs leave it as a spanning
forest, which keeps every connection and never more links than fingerprints.

Components of the forest are found by alternating star contraction in the cluster.

Cases: texts without words have fingerprint zero and link like others; a null doc_id is no
candidate for the smallest id, and a component of null ids has a null id; repeated rows give
a row each; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import mix
from .common import append_columns, encoded, field, pick, stage

DISTANCE = 4
SHINGLE = 4
PIVOTS = mix(np.arange(1, 33, dtype=np.uint64), 0x51A4)  # reference fingerprints
#: A–Z to a–z by byte; UTF-8 has these bytes nowhere else.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = 42) -> int:
    words = encoded(text).translate(LOWER).split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        return digest(joined, seed)
    ends = list(accumulate(map(len, words), lambda a, w: a + w + 1))
    starts = [0, *[e + 1 for e in ends[: n - 1]]]
    h = np.array([digest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :])], "<u8")
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text_col: str = "text", fp_col: str = "fp") -> DataFrame:
    """df with the fingerprint of each text as a signed 64-bit number."""

    def make():
        return lambda texts: {fp_col: np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)}

    return append_columns(df, text_col, make, [field(fp_col, T.LongType())], rows=512)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def band_masks(classes: int) -> list[int]:
    """Masks of the bits in each key: all choices of bands - DISTANCE out of so many bands."""
    bands = DISTANCE + 1
    while bands < 2 * DISTANCE and (64 * (bands - DISTANCE)) // bands < max(1, classes).bit_length() - 8:
        bands += 1
    edge = [64 * i // bands for i in range(bands + 1)]
    band = [((1 << edge[i + 1]) - 1) & ~((1 << edge[i]) - 1) for i in range(bands)]
    return [sum(c) for c in combinations(band, bands - DISTANCE)]


def find(parent: dict[int, int], x: int) -> int:
    while parent.setdefault(x, x) != x:
        parent[x] = x = parent[parent[x]]
    return x


def links_under_keys(key: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs at most DISTANCE apart that share a key.

    Rows with a key stand together. They are put in order of the distance to the first pivot,
    and compared at growing offsets until that coordinate alone rules every pair out.
    """
    table = np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8)
    order = np.lexsort((fp, table[:, 0], key))
    key, fp, table = key[order], fp[order], table[order]
    parent: dict[int, int] = {}
    label = np.arange(len(fp))  # of each row, the root known so far: pairs already joined need no look
    links, alive = [], np.arange(len(fp))
    for offset in range(1, len(fp)):
        alive = alive[alive + offset < len(fp)]
        alive = alive[(key[alive] == key[alive + offset]) & (table[alive + offset, 0] - table[alive, 0] <= DISTANCE)]
        if not len(alive):
            break
        a = alive[label[alive] != label[alive + offset]]
        for p in range(1, len(PIVOTS)):
            if not len(a):
                break
            a = a[np.abs(table[a, p] - table[a + offset, p]) <= DISTANCE]
        a = a[np.bitwise_count(fp[a] ^ fp[a + offset]) <= DISTANCE]
        changed = False
        for i in a.tolist():
            x, y = find(parent, i), find(parent, i + offset)
            if x != y:
                parent[max(x, y)] = min(x, y)
                links.append((i, i + offset))
                changed = True
        if changed and len(links) > 32:
            known = np.fromiter(parent, np.int64, len(parent))
            label[known] = [find(parent, x) for x in known.tolist()]
    signed = fp.view(np.int64)
    return [(int(signed[i]), int(signed[j])) for i, j in links]


def near_links(classes: DataFrame, fp_col: str = "fp") -> DataFrame:
    """Links (a, b) between distinct fingerprints; their components are those of all near pairs."""
    masks = band_masks(classes.count())
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.posexplode(F.array(*[F.col(fp_col).bitwiseAND(F.lit(m)) for m in signed])).alias("band", "part")
    keyed = classes.select(F.col(fp_col).alias("fp"), keys)
    dealt = keyed.select("fp", F.xxhash64("band", "part").alias("key")).repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            links = links_under_keys(key, fp.view(np.uint64))
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            fp, key = (batch.column(n).to_numpy() for n in ("fp", "key"))
            if len(held) and key[0] == held[-1][0][-1] and key[-1] == key[0]:
                held.append((key, fp))
                continue
            cut = int(np.searchsorted(key, key[-1]))  # keys before it are whole
            if cut or held:
                parts = [*held, (key[:cut], fp[:cut])]
                yield out(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            held = [(key[cut:], fp[cut:])]
        if held:
            yield out(np.concatenate([p[0] for p in held]), np.concatenate([p[1] for p in held]))

    return dealt.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component, for every node of the links (a, b).

    Each round first links every larger neighbour of a node to the node's smallest neighbour,
    then every smaller one; roots of stars are what remains. A round is written before the next.
    """

    def star(edges: DataFrame, larger: bool) -> DataFrame:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        near = both.join(low, "a")
        out = near.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if larger else near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def state(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.crc32(F.concat_ws(",", "a", "b").cast("binary")))).first())

    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = state(edges)
    while before[0]:
        edges = stage(star(star(edges, True), False), "links")
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id) of every row; component_id is the smallest id reachable."""
    marked = stage(fingerprints(pick(df, id_col, text_col).toDF("doc_id", "text")).select("doc_id", "fp"), "fingerprints")
    classes = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    roots = components(near_links(classes))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_first(df: DataFrame, marked: DataFrame, roots: DataFrame, with_class: Callable[[DataFrame], DataFrame], id_col: str, text_col: str) -> DataFrame:
    """One row of each component, whole: that of the smallest id. Rows with a null id stay.

    marked has (doc_id, cls) of every row, roots (cls, root) of classes with neighbours;
    with_class appends cls to rows with a text. Where ids are shared, the class tells which
    row is meant; of repeated rows with one id and class, that with the smallest text stays.
    """
    classes = marked.groupBy("cls").agg(F.min("doc_id").alias("rep")).where("rep IS NOT NULL")
    rooted = classes.join(roots, "cls", "left").select("cls", "rep", F.coalesce("root", "cls").alias("root"))
    first = rooted.groupBy("root").agg(F.min(F.struct("rep", "cls")).alias("first")).select("first.*")
    rows = marked.groupBy("doc_id").agg(F.count("*").alias("copies"))
    kept = first.join(rows, first["rep"] == rows["doc_id"]).select(F.col("rep").alias("kept_id"), F.col("cls").alias("kept_cls"), "copies")
    names = df.columns
    joined = df.join(kept, df[id_col] == kept["kept_id"])
    once = joined.where(kept["copies"] == 1).select(*[df[n] for n in names])
    rest = joined.where(kept["copies"] > 1).select(kept["kept_id"], kept["kept_cls"], df[text_col].alias("text"), F.struct(*[df[n] for n in names]).alias("row"))  # only rows that share an id
    rest = with_class(rest).where("cls = kept_cls")
    least = rest.groupBy("kept_id", "kept_cls").agg(F.min_by("row", F.coalesce("text", F.lit(""))).alias("row"))
    return once.unionAll(least.select("row.*")).unionAll(df.where(F.col(f"`{id_col}`").isNull()))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, whole: that of the smallest id. Rows with a null id stay."""
    marked = stage(fingerprints(pick(df, id_col, text_col).toDF("doc_id", "text")).select("doc_id", F.col("fp").alias("cls")), "fingerprints")
    roots = stage(components(near_links(marked.select(F.col("cls").alias("fp")).distinct())).select(F.col("node").alias("cls"), "root"), "roots")
    return keep_first(df, marked, roots, lambda rows: fingerprints(rows, fp_col="cls"), id_col, text_col)
