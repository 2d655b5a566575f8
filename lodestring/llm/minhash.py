"""MinHash near-duplicates by an inverted join of signature coordinates.

A text's set are its distinct shingles of SHINGLE words (A-Z lower-cased), by 64-bit hash; a
text of fewer words has one shingle, all of it. Two texts link where their intersection is
SHARE of their union or more. Texts with equal sets are one class from the start, so any
number of copies is one row.

A signature has PLACES coordinates, each the least value of one hash over the set. Classes are
posted under coordinate and value. A pair that agrees in NEED coordinates or more must agree
in one of the first PLACES - NEED + 1, so only that prefix is posted; a pair is counted under
its first agreement alone, and coordinates are merged STEP at a time while pairs that can't
reach NEED any more are skipped. Pairs that reach it are confirmed on their full sets. A pair
at SHARE misses NEED agreements with a probability of 2.4 in a million, and less above.

Links are found in two passes. In the first, every posting list has a centre, chosen by a
hash, and each class confirms one pair: with the centre that it agrees with most. That joins
most of a large group of near copies without its pairs. The second takes the lists that still
hold classes of different components, and counts every pair across components, so that no
link is lost. A long list is cut into parts, and two parts at a time meet in a task. Signatures
alone are counted at first; classes that have a partner under a list then meet under it once
more with their sets, pairs are confirmed there, and a spanning forest leaves it: rows grow
with the classes, never with the pairs.

Cases: texts that are null or without words have no shingles and link with nothing; a null
doc_id is no candidate for the smallest id, links others nevertheless, and is kept only in a
component of null ids, whose id is null; repeated rows give a row each, and all rows with the
component's smallest id are kept; very long texts go whole; other columns aren't read; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import mix
from .common import encoded, pick, slices_by_bytes, stage
from .near_copies import class_of, shingle_sets
from .simhash import components, find

SHARE = 85  # in a hundred
PLACES, NEED = 64, 40
PREFIX = PLACES - NEED + 1
STEP = 16
PART, PART_SHINGLES = 1024, 1 << 21  # classes of a posting list in one part, and shingles of these
BROADCAST_CLASSES = 1 << 22  # numbers of classes that may be copied to every executor: 32 MB
FACTOR = mix(np.arange(1, PLACES + 1, dtype=np.uint64), 0x12C) | np.uint64(1)
FLIP = mix(np.arange(1, PLACES + 1, dtype=np.uint64), 0x12D)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of PLACES 32-bit coordinates for each set; sets must not be empty."""
    flat = np.concatenate(sets)
    start = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    out = np.zeros((len(sets), PLACES), np.uint32)
    for j in range(PLACES):
        out[:, j] = np.minimum.reduceat((flat ^ FLIP[j]) * FACTOR[j], start) >> np.uint64(32)
    return out


def marked(df: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, cls, sig) of rows (doc_id, text); a class is 0 where there are no shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices_by_bytes(whole, 1, 1 << 18):
                sets = shingle_sets(b.column(1).to_pylist())
                some = [i for i, s in enumerate(sets) if len(s)]
                sig = [None] * len(sets)
                for i, row in zip(some, signatures([sets[i] for i in some]) if some else ()):
                    sig[i] = row.tobytes()
                columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) for s in sets], pa.int64()), pa.array(sig, pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", "n_shingles", "cls", "sig"])

    return stage(df.mapInArrow(run, "doc_id long, n_shingles long, cls long, sig binary"), "marks")


def posted(classes: DataFrame) -> DataFrame:
    """(key, place, cls, size): the prefix of every class, and its number of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = matrix(b.column("sig"))[:, :PREFIX].astype(np.uint64)
            place = np.arange(PREFIX, dtype=np.uint64)
            key = mix((sig | place << np.uint64(32)).ravel(), 0x12E).view(np.int64)
            cls, size = (np.repeat(b.column(c).to_numpy(), PREFIX) for c in ("cls", "size"))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.tile(place, b.num_rows).astype(np.int32)), pa.array(cls), pa.array(size)], names=["key", "place", "cls", "size"])

    return classes.select("cls", "size", "sig").mapInArrow(run, "key long, place int, cls long, size long")


def matrix(sig: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(sig.to_pylist()), np.uint32).reshape(len(sig), PLACES)


def shared_lists(classes: DataFrame) -> DataFrame:
    """(key, place, cls, parts, centre) of the posting lists with more than one class."""
    rows = posted(classes)
    parts = F.greatest(F.ceil(F.count("*") / PART), F.ceil(F.sum("size") / PART_SHINGLES)).cast("int")
    keys = rows.groupBy("key").agg(F.count("*").alias("n"), parts.alias("parts"), F.min_by("cls", F.xxhash64("cls", "key")).alias("centre"))
    return stage(rows.join(keys.where("n > 1").drop("n").hint("merge"), "key").drop("size"), "postings")


def with_end(pairs: DataFrame, end: str, what: DataFrame, name: str) -> DataFrame:
    """Pairs (a, b, part, ...) with a column of what (cls, value) for one end.

    part is below the number of parts of the longest list of a pair, so a class in very many
    pairs reaches them in so many copies.
    """
    needed = pairs.select(F.col(end).alias("cls"), "part").distinct()
    copies = needed.join(what, "cls").select(F.col("cls").alias(end), "part", F.col("value").alias(name))
    return pairs.join(copies, [end, "part"])


def counted(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, part, agree) of the pairs (a, b, part) with NEED agreements or more."""
    sig = classes.select("cls", F.col("sig").alias("value"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            agree = (matrix(b.column("x")) == matrix(b.column("y"))).sum(1)
            keep = pa.array(agree >= NEED)
            yield pa.RecordBatch.from_arrays([*[b.column(c).filter(keep) for c in ("a", "b", "part")], pa.array(agree).filter(keep)], names=["a", "b", "part", "agree"])

    both = with_end(with_end(pairs, "a", sig, "x"), "b", sig, "y").select("a", "b", "part", "x", "y")
    return both.mapInArrow(run, "a long, b long, part int, agree long")


def sets_of(cls: DataFrame, docs: DataFrame) -> DataFrame:
    """(cls, shingles) of some classes (cls), computed again: all sets together are larger than the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices_by_bytes(whole, 0, 1 << 18):
                sets = {class_of(s): s.tobytes() for s in shingle_sets(b.column(0).to_pylist())}
                yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), pa.array(list(sets.values()), pa.binary())], names=["cls", "shingles"])

    wanted = stage(cls.distinct(), "wanted")
    few = wanted.count() <= BROADCAST_CLASSES
    found = docs.select("text").mapInArrow(run, "cls long, shingles binary").join(F.broadcast(wanted) if few else wanted, "cls", "left_semi")
    return stage(found.groupBy("cls").agg(F.min("shingles").alias("shingles")), "sets")


def are_near(both, x, y):
    return 100 * both >= SHARE * (x + y - both)


def star_links(lists: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links of each class with the centre that it agrees with most."""
    met = lists.where("cls <> centre").groupBy(F.col("cls").alias("a"), F.col("centre").alias("b")).agg(F.max("parts").alias("parts"))
    near = counted(met.select("a", "b", F.pmod(F.xxhash64("a", "b"), "parts").cast("int").alias("part")), classes)
    best = near.groupBy("a").agg(F.max_by(F.struct("b", "part"), F.struct("agree", "b")).alias("c")).select("a", "c.*")
    pairs = stage(best, "pairs")
    sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("cls")), docs).withColumnRenamed("shingles", "value")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for x, y in zip(b.column("x"), b.column("y")):
                x, y = (np.frombuffer(s.as_py(), np.uint64) for s in (x, y))
                near.append(bool(are_near(np.intersect1d(x, y, assume_unique=True).size, len(x), len(y))))
            keep = pa.array(near, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(c).filter(keep) for c in ("a", "b")], names=["a", "b"])

    both = with_end(with_end(pairs, "a", sets, "x"), "b", sets, "y").select("a", "b", "x", "y")
    return stage(both.mapInArrow(run, "a long, b long"), "links")


def whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows in tables of whole lists."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column("list").to_numpy()
        cut = int(np.searchsorted(key, key[-1]))  # lists before it are whole
        if cut or held and held[-1].column("list")[-1].as_py() != key[0]:
            yield pa.concat_tables([*held, pa.Table.from_batches([batch.slice(0, cut)])]).combine_chunks()
            held = []
        held.append(pa.Table.from_batches([batch.slice(cut)]))
    if held:
        yield pa.concat_tables(held).combine_chunks()


def with_partner(t: dict[str, np.ndarray], sig: np.ndarray) -> np.ndarray:
    """Which rows have a partner of another label with NEED agreements, the first of them at their list's place.

    Rows of a list stand together. A list with cross is of two parts, whose own pairs are not asked.
    """
    key, label, side, cross, place = (t[n] for n in ("list", "label", "side", "cross", "place"))
    met, alive = np.zeros(len(key), bool), np.arange(len(key))
    for offset in range(1, len(key)):
        alive = alive[alive + offset < len(key)]
        alive = alive[key[alive] == key[alive + offset]]
        if not len(alive):
            break
        a = alive[label[alive] != label[alive + offset]]
        a = a[~cross[a] | (side[a] != side[a + offset])]
        agree, left = np.zeros(len(a), np.int64), PLACES
        for at in range(0, PLACES, STEP):
            same = sig[a, at : at + STEP] == sig[a + offset, at : at + STEP]
            left -= STEP
            go = agree + same.sum(1) + left >= NEED
            go &= (agree > 0) | ~same.any(1) | (at + np.argmax(same, 1) == place[a])  # an earlier agreement has the pair in its own list
            agree = (agree + same.sum(1))[go]
            a = a[go]
        met[a] = met[a + offset] = True
    return met


def confirmed(t: dict[str, np.ndarray], sig: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest, as rows (a, b), of the near pairs across labels of one list."""
    label, side, cross, place = (t[n] for n in ("label", "side", "cross", "place"))
    size = np.array([len(s) for s in sets], np.int64)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    stop = np.cumsum(size)
    mark = np.zeros(int(code.max()) + 1, bool)
    parent: dict[int, int] = {}
    links = []
    for x in range(len(sets) - 1):
        y = np.arange(x + 1, len(sets))
        keep = (label[y] != label[x]) & are_near(np.minimum(size[y], size[x]), size[y], size[x])
        y = y[keep & (side[y] != side[x])] if cross[x] else y[keep]
        same = sig[y] == sig[x]
        y = y[(same.sum(1) >= NEED) & (np.argmax(same, 1) == place[x])]
        if not len(y):
            continue
        own = slice(stop[x] - size[x], stop[x])
        mark[code[own]] = True
        if 8 * len(y) > len(sets) - x:
            both = np.add.reduceat(mark[code[stop[x] :]].astype(np.int64), (stop - size)[x + 1 :] - stop[x])[y - x - 1]
        else:
            both = np.array([np.count_nonzero(mark[code[stop[i] - size[i] : stop[i]]]) for i in y.tolist()])
        mark[code[own]] = False
        for i in y[are_near(both, size[y], size[x])].tolist():
            a, b = find(parent, int(label[x])), find(parent, int(label[i]))
            if a != b:
                parent[max(a, b)] = min(a, b)
                links.append((x, i))
    return links


ROW = "list long, place int, cls long, label long, side int, cross boolean"
COLUMNS = [f.split()[0] for f in ROW.split(", ")]


def arrays(t: pa.Table) -> dict[str, np.ndarray]:
    return {n: t.column(n).combine_chunks().to_numpy(zero_copy_only=False) for n in COLUMNS}


def crossing_links(lists: DataFrame, roots: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) that join all near pairs of different components."""
    labelled = lists.select("key", "place", "cls", "parts").join(roots, lists["cls"] == roots["node"], "left").select("key", "place", "cls", "parts", F.coalesce("root", "cls").alias("label"))
    labelled = stage(labelled, "labels")
    mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    cut = labelled.join(mixed, "key").withColumn("side", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    i, j = F.least("side", "other"), F.greatest("side", "other")
    dealt = met.select(F.xxhash64("key", i, j).alias("list"), "place", "cls", "label", "side", (i < j).alias("cross"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_lists(batches):
            some = with_partner(arrays(t), matrix(t.column("sig").combine_chunks()))
            yield from t.select(COLUMNS).filter(pa.array(some)).combine_chunks().to_batches()

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_lists(batches):
            own, sig = arrays(t), matrix(t.column("sig").combine_chunks())
            edge = [0, *(np.nonzero(own["list"][1:] != own["list"][:-1])[0] + 1).tolist(), t.num_rows]
            found = []
            for s, e in zip(edge, edge[1:]):
                sets = [np.frombuffer(x.as_py(), np.uint64) for x in t.column("shingles").slice(s, e - s)]
                found += [(own["cls"][s + a], own["cls"][s + b]) for a, b in confirmed({n: c[s:e] for n, c in own.items()}, sig[s:e], sets)]
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], names=["a", "b"])

    by_list = lambda rows: rows.repartition("list").sortWithinPartitions("list")
    partners = stage(by_list(dealt.join(classes.select("cls", "sig").hint("merge"), "cls")).mapInArrow(look, ROW), "partners")
    sets = sets_of(partners.select("cls"), docs)
    return stage(by_list(partners.join(sets, "cls").join(classes.select("cls", "sig"), "cls")).mapInArrow(confirm, "a long, b long"), "links")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; component_id is the smallest id reachable."""
    docs = pick(df, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    marks = marked(docs)
    least = [F.min(c).alias(n) for c, n in (("doc_id", "rep"), ("n_shingles", "size"), ("sig", "sig"))]
    classes = stage(marks.where("n_shingles > 0").groupBy("cls").agg(*least), "classes")
    lists = shared_lists(classes)
    roots = stage(components(star_links(lists, docs, classes)), "roots")
    rest = crossing_links(lists, roots, docs, classes)
    joined = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(rest))
    rooted = classes.join(joined, classes["cls"] == joined["node"], "left").select("cls", "rep", F.coalesce("root", "cls").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(smallest, "root").select("cls", "component_id")
    alone = F.col("n_shingles") == 0
    out = marks.select("doc_id", "n_shingles", "cls").join(named, "cls", "left")
    out = out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
