"""The suffix array of all strings, read from right to left, and the states that it holds.

A row stands for a place (sid, end): the letters before and at `end`, the last one first.
Rows in the order of these letters are the array; substrings with the same end positions are
then an interval of it. Strings that stand more than once are taken once, with their number.

Ranks come by prefix doubling. The first START letters are sorted as they are; from then on
rows that share h letters are sorted by the rank of the place h letters before, which a window
over the string finds, and rows that no other row equals, or whose string has ended, stay as
they are. A sort deals rows by range, ties by place, so no key that many rows share meets in
one task; the runs that cross tasks are joined from one row a task. Rounds grow with the
logarithm of the longest repeat, and every round moves the rows of the strings with rows left.

Lengths of common prefixes follow the same way: a row's predecessor split from it in a known
round, so the length is known to a factor of two, and of neighbouring places with neighbouring
predecessors only the first compares letters.

Null and empty strings have no rows. Strings are made of letters of one byte each.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import l2
from ..plans.storage import checkpointed, rewritten
from .search import bounded, exact_topk_batch, largest_k, top_k

START = 16  # letters that the first sort compares
SHORT = 4  # letters of a bucket: longer states lie within one


def distinct_strings(base: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((sid, s, copies) of the distinct strings, (sid, id) of every row)."""
    some = base.where("s <> ''")
    hashed = checkpointed(base.sparkSession, some.select("id", F.sha2("s", 256).alias("h")))
    first = hashed.groupBy("h").agg(F.min("id").alias("sid"), F.count("*").alias("copies"))
    named = checkpointed(base.sparkSession, first)
    strings = some.withColumnRenamed("id", "sid").join(named.select("sid", "copies"), "sid").select("sid", "s", "copies")
    return strings.dropDuplicates(["sid"]), hashed.join(named.select("h", "sid"), "h").select("sid", "id")


def places(strings: DataFrame) -> DataFrame:
    """(sid, end, head, bucket, copies): every place with the START letters up to it, the last one first."""
    heads = F.regexp_extract_all(F.reverse("s"), F.lit(f"(?=(.{{1,{START}}}))"), F.lit(1))
    rows = strings.select("sid", "copies", F.length("s").alias("n"), F.posexplode(heads).alias("q", "head"))
    return rows.select("sid", (F.col("n") - F.col("q")).cast("int").alias("end"), "head", F.substring("head", 1, SHORT).alias("bucket"), "copies")


def common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of equal first letters of each two fixed-width strings."""
    x, y = (np.ascontiguousarray(s).view(np.uint8).reshape(len(s), START) for s in (a, b))
    return np.cumprod((x == y) & (x > 0), axis=1).sum(1)


def run_starts(rows: DataFrame, outer: list[str], inner: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows in the order of outer and inner, with the global position of the first row equal in outer, and in both.

    Also: place, the row's own position; alone, whether no other row equals it in both;
    shared, the letters that a run of `head` shares with the run before; before_sid and
    before_end, the row before, whatever its run. The second result is the table that they
    are read from, which can go when they are written.
    """
    spark, keys = rows.sparkSession, [*outer, *inner]
    dealt = rows.repartitionByRange(*keys, "sid", "end").sortWithinPartitions(*keys, "sid", "end").withColumn("part", F.spark_partition_id())
    names, lettered = dealt.columns, inner == ["head"]
    added = ["at", "outer_at", "inner_at", "alone", "shared", "before_sid", "before_end"]

    def column(t: pa.Table, name: str) -> np.ndarray:
        c = t.column(name)
        return np.array(c.to_pylist(), f"S{START}") if name == "head" else c.to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen = None, 0  # the row before, with what is known of it; rows given out
        outer_at = inner_at = shared = 0
        last = None

        def out(t: pa.Table, more: bool) -> pa.RecordBatch | None:
            nonlocal seen, outer_at, inner_at, shared, last
            size = t.num_rows - more  # the last row waits for the one after
            key = {k: column(t, k) for k in keys}
            differ = {k: np.concatenate(([False], key[k][1:] != key[k][:-1])) for k in keys}
            if last is None:
                new_inner = new_outer = np.zeros(t.num_rows, bool)
            new_outer = np.logical_or.reduce([np.zeros(t.num_rows, bool), *[differ[k] for k in outer]])
            new_inner = np.logical_or.reduce([new_outer, *[differ[k] for k in inner]])
            if last is not None:
                new_outer[0], new_inner[0] = last[0], last[1]
            at = seen + np.arange(t.num_rows)
            starts = [np.maximum.accumulate(np.where(n, at, s)) for n, s in ((new_outer, outer_at), (new_inner, inner_at))]
            meets = np.concatenate((~new_inner[1:], [False]))
            alone = new_inner & ~meets | (at == 0) & ~meets
            shares = np.zeros(t.num_rows, np.int64)
            if lettered:
                shares[1:] = common(key["head"][1:], key["head"][:-1])
                shares[0] = last[2] if last is not None else 0
                run_at = np.maximum.accumulate(np.where(new_inner, np.arange(t.num_rows), -1))
                shares = np.where(run_at >= 0, shares[np.maximum(run_at, 0)], shared)
            sid, end = t.column("sid").to_numpy(), t.column("end").to_numpy()
            before = [np.concatenate(([last[3 + i] if last is not None else -1], x[:-1])) for i, x in enumerate((sid, end))]
            made = [pa.array(x[:size]) for x in (at, *starts, alone, shares, before[0].astype(np.int64), before[1].astype(np.int64))]
            if size:
                outer_at, inner_at, shared = int(starts[0][size - 1]), int(starts[1][size - 1]), int(shares[size - 1])
            z = size if more else size - 1
            last = (bool(new_outer[z]), bool(new_inner[z]), int(common(key["head"][z : z + 1], key["head"][z - 1 : z])[0]) if lettered and z else (last[2] if last else 0), int(before[0][z]), int(before[1][z]))
            seen += size
            if not size:
                return None
            head = t.slice(0, size).combine_chunks()
            return pa.RecordBatch.from_arrays([*[head.column(n).combine_chunks() for n in names], *made], names=[*names, *added])

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]) if held is not None else t
            made = out(t, True)
            held = t.slice(t.num_rows - 1)
            if made is not None:
                yield made
        if held is not None:
            yield out(held, False)

    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields], "at long, outer_at long, inner_at long, alone boolean, shared long, before_sid long, before_end long"])
    staged = checkpointed(spark, dealt.mapInArrow(run, schema))
    ends = staged.groupBy("part").agg(F.count("*").alias("n"), *[f(F.struct(*[F.col(k) for k in keys], "sid", "end"), "at").alias(a) for f, a in ((F.min_by, "lo"), (F.max_by, "hi"))], F.max("outer_at").alias("outer_last"), F.max("inner_at").alias("inner_last"), F.max_by("shared", "at").alias("shared_last"))
    edges = joined_edges(ends.orderBy("part").collect(), outer, inner)  # a row a task
    about = spark.createDataFrame(edges, "part int, offset long, outer_from long, inner_from long, met boolean, meets boolean, inner_last long, shared_from long, sid_from long, end_from long")
    rows = staged.join(F.broadcast(about), "part")  # a row a task
    first, opens = F.col("at") == 0, F.col("inner_at") == 0
    found = rows.select(
        *[n for n in names if n != "part"],
        (F.col("offset") + F.col("at")).alias("place"),
        F.when(F.col("outer_at") == 0, F.col("outer_from")).otherwise(F.col("offset") + F.col("outer_at")).alias("outer_start"),
        F.when(opens, F.col("inner_from")).otherwise(F.col("offset") + F.col("inner_at")).alias("inner_start"),
        (F.col("alone") & ~(opens & F.col("met")) & ~((F.col("inner_at") == F.col("inner_last")) & F.col("meets"))).alias("alone"),
        F.when(opens, F.col("shared_from")).otherwise(F.col("shared")).alias("shared"),
        F.when(first, F.col("sid_from")).otherwise(F.col("before_sid")).alias("before_sid"),
        F.when(first, F.col("end_from")).otherwise(F.col("before_end")).alias("before_end"),
    )
    return found, staged


def joined_edges(ends: list, outer: list[str], inner: list[str]) -> list[tuple]:
    """What each task's first and last runs take over from the tasks beside it."""
    out, offset = [], 0
    of = lambda row, names: tuple(row[n] for n in names)
    for i, e in enumerate(ends):
        before = ends[i - 1] if i else None
        same_outer = before is not None and of(e.lo, outer) == of(before.hi, outer)
        same = same_outer and of(e.lo, inner) == of(before.hi, inner)
        ahead = i + 1 < len(ends) and of(e.hi, [*outer, *inner]) == of(ends[i + 1].lo, [*outer, *inner])
        outer_from, inner_from, shared = offset, offset, 0
        if before is not None:
            _, start, outer_was, inner_was, _, _, last, shared_was, _, _ = out[-1]
            if same_outer:
                outer_from = outer_was if before.outer_last == 0 else start + before.outer_last
            if same:
                inner_from = inner_was if last == 0 else start + last
                shared = shared_was if last == 0 else before.shared_last
            elif inner == ["head"]:
                shared = int(common(np.array([e.lo.head], f"S{START}"), np.array([before.hi.head], f"S{START}"))[0])
        out.append((e.part, offset, outer_from, inner_from, same, ahead, e.inner_last, shared, before.hi.sid if before else -1, before.hi.end if before else -1))
        offset += e.n
    return out


def suffix_ranks(strings: DataFrame) -> DataFrame:
    """(sid, end, bucket, copies, r, parted) of every place; equal ones, of strings that begin alike, share a rank.

    parted tells of the row at position r and the one before how many letters they share: -1
    less that number if they differ in their first START letters, else h, and it is h to 2h - 1.
    """
    spark = strings.sparkSession
    sorted_heads, staged = run_starts(places(strings), [], ["head"])
    rows = sorted_heads.select("sid", "end", "bucket", "copies", F.col("inner_start").alias("r"), (-1 - F.col("shared")).cast("int").alias("parted"), (F.col("alone") | (F.length("head") < START)).alias("done"))
    rows = rewritten(spark, rows, staged)
    done, active, h = rows.where("done"), rows.where("NOT done"), START
    while not active.isEmpty():
        every = done.unionAll(active).join(active.select("sid").distinct(), "sid", "left_semi")
        before = F.lag("r", h).over(Window.partitionBy("sid").orderBy("end"))
        left = every.withColumn("r2", F.coalesce(before, F.lit(-1))).where("NOT done").drop("done")
        found, staged = run_starts(left, ["r"], ["r2"])
        r = F.col("r") + F.col("inner_start") - F.col("outer_start")
        ranked = found.select("sid", "end", "bucket", "copies", r.alias("r"), F.when(r != F.col("r"), F.lit(h)).otherwise(F.col("parted")).alias("parted"), (F.col("alone") | (F.col("r2") < 0)).alias("done"))
        ranked = rewritten(spark, ranked, staged)
        done, active, h = done.unionAll(ranked.where("done")), ranked.where("NOT done"), 2 * h
    return done.drop("done")


def suffix_array(strings: DataFrame) -> DataFrame:
    """(i, sid, end, bucket, copies, lcp): the array, with the letters that row i shares with row i - 1."""
    spark = strings.sparkSession
    ordered, staged = run_starts(suffix_ranks(strings), ["r"], ["sid"])
    tied = F.col("place") > F.col("outer_start")
    near = F.when(tied, F.col("end")).when(F.col("parted") < 0, -1 - F.col("parted"))
    line = Window.partitionBy("sid").orderBy("end")
    # a run goes from a place to the one before it in the string, its predecessor likewise
    far = near.isNull()
    rows = rewritten(spark, ordered.select(F.col("place").alias("i"), "sid", "end", "bucket", "copies", "parted", "before_sid", "before_end", near.cast("int").alias("near"), far.alias("far")), staged)
    after = [F.lead(c).over(line) for c in ("before_sid", "before_end", "far")]
    follows = F.coalesce(after[2] & (after[0] == F.col("before_sid")) & (after[1] == F.col("before_end") + 1), F.lit(False))
    marked = rows.withColumn("opens", F.col("far") & ~follows)
    lengths = compared(marked.where("opens").select("sid", "end", "parted", "before_sid", "before_end"), strings)
    known = marked.join(lengths, ["sid", "end"], "left")
    ahead = Window.partitionBy("sid").orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    opened = F.last(F.when(F.col("opens"), F.struct(F.col("end").alias("at"), "length")), ignorenulls=True).over(ahead)
    lcp = F.when(F.col("far"), opened["length"] - (opened["at"] - F.col("end"))).otherwise(F.col("near"))
    return checkpointed(spark, known.select("i", "sid", "end", "bucket", "copies", lcp.cast("int").alias("lcp")))


def compared(pairs: DataFrame, strings: DataFrame) -> DataFrame:
    """(sid, end, length) of pairs of places that share `parted` letters and fewer than twice that."""
    piece = lambda end: F.reverse(F.expr(f"substring(s, greatest({end} - 2 * parted + 1, 1), least({end}, 2 * parted) - parted)"))
    one = pairs.join(strings.select("sid", "s"), "sid").select("sid", "end", "parted", "before_sid", "before_end", piece("end").alias("x"))
    two = one.join(strings.select(F.col("sid").alias("before_sid"), "s"), "before_sid").select("sid", "end", "parted", "x", piece("before_end").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
                n = min(len(x), len(y))
                differ = np.frombuffer(x[:n].encode(), np.uint8) != np.frombuffer(y[:n].encode(), np.uint8)
                same.append(int(differ.argmax()) if differ.any() else n)
            yield pa.RecordBatch.from_arrays([b.column("sid"), b.column("end"), pa.array(np.array(same, np.int64) + b.column("parted").to_numpy())], names=["sid", "end", "length"])

    return two.mapInArrow(run, "sid long, end int, length long")


def long_states(array: DataFrame) -> DataFrame:
    """(sid, end, len, link_len, occurrences, ids) of the states of SHORT letters or more; (sid, end) is one of their places.

    link_len is 0 where the next shorter state has fewer than SHORT letters. A bucket's rows are
    read in order with the stack of the intervals that are open. ids counts rows of the corpus:
    a place adds its string to the smallest interval, and takes it from the smallest that holds
    the string's place before, too.
    """
    before = F.lag("i").over(Window.partitionBy("sid", "bucket").orderBy("i"))
    rows = array.where(F.length("bucket") == SHORT).withColumn("seen", F.coalesce(before, F.lit(-1)))
    dealt = rows.select("bucket", "i", "sid", "end", "copies", "lcp", "seen").repartitionByRange("bucket").sortWithinPartitions("i")
    names = ["sid", "end", "len", "link_len", "occurrences", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        lens, lefts, held = [0], [-1], [[0, 0, 0, 0]]  # of each open interval: (sid, end, occurrences, ids)
        last = None

        def close(v: int) -> None:
            """The row `last` and the intervals that end with it; v is what it shares with the next."""
            i, sid, end, copies, seen = last
            deepest = max(lens[-1], v)
            if end > deepest:
                found.append((sid, end, end, deepest, copies, copies))
            if v > lens[-1]:
                lens.append(v), lefts.append(i), held.append([sid, end, 0, 0])
            held[-1][2] += copies
            held[-1][3] += copies
            if seen >= lefts[1 if len(lefts) > 1 else 0] and len(lefts) > 1:
                held[bisect_right(lefts, seen) - 1][3] -= copies
            while lens[-1] > v:
                n, left, h = lens.pop(), lefts.pop(), held.pop()
                if lens[-1] < v:
                    lens.append(v), lefts.append(left), held.append([h[0], h[1], 0, 0])
                found.append((h[0], h[1], n, lens[-1], h[2], h[3]))
                held[-1][2] += h[2]
                held[-1][3] += h[3]
            if not v:
                held[0][2] = held[0][3] = 0

        def out() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*found), kinds)], names=names)
            found.clear()
            return batch

        for b in batches:
            for i, sid, end, copies, lcp, seen in zip(*[b.column(c).to_pylist() for c in ("i", "sid", "end", "copies", "lcp", "seen")]):
                if last is not None:
                    close(lcp if lcp >= SHORT else 0)
                last = (i, sid, end, copies, seen)
            if found:
                yield out()
        if last is not None:
            close(0)
            if found:
                yield out()

    return dealt.mapInArrow(run, "sid long, end int, len int, link_len int, occurrences long, ids long")


def short_states(array: DataFrame) -> DataFrame:
    """(state, len, link_len, occurrences, ids) of the states below SHORT letters: no more than the alphabet allows.

    state is written as it is read, from left to right.
    """
    spark = array.sparkSession
    buckets = checkpointed(spark, array.groupBy("bucket").agg(F.sum("copies").alias("occurrences")))
    in_strings = array.groupBy("sid", "bucket").agg(F.first("copies").alias("copies"))
    found = None
    for n in range(1, SHORT):
        long = buckets.where(F.length("bucket") >= n).withColumn("g", F.substring("bucket", 1, n))
        states = long.groupBy("g").agg(F.sum("occurrences").alias("occurrences"), F.countDistinct(F.substring("bucket", 1, n + 1)).alias("ways"), F.max((F.length("bucket") == n).cast("int")).alias("ended"))
        df = in_strings.where(F.length("bucket") >= n).select("sid", "copies", F.substring("bucket", 1, n).alias("g")).distinct().groupBy("g").agg(F.sum("copies").alias("ids"))
        level = states.where("ways > 1 OR ended = 1").join(df, "g").select("g", F.lit(n).alias("len"), "occurrences", "ids")
        found = level if found is None else found.unionAll(level)
    found = checkpointed(spark, found)
    links = found.select(F.col("g").alias("up"), F.col("len").alias("up_len"))
    shorter = found.join(F.broadcast(links), F.expr("up_len < len AND startswith(g, up)"), "left")  # at most 26 ** SHORT of either
    linked = shorter.groupBy("g", "len", "occurrences", "ids").agg(F.coalesce(F.max("up_len"), F.lit(0)).alias("link_len"))
    return linked.select(F.reverse("g").alias("state"), "len", "link_len", "occurrences", "ids")


def suffix_states(array: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The short states, and the long ones with the length of every link."""
    short, long = checkpointed(array.sparkSession, short_states(array)), long_states(array)
    heads = array.select("sid", "end", F.substring("bucket", 1, SHORT - 1).alias("head"))
    open_links = long.where("link_len = 0").join(heads, ["sid", "end"])
    ups = short.select(F.reverse("state").alias("up"), F.col("len").alias("up_len"))
    tried = open_links
    for n in range(1, SHORT):
        named = ups.where(F.col("up_len") == n).select(F.col("up").alias("x"), F.col("up_len").alias(f"up{n}"))
        tried = tried.join(F.broadcast(named), F.substring("head", 1, n) == F.col("x"), "left").drop("x")  # at most 26 ** n rows
    link = F.greatest(F.lit(0), *[F.coalesce(f"up{n}", F.lit(0)) for n in range(1, SHORT)])
    names = ["sid", "end", "len", "link_len", "occurrences", "ids"]
    return short, long.where("link_len > 0").unionAll(tried.withColumn("link_len", link).select(*names))


def named_states(short: DataFrame, long: DataFrame, strings: DataFrame) -> DataFrame:
    """(state, len, n_substrings, occurrences, ids) with the states' letters: for small corpora."""
    spelled = long.join(strings.select("sid", "s"), "sid").withColumn("state", F.expr("substring(s, end - len + 1, len)"))
    rows = short.select("state", "len", "link_len", "occurrences", "ids").unionAll(spelled.select("state", "len", "link_len", "occurrences", "ids"))
    return rows.select("state", "len", (F.col("len") - F.col("link_len")).cast("long").alias("n_substrings"), "occurrences", "ids")


def state_lengths(array: DataFrame, short: DataFrame, long: DataFrame) -> DataFrame:
    """(len, states, substrings, occurrences, ids): for each length that a state has, the states of that length, the distinct
    substrings of that length, and the states' places and rows."""
    both = short.select("len", "occurrences", "ids").unionAll(long.select("len", "occurrences", "ids"))
    sizes = both.groupBy("len").agg(F.count("*").alias("states"), F.sum("occurrences").alias("occurrences"), F.sum("ids").alias("ids"))
    ends = array.select(F.explode(F.array(F.struct((F.col("lcp") + 1).alias("len"), F.lit(1).alias("d")), F.struct((F.col("end") + 1).alias("len"), F.lit(-1).alias("d")))).alias("x")).select("x.*")
    steps = ends.groupBy("len").agg(F.sum("d").alias("d"))
    upto = steps.select("len", F.sum("d").over(Window.orderBy("len")).alias("substrings"), F.lead("len").over(Window.orderBy("len")).alias("before"))  # as many rows as the longest string has letters
    between = F.expr("s.len >= u.len AND (u.before IS NULL OR s.len < u.before)")
    return sizes.alias("s").join(F.broadcast(upto).alias("u"), between).select("s.len", "states", "substrings", "occurrences", "ids")


class SuffixIndex:
    """Every place under the START letters up to it: rows with a pattern of any length are found by one range of letters."""

    def __init__(self, base: DataFrame, places: DataFrame):
        self.base, self.places = base, places

    @staticmethod
    def build(base: DataFrame) -> SuffixIndex:
        base = base.where("s IS NOT NULL AND v IS NOT NULL").select("id", "s", "v")
        rows = places(base.select(F.col("id").alias("sid"), "s", F.lit(1).cast("long").alias("copies")))
        return SuffixIndex(base, rows.select(F.col("sid").alias("id"), "head", "bucket"))

    def save(self, path: str) -> None:
        """Places are dealt and sorted by their letters, so a lookup prunes row groups."""
        self.base.write.mode("overwrite").parquet(f"{path}/base")
        self.places.repartitionByRange("head", "id").sortWithinPartitions("head").write.mode("overwrite").parquet(f"{path}/places")

    @staticmethod
    def load(spark, path: str) -> SuffixIndex:
        return SuffixIndex(*[spark.read.parquet(f"{path}/{n}") for n in ("base", "places")])

    def hits(self, queries: DataFrame) -> DataFrame:
        """(qid, id) of the places whose letters begin with the last START of a query's pattern."""
        asked = queries.where("p <> ''").select("qid", F.substring(F.reverse("p"), 1, START).alias("g"))
        found = None
        for n in range(1, SHORT + 1):
            own = asked.where(F.length("g") >= n if n == SHORT else F.length("g") == n).withColumn("x", F.substring("g", 1, n))
            own = F.broadcast(own) if bounded(queries) else own
            at = self.places.withColumn("x", F.substring("bucket", 1, n)).join(own, "x").where(F.startswith("head", "g")).select("qid", "id")
            found = at if found is None else found.unionAll(at)
        return found.distinct()

    def search(self, queries: DataFrame) -> DataFrame:
        """(qid, rank, id, dist); the empty pattern stands for all rows."""
        rows = self.hits(queries).join(self.base.hint("merge"), "id").join(queries, "qid").where((F.length("p") <= START) | F.contains("s", "p"))
        found = top_k(rows.select("qid", "k", "id", l2(F.col("v"), F.col("qv")).alias("dist")), F.col("k"), largest_k(queries))
        empty = queries.where("p = ''")
        return found if empty.isEmpty() else found.unionAll(exact_topk_batch(self.base, empty))
