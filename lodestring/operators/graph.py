"""A neighbour graph as a table of edges, and best-first search over it by joins.

Build: rows are sorted by the signs of a few random projections, and runs of them are compared
among themselves; each row keeps its `degree` nearest. Then rounds improve this: a row's
neighbours, and as many of those that have it as theirs, meet in one place with their vectors,
are compared, and leave pairs that are nearer than the worst that either has. A row's list has
a bounded length on both sides, so hubs don't grow.

Each row also gets the rows beside it in CHAINS random orders: groups that lie far apart would
have no way between them otherwise.

Search: a query starts from the nearest of a bounded sample. Its `ef` nearest rows so far, with
their distances, are in a table; in each round, the nearest of these that aren't opened yet bring
their neighbours, which are scored unless they are there. It ends when all of a query's ef
nearest are opened. A wider ef scores more rows and finds more.

Null vectors take no part; rows and queries have one row an id; vectors are of one dimension.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import l2
from ..plans.storage import checkpointed, rewritten
from .search import BROADCAST_BYTES, bounded, largest_k, top_k

EDGE = "a long, b long, dist double"
CHAINS = 2
LEAF = 64  # rows of a run that are compared in the first graph


def vectors_of(batch: pa.RecordBatch | pa.Table, name: str = "v") -> np.ndarray:
    return np.array(batch.column(name).to_pylist(), np.float64).reshape(batch.num_rows, -1)


def edge_batch(a: list, b: list, dist: list) -> pa.RecordBatch:
    parts = [np.concatenate(x) if x else np.zeros(0) for x in (a, b, dist)]
    return pa.RecordBatch.from_arrays([pa.array(parts[0].astype(np.int64)), pa.array(parts[1].astype(np.int64)), pa.array(parts[2].astype(np.float64))], names=["a", "b", "dist"])


def squares(x: np.ndarray) -> np.ndarray:
    """Squared distances of all rows; only their order counts."""
    n = np.square(x).sum(1)
    return np.maximum(n[:, None] + n[None, :] - 2 * (x @ x.T), 0)


def in_runs(rows: DataFrame, degree: int, tables: int, seed: int) -> DataFrame:
    """(a, b, dist) of each row's nearest within runs of LEAF rows with like signs."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = vectors_of(b)
            for t in range(tables):
                planes = np.random.default_rng([seed, t]).normal(size=(x.shape[1], 24))
                code = ((x @ planes > 0) << np.arange(24)).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(code.astype(np.int64)), b.column("id"), b.column("v")], names=["t", "code", "id", "v"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in chain(batches, [None]):
            t = pa.Table.from_batches([b]) if b is not None else None
            held = t if held is None else held if t is None else pa.concat_tables([held, t])
            if held is None:
                return
            whole = held.num_rows if b is None else held.num_rows // LEAF * LEAF
            out = [], [], []
            for s in range(0, whole, LEAF):
                part = held.slice(s, min(LEAF, whole - s)).combine_chunks()
                ids, table = part.column("id").to_numpy(), part.column("t").to_numpy()
                d = squares(vectors_of(part))
                d[(ids[:, None] == ids[None, :]) | (table[:, None] != table[None, :])] = np.inf
                near = np.argsort(d, axis=1)[:, :degree]
                keep = np.isfinite(np.take_along_axis(d, near, 1))
                for o, x in zip(out, (np.repeat(ids, keep.sum(1)), ids[near][keep], np.take_along_axis(d, near, 1)[keep])):
                    o.append(x)
            yield edge_batch(*out)
            held = held.slice(whole)

    schema = next(f.dataType.simpleString() for f in rows.schema.fields if f.name == "v")
    dealt = rows.mapInArrow(keyed, f"t int, code long, id long, v {schema}").repartitionByRange("t", "code", "id").sortWithinPartitions("t", "code", "id")
    return dealt.mapInArrow(compared, EDGE)


def nearest_edges(found: DataFrame, degree: int) -> DataFrame:
    """The degree nearest of each row's edges, each once."""
    once = found.repartition("a").groupBy("a", "b").agg(F.min("dist").alias("dist"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy("dist", "b"))
    return once.withColumn("r", rank).where(F.col("r") <= degree).drop("r")


def both_ways(edges: DataFrame, degree: int) -> DataFrame:
    """(a, b): each row's neighbours, and the degree nearest of the rows that have it as theirs."""
    back = nearest_edges(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "dist"), degree)
    return edges.select("a", "b").unionAll(back.select("a", "b")).distinct()


def improved(rows: DataFrame, edges: DataFrame, degree: int) -> DataFrame:
    """(a, b, dist) of pairs of rows that have a neighbour in common and are nearer than the worst that either has."""
    worst = edges.groupBy("a").agg(F.when(F.count("*") < degree, float("inf")).otherwise(F.max("dist")).alias("worst"))
    known = rows.join(worst.withColumnRenamed("a", "id"), "id", "left").select(F.col("id").alias("b"), "v", F.coalesce("worst", F.lit(float("inf"))).alias("worst"))
    met = both_ways(edges, degree).join(known, "b").select("a", "b", "v", "worst").repartition("a").sortWithinPartitions("a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in chain(batches, [None]):
            t = pa.Table.from_batches([b]) if b is not None else None
            held = t if held is None else held if t is None else pa.concat_tables([held, t])
            if held is None:
                return
            own = held.column("a").to_numpy()
            whole = len(own) if b is None else int(np.searchsorted(own, own[-1])) if len(own) else 0
            if not whole:
                continue
            part = held.slice(0, whole).combine_chunks()
            x, ids, worst = vectors_of(part), part.column("b").to_numpy(), part.column("worst").to_numpy()
            edge = [0, *(np.nonzero(own[1:whole] != own[: whole - 1])[0] + 1).tolist(), whole]
            out = [], [], []
            for s, e in zip(edge, edge[1:]):
                d = squares(x[s:e])
                i, j = np.nonzero((d < worst[s:e, None]) & (ids[s:e, None] != ids[None, s:e]))
                for o, y in zip(out, (ids[s + i], ids[s + j], d[i, j])):
                    o.append(y)
            yield edge_batch(*out)
            held = held.slice(whole)

    return met.mapInArrow(run, EDGE)


def chained(rows: DataFrame, seed: int) -> DataFrame:
    """(a, b) of rows that stand beside each other in a random order, within the tasks that sort it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            ids = b.column("id").to_numpy()
            own = ids if last is None else np.concatenate(([last], ids))
            last = ids[-1] if len(ids) else last
            yield pa.RecordBatch.from_arrays([pa.array(own[:-1]), pa.array(own[1:])], names=["a", "b"])

    dealt = rows.select("id", F.xxhash64("id", F.lit(seed)).alias("h")).repartitionByRange("h").sortWithinPartitions("h", "id")
    links = dealt.mapInArrow(run, "a long, b long")
    return links.unionAll(links.select("b", "a"))


class NeighbourGraph:
    """Edges (a, b) in both directions, bounded a row; entries are the rows that searches start from."""

    def __init__(self, rows: DataFrame, edges: DataFrame, entries: DataFrame):
        self.rows, self.edges, self.entries = rows, edges, entries

    @staticmethod
    def build(base: DataFrame, degree: int = 16, rounds: int = 4, tables: int = 3, sample: int = 256, seed: int = 7) -> NeighbourGraph:
        spark = base.sparkSession
        rows = checkpointed(spark, base.where("v IS NOT NULL").select("id", "v"))
        edges = checkpointed(spark, nearest_edges(in_runs(rows, degree, tables, seed), degree))
        for _ in range(rounds):
            edges = rewritten(spark, nearest_edges(edges.unionAll(improved(rows, edges, degree)), degree), edges)
        entries = checkpointed(spark, rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample))
        links = both_ways(edges, degree)
        for c in range(CHAINS):
            links = links.unionAll(chained(rows, seed + c))
        return NeighbourGraph(rows, checkpointed(spark, links.distinct()), entries)

    def save(self, path: str) -> None:
        for name in ("rows", "edges", "entries"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @staticmethod
    def load(spark, path: str) -> NeighbourGraph:
        return NeighbourGraph(*[spark.read.parquet(f"{path}/{n}") for n in ("rows", "edges", "entries")])

    def walk(self, queries: DataFrame, ef: int, log: tuple[list, list] | None = None) -> DataFrame:
        """(qid, id, dist) of each query's ef nearest rows that a search finds; log gets the rows scored and the rows opened, by round.

        Only the ef nearest go from round to round: what is farther can't come back, and may be scored again.
        """
        spark = self.rows.sparkSession
        asked = checkpointed(spark, queries.where("qv IS NOT NULL").select("qid", "qv"))
        asked = F.broadcast(asked) if bounded(queries) else asked
        near = l2(F.col("v"), F.col("qv")).alias("dist")
        by = Window.partitionBy("qid").orderBy("dist", "id")
        width = max(4, ef // 4)  # rows opened a round
        scored, pool = asked.join(F.broadcast(self.entries)).select("qid", "id", near), None  # entries are a bounded sample
        while True:
            if log:
                scored = checkpointed(spark, scored)
                log[0].append(scored)
            met = scored.withColumn("opened", F.lit(False))
            met = met if pool is None else pool.select("qid", "id", "dist", (F.col("opened") | F.col("now")).alias("opened")).unionAll(met)
            best = met.withColumn("place", F.row_number().over(by)).where(F.col("place") <= ef)
            turn = F.sum((~F.col("opened")).cast("int")).over(by)
            marked = best.select("qid", "id", "dist", "opened", (~F.col("opened") & (turn <= width)).alias("now"))
            pool = rewritten(spark, marked, *[] if pool is None else [pool])
            front = pool.where("now").select("qid", F.col("id").alias("a"))
            if front.isEmpty():
                return pool.select("qid", "id", "dist")
            if log:
                log[1].append(checkpointed(spark, front.withColumnRenamed("a", "id")))
            reached = front.join(self.edges, "a").select("qid", F.col("b").alias("id")).distinct()
            new = reached.join(pool.select("qid", "id"), ["qid", "id"], "left_anti")
            scored = new.join(self.rows, "id").join(asked, "qid").select("qid", "id", near)

    def explore(self, queries: DataFrame, ef: int) -> DataFrame:
        """(qid, id, dist, opened) of all rows that a search of each query scored; its ef nearest are all opened."""
        log = [], []
        self.walk(queries, ef, log)
        scored, opened = (reduce(DataFrame.unionAll, x) if x else None for x in log)
        scored = scored.dropDuplicates(["qid", "id"])
        if opened is None:
            return scored.withColumn("opened", F.lit(False))
        return scored.join(opened.withColumn("opened", F.lit(True)), ["qid", "id"], "left").select("qid", "id", "dist", F.coalesce("opened", F.lit(False)).alias("opened"))

    def nearest(self, queries: DataFrame, ef: int) -> DataFrame:
        """(qid, rank, id, dist): about the ef nearest rows of each query."""
        return top_k(self.walk(queries, ef), ef, ef)


def graph_topk(graph: NeighbourGraph, base: DataFrame, queries: DataFrame, ef: int = 64) -> DataFrame:
    """Rank by the graph, filter after: of each query's max(ef, k) nearest rows that the search finds, those with the pattern."""
    most = largest_k(queries)
    depth = max(ef, most, 1)
    near = checkpointed(base.sparkSession, graph.nearest(queries.where("k > 0"), depth))
    asked = queries.select("qid", "p", "k")
    ranked = near.join(asked, "qid").where(F.col("rank") <= F.greatest(F.lit(ef), F.col("k")))
    ranked = F.broadcast(ranked) if near.count() <= BROADCAST_BYTES // 64 else ranked  # then strings stay where they are
    hits = base.select("id", "s").join(ranked, "id").where(F.contains("s", "p"))
    return top_k(hits.select("qid", "k", "id", "dist"), F.col("k"), most)
