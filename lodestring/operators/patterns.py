"""Many patterns in one pass: an automaton of all patterns reads every string once.

A join that looks for each pattern in each string takes time that grows with their product.
Here the patterns of a portion of queries are one automaton, built once a task;
a string's letters are read once, whatever the number of patterns, and only rows and queries
that match get a distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .search import RESULT, Asked, largest_k, portions_of, top_k


class PatternSet:
    """The distinct patterns of some queries, and the queries of each."""

    def __init__(self, patterns: list[str]):
        self.queries: dict[str, list[int]] = {}
        for i, p in enumerate(patterns):
            self.queries.setdefault(p, []).append(i)
        self.every = np.array(self.queries.pop("", []), np.int64)
        self.automaton = ahocorasick.Automaton()
        for p, own in self.queries.items():
            self.automaton.add_word(p, (p, np.array(own, np.int64)))
        if self.queries:
            self.automaton.make_automaton()

    def matching(self, strings: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of all that match."""
        queries, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for row, s in enumerate(strings):
            if s is None:
                continue
            found = dict(v for _, v in self.automaton.iter(s)) if self.queries else {}
            for own in (*found.values(), self.every):
                queries.append(own)
                rows.append(np.full(len(own), row))
        return np.concatenate(queries), np.concatenate(rows)


def best_of(q: np.ndarray, dist: np.ndarray, ids: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Positions of each query's k nearest, in order of query, distance and id."""
    order = np.lexsort((ids, dist, q))
    own = q[order]
    return order[np.arange(len(own)) - np.searchsorted(own, own) < k[own]]


def matching_counts(rows: DataFrame, asked: Asked) -> DataFrame:
    """(qid, cell, matching): how many rows (s, cell) of each cell contain each query's pattern."""
    shipped = rows.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shipped.value
        patterns = PatternSet(asked.patterns)
        total: np.ndarray = np.zeros((len(asked), 0), np.int64)
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                b = whole.slice(start, 512)
                own, row = patterns.matching(b.column("s").to_pylist())
                cell = b.column("cell").to_numpy()[row]
                if len(cell) and cell.max() >= total.shape[1]:
                    total = np.pad(total, ((0, 0), (0, int(cell.max()) + 1 - total.shape[1])))
                np.add.at(total, (own, cell), 1)
        q, cell = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(asked.qids[q]), pa.array(cell.astype(np.int32)), pa.array(total[q, cell])], names=["qid", "cell", "matching"])

    return rows.select("s", "cell").mapInArrow(run, "qid long, cell int, matching long").groupBy("qid", "cell").agg(F.sum("matching").alias("matching"))


def matching_hits(base: DataFrame, asked: Asked, opened: np.ndarray | None = None) -> DataFrame:
    """(qid, k, id, dist): for each query and task, the k nearest rows that contain the pattern.

    opened, with a line a query, tells which cells count for it; base has the cell of each row then.
    """
    shipped = base.sparkSession.sparkContext.broadcast((asked, opened))
    names = ["id", "s", "v", *(["cell"] if opened is not None else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, opened = shipped.value
        patterns = PatternSet(asked.patterns)
        q, dist, ids = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                rows = whole.slice(start, 512)
                own, row = patterns.matching(rows.column("s").to_pylist())
                if opened is not None:
                    kept = opened[own, rows.column("cell").to_numpy()[row]]
                    own, row = own[kept], row[kept]
                x = np.array(rows.column("v").to_pylist(), np.float64).reshape(rows.num_rows, -1)
                if len(own) and x.shape[1] != asked.vectors.shape[1]:
                    raise ValueError(f"vectors of {x.shape[1]} and {asked.vectors.shape[1]} dimensions")
                for a in range(0, len(own), 1 << 16):
                    part, at = own[a : a + (1 << 16)], row[a : a + (1 << 16)]
                    total = np.zeros(len(part))
                    for d in range(x.shape[1]):  # dimension by dimension, so they equal the expression l2
                        total += np.square(x[at, d] - asked.vectors[part, d])
                    q, dist, ids = np.concatenate([q, part]), np.concatenate([dist, np.sqrt(total)]), np.concatenate([ids, rows.column("id").to_numpy()[at]])
                    kept = best_of(q, dist, ids, asked.k)
                    q, dist, ids = q[kept], dist[kept], ids[kept]
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (asked.qids[q], asked.k[q], ids, dist)], names=["qid", "k", "id", "dist"])

    return base.where("v IS NOT NULL").select(*names).mapInArrow(run, "qid long, k long, id long, dist double")


def topk_by_patterns(base: DataFrame, queries: DataFrame) -> DataFrame:
    """The rows of exact_topk_batch(), with a pass over the strings for each portion of queries; those without a vector find nothing."""
    out = base.sparkSession.createDataFrame([], RESULT)
    most = largest_k(queries)
    for portion in portions_of(queries, 32 * most):
        asked = Asked(portion.select("qid", "p", "qv", "k"))
        if len(asked):
            out = out.unionAll(top_k(matching_hits(base, asked), F.col("k"), most))
    return out
