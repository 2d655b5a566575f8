"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct hashed n-grams of its lower-cased, space-normalised bytes.
Each has the ratio r = log(share among toxic texts / share among others), smoothed in
proportion to the classes, so that unseen and rare n-grams have r near 0. Logistic regression
on the n-grams that tell the classes apart best, scaled by r, gives the weights. Their number
and the penalty are those of Settings.features and Settings.penalties whose predictions for
left-out folds fit best, and those predictions, on rows that neither ratios nor weights were
learned from, also give the line that turns sums of weights into probabilities, so that the
threshold means what it says. The classifier is fitted on at most
Settings.sample labelled documents, chosen by the smallest hashes of their ids; scoring reads
every text whole.

Cases: null and empty texts have no features and get the score of the intercept; labels that
are null, or whose document is missing, teach nothing; of several labels of one document the
largest counts, and of several texts under one id the smallest teaches; repeated rows are
scored one by one; texts of any length are read whole; input columns named like a new one are
replaced; without labels of both kinds every score is 0.5; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, encoded, field, pick, stage


@dataclass(frozen=True)
class Settings:
    sample: int = 10_000  #: labelled documents that the classifier is fitted on, at most
    sizes: tuple[int, ...] = (4, 5, 6)
    bits: int = 18
    features: tuple[int, ...] = (1 << 6, 1 << 8, 1 << 10, 1 << 12)  #: numbers of features to choose from, ascending
    smoothing: float = 20.0
    penalties: tuple[float, ...] = (2e-3, 5e-3, 1e-2, 2e-2)
    folds: int = 3  #: exact copies of a text are in one fold
    steps: int = 40


@dataclass
class Model:
    weights: np.ndarray  #: by feature; ratio times regression weight
    intercept: float


def ngrams(text: str | None, s: Settings) -> np.ndarray:
    """The distinct features of a text, in no certain order."""
    words = encoded(text).lower().split()
    if not words:
        return np.zeros(0, np.int64)
    b = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8).astype(np.uint64)
    out = []
    acc, step = np.zeros(len(b), np.uint64), np.uint64(0x100000001B3)
    for n in range(1, max(s.sizes) + 1):
        if n > len(b):
            break
        acc = acc[: len(b) - n + 1] * step + b[n - 1 :]
        if n in s.sizes:
            out.append(((acc + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - s.bits))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


class Distinct:
    """Picks one of each value without sorting: every value's slot names its last position."""

    def __init__(self, size: int):
        self.slot = np.zeros(size, np.int64)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        at = np.arange(len(values))
        self.slot[values] = at
        return values[self.slot[values] == at]


def ratios(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int, s: Settings) -> np.ndarray:
    share = n_pos / (n_pos + n_neg)
    a, b = s.smoothing * share, s.smoothing * (1 - share)
    return np.log((pos + a) / (n_pos + a)) - np.log((neg + b) / (n_neg + b))


def evidence(by: np.ndarray, n: np.ndarray) -> np.ndarray:
    """By feature: the likelihood ratio (G) of its presence and the label; by and n are counts by label."""
    total = 0.0
    for seen, of in ((by, by.sum(0)), (n[:, None] - by, n.sum() - by.sum(0))):
        for label in (0, 1):
            expected = of * (n[label] / n.sum())
            total = total + seen[label] * np.log(np.maximum(seen[label], 1) / np.where(seen[label] > 0, expected, 1))
    return total


def strongest(by: np.ndarray, n: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(ratios, ranks) of all features, rank 0 being that with the most evidence; by and n are counts by label."""
    rank = np.empty(by.shape[1], np.int64)
    rank[np.argsort(-evidence(by, n), kind="stable")] = np.arange(by.shape[1])
    return ratios(by[1], by[0], int(n[1]), int(n[0]), s), rank


def line(z: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(slope, shift) for probabilities of sums z: logistic regression near slope 1 and shift 0, by damped Newton steps."""
    n1, n0 = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, start = np.stack((z, np.ones(len(z))), 1), np.array([1.0, 0.0])
    hold = np.diag([1.0, 0.1])

    def loss(c: np.ndarray) -> float:
        m = x @ c
        return float(np.sum(np.logaddexp(0, m) - target * m) + 0.5 * (c - start) @ hold @ (c - start))

    c = start
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold, x.T @ (p - target) + hold @ (c - start))
        size = 1.0
        while size > 1e-4 and loss(c - size * step) > loss(c):
            size /= 2
        if size <= 1e-4:
            break
        c = c - size * step
    return float(c[0]), float(c[1])


def cross_fitted(rows: list[np.ndarray], labels: np.ndarray, fold: np.ndarray, by: np.ndarray, n: np.ndarray, s: Settings) -> Model:
    """The model of all rows, its size, penalty and line found on left-out folds; by and n are counts by fold and label."""
    best = None
    parts = [f for f in range(s.folds) if (n.sum(0) - n[f] > 0).all() and (fold == f).any()]
    found = {f: strongest(by.sum(0) - by[f], n.sum(0) - n[f], s) for f in parts}
    for size in s.features if parts else s.features[-1:]:
        short = {f: [r[found[f][1][r] < size] for r in rows] for f in parts}
        for penalty in s.penalties if parts else s.penalties[:1]:
            z = np.full(len(rows), np.nan)
            for f in parts:
                rest = [i for i in range(len(rows)) if fold[i] != f]
                model = regress([short[f][i] for i in rest], labels[rest], found[f][0], s, penalty)
                for i in np.nonzero(fold == f)[0].tolist():
                    z[i] = model.intercept + model.weights[short[f][i]].sum()
            seen = np.isfinite(z)
            slope, shift = line(z[seen], labels[seen]) if seen.any() else (1.0, 0.0)
            m = slope * z[seen] + shift
            loss = float(np.mean(np.logaddexp(0, m) - labels[seen] * m)) if seen.any() else 0.0
            if best is None or loss < best[0]:
                best = (loss, size, penalty, slope, shift)
    _, size, penalty, slope, shift = best
    ratio, rank = strongest(by.sum(0), n.sum(0), s)
    model = regress([r[rank[r] < size] for r in rows], labels, ratio, s, penalty)
    return Model(slope * model.weights, slope * model.intercept + shift)


def regress(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, s: Settings, penalty: float) -> Model:
    """Logistic regression with ridge penalty on ratio-scaled binary features; full-batch Adam."""
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    used, at = np.unique(flat, return_inverse=True)
    scale = ratio[used]
    w, b = np.ones(len(used)) * 0.1, float(np.log((labels.mean() + 1e-6) / (1 - labels.mean() + 1e-6)))
    m, v = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, s.steps + 1):
        z = np.bincount(doc, weights=(w * scale)[at], minlength=len(rows)) + b
        err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / len(rows)
        g = np.append(np.bincount(at, weights=err[doc], minlength=len(used)) * scale + penalty * w, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    weights = np.zeros(len(ratio))
    weights[used] = w * scale
    return Model(weights, float(b))


def held_out(doc_id: int | None, of: int = 3, part: int = 1) -> bool:
    """crc32 of the id as text, modulo `of`; a null id counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % of == part


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learns from the labelled documents that aren't held out."""
    teach = pick(labels, id_col, label_col).toDF("doc_id", "y").dropna().groupBy("doc_id").agg(F.max("y").alias("y"))
    teach = teach.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    teach = teach.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.sample)  # this bound makes the broadcast safe
    joined = pick(docs, id_col, text_col).toDF("doc_id", "text").join(F.broadcast(teach), "doc_id")
    one = joined.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("y").alias("y"))
    fold = F.pmod(F.xxhash64("text"), F.lit(s.folds)).cast("int")
    rows = stage(one.select("text", (F.col("y") > 0).cast("int").alias("y"), fold.alias("fold")), "taught").repartition(2)  # at most s.sample rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct, by, n = Distinct(1 << s.bits), np.zeros((s.folds, 2, 1 << s.bits), np.int32), np.zeros((s.folds, 2), np.int64)
        for batch in batches:
            for text, y, f in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by[f, y][distinct(ngrams(text, s))] += 1
                n[f, y] += 1
        yield pa.RecordBatch.from_arrays([pa.array([by.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], names=["by", "n"])

    parts = rows.mapInArrow(count, "by binary, n binary").collect()  # two rows of a fixed size
    by = sum((np.frombuffer(p.by, np.int32).reshape(s.folds, 2, -1).astype(np.int64) for p in parts), np.zeros((s.folds, 2, 1 << s.bits), np.int64))
    n = sum((np.frombuffer(p.n, np.int64).reshape(s.folds, 2) for p in parts), np.zeros((s.folds, 2), np.int64))
    if not n.sum(0).all():
        return Model(np.zeros(1 << s.bits), 0.0)
    needed = strongest(by.sum(0), n.sum(0), s)[1] < s.features[-1]
    for f in range(s.folds):
        if (n.sum(0) - n[f] > 0).all():
            needed |= strongest(by.sum(0) - by[f], n.sum(0) - n[f], s)[1] < s.features[-1]

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct = Distinct(1 << s.bits)
        for batch in batches:
            found = [distinct(f[needed[f]]).astype(np.int32).tobytes() for f in (ngrams(t, s) for t in batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column(1), batch.column(2)], names=["features", "y", "fold"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, y, folds = [], [], []
        for batch in batches:
            features += [np.frombuffer(x, np.int32).astype(np.int64) for x in batch.column(0).to_pylist()]
            y += batch.column(1).to_pylist()
            folds += batch.column(2).to_pylist()
        model = cross_fitted(features, np.array(y, np.float64), np.array(folds), by, n, s)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.intercept])], names=["weights", "intercept"])

    # one task for at most s.sample rows; order, which sums depend on, is fixed
    found = rows.mapInArrow(chosen, "features binary, y int, fold int").repartition(1).sortWithinPartitions("features", "y").mapInArrow(train, "weights binary, intercept double").first()
    return Model(np.frombuffer(found.weights, np.float64), found.intercept)


def scorer(model: Model, s: Settings):
    """A function from texts to probabilities."""
    distinct, weights = Distinct(1 << s.bits), model.weights
    active = weights != 0

    def work(texts: list) -> list[float]:
        z = []
        for t in texts:
            f = ngrams(t, s)
            z.append(model.intercept + float(weights[distinct(f[active[f]])].sum()))
        return (1 / (1 + np.exp(-np.clip(np.array(z, np.float64), -50, 50)))).tolist()

    return work


def score(df: DataFrame, model: Model, s: Settings = Settings(), text_col: str = "text", score_col: str = "score", threshold: float = 0.7) -> DataFrame:
    """df with the score and predicted (1 from the threshold on)."""
    shipped = df.sparkSession.sparkContext.broadcast(model)  # 8 bytes a bucket: 2 MB

    def make():
        of = scorer(shipped.value, s)

        def work(texts: list) -> dict:
            p = of(texts)
            return {score_col: p, "predicted": [int(x >= threshold) for x in p]}

        return work

    return append_columns(df, text_col, make, [field(score_col, T.DoubleType()), field("predicted", T.IntegerType())])


def drop_toxic(df: DataFrame, model: Model, s: Settings = Settings(), text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of df that score below the threshold, unchanged."""
    shipped = df.sparkSession.sparkContext.broadcast(model)

    def make():
        of = scorer(shipped.value, s)
        return lambda texts: {"clean": [x < threshold for x in of(texts)]}

    return append_columns(df, text_col, make, [], keep="clean")
