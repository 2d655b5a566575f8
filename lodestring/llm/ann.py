"""Approximate nearest neighbours by additive quantisation.

A vector is its norm and a direction; a direction is coded as the sum of one entry from each
of CODEBOOKS codebooks, all of full dimension. Codebooks are fitted one after another on what
the ones before leave over, on a bounded sample; encoding keeps the BEAM best partial sums.
A stored vector's product with a query is that of its code times the stored norm, and lies
within the code's stored error of it, by Cauchy-Schwarz. Rows that may be in a result by that
bound are computed exactly, in double precision, on the original vectors.

Every row is indexed, in the cell of its code's first entry; a cell is kept in blocks. The k-th
product of a query within the sample is one that its k-th row reaches at least; it visits the
cells that may hold such products by their entry, the largest distance from it and the norms in
them. So results are exact on any vectors; the bounds decide only how much is computed. Queries
are copied to the cells that they visit, packed there, and each block of a cell gives each
query's best rows; those are merged by query. Cells with more rows are dealt into more parts, so
no task takes a hot cell. Of many copies of one vector a block only considers as many as could
be in a result, smallest ids first. Settings.visits and rerank trade exactness for time.

Cases: vectors that are null, zero, of another dimension than the sample's commonest, or hold
null or non-finite components take no part; a null id takes no part; repeated rows are
candidates each on their own, but rows with the query's own id are not; a query id in several
rows is asked with the least of its vectors that take part; products are of the table's own floats
or doubles; ties of a product go to the smaller id; an empty table, or one
without queries, gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, stage


@dataclass(frozen=True)
class Settings:
    sample: int = 8192  #: vectors that codebooks are fitted on, at most
    codebooks: int = 16
    entries: int = 256
    rounds: int = 6
    beam: int = 4
    rerank: int = 0  #: rows of a block that are computed exactly for a query, at most, but k + 1 at least; 0: all that may be in its result
    visits: int = 0  #: cells that a query visits, at most; 0: all that may hold a row of its result
    block_rows: int = 8192
    block_queries: int = 512


def usable(vectors: list, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, matrix) of the vectors that take part."""
    at = [i for i, v in enumerate(vectors) if v is not None and len(v) == dim and None not in v]
    x = np.array([vectors[i] for i in at], np.float64).reshape(len(at), dim)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return np.array(at, np.int64)[good], x[good]


def takes_part(vector: str, dim: int):
    """usable(), as a condition."""
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return (F.size(x) == dim) & ~bad & F.exists(x, lambda v: v != 0)


def unit(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    most = np.abs(x).max(1, initial=0).astype(np.float64)  # squares of very large or small components leave the doubles
    x = x.astype(np.float64) / most[:, None]
    norm = np.linalg.norm(x, axis=1)
    with np.errstate(over="ignore"):
        return (x / norm[:, None]).astype(np.float32), most * norm


def nearest(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    return np.argmin((entries * entries).sum(1) - 2 * (x @ entries.T), axis=1)


def train(x: np.ndarray, s: Settings, seed: int = 7) -> np.ndarray:
    """Codebooks (codebook, entry, dimension) fitted to the residuals of unit vectors."""
    rng, rest, books = np.random.default_rng(seed), x.copy(), []
    for _ in range(s.codebooks):
        book = rest[rng.choice(len(rest), s.entries, replace=len(rest) < s.entries)].copy()
        for _ in range(s.rounds):
            code = nearest(rest, book)
            n = np.bincount(code, minlength=s.entries)
            total = np.zeros_like(book)
            np.add.at(total, code, rest)
            book[n > 0] = total[n > 0] / n[n > 0, None]
            if (n == 0).any():
                book[n == 0] = rest[rng.choice(len(rest), int((n == 0).sum()))]
        rest = rest - book[nearest(rest, book)]
        books.append(book)
    return np.stack(books)


def encode(x: np.ndarray, books: np.ndarray, beam: int) -> np.ndarray:
    """Codes of unit vectors: beam search over the codebooks."""
    out = []
    for start in range(0, len(x), 512):
        part = x[start : start + 512]
        n = len(part)
        rest, code = part[:, None, :], np.zeros((n, 1, 0), np.uint8)
        for book in books:
            width = rest.shape[1]
            left = (rest * rest).sum(2)[:, :, None] - 2 * (rest @ book.T) + (book * book).sum(1)
            flat = left.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            row, entry = best // len(book), best % len(book)
            at = np.arange(n)[:, None]
            rest = rest[at, row] - book[entry]
            code = np.concatenate((code[at, row], entry[:, :, None].astype(np.uint8)), axis=2)
            assert width <= beam
        last = np.argmin((rest * rest).sum(2), axis=1)
        out.append(code[np.arange(n), last])
    return np.concatenate(out) if out else np.zeros((0, len(books)), np.uint8)


def few_copies(x: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Positions, in order of id, of at most so many rows of each vector: those of the smallest ids."""
    order = np.argsort(ids, kind="stable")
    rows = np.ascontiguousarray(x[order]).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
    _, group = np.unique(rows, return_inverse=True)
    by_group = np.argsort(group, kind="stable")
    sorted_group = group[by_group]
    start = np.searchsorted(sorted_group, sorted_group)
    nth = np.empty(len(order), np.int64)
    nth[by_group] = np.arange(len(order)) - start
    return order[nth < most]


def decoded(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    """The directions that codes stand for."""
    total = np.zeros((len(codes), books.shape[2]), np.float32)
    for m, book in enumerate(books):
        total += book[codes[:, m]]
    return total


#: Of rounding: in products of unit vectors as floats and of their parts, and in products as doubles.
LOOSE, TIGHT = 1e-4, 1e-10


def best_of_block(q: np.ndarray, q_ids: np.ndarray, floor: np.ndarray, rows: tuple, books: np.ndarray, k: int, rerank: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query ids, row ids, exact products) of each query's k best rows, of those that reach its floor; rows: ids, vectors, codes, norms, errors of the codes."""
    ids, x, codes, norm, error = rows
    y, x64 = decoded(codes, books), x.astype(np.float64)
    direction, length = unit(q)
    for a in range(0, len(q), 64):
        q64, own, size = q[a : a + 64].astype(np.float64), q_ids[a : a + 64], length[a : a + 64]
        with np.errstate(all="ignore"):  # what is not finite stays in
            most = ((y @ direction[a : a + 64].T) + (error + LOOSE)[:, None]) * norm[:, None] * size
            fits = ~(most < floor[a : a + 64]) & (ids[:, None] != own)
            if 0 < rerank < len(ids):
                most[~fits] = -np.inf
                fits &= most >= -np.partition(-most, rerank - 1, axis=0)[rerank - 1]
            near = np.nonzero(fits.any(1))[0]
            fits, exact = fits[near], x64[near] @ q64.T
            exact[~fits] = -np.inf
            if len(near) > k:
                least = -np.partition(-exact, k - 1, axis=0)[k - 1] - TIGHT * size * norm[near].max()
                fits &= ~(exact < least)
            row, j = np.nonzero(fits)
            row = near[row]
            score = (x64[row] * q64[j]).sum(1)
        order = np.lexsort((ids[row], -score, j))
        j = j[order]
        order = order[np.arange(len(j)) - np.searchsorted(j, j) < k]
        row, j = row[order], np.sort(j[np.arange(len(j)) - np.searchsorted(j, j) < k])
        yield own[j], ids[row], score[order]


def floors(q: np.ndarray, q_ids: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """A product that each query's k-th best row reaches at least: that of its k-th best among sample rows."""
    if len(ids) < k:
        return np.full(len(q), -np.inf)
    with np.errstate(all="ignore"):
        near = q.astype(np.float64) @ x.T
        near[q_ids[:, None] == ids] = -np.inf
        least = -np.partition(-near, k - 1, axis=1)[:, k - 1] - TIGHT * unit(q)[1] * unit(x)[1].max()
    return np.where(np.isfinite(least), least, -np.inf)


def cells_of(q: np.ndarray, floor: np.ndarray, book: np.ndarray, cells: tuple, visits: int) -> np.ndarray:
    """Which cells may hold a row whose product with a query reaches its floor; cells: numbers, largest distances from the entry, least and largest norms."""
    number, reach, small, large = cells
    direction, length = unit(q)
    out = np.zeros((len(q), len(book)), bool)
    with np.errstate(all="ignore"):
        most = direction @ book[number].T + reach + LOOSE
        out[:, number] = ~(np.maximum(most * small, most * large) * length[:, None] < floor[:, None])
    if 0 < visits < len(book):
        rank = np.argsort(np.argsort(-(direction @ book.T), axis=1, kind="stable"), axis=1)
        out &= rank < visits
    return out


def coded_rows(df: DataFrame, dim: int, books, beam: int, kind: str) -> DataFrame:
    """(vec_id, cell, x, code, norm, error, reach) of the rows that take part: how far its code and its cell's entry are from a row's direction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = usable(batch.column(1).to_pylist(), dim)
            u, norm = unit(x) if len(x) else (x, np.zeros(0))
            code = encode(u, books.value, beam)
            cell = code[:, 0].astype(np.int32)
            error, reach = (np.linalg.norm(u - y, axis=1).astype(np.float64) for y in (decoded(code, books.value), books.value[0][cell]))
            columns = [batch.column(0).take(pa.array(at)), pa.array(cell), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary()), pa.array([r.tobytes() for r in code], pa.binary()), pa.array(norm), pa.array(error), pa.array(reach)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cell", "x", "code", "norm", "error", "reach"])

    return df.mapInArrow(run, "vec_id long, cell int, x binary, code binary, norm double, error double, reach double")


def visiting_rows(df: DataFrame, dim: int, shipped, k: int, visits: int, kind: str) -> DataFrame:
    """(vec_id, cell, x, floor) of the queries that take part, a row for each cell that they visit; shipped: codebooks, sample ids and vectors, cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, ids, sampled, cells = shipped.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                at, x = usable(part.column(1).to_pylist(), dim)
                if not len(x):
                    continue
                floor = floors(x, part.column(0).to_numpy()[at], ids, sampled, k)
                rows, cell = np.nonzero(cells_of(x, floor, books[0], cells, visits))
                packed = pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at[rows])), pa.array(cell.astype(np.int32)), packed.take(pa.array(rows)), pa.array(floor[rows])], names=["vec_id", "cell", "x", "floor"])

    return df.mapInArrow(run, "vec_id long, cell int, x binary, floor double")


def packed_by_cell(df: DataFrame, rows: int, dim: int, kind: str, most: int | None = None) -> DataFrame:
    """Blocks of at most so many rows of one cell and part, which stand together in df; most: of copies of one vector."""
    names = [c for c in df.columns if c not in ("cell", "part")]
    doubles = [n for n in names if n not in ("vec_id", "x", "code")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            held.clear()
            ids = table.column("vec_id").to_numpy()
            columns = {n: b"".join(table.column(n).to_pylist()) for n in names if n in ("x", "code")}
            x = np.frombuffer(columns["x"], kind).reshape(len(ids), dim)
            at = np.argsort(ids, kind="stable") if most is None else few_copies(x, ids, most)
            out = {"ids": ids[at].astype("<i8").tobytes(), "x": x[at].tobytes()}
            if "code" in names:
                out["code"] = np.frombuffer(columns["code"], np.uint8).reshape(len(ids), -1)[at].tobytes()
            for n in doubles:
                out[n] = table.column(n).to_numpy()[at].astype("<f8").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), *[pa.array([v], pa.binary()) for v in out.values()]], names=["cell", "part", *out])

        for batch in batches:
            cell, part = batch.column("cell").to_numpy(), batch.column("part").to_numpy()
            edge = np.nonzero((np.diff(cell) != 0) | (np.diff(part) != 0))[0] + 1
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(cell)]):
                own = (int(cell[a]), int(part[a]))
                if held and own != key:
                    yield flush()
                key = own
                while a < b:
                    room = rows - sum(h.num_rows for h in held)
                    held.append(batch.slice(a, min(room, b - a)))
                    a += min(room, b - a)
                    if sum(h.num_rows for h in held) >= rows:
                        yield flush()
        if held:
            yield flush()

    kinds = ", ".join(f"{n} binary" for n in ["ids", "x", *(n for n in names if n == "code"), *doubles])
    return df.repartition("cell", "part").sortWithinPartitions("cell", "part").mapInArrow(run, f"cell int, part long, {kinds}")


def search(df: DataFrame, k: int = 20, every: int = 20, s: Settings = Settings(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows of each row whose id is divisible by `every`."""
    vectors = pick(df, id_col, vector_col).toDF("vec_id", "v").where("vec_id is not null and v is not null")
    order = F.xxhash64("vec_id")
    rows = vectors.select("vec_id", "v").orderBy(order, "vec_id").limit(s.sample).collect()  # bounded
    sample = [r.v for r in rows]
    sizes = Counter(len(v) for v in sample if v)
    dim = max(sizes, key=lambda d: (sizes[d], d), default=0)
    kind = "<f8" if "double" in vectors.schema["v"].dataType.simpleString() else "<f4"  # as precise as the table
    at, x = usable(sample, dim) if dim else (None, np.zeros((0, 1), np.float32))
    spark = df.sparkSession
    if not len(x):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    trained = train(unit(x)[0], s)
    books = spark.sparkContext.broadcast(trained)  # codebooks x entries x dimension numbers
    coded = stage(coded_rows(vectors, dim, books, s.beam, kind), "ann-coded")
    parts = coded.groupBy("cell").agg(F.ceil(F.count("*") / s.block_rows).alias("parts"), F.max("reach"), F.min("norm"), F.max("norm"))
    cells = parts.collect()  # a row a cell
    parts = spark.createDataFrame([(r[0], r[1]) for r in cells], "cell int, parts long")
    bounds = tuple(np.array([r[i] for r in cells], np.int64 if i == 0 else np.float64) for i in (0, 2, 3, 4))
    shipped = spark.sparkContext.broadcast((trained, np.array([rows[i].vec_id for i in at.tolist()], np.int64), x, bounds))
    dealt = coded.drop("reach").join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("vec_id", "x", F.spark_partition_id()), F.col("parts"))).drop("parts")
    blocks = stage(packed_by_cell(dealt, s.block_rows, dim, kind, k + 1), "ann-index")
    asked = vectors.where((F.col("vec_id") % every == 0) & takes_part("v", dim)).groupBy("vec_id").agg(F.min("v").alias("v"))
    visiting = stage(visiting_rows(asked, dim, shipped, k, s.visits, kind), "ann-visits")
    spread = max(1, visiting.count() // (s.block_queries * s.entries))
    packs = packed_by_cell(visiting.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(spread))), s.block_queries, dim, kind)
    copied = packs.drop("part").withColumnsRenamed({"ids": "q_ids", "x": "qx"}).join(F.broadcast(parts), "cell").select("cell", "q_ids", "qx", "floor", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    rerank = s.rerank and max(s.rerank, k + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                get = lambda name, kind: np.frombuffer(batch.column(name)[r].as_py(), kind)  # noqa: B023, E731
                ids = get("ids", "<i8")
                rows = ids, get("x", kind).reshape(-1, dim), get("code", "u1").reshape(len(ids), -1), get("norm", "<f8"), get("error", "<f8")
                for found in best_of_block(get("qx", kind).reshape(-1, dim), get("q_ids", "<i8"), get("floor", "<f8"), rows, books.value, k, rerank):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "vec_id", "score"])

    pairs = blocks.join(copied.hint("shuffle_hash"), ["cell", "part"]).select("ids", "x", "code", "norm", "error", "q_ids", "qx", "floor")
    found = pairs.mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
