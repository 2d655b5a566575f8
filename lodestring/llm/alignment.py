"""Alignment of two tokenizers over a corpus: which ids of the one stand where which of the other do.

Both tokenizers cut one and the same bytes: a space and the text. Where tokens of both end,
there is a group's end; tokens whose bytes overlap are linked. A link's ids are packed into
one 64-bit key, id of B above id of A. Tasks count the keys of their documents by np.unique;
these partial counts are dealt by range and sorted over the whole corpus, and runs of one key
are summed. Each range is then a shard: two arrays, ascending keys and their counts, in files
of the shared folder. The last pass maps these files into memory and looks keys up by
searchsorted.

Documents are encoded once; their links are staged beside them. How many keys there are is
bounded by the two vocabularies, not by the corpus, and a worker maps a shard only when it
needs one. A shard's file has the attempt's number in its name, and only files of attempts
that Spark reports as done are read, so lost executors do no harm.

Cases: null and empty texts, and texts whose tokens don't spell a space and the text in either
tokenizer (B writes spaces as U+2581, so a text that holds that sign doesn't), have no tokens;
strings of special tokens are plain text; a null doc_id and repeated rows give a row each; a
text of any length is aligned whole; ties for a token's highest count all count; other columns
aren't read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, shared_path, slices_by_bytes, stage
from .tokens import byte_alphabet, encoder

HELD = 1 << 22  # links, or counts, that a task holds before it merges them or gives them out
STAGED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, links binary, groups string, groups_sha256 string"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

_LOADED: dict[tuple[str, str], Aligner] = {}


class Aligner:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        self.a = encoder(path_a, plain=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = {c: i for i, c in enumerate(byte_alphabet())}
        self.bytes_a = [b""] * self.a.library.get_vocab_size()
        for token, i in self.a.library.get_vocab().items():
            self.bytes_a[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.piece_size())]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.written = [f"{i}{c}" for i in range(len(self.bytes_a)) for c in ",|"] + [f"{i}{c}" for i in range(len(self.bytes_b)) for c in ",;"]

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The ids of each text by A and by B; none for texts without tokens."""
        some = [i for i, t in enumerate(texts) if t]
        a, b = ([np.zeros(0, np.int64)] * len(texts) for _ in "ab")
        flat, ends = self.a.encode([" " + texts[i] for i in some])
        start = 0
        for i, end, own in zip(some, ends.tolist(), self.b.encode([texts[i] for i in some], num_threads=1) if some else ()):
            want = b" " + texts[i].encode()
            ids = flat[start:end].astype(np.int64)
            if b"".join(map(self.bytes_a.__getitem__, ids.tolist())) == want == b"".join(map(self.bytes_b.__getitem__, own)):
                a[i], b[i] = ids, np.array(own, np.int64)
            start = end
        return a, b

    def align(self, texts: list[str | None]) -> tuple[list[list[int]], list[np.ndarray], list[str]]:
        """(n_a, n_b, n_groups, n_links), packed links and written groups of each text."""
        own_a, own_b = self.encode(texts)
        n_a, n_b = np.array([len(x) for x in own_a], np.int64), np.array([len(x) for x in own_b], np.int64)
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (own_a, own_b))
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])  # of all texts, one after another
        whole = int(end_a[-1]) if len(a) else 0
        at_a, at_b = np.zeros(whole + 1, bool), np.zeros(whole + 1, bool)
        at_a[end_a], at_b[end_b] = True, True
        cut, group = np.nonzero(at_a | at_b)[0], np.nonzero(at_a & at_b)[0]
        links = b[np.searchsorted(end_b, cut)] << 32 | a[np.searchsorted(end_a, cut)]
        upto_a, upto_b = (np.concatenate(([0], np.searchsorted(e, group, side="right"))) for e in (end_a, end_b))
        code = np.zeros(len(a) + len(b), np.int64)  # in order of groups, A's tokens before B's
        code[np.arange(len(a)) + upto_b[np.searchsorted(group, end_a)]] = 2 * a + at_b[end_a]
        code[np.arange(len(b)) + upto_a[np.searchsorted(group, end_b) + 1]] = 2 * (len(self.bytes_a) + b) + at_a[end_b]
        stop = np.concatenate(([0], np.cumsum(n_a)))
        text_end = np.concatenate(([0], end_a))[stop[1:]] if len(texts) else stop[:0]  # the byte after each text
        by_cut, by_group = (np.concatenate(([0], np.searchsorted(x, text_end, side="right"))) for x in (cut, group))
        tokens = np.concatenate(([0], np.cumsum(n_a + n_b)))
        counts = np.stack([n_a, n_b, np.diff(by_group), np.diff(by_cut)], 1).tolist()
        groups = ["".join(map(self.written.__getitem__, code[x:y].tolist()))[:-1] for x, y in zip(tokens, tokens[1:])]
        return counts, [links[x:y] for x, y in zip(by_cut, by_cut[1:])], groups


def aligner(path_a: str, path_b: str) -> Aligner:
    """One a worker process."""
    if (path_a, path_b) not in _LOADED:
        _LOADED[path_a, path_b] = Aligner(path_a, path_b)
    return _LOADED[path_a, path_b]


def packed(links: np.ndarray) -> bytes:
    """Keys in as many bytes as their ids need: the ids of B, then those of A, of 16 bits or of 32."""
    low, high = links & 0xFFFFFFFF, links >> 32
    kind = "<u2" if max(low.max(initial=0), high.max(initial=0)) < 1 << 16 else "<u4"
    return kind[2:].encode() + high.astype(kind).tobytes() + low.astype(kind).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    high, low = np.frombuffer(data, f"<u{data[:1].decode()}", offset=1).reshape(2, -1).astype(np.int64)
    return high << 32 | low


def aligned(df: DataFrame, path_a: str, path_b: str, with_groups: bool = False) -> DataFrame:
    """The documents (doc_id, text), encoded, with their links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = aligner(path_a, path_b)
        for whole in batches:
            for b in slices_by_bytes(whole, 1):
                counts, links, groups = work.align(b.column(1).to_pylist())
                digest = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                columns = [*[pa.array([c[i] for c in counts], pa.int64()) for i in range(4)], pa.array([packed(x) for x in links], pa.binary()), pa.array(groups if with_groups else [None] * len(groups), pa.string()), pa.array(digest, pa.string())]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "links", "groups", "groups_sha256"])

    return stage(df.mapInArrow(run, STAGED), "aligned")


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys and their counts added up."""
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    start = np.nonzero(np.concatenate(([True], key[1:] != key[:-1])))[0] if len(key) else np.zeros(0, np.int64)
    return key[start], np.add.reduceat(count, start) if len(start) else count


def partial_counts(docs: DataFrame) -> DataFrame:
    """(key, n) of the links of each task's documents; a key more than once only where a task has very many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, held, key, count = [], 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        out = lambda: pa.RecordBatch.from_arrays([pa.array(key), pa.array(count)], names=["key", "n"])

        def add() -> None:
            nonlocal raw, held, key, count
            if raw:
                new, n = np.unique(np.concatenate(raw), return_counts=True)
                key, count = merged([key, new], [count, n])
                raw, held = [], 0

        for b in batches:
            for x in b.column(0):
                raw.append(unpacked(x.as_py()))
                held += len(raw[-1])
                if held >= HELD:
                    add()
                    if len(key) >= HELD:
                        yield out()
                        key, count = key[:0], count[:0]
        add()
        if len(key):
            yield out()

    return docs.select("links").mapInArrow(run, "key long, n long")


def file_system(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


class Shard:
    """Ascending keys and their counts, mapped from a file where the file system is local."""

    def __init__(self, uri: str, n: int):
        files, at = file_system(uri)
        if isinstance(files, pyarrow.fs.LocalFileSystem):
            both = np.memmap(at, "<i8", "r", shape=(2, n))
        else:
            with files.open_input_file(at) as f:
                both = np.frombuffer(f.read(), "<i8").reshape(2, n)
        self.keys, self.counts = both


def count_shards(partial: DataFrame, folder: str) -> list[tuple]:
    """Writes the summed counts; (first key, last key, file, number of keys, highest count of each B id) of every shard, in order.

    Rows come to the driver one a shard, with at most one entry a B id and shard boundary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        keys, counts = [], []
        for b in batches:  # sorted, so runs are summed as they come
            key, n = b.column("key").to_numpy(), b.column("n").to_numpy()
            start = np.nonzero(np.concatenate(([True], key[1:] != key[:-1])))[0]
            key, n = key[start], np.add.reduceat(n, start)
            if keys and keys[-1][-1] == key[0]:
                counts[-1][-1] += n[0]
                key, n = key[1:], n[1:]
            if len(key):
                keys.append(key)
                counts.append(n)
        if not keys:
            return
        key, n = np.concatenate(keys), np.concatenate(counts)
        uri = f"{folder}/shard-{context.partitionId()}-{context.taskAttemptId()}"
        files, at = file_system(uri)
        files.create_dir(at.rsplit("/", 1)[0], recursive=True)
        with files.open_output_stream(at) as f:
            f.write(np.stack([key, n]).astype("<i8").tobytes())
        own = key >> 32
        start = np.nonzero(np.concatenate(([True], own[1:] != own[:-1])))[0]
        row = [[int(key[0])], [int(key[-1])], [uri], [len(key)], [own[start].tolist()], [np.maximum.reduceat(n, start).tolist()]]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(row, kinds)], names=["first", "last", "file", "n", "ids", "best"])

    dealt = partial.repartitionByRange("key").sortWithinPartitions("key")
    rows = stage(dealt.mapInArrow(run, "first long, last long, file string, n long, ids array<long>, best array<long>"), "shards")
    return [tuple(r) for r in rows.orderBy("first").collect()]


class Counts:
    """The counts of the whole corpus, by key; shards are mapped when first asked."""

    def __init__(self, shards: list[tuple]):
        self.first = np.array([s[0] for s in shards], np.int64)
        self.files = [(s[2], s[3]) for s in shards]
        top = max((s[4][-1] for s in shards), default=-1) + 1
        self.best = np.zeros(top, np.int64)
        for s in shards:
            np.maximum.at(self.best, np.array(s[4], np.int64), np.array(s[5], np.int64))
        self.mapped: dict[int, Shard] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"mapped": {}}

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The count of each of some ascending keys, all of which are there."""
        out = np.zeros(len(keys), np.int64)
        where = np.searchsorted(self.first, keys, side="right") - 1
        for i in np.unique(where).tolist():
            if i not in self.mapped:
                self.mapped[i] = Shard(*self.files[i])
            shard, (x, y) = self.mapped[i], np.searchsorted(where, [i, i + 1])
            out[x:y] = shard.counts[np.searchsorted(shard.keys, keys[x:y])]
        return out


def align(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every document, and its groups where asked."""
    docs = aligned(pick(df, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")), path_a, path_b, with_groups)
    spark = df.sparkSession
    shipped = spark.sparkContext.broadcast(Counts(count_shards(partial_counts(docs), shared_path(spark, f"counts-{uuid.uuid4().hex}"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shipped.value
        for whole in batches:
            for b in slices_by_bytes(whole, 5):
                links = [unpacked(x.as_py()) for x in b.column("links")]
                size = np.array([len(x) for x in links], np.int64)
                flat = np.concatenate(links)
                keys, place = np.unique(flat, return_inverse=True)
                n = counts.of(keys)
                best = n == counts.best[keys >> 32]
                stop = np.cumsum(size)
                both = [np.concatenate(([0], np.cumsum(x[place])))[np.stack([stop - size, stop])] for x in (best.astype(np.int64), n)]
                found = [pa.array(x[1] - x[0]) for x in both]
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(5)], *found, b.column("groups_sha256"), *([b.column("groups")] if with_groups else [])], names=[f.split()[0] for f in schema.split(", ")])

    schema = RESULT + (", groups string" if with_groups else "")
    return docs.mapInArrow(run, schema)
