"""Byte-level BPE encoding and decoding by a contiguous rank array.

A short piece of text is two small contiguous lists: the ids of its parts and the merge
rank of each adjacent pair. The lowest rank is found by a scan, its boundary is deleted and
the two neighbouring ranks are looked up again, until no pair can merge. Pieces over
LONG_PIECE bytes would make that scan quadratic; they take a heap over a linked list with
the same order of merges.

Cases: a null or empty text has no ids and decodes to ""; every row is encoded on its own,
so repeated rows give equal results; texts of any length are encoded whole; input columns
named like a new one are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import json
from array import array
from string import ascii_letters

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns, field
from .tokens import byte_alphabet

#: Fixed value: the pattern by which the public byte-level files split text.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters on whose class every Unicode version agrees.
PLAIN = regex.compile(r"[!-~\u00C0-\u012F\u0131-\u017F]+")
LONG_PIECE = 200
NONE = 1 << 60
_LOADED: dict[str, RankArrayBpe] = {}


class RankArrayBpe:
    """Encodes and decodes by a byte-level BPE file (vocabulary, merges, added tokens).

    words bounds the cache of whole words; emptying it never changes a result.
    """

    def __init__(self, path: str, words: int = 300_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("dropout"):
            raise ValueError("a byte-level BPE file without normaliser and prefix space is needed")
        vocab = model["vocab"]
        chars = {c: bytes([b]) for b, c in enumerate(byte_alphabet())}
        self.token_bytes = {i: b"".join(chars[c] for c in t) for t, i in vocab.items()}
        self.byte_id = [0] * 256
        for c, b in chars.items():
            self.byte_id[b[0]] = vocab[c]
        self.width = 1 << 20
        self.rank: dict[int, int] = {}
        self.merged: list[int] = []
        for r, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[left] * self.width + vocab[right]] = r
            self.merged.append(vocab[left + right])
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.token_bytes.update((i, t.encode()) for t, i in self.added.items())
        self.specials = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.find = regex.compile(BYTE_LEVEL_PATTERN).findall
        self.limit = words
        self.words: dict[str, bytes] = {}  # ids as 32-bit numbers
        self.tails: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        ids = [self.byte_id[b] for b in piece]
        if len(ids) > LONG_PIECE:
            return self.merge_long(ids)
        rank, width, merged = self.rank.get, self.width, self.merged
        ranks = [rank(a * width + b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == NONE:
                break
            i = ranks.index(low)
            ids[i] = merged[low]
            del ids[i + 1], ranks[i]
            if i:
                ranks[i - 1] = rank(ids[i - 1] * width + ids[i], NONE)
            if i < len(ranks):
                ranks[i] = rank(ids[i] * width + ids[i + 1], NONE)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        rank, width = self.rank.get, self.width
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := rank(ids[i] * width + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = self.merged[r], -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (n := rank(ids[x] * width + ids[y])) is not None:
                    heapq.heappush(heap, (n, x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def pieces(self, text: str) -> array:
        return array("I", [i for p in self.find(text) for i in self.merge(p.encode("utf-8", "surrogatepass"))])

    def whole(self, text: str) -> array:
        out = array("I")
        for k, part in enumerate(self.specials.split(text) if self.specials else [text]):
            if k % 2:
                out.append(self.added[part])
            elif part:
                out += self.pieces(part)
        return out

    def learn(self, word: str) -> bytes | None:
        """The ids of a space and the word; None if the word can't be cut out of its text."""
        if self.specials and "<" in word and self.specials.search(word):
            return None
        if word.isascii() and word.isprintable() and word:
            tail = word.lstrip(ascii_letters)
            stem = word[: len(word) - len(tail)]
            if not stem:
                return self.pieces(" " + word).tobytes()
            ids = tail and self.words.get(stem) or array("I", self.merge(b" " + stem.encode())).tobytes()
            if tail:
                if tail not in self.tails:
                    self.tails[tail] = self.pieces(tail).tobytes()
                ids += self.tails[tail]
            return ids
        if not word or word[0].isspace() or word[-1].isspace() or self.specials and self.specials.search(word) or not (PLAIN.fullmatch(word) or word[0].isprintable() and word[-1].isprintable()):
            return None
        return self.pieces(" " + word).tobytes()

    def encode(self, text: str | None) -> array:
        if not text:
            return array("I")
        first, *rest = text.split(" ")
        if not first or first[-1].isspace() or not first[-1].isprintable() or self.specials and self.specials.search(first):
            return self.whole(text)
        words = self.words
        if len(words) > self.limit:
            words.clear()
            self.tails.clear()
        for w in rest:
            if w not in words:
                ids = self.learn(w)
                if ids is None:
                    return self.whole(text)
                words[w] = ids
        out = self.pieces(first)
        out.frombytes(b"".join(map(words.__getitem__, rest)))
        return out

    def decode(self, ids: list[int] | None) -> str:
        """The text of the ids, special tokens included; bytes that aren't UTF-8 become U+FFFD, and null or unknown ids add nothing."""
        try:
            found = b"".join(map(self.token_bytes.__getitem__, ids or ()))
        except KeyError:
            found = b"".join(self.token_bytes.get(i, b"") for i in ids)
        return found.decode("utf-8", "replace")


def loaded(path: str) -> RankArrayBpe:
    if path not in _LOADED:
        _LOADED[path] = RankArrayBpe(path)
    return _LOADED[path]


def _ids_array(found: list[array]) -> pa.Array:
    offsets = array("i", [0])
    for x in found:
        offsets.append(offsets[-1] + len(x))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(found))]))


def bpe_encode(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """df with the ids of each text."""

    def make():
        bpe = loaded(path)
        return lambda texts: {ids_col: _ids_array([bpe.encode(t) for t in texts])}

    return append_columns(df, text_col, make, [field(ids_col, T.ArrayType(T.IntegerType(), True))], rows=512)


def bpe_decode(df: DataFrame, path: str, ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """df with the text of each list of ids; a null list decodes to ""."""

    def make():
        bpe = loaded(path)
        return lambda lists: {decoded_col: [bpe.decode(x) for x in lists]}

    return append_columns(df, ids_col, make, [field(decoded_col, T.StringType())], rows=512)


def bpe_round_trip(df: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded") -> DataFrame:
    """df with ids and what they decode to, in one pass over the texts."""

    def make():
        bpe = loaded(path)

        def work(texts: list) -> dict:
            found = [bpe.encode(t) for t in texts]
            return {ids_col: _ids_array(found), decoded_col: [bpe.decode(x) for x in found]}

        return work

    return append_columns(df, text_col, make, [field(ids_col, T.ArrayType(T.IntegerType(), True)), field(decoded_col, T.StringType())], rows=512)
