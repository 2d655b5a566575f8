"""Ids of whole texts as the tokenizers library gives them, computed for a batch of texts at once.

The bytes of a batch are cut into the tokenizer's pieces (runs of letters, digits, other
signs and white space, contractions apart) by comparing byte classes. Each distinct piece of
the batch is merged once: pieces of one width stand in a matrix of symbols, and each step
merges every row's leftmost pair of least rank, as the library does. Nothing is kept between
batches. What the classes don't cover goes to the library: words with other characters than
printable ASCII and Latin letters, very long pieces, texts with special tokens, and every
text of a tokenizer whose rules are not the two known here.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

#: Fixed value: the pattern by which one of the two kinds of public tokenizer files splits text.
WORD_END_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"""
BATCH_BYTES = 4 << 20  # of text cut at once; longer texts are cut between words
WIDEST = 32  # bytes of a piece that is merged in the matrix
MERGED_AT_ONCE = 1 << 14  # pieces, so that their matrix stays in the processor's cache
NONE = np.int32(1 << 25)  # no rank
LETTER, DIGIT, SIGN, SPACE, BREAK, OTHER = 1, 2, 3, 4, 5, 0

_LOADED: dict[tuple[str, bool], BatchEncoder] = {}


def byte_classes() -> np.ndarray:
    """Class by byte; two-byte letters are found from their first byte."""
    c = np.full(256, OTHER, np.uint8)
    c[33:127] = SIGN
    c[[*b"0123456789"]] = DIGIT
    for first, last in (b"AZ", b"az"):
        c[first : last + 1] = LETTER
    c[32] = SPACE
    c[9:14] = BREAK
    return c


CLASS = byte_classes()
#: By code point below U+0180: a letter of two bytes whose class and normal form no version disputes, and its lower case.
IS_LATIN = np.array([c >= 0xC0 and c not in (0xD7, 0xF7, 0x130) for c in range(0x180)])
LOWERED = np.array([ord(chr(c).lower()) if c >= 0xC0 and IS_LATIN[c] else c for c in range(0x180)], np.uint16)
ASCII_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def cut_rule(spec: dict) -> str:
    """"prefix": a space opens the next word; "drop": white space has no ids; "whole": the rules aren't known here."""
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain = model.get("type") == "BPE" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "ignore_merges", "byte_fallback"))
    if plain and not spec.get("normalizer") and not model.get("end_of_word_suffix") and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
        return "prefix"
    parts = pre.get("pretokenizers") or [{}]
    if plain and parts[0].get("type") == "Split" and parts[0].get("behavior") == "Removed" and parts[0].get("invert") and parts[0].get("pattern", {}).get("Regex") == WORD_END_PATTERN:
        steps = [x.get("type") for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        return "drop" if steps == ["NFC", "Replace", "Lowercase"] and [p.get("type") for p in parts[1:]] == ["ByteLevel"] and not parts[1].get("add_prefix_space") else "whole"
    return "whole"


def byte_alphabet() -> list[str]:
    """The public byte-level mapping: printable bytes stand for themselves, the others for U+0100 onwards."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merges:
    """The rank of a pair of symbols, by a hash table that answers arrays."""

    BITS = 19

    def __init__(self, pairs: np.ndarray):
        self.key, self.rank = np.full(1 << self.BITS, -1, np.int64), np.full(1 << self.BITS, NONE, np.int32)
        todo, step = np.arange(len(pairs)), 0
        keys = pairs[:, 0].astype(np.int64) << 32 | pairs[:, 1]
        while len(todo):
            at = self.slot(keys[todo], step)
            free = self.key[at] < 0
            self.key[at[free][::-1]] = keys[todo[free]][::-1]  # of several in one slot, the last written stays
            mine = self.key[at] == keys[todo]
            self.rank[at[mine]] = todo[mine]
            todo, step = todo[~mine], step + 1
        self.steps = step

    def slot(self, key: np.ndarray, step: int) -> np.ndarray:
        h = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)
        return (h.astype(np.int64) + step) & ((1 << self.BITS) - 1)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = self.slot(key, 0)
        found = self.key[at]
        rank = np.where(found == key, self.rank[at], NONE)
        left = np.nonzero((found != key) & (found >= 0))
        for step in range(1, self.steps):
            if not len(left[0]):
                break
            k = key[left]
            at = self.slot(k, step)
            found = self.key[at]
            hit = found == k
            rank[tuple(x[hit] for x in left)] = self.rank[at[hit]]
            left = tuple(x[~hit & (found >= 0)] for x in left)
        return rank


class BatchEncoder:
    """encode(texts) gives all ids of some texts and where each text's ids end; with plain, strings of special tokens are text."""

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.library.encode_special_tokens = plain
        self.rule = cut_rule(spec)
        self.narrow = self.library.get_vocab_size() <= 1 << 16
        self.specials = [x["content"].encode() for x in spec.get("added_tokens", [])]
        if self.rule == "whole":
            return
        vocab, suffix = spec["model"]["vocab"], spec["model"].get("end_of_word_suffix") or ""
        self.alphabet = byte_alphabet()
        self.symbol = np.array([vocab[c] for c in self.alphabet], np.int32)
        self.last_symbol = np.array([vocab[c + suffix] for c in self.alphabet], np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.merges = Merges(np.array([(vocab[a], vocab[b]) for a, b in pairs], np.int64).reshape(-1, 2))
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.int32)

    def encode(self, texts: pa.Array | list) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): unsigned 32-bit ids of all texts, and the position after each text's last."""
        texts = texts if isinstance(texts, list) else texts.to_pylist()
        raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        ids, count = [], np.zeros(len(texts), np.int64)
        for part, owner in self.parts(raw):
            if self.rule == "whole" or len(part) == 1 and len(part[0]) > 2 * BATCH_BYTES:
                found = [self.whole(p.decode("utf-8", "surrogatepass")) if p else np.zeros(0, np.int32) for p in part]
                flat, n = np.concatenate(found) if found else np.zeros(0, np.int32), [len(x) for x in found]
            else:
                flat, n = self.encode_part(part)
            ids.append(flat.astype(np.uint32))
            np.add.at(count, owner, n)
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.cumsum(count)

    def packed(self, texts: pa.Array | list) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit bytes."""
        ids, ends = self.encode(texts)
        data, ends = ids.astype("<u4").tobytes(), (4 * ends).tolist()
        return [data[a:z] for a, z in zip([0, *ends[:-1]], ends, strict=True)]

    def parts(self, raw: list[bytes]) -> Iterator[tuple[list[bytes], list[int]]]:
        """The texts in groups of about BATCH_BYTES with their positions; longer texts in pieces that begin at single spaces between letters."""
        held, owner, size = [], [], 0
        for i, t in enumerate(raw):
            cuts = [0]
            special = self.rule == "whole" or len(t) > BATCH_BYTES and any(s in t for s in self.specials)
            while not special and len(t) - cuts[-1] > BATCH_BYTES:
                at = cuts[-1] + BATCH_BYTES
                while at > cuts[-1] and not (t[at] == 32 and CLASS[t[at - 1]] == LETTER and CLASS[t[at + 1]] == LETTER):
                    at = t.rfind(b" ", cuts[-1], at)
                if at <= cuts[-1]:
                    break
                cuts.append(at)
            for a, b in zip(cuts, [*cuts[1:], len(t)], strict=True):
                if held and size + b - a > BATCH_BYTES:
                    yield held, owner
                    held, owner, size = [], [], 0
                held.append(t[a:b])
                owner.append(i)
                size += b - a
        if held:
            yield held, owner

    def encode_part(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all, number of ids of each)"""
        whole = {i for i, t in enumerate(raw) if any(s in t for s in self.specials)}
        plain = [b"" if i in whole else t for i, t in enumerate(raw)]
        data = b"".join(plain)
        ends = np.cumsum([len(t) for t in plain])
        starts = ends - [len(t) for t in plain]
        if not data:
            piece_ids, piece_start, n, of = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            edge = np.zeros(0, np.int64)
        else:
            edge, final, unsafe, odd = self.cut(np.frombuffer(data, np.uint8), data, starts[starts < ends], ends)
            if len(unsafe):  # white space or unprintable signs of other kinds at the end of a word
                whole |= set(np.unique(np.searchsorted(ends, unsafe, side="right")).tolist())
                again = [b"" if i in whole else t for i, t in enumerate(raw)]
                return self.join(raw, again, whole)
            piece_ids, piece_start, n, of = self.pieces(final, edge, odd)
        count = n[of]
        place = np.cumsum(count) - count
        flat = piece_ids[np.repeat(piece_start[of] - place, count) + np.arange(int(count.sum()))]
        text = np.searchsorted(ends, edge, side="right")
        by_text = np.bincount(text, weights=count, minlength=len(raw)).astype(np.int64)
        return self.put(raw, flat, by_text, whole)

    def join(self, raw: list[bytes], again: list[bytes], whole: set[int]) -> tuple[np.ndarray, np.ndarray]:
        flat, by_text = self.encode_part(again)
        return self.put(raw, flat, by_text, whole)

    def put(self, raw: list[bytes], flat: np.ndarray, by_text: np.ndarray, whole: set[int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids with those of the texts that the library takes whole in their places."""
        if not whole:
            return flat, by_text
        out, upto = [], np.cumsum(by_text)
        by_text = by_text.copy()
        for i, t in enumerate(raw):
            if i in whole:
                out.append(self.whole(t.decode("utf-8", "surrogatepass")))
                by_text[i] = len(out[-1])
            else:
                out.append(flat[upto[i] - by_text[i] : upto[i]])
        return np.concatenate(out), by_text

    def cut(self, b: np.ndarray, data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(where pieces begin, the bytes they are made of, positions in texts that can't be cut, whether the library takes a piece).

        With "drop", pieces of white space are there too; pieces() leaves them out.
        """
        prefix = self.rule == "prefix"
        c = CLASS[b]
        lead = np.nonzero((b >= 0xC3) & (b <= 0xC5))[0]
        if len(lead):
            code = (b[lead].astype(np.int64) & 31) << 6 | b[lead + 1] & 63
            good = lead[IS_LATIN[code]]
            c[good] = c[good + 1] = LETTER
        if not prefix:
            b = ASCII_LOWER[b]
            if len(lead):
                low = LOWERED[code]
                b[lead], b[lead + 1] = 0xC0 | low >> 6, 0x80 | low & 63
        first = np.zeros(len(b) + 1, bool)
        first[starts] = True
        first[-1] = True
        before, after = np.empty_like(c), np.empty_like(c)  # classes of the neighbours in the same text; 255 where there is none
        before[0], before[1:] = 255, c[:-1]
        before[first[:-1]] = 255
        after[-1], after[:-1] = 255, c[1:]
        after[first[1:]] = 255
        white, white_before, white_after = c >= SPACE, (before >= SPACE) & (before < 255), (after >= SPACE) & (after < 255)
        start = c != before
        start[white] = False
        if not prefix:
            start |= white | (c == DIGIT)
        else:
            inner = white & (after < SPACE)  # the last of a run of white space before a word
            start |= white & ~white_before | inner
            joins = inner & (c == SPACE)
            start[1:][joins[:-1]] = False
        apostrophe = np.nonzero((b == 39) & (before != SIGN) & (after == LETTER))[0]
        if len(apostrophe):
            if prefix:
                apostrophe = apostrophe[before[apostrophe] != SPACE]
            padded = np.concatenate((b, np.zeros(3, np.uint8)))
            text_end = ends[np.searchsorted(ends, apostrophe, side="right")]
            one, two = padded[apostrophe + 1], padded[apostrophe + 2]
            two = np.where(apostrophe + 2 < text_end, two, 0)
            long = (two == 101) & ((one == 114) | (one == 118)) | (two == 108) & (one == 108)
            short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
            at, size = apostrophe[long | short], np.where(long, 2, 1)[long | short]
            start[at + 1] = False
            rest = at + 1 + size
            rest = rest[(rest < text_end[long | short])]
            start[rest[c[rest] == LETTER]] = True
        odd = np.zeros(0, np.int64)
        unsafe = np.zeros(0, np.int64)
        strange = np.nonzero(c == OTHER)[0]
        if len(strange):
            opens = np.nonzero(~white & (white_before | (before == 255)))[0]
            closes = np.nonzero(~white & (white_after | (after == 255)))[0] + 1
            hit = np.unique(np.searchsorted(opens, strange, side="right") - 1)
            o, e = opens[hit], closes[hit]
            words = [data[x:y].decode("utf-8", "surrogatepass") for x, y in zip(o.tolist(), e.tolist())]
            bad = np.array([w[0].isspace() or w[-1].isspace() or not w[0].isprintable() or not w[-1].isprintable() for w in words], bool)
            unsafe = o[bad]
            inside = np.zeros(len(b) + 1, np.int32)
            np.add.at(inside, o + 1, 1)
            np.add.at(inside, e, -1)
            start[np.cumsum(inside[:-1]) > 0] = False
            joined = (before[o] == SPACE) & prefix
            start[o] = ~joined
            odd = np.where(joined, o - 1, o)
        edge = np.nonzero(start)[0]
        marked = np.zeros(len(edge), bool)
        marked[np.searchsorted(edge, odd)] = True
        # an odd word must reach the library as it was written
        if len(strange) and not prefix:
            b = b.copy()
            raw = np.frombuffer(data, np.uint8)
            size = np.diff(np.append(edge, len(b)))[marked]
            where = np.repeat(edge[marked] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            b[where] = raw[where]
        return edge, b, unsafe, marked

    def pieces(self, b: np.ndarray, edge: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids, start and number of ids of each distinct piece, the distinct piece of each piece)"""
        offsets = np.append(edge, len(b)).astype(np.int32)
        distinct = pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(b))]).dictionary_encode()
        of = distinct.indices.to_numpy().astype(np.int64)
        words = distinct.dictionary
        strange = np.zeros(len(words), bool)
        strange[of[odd]] = True
        at = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2], np.uint8)
        size = np.diff(at)
        n = np.zeros(len(words), np.int64)
        start = np.zeros(len(words), np.int64)
        alone = strange | (size > WIDEST)
        if self.rule == "drop":
            blank = CLASS[data[at[:-1]]] >= SPACE
            alone &= ~blank
            dealt = ~alone & ~blank
        else:
            dealt = ~alone
        ids, total = [], 0
        for rows, made in self.merge(data, at, size, np.nonzero(dealt)[0]):
            width = made.shape[1]
            n[rows], start[rows] = width, total + np.arange(len(rows)) * width
            ids.append(made.ravel())
            total += made.size
        for i in np.nonzero(alone)[0].tolist():
            text = data[at[i] : at[i + 1]].tobytes()
            if strange[i]:
                found = self.whole(text.decode("utf-8", "surrogatepass"))
            else:
                found = np.array([t.id for t in self.library.model.tokenize("".join(map(self.alphabet.__getitem__, text)))], np.int32)
            n[i], start[i] = len(found), total
            ids.append(found)
            total += len(found)
        return np.concatenate(ids) if ids else np.zeros(0, np.int32), start, n, of

    def merge(self, data: np.ndarray, at: np.ndarray, size: np.ndarray, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, matrix of their ids) by number of ids. A piece is a column; those of one width take one merge a step."""
        order = rows[np.argsort(-size[rows], kind="stable")]
        for a in range(0, len(order), MERGED_AT_ONCE):
            yield from self.merge_some(data, at, order[a : a + MERGED_AT_ONCE], size)

    def merge_some(self, data: np.ndarray, at: np.ndarray, order: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        widths, places = -size[order], np.arange(WIDEST, dtype=np.int32)[:, None]
        held = None
        for width in range(-int(widths[0]), 0, -1):
            a, z = np.searchsorted(widths, [-width, -width + 1])
            new = order[a:z]
            if len(new):
                s = self.symbol[data[at[new] + places[:width]]]
                s[-1] = self.last_symbol[data[at[new] + width - 1]]
                r = self.merges.of(s[:-1], s[1:])
                held, sym, rank = (new, s, r) if held is None else (np.concatenate((held, new)), np.concatenate((sym, s), 1), np.concatenate((rank, r), 1))
            if held is None:
                continue
            if width == 1:
                yield held, sym.T
                break
            least = ((rank << 5) + places[: width - 1]).min(0)  # of equal ranks the leftmost
            done = least >= NONE << 5
            if done.any():
                yield held[done], sym[:, done].T
                go = ~done
                held, sym, rank, least = held[go], sym[:, go], rank[:, go], least[go]
                if not len(held):
                    held = None
                    continue
            j, line = least & 31, np.arange(len(held))
            sym = np.where(places[: width - 1] <= j, sym[:-1], sym[1:])
            sym[j, line] = self.merged[least >> 5]
            rank = np.where(places[: width - 2] < j, rank[:-1], rank[1:])  # the merged pair is gone, its neighbours are new
            left, right = np.nonzero(j > 0)[0], np.nonzero(j < width - 2)[0]
            jl, jr = j[left], j[right]
            rank[jl - 1, left] = self.merges.of(sym[jl - 1, left], sym[jl, left])
            rank[jr, right] = self.merges.of(sym[jr, right], sym[jr + 1, right])


def encoder(path: str, plain: bool = False) -> BatchEncoder:
    """One encoder a worker process and file: reading the vocabulary takes a moment."""
    if (path, plain) not in _LOADED:
        _LOADED[path, plain] = BatchEncoder(path, plain)
    return _LOADED[path, plain]
