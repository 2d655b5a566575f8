"""Language-model scores by logistic context mixing over bits.

A text is its words (A–Z lower-cased) and one end. Every word is a few binary decisions, and
each decision is predicted under several contexts from counts in hashed tables. A gate (the
kind of decision, the longest context seen, how often) selects the weights that mix the
predictions in the logistic domain, and an adaptive map refines the mixed probability.

1. Repeat. Where the three words before have stood elsewhere in the training texts, their
   commonest next word is predicted; one bit says whether it came.
2. Symbol. Otherwise the bits of a Huffman code, under the contexts: none, the last two
   common words, the word before, the two words before. Frequent words are symbols of
   their own; others share one by the magnitude of their count, and are then told apart by
   their exact share of that magnitude's tokens; unseen words share the last symbol.
3. Spelling. An unseen word is then written as its bytes and a space, in a code that is
   shorter for the bytes that are frequent in rare words and keeps their order, each bit
   under the last one, two, three and five bytes.

All training texts are counted, and nothing is sampled. Blocks send their distinct words and
three-word contexts to shards, which answer exact counts and predictions, so this memory
grows with the corpus; the bit tables have a fixed size (TABLE_BITS) and are added up in a
tree. Weights and map are learned online in a further pass over all training texts, against
the tables of the whole corpus and without the own count of each event (a word met once counts
as unseen there, and is what spelling learns from); they are averaged by use. Held-out texts
are then scored as they are; a training text's own words never predict their own repeat.

Cases: null and empty texts are one end; a null id is the empty text for crc32, so held out;
repeated rows are scored, and count in training, one by one; texts of any length are read whole
and in chunks; other columns aren't read; without any training text all counts are 0 and every
bit costs about one bit; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import MESSAGE, Words, distinct, each_block, message_batch, mix, order_of, per_block, per_shard, shard_count, shares, squeeze, texts_of, unsqueeze, with_replies, write_blocks
from .common import pick, stage
from .simhash import LOWER

TABLE_BITS = 20
ORDERS = (1, 2, 3, 5)  # bytes of the contexts of spelling
PREDICTORS = 4
NEAR = 4  # steps of a code whose slots stand together
LEVELS = 8  # of confidence: log2 of how often a context was seen
PLACES = 16  # kinds of decisions
GATES = PLACES * (PREDICTORS + 1) * LEVELS
PAD = b"\x00\x00\x00\x00\x00 "
END_HASH = mix(np.array([0xE4D], np.uint64))[0]
NO_CONTEXT = mix(np.zeros(1, np.uint64), 11)
ADD = 0.4
SCALE = 160
MAP_CELLS = 33
MAPS = 256
CHUNK = 1 << 14  # words or bytes whose decisions are taken together
LEARN_CHUNK = 1 << 14  # the same between two steps of the weights
SHARD_WORDS = 1 << 23  # running words of the corpus a shard
TASK_WORDS = 1 << 23  # running words that a task counts before it gives its tables away
FREQUENT = 17  # a frequent word is one of 2 ** FREQUENT tokens at least: so many words at most
COMMON = 64  # the words that the second context looks at
BEFORE = 3  # words of the context of a repeat
CLASSES = 64
RATE = 0.3
SLICES = 8
AT_ONCE = 1 << 20  # entries of a shard that are compared together
STEP = "part int, slice int, source long, packed binary"


def in_training(ids: list) -> np.ndarray:
    return np.array([zlib.crc32(b"" if d is None else str(d).encode()) % 10 != 0 for d in ids], bool)


def before(word: np.ndarray, place: np.ndarray, k: int) -> np.ndarray:
    """The hash of the token k places before in the same text, or 0."""
    h = np.zeros(len(word), np.uint64)
    h[k:] = word[:-k]
    h[place < k] = 0
    return h


class Tokens:
    """The tokens of a block's texts: the words of each, then its end."""

    def __init__(self, table: pa.Table):
        self.words = w = Words([t.translate(LOWER) for t in texts_of(table)])
        self.docs, self.ids = table.num_rows, table.column(0).combine_chunks()
        self.ids = self.ids.combine_chunks() if isinstance(self.ids, pa.ChunkedArray) else self.ids
        self.train = in_training(table.column(0).to_pylist())
        size = np.diff(w.first) + 1
        self.end = np.cumsum(size) - 1
        self.size, self.doc = size, np.repeat(np.arange(self.docs), size)
        self.place = np.arange(len(self.doc)) - np.repeat(self.end - size + 1, size)
        is_word = np.ones(len(self.doc), bool)
        is_word[self.end] = False
        self.hash = np.full(len(self.doc), END_HASH, np.uint64)
        self.hash[is_word] = w.hashes()
        self.word = np.cumsum(is_word) - 1  # of the text's words, for tokens that are one
        self.is_word, self.trains = is_word, self.train[self.doc]
        self.distinct, self.back = distinct(self.hash)

    def text(self, token: np.ndarray) -> list[bytes]:
        w = self.word[token]
        return [self.words.data[a:b] for a, b in zip(self.words.start[w].tolist(), self.words.end[w].tolist())]

    def answers(self, replies: dict, shards: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(training count, predicted repeat) of each token; a training text's own words don't predict it."""
        parts = [unsqueeze(replies[0, s], "<i8")[0] for s, _, _ in shares(self.distinct, shards, 64)]
        count = np.concatenate(parts)[self.back] if parts else np.zeros(0, np.int64)
        answer = np.zeros(len(count), np.uint8)
        at, key, back = self.repeats(bits)
        if len(key):
            found = np.concatenate([unsqueeze(replies[1, s], "u1")[0] for s, _, _ in shares(key, shards, bits + 16)])[back]
            answer[at] = np.where(self.trains[at], found >> 4, found & 15)
        return count, answer

    def some(self, docs: np.ndarray, lexicon: Lexicon, count: np.ndarray, answer: np.ndarray, less: int) -> tuple[Text, np.ndarray]:
        """The Text of some documents, and their tokens' places here; less is taken off every count."""
        at = np.nonzero(docs[self.doc])[0]
        return Text(lexicon, self.size[docs], self.hash[at], count[at] - less, answer[at], lexicon.ranks(self.distinct)[self.back[at]]), at

    def rare_bytes(self, count: np.ndarray) -> np.ndarray:
        """How often each byte, with a space a word, stands in the words that training texts of the block hold once."""
        words = self.text(np.nonzero((count[self.back] == 1) & self.trains & self.is_word)[0])
        return np.bincount(np.frombuffer(b" ".join([*words, b""]), np.uint8), minlength=256)

    def repeats(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(token, key of each distinct (context, next word), which of them each token is): 16 low bits of a key are the next word's."""
        at = np.nonzero(self.place >= BEFORE)[0]
        c = np.zeros(len(at), np.uint64)
        for k in range(1, BEFORE + 1):
            c = mix(c ^ self.hash[at - k], k)
        cell = c >> np.uint64(64 - bits)
        return at, *distinct(cell << np.uint64(16) | self.hash[at] >> np.uint64(48))


def strength(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """How sure a prediction is, 0 to 7, by the counts of the commonest next word and of the one after it."""
    size = np.minimum(np.frexp(first.astype(np.float32))[1], 4)
    return np.where(first <= 0, 0, np.where(second <= 0, size, 4 + np.minimum(size, 3))).astype(np.int64)


def predict(kind: int, shard: int, blocks: list[int], packed: list[bytes]) -> list[tuple]:
    """A shard of the contexts: a byte for each (context, next word) of a block.

    Low half: whether the word is the one predicted, and how sure the prediction is; high half:
    the same without one count of the word itself, as a training text sees it.
    """
    parts = [unsqueeze(p, "<u4", "<u2", "<u2") for p in packed]
    cells = [np.cumsum(p[0], dtype=np.uint32) for p in parts]
    replies = [np.zeros(len(c), np.uint8) for c in cells]
    entries = sum(len(c) for c in cells)
    ranges = max(1, -(-entries // AT_ONCE))
    for k in range(ranges):  # a range of contexts at a time
        low, high = (np.uint64(x * (1 << 32) // ranges) for x in (k, k + 1))
        cut = [(int(np.searchsorted(c, low)), int(np.searchsorted(c, high))) for c in cells]
        key = np.concatenate([c[a:b].astype(np.uint64) << np.uint64(16) | p[1][a:b] for c, p, (a, b) in zip(cells, parts, cut)])
        if len(key):
            found = predicted(key, np.concatenate([p[2][a:b] for p, (a, b) in zip(parts, cut)]))
            at = 0
            for r, (a, b) in zip(replies, cut):
                r[a:b] = found[at : at + b - a]
                at += b - a
    return [(block, kind, shard, squeeze(r)) for block, r in zip(blocks, replies, strict=True)]


def predicted(key: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The byte of each (context, next word), all of a context's being there."""
    pair, back = distinct(key)
    total = np.bincount(back, weights=count, minlength=len(pair)).astype(np.int64)
    own = pair >> np.uint64(16)
    new = np.ones(len(pair), bool)
    new[1:] = own[1:] != own[:-1]
    start, which = np.nonzero(new)[0], np.cumsum(new) - 1
    most = total.max(initial=0)
    order = order_of((which << int(most).bit_length() | (most - total)).view(np.uint64))  # contexts stand together already
    size = np.diff(np.append(start, len(order)))
    # the counts of the three commonest next words of each context, and each pair's own place
    top = [np.where(size > k, total[order[np.minimum(start + k, len(order) - 1)]], 0) for k in range(3)]
    group, place = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    group[order] = which
    place[order] = np.arange(len(order)) - np.repeat(start, size)
    one, two, three = (t[group] for t in top)
    plain = (place == 0).astype(np.int64) << 3 | strength(one, two)
    left = one - 1
    without_first = np.where(left >= two, 8 | strength(left, two), strength(two, np.maximum(left, three)))
    without_second = strength(one, np.maximum(two - 1, three))
    alone = np.where(place == 0, without_first, np.where(place == 1, without_second, strength(one, two)))
    return ((alone << 4) | plain).astype(np.uint8)[back]


def count_words(kind: int, shard: int, blocks: list[int], packed: list[bytes], frequent: int) -> list[tuple]:
    """A shard of the vocabulary: the exact training count of each word of a block, and what the code is made from."""
    parts = [unsqueeze(p, "<u8", "<i4") for p in packed]
    word, back = distinct(np.concatenate([p[0] for p in parts]))
    total = np.bincount(back, weights=np.concatenate([p[1] for p in parts]), minlength=len(word)).astype(np.int64)
    rows, at = [], 0
    for block, p in zip(blocks, parts, strict=True):
        rows.append((block, kind, shard, squeeze(total[back[at : at + len(p[0])]].astype("<i8"))))
        at += len(p[0])
    seen, often = total > 0, total >= frequent
    rare = total[seen & ~often]
    tokens = np.bincount(magnitude(rare), weights=rare, minlength=CLASSES)
    facts = np.concatenate(([total.sum(), seen.sum()], tokens)).astype("<f8")
    return [*rows, (-1, 2, shard, facts.tobytes()), (-1, 3, shard, squeeze(word[often].astype("<u8"), total[often].astype("<i8")))]


def magnitude(count: np.ndarray) -> np.ndarray:
    return np.maximum(np.frexp(count.astype(np.float64))[1] - 1, 0)


def code_lengths(weight: list[int]) -> list[int]:
    """Huffman's: bits of each symbol."""
    if len(weight) < 2:
        return [0] * len(weight)
    heap, parent = [(w, i) for i, w in enumerate(weight)], [0] * (2 * len(weight) - 1)
    heapq.heapify(heap)
    for node in range(len(weight), 2 * len(weight) - 1):
        (a, i), (b, j) = heapq.heappop(heap), heapq.heappop(heap)
        parent[i] = parent[j] = node
        heapq.heappush(heap, (a + b, node))
    depth = [0] * len(parent)
    for node in range(len(parent) - 2, -1, -1):
        depth[node] = depth[parent[node]] + 1
    return depth[: len(weight)]


class Code:
    """Bits for each symbol: how many, and which."""

    def __init__(self, length: np.ndarray, code: np.ndarray):
        self.length, self.code, self.longest = length, code, int(length.max(initial=0))
        self.aligned = (code | 1 << length) << (self.longest - length)  # with a one before it, as long as the longest

    def order(self, symbol: np.ndarray) -> np.ndarray:
        """Longer codes first, so that at each step those still at work are in front."""
        return np.argsort((self.longest - self.length).astype(np.uint8)[symbol], kind="stable")

    def steps(self, symbol: np.ndarray, context: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        """(how many are still at work, their bits, their cells under every context) at each step, for symbols in order.

        The nodes of NEAR steps lie in one line of the memory, each at a place of its own there.
        """
        aligned, base = self.aligned[symbol], []
        ended = np.cumsum(np.bincount(self.length[symbol]))
        for step, n in enumerate((len(symbol) - ended[:-1]).tolist()):
            k = step % NEAR
            taken = aligned[:n] >> (self.longest - step - 1)  # a one, the bits before this one and this one
            bit = taken & 1
            if k == 0:
                base = cells_of([c[:n] for c in context], taken >> 1)
            taken &= (2 << k) - 1
            taken |= 2 << k
            yield n, bit, [b[:n] ^ taken for b in base]


def huffman(weight: list[int]) -> Code:
    """The canonical one of these weights."""
    length = np.array(code_lengths(weight), np.int64)
    at = np.lexsort((np.arange(len(length)), length))
    code, last = np.zeros(len(length), np.int64), 0
    for i, s in enumerate(at.tolist()):  # shorter codes first
        if i:
            code[s] = (code[at[i - 1]] + 1) << (length[s] - last)
        last = int(length[s])
    return Code(length, code)


def in_order(weight: np.ndarray) -> Code:
    """Symbols in their order, cut in two where the weights are most alike, again and again; neighbours keep their first bits in common."""
    length, code = np.zeros(len(weight), np.int64), np.zeros(len(weight), np.int64)
    before, todo = np.concatenate(([0], np.cumsum(weight))), [(0, len(weight))]
    while todo:
        first, last = todo.pop()
        if last - first > 1:
            apart = np.abs(2 * before[first + 1 : last] - before[first] - before[last])
            best = np.nonzero(apart == apart.min())[0]
            cut = first + 1 + int(best[len(best) // 2])
            length[first:last] += 1
            code[first:last] <<= 1
            code[cut:last] += 1
            todo += [(first, cut), (cut, last)]
    return Code(length, code)


LETTERS = in_order(np.ones(256, np.int64))  # bytes as they are


class Lexicon:
    """The symbols of words and their code. Frequent words come first, by count; then the magnitudes, then the unseen."""

    def __init__(self, word: np.ndarray, count: np.ndarray, mass: np.ndarray, tokens: int, distinct: int, letters: Code = LETTERS):
        order = np.lexsort((word, -count))
        self.tokens, self.distinct, self.mass = tokens, distinct, mass
        self.frequent = len(word)
        by_hash = np.argsort(word[order])
        self.word, self.rank = word[order][by_hash], by_hash
        weight = [*count[order].tolist(), *(mass + 1).astype(np.int64).tolist(), int(mass[0]) + 1]
        self.of_words, self.letters = huffman(weight), letters
        self.length, self.code = self.of_words.length, self.of_words.code
        self.unseen = len(self.length) - 1

    def ranks(self, word: np.ndarray) -> np.ndarray:
        """The symbols of frequent words, -1 for others."""
        if not self.frequent:
            return np.full(len(word), -1)
        at = np.minimum(np.searchsorted(self.word, word), self.frequent - 1)
        return np.where(self.word[at] == word, self.rank[at], -1)

    def symbols(self, word: np.ndarray, count: np.ndarray, rank: np.ndarray | None = None) -> np.ndarray:
        """rank: what ranks() has for the words, if that is known."""
        s = self.ranks(word) if rank is None else rank.copy()
        other = np.nonzero(s < 0)[0]
        seen = count[other]
        s[other] = np.where(seen > 0, self.frequent + magnitude(seen), self.unseen)
        return s

    def steps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(symbol, slot under no context, bit) at every step of the code."""
        order = self.of_words.order(np.arange(len(self.length)))
        for n, bit, (cell,) in self.of_words.steps(order, [np.broadcast_to(NO_CONTEXT, len(order))]):
            yield order[:n], cell >> 1, bit


@dataclass
class Decisions:
    """Binary decisions taken at once: the item each belongs to, its outcome, place, map and cell under every context.

    A cell is twice a slot, and the outcome. An item stands in it once, and all have the same
    place. Steps of the code have their symbols; their cells under no context follow from
    those, and may be left out. goes_on: its items are the first ones of the decisions before.
    """

    item: np.ndarray
    bit: np.ndarray
    place: np.ndarray
    map: np.ndarray
    cells: list[np.ndarray | None]
    symbol: np.ndarray | None = None
    step: int = 0
    goes_on: bool = False

    @property
    def slots(self) -> list[np.ndarray | None]:
        return [None if c is None else c >> 1 for c in self.cells]


def same(value: int, n: int) -> np.ndarray:
    return np.full(n, value, np.int64)


def cells_of(context: list[np.ndarray], node: np.ndarray) -> list[np.ndarray]:
    """Twice the slot of a node under every context."""
    n = node.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out = []
    for c in context:
        x = c ^ n
        x *= np.uint64(0xD6E8FEB86659FD93)
        x >>= np.uint64(63 - TABLE_BITS)
        x &= ~np.uint64(1)
        out.append(x.view(np.int64))
    return out


class Text:
    """Tokens of some texts with their symbols, contexts and predicted repeats.

    size is the number of tokens of each text; seen the training count of each token, and
    answer the byte half that predict() has for it (0: nothing is predicted). rank: what the
    lexicon's ranks() has for the words, if that is known.
    """

    maps = PLACES

    def __init__(self, lexicon: Lexicon, size: np.ndarray, word: np.ndarray, seen: np.ndarray, answer: np.ndarray, rank: np.ndarray | None = None):
        self.lexicon, self.size, self.hash, self.seen = lexicon, size, word, seen
        idx = np.arange(len(word))
        self.doc = np.repeat(np.arange(len(size)), size)
        place = idx - np.repeat(np.cumsum(size) - size, size)
        self.symbol = lexicon.symbols(word, seen, rank)
        self.level, self.match = answer.astype(np.int64) & 7, (answer & 8 > 0) & (answer & 7 > 0)
        missed = np.maximum.accumulate(np.where(self.match, -1, idx))
        run = np.zeros(len(idx), np.int64)
        run[1:] = idx[:-1] - missed[:-1]
        run = np.minimum(run, 7)
        one, two = before(word, place, 1), before(word, place, 2)
        is_common = self.symbol < min(COMMON, lexicon.frequent)
        common = np.nonzero(is_common)[0]
        near = np.zeros((2, len(idx)), np.uint64)
        if len(common):
            j = np.cumsum(is_common) - is_common  # how many stand before each token
            for k in (1, 2):
                p = np.maximum(j - k, 0)
                ok = (j >= k) & (self.doc[common[p]] == self.doc)
                near[k - 1] = np.where(ok, self.symbol[common[p]].astype(np.uint64) + np.uint64(1), 0)
        self.context = [np.broadcast_to(NO_CONTEXT, len(idx)), *(mix(x, 12 + i) for i, x in enumerate((near[0] << np.uint64(8) | near[1], one, mix(two, 3) ^ one)))]
        self.asked = at = np.nonzero(self.level)[0]  # the tokens that a prediction is there for, and their contexts
        level, ran = self.level[at].astype(np.uint64), run[at].astype(np.uint64)
        self.flag = [mix(x, 21 + i) for i, x in enumerate((level, level << np.uint64(4) | ran, level << np.uint64(8) | near[0][at], mix(one[at], 5) ^ level))]

    def unseen(self) -> np.ndarray:
        """Which tokens are words that have to be spelled."""
        return np.nonzero((self.symbol == self.lexicon.unseen) & ~self.match & (self.hash != END_HASH))[0]

    def decisions(self, start: int, end: int, whole: bool = True) -> Iterator[Decisions]:
        """Those of the tokens from start to end, step by step; not whole: without the code's slots under no context."""
        first, last = np.searchsorted(self.asked, (start, end))
        if last > first:
            asked = self.asked[first:last]
            place = same(PLACES - 1, len(asked))
            match = self.match[asked].astype(np.int64)
            yield Decisions(asked, match, place, place, [c | match for c in cells_of([c[first:last] for c in self.flag], np.ones(len(asked), np.int64))])
        live, code = start + np.nonzero(~self.match[start:end])[0], self.lexicon.of_words
        live = live[code.order(self.symbol[live])]
        symbol, left_out = self.symbol[live], [] if whole else [None]
        for step, (n, bit, cells) in enumerate(code.steps(symbol, [c[live] for c in self.context[len(left_out) :]])):
            place = same(min(step, PLACES - 2), n)
            yield Decisions(live[:n], bit, place, place, left_out + cells, symbol[:n], step, step > 0)

    def fixed_bits(self) -> np.ndarray:
        """What telling words of one magnitude apart costs each token."""
        k = self.symbol - self.lexicon.frequent
        rare = (k >= 0) & (self.symbol != self.lexicon.unseen) & ~self.match
        cost = np.zeros(len(k))
        cost[rare] = np.log2(np.maximum(self.lexicon.mass[k[rare]] / self.seen[rare], 1))  # without its own count a word may stand in an empty magnitude
        return cost


class Spelling:
    """The bytes of some words, each with a space after it, with the hash of every context at each."""

    maps = MAPS

    def __init__(self, words: list[bytes], code: Code = LETTERS):
        self.code = code
        flat = np.frombuffer(b"".join([PAD + w + b" " for w in words]), np.uint8)
        size = np.array([len(w) + 1 for w in words], np.int64)
        start = np.cumsum(size + len(PAD)) - size
        self.word = np.repeat(np.arange(len(words)), size)
        at = np.repeat(start, size) + np.arange(len(self.word)) - np.repeat(np.cumsum(size) - size, size)
        self.byte, self.before = flat[at].astype(np.int64), flat[at - 1].astype(np.int64)
        self.context, acc = [], np.zeros(len(at), np.uint64)
        for k in range(1, max(ORDERS) + 1):
            acc = acc * np.uint64(0x100000001B3) + flat[at - k] + np.uint64(1)
            if k in ORDERS:
                self.context.append(mix(acc, 0x77 * k))

    def decisions(self, start: int, end: int, whole: bool = True) -> Iterator[Decisions]:
        item = start + self.code.order(self.byte[start:end])
        before = self.before[item]
        for step, (n, bit, cells) in enumerate(self.code.steps(self.byte[item], [c[item] for c in self.context])):
            yield Decisions(item[:n], bit, same(min(step, PLACES - 1), n), before[:n], cells, goes_on=step > 0)


def chunks(n: int, most: int) -> Iterator[tuple[int, int]]:
    for a in range(0, n, most):
        yield a, min(n, a + most)


def squash(x: np.ndarray) -> np.ndarray:
    y = between(x, -20, 20)  # in the precision of x
    np.negative(y, out=y)
    np.exp(y, out=y)
    y += 1
    return np.divide(1, y, out=y)


def between(x: np.ndarray, low: float, high: float) -> np.ndarray:
    """np.clip() without its way through Python."""
    return np.minimum(np.maximum(x, low), high)


def count_of(code: np.ndarray) -> np.ndarray:
    """The count that an 8-bit code stands for: exact to 31, then an eighth of a doubling a step."""
    return np.where(code < 32, code, np.rint(2.0 ** (5 + (code - 32) / 8)))


def code_of(count: np.ndarray) -> np.ndarray:
    return np.where(count < 32, count, np.minimum(32 + np.rint(8 * (np.log2(np.maximum(count, 1)) - 5)), 255)).astype(np.uint16)


def evidence() -> np.ndarray:
    """By a slot's pair of codes, as it stands, without one zero and without one one: log odds times SCALE, and in three low bits how often it was seen."""
    pair = np.arange(1 << 16)
    n0, n1 = count_of(pair & 255), count_of(pair >> 8)
    found = []
    for a, b in ((n0, n1), (np.maximum(n0 - 1, 0), n1), (n0, np.maximum(n1 - 1, 0))):
        level = np.minimum(np.frexp(a + b)[1], LEVELS - 1) * (a + b > 0)
        found.append(np.rint(np.log((b + ADD) / (a + ADD)) * SCALE).astype(np.int16) << 3 | level.astype(np.int16))
    return np.concatenate(found)


EVIDENCE = evidence()


def without_own(table: np.ndarray) -> np.ndarray:
    """The evidence of each slot, by twice the slot and the outcome, without the count of the event itself."""
    out = np.empty((len(table), 2 << TABLE_BITS), np.int16)
    for p, row in enumerate(table):
        for bit in (0, 1):
            out[p, bit::2] = EVIDENCE[(bit + 1) << 16 : (bit + 2) << 16].take(row)
    return out


class Plain:
    """The evidence that a table has for the steps of the code under no context, by symbol, without the count of the event itself."""

    def __init__(self, row: np.ndarray, lexicon: Lexicon):
        self.found = []
        for symbol, slot, bit in lexicon.steps():
            found = np.zeros(len(lexicon.length), np.int16)
            found[symbol] = EVIDENCE.take(row.take(slot) + ((bit + 1) << 16))
            self.found.append(found)


def look(table: np.ndarray, d: Decisions, alone: bool, plain: Plain | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """(log odds under each context, gate within the place) of some decisions; alone: without the count of the event itself.

    The gate is the longest context that has been seen (0: none), and how often. The table holds
    pairs of codes or, if alone, what without_own() makes from them.
    """
    x, longest = [], np.zeros(len(d.bit), np.int16)
    ready = table.dtype == np.int16
    which = 0 if ready or not alone else (d.bit + 1) << 16
    for p, cell in enumerate(d.cells):
        if cell is None:
            found = plain.found[d.step].take(d.symbol)
        else:
            found = table[p][cell] if ready else EVIDENCE.take(table[p][cell >> 1] + which)
        seen = found & np.int16(LEVELS - 1)
        own = seen + np.int16(LEVELS - 1)
        own &= np.int16(LEVELS)  # LEVELS if it has been seen
        own *= np.int16(p + 1)
        own += seen
        np.maximum(longest, own, out=longest)
        found >>= 3
        x.append(np.multiply(found, np.float32(1 / SCALE), dtype=np.float32))
    return x, longest.astype(np.int64)


def gates_of(d: Decisions) -> slice:
    """Those of a step's place."""
    n = (PREDICTORS + 1) * LEVELS
    return slice(int(d.place[0]) * n, int(d.place[0]) * n + n)


def mixed(weights: np.ndarray, gate: np.ndarray, x: list[np.ndarray]) -> np.ndarray:
    """The log odds under each context with the gate's weights, added up."""
    total = weights[0].take(gate)
    total *= x[0]
    for p in range(1, PREDICTORS):
        part = weights[p].take(gate)
        part *= x[p]
        total += part
    return total


def map_cell(which: np.ndarray, x: np.ndarray) -> np.ndarray:
    y = x + x
    np.rint(y, out=y)
    y = between(y, -(MAP_CELLS // 2), MAP_CELLS // 2)
    return which * MAP_CELLS + MAP_CELLS // 2 + y.astype(np.int64)


def start_weights() -> np.ndarray:
    w = np.zeros((PREDICTORS, GATES), np.float32)
    for g in range(GATES):
        w[max(0, g // LEVELS % (PREDICTORS + 1) - 1), g] = 1.0
    return w


def new_table(kind: type = np.int32) -> np.ndarray:
    return np.zeros((PREDICTORS, 2 << TABLE_BITS), kind)


def add_counts(table: np.ndarray, decisions: Iterator[Decisions]) -> None:
    for d in decisions:
        one = np.ones(len(d.bit), table.dtype)  # an array is added faster than a number
        for row, cell in zip(table, d.cells):
            if cell is not None:  # else it is counted by symbol
                np.add.at(row, cell, one)


def bits_of(p1: np.ndarray, bit: np.ndarray, refined: np.ndarray, trust: np.ndarray) -> np.ndarray:
    """What an outcome costs, given the mixed probability of a one and the map's."""
    p = refined - p1
    p *= trust
    p += p1
    p = between(p, 1e-6, 1 - 1e-6)
    p -= 1 - bit.astype(p.dtype)
    np.log2(np.abs(p, out=p), out=p)
    return np.negative(p, out=p)


LEVEL = 8 * squash((np.arange(MAPS * MAP_CELLS) % MAP_CELLS - MAP_CELLS // 2) / 2)


def refinement(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cells = cells.reshape(-1, 2)
    ones, n = cells[:, 1], cells[:, 0] + cells[:, 1]
    return ((ones + LEVEL[: len(n)]) / (n + 8)).astype(np.float32), (0.5 * n / (n + 64)).astype(np.float32)


class Learner:
    """Weights and map, corrected step by step."""

    def __init__(self):
        self.weights, self.squares = start_weights(), np.full((PREDICTORS, GATES), 1e-3, np.float32)
        self.used, self.cells = np.zeros(GATES), np.zeros(2 * MAPS * MAP_CELLS)

    def map(self, maps: int = MAPS) -> tuple[np.ndarray, np.ndarray]:
        """By cell of the first maps, the refined probability of a one and its share in the final one."""
        return refinement(self.cells[: 2 * maps * MAP_CELLS])

    def chunk(self, table: np.ndarray, decisions: Iterator[Decisions], cost: np.ndarray | None, plain: Plain | None = None, maps: int = MAPS) -> None:
        """One step of each gate's weights for every kind of decision, in proportion to its error.

        What the decisions cost before they were learned from is added to cost, by item.
        """
        refined, trust = self.map(maps) if cost is not None else (None, None)
        items = spent = None
        for d in decisions:
            if not len(d.bit):
                continue
            x, gate = look(table, d, True, plain)
            own = gates_of(d)
            weights, squares = self.weights[:, own], self.squares[:, own]
            total = mixed(weights, gate, x)
            at, p1 = map_cell(d.map, total), squash(total)
            if cost is not None:
                bits = bits_of(p1, d.bit, refined.take(at), trust.take(at))
                if d.goes_on:
                    spent[: len(bits)] += bits
                else:
                    if items is not None:
                        cost[items] += spent
                    items, spent = d.item, bits.astype(cost.dtype)
            err = d.bit.astype(p1.dtype) - p1
            n = np.bincount(gate, minlength=weights.shape[1])
            g = np.empty(weights.shape)
            for p, xp in enumerate(x):
                g[p] = np.bincount(gate, weights=err * xp, minlength=len(n))
            g /= np.maximum(n, 1)
            squares += g * g
            g *= RATE
            g /= np.sqrt(squares)
            weights += g
            self.used[own] += n
            at <<= 1
            at |= d.bit
            np.add.at(self.cells, at, np.ones(len(at)))
        if items is not None:
            cost[items] += spent

    def read(self, table: np.ndarray, source: Text | Spelling, items: int, cost: np.ndarray | None, plain: Plain | None = None) -> None:
        for a, b in chunks(items, LEARN_CHUNK):
            self.chunk(table, source.decisions(a, b, plain is None), cost, plain, source.maps)

    def facts(self) -> np.ndarray:
        return np.concatenate(((self.weights * self.used).ravel(), self.used, self.cells))


class Mixer:
    """Counts with the weights and map to use them."""

    def __init__(self, table: np.ndarray, facts: np.ndarray | None = None):
        self.table, a = table, GATES * PREDICTORS
        facts = np.zeros(a + GATES + 2 * MAPS * MAP_CELLS) if facts is None else facts
        used = facts[a : a + GATES]
        self.weights = np.where(used > 0, facts[:a].reshape(PREDICTORS, GATES) / np.maximum(used, 1), start_weights()).astype(np.float32)
        self.refined, self.trust = refinement(facts[a + GATES :])

    def probability(self, d: Decisions) -> tuple[np.ndarray, np.ndarray]:
        """(of a one as mixed, cell of the map) of each decision."""
        x, gate = look(self.table, d, alone=False)
        total = mixed(self.weights[:, gates_of(d)], gate, x)
        return squash(total), map_cell(d.map, total)

    def cost(self, source: Text | Spelling, items: int) -> np.ndarray:
        """Bits of each item."""
        cost = np.zeros(items)
        for a, b in chunks(items, CHUNK):
            for d in source.decisions(a, b):
                if len(d.bit):
                    p1, at = self.probability(d)
                    cost[d.item] += bits_of(p1, d.bit, self.refined.take(at), self.trust.take(at))
        return cost


def narrow(table: np.ndarray) -> np.ndarray:
    """The two counts of each slot in 16 bits."""
    out = np.empty((len(table), 1 << TABLE_BITS), np.uint16)
    for p, row in enumerate(table):
        codes = code_of(row)
        out[p] = codes[0::2] | codes[1::2] << 8
    return out


def tree_sum(parts: DataFrame, sources: int, fan: int = 16) -> dict[tuple[int, int], np.ndarray]:
    """The sums of the arrays of each (part, slice), a few sources at a time; their number and size are fixed."""

    def add(table: pa.Table) -> pa.Table:
        total, names = None, ("part", "slice", "source")
        for p in table.column("packed"):
            x = unsqueeze(p.as_py(), "<f4")[0] if table.column("part")[0].as_py() >= 0 else np.frombuffer(p.as_py(), "<f8")
            total = x if total is None else total + x
        made = squeeze(total.astype("<f4")) if table.column("part")[0].as_py() >= 0 else total.tobytes()
        return pa.table({**{n: table.column(n)[:1] for n in names}, "packed": pa.array([made], pa.binary())})

    while True:
        sources = -(-sources // fan)
        parts = parts.withColumn("source", F.floor(F.col("source") / fan)).groupBy("part", "slice", "source").applyInArrow(add, STEP)
        if sources <= 1:
            break
    return {(r.part, r.slice): unsqueeze(r.packed, "<f4")[0] if r.part >= 0 else np.frombuffer(r.packed, "<f8") for r in parts.collect()}


def table_rows(tables: list[np.ndarray], source: int) -> Iterator[pa.RecordBatch]:
    step = (2 << TABLE_BITS) // SLICES
    for m, table in enumerate(tables):
        for p in range(PREDICTORS):
            for i in range(SLICES):
                part = table[p, i * step : (i + 1) * step]
                if part.any():
                    yield step_batch(m * PREDICTORS + p, i, source, squeeze(part.astype("<f4")))


def step_batch(part: int, i: int, source: int, packed: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([i], pa.int32()), pa.array([source], pa.int64()), pa.array([packed], pa.binary())], names=["part", "slice", "source", "packed"])


class Plan:
    """How the corpus is dealt, and what passes over it share."""

    def __init__(self, blocks: DataFrame):
        self.blocks, self.context = blocks, blocks.sparkSession.sparkContext
        self.total = blocks.agg(F.sum("n_words")).first()[0] or 0
        self.shards = shard_count(self.total, SHARD_WORDS)
        self.bits = 32 + self.shards.bit_length() - 1
        self.tasks = max(-(-max(1, self.total) // TASK_WORDS), min(8, self.total >> 18))  # a small corpus takes a few tasks, too
        self.replies = self.lexicon = None

    def exchange(self) -> None:
        """Exact counts and predictions of repeats, from all training texts."""
        shards, bits, frequent = self.shards, self.bits, max(2, self.total >> FREQUENT)

        def send(block: int, table: pa.Table) -> pa.RecordBatch:
            t = Tokens(table)
            count = np.bincount(t.back, weights=t.trains, minlength=len(t.distinct)).astype("<i4")
            rows = [(block, 4, block % shards, t.rare_bytes(count).astype("<i8").tobytes())]
            rows += [(block, 0, s, squeeze(t.distinct[a:b].astype("<u8"), count[a:b])) for s, a, b in shares(t.distinct, shards, 64)]
            at, key, back = t.repeats(bits)
            n = np.minimum(np.bincount(back, weights=t.trains[at], minlength=len(key)), 65535).astype("<u2")
            cell, word = key >> np.uint64(16), (key & np.uint64(0xFFFF)).astype("<u2")
            for s, a, b in shares(key, shards, bits + 16):
                rows.append((block, 1, s, squeeze(np.diff(cell[a:b], prepend=np.uint64(s << 32)).astype("<u4"), word[a:b], n[a:b])))
            return message_batch(rows)

        def answer(kind: int, shard: int, from_blocks: list[int], packed: list[bytes]) -> list[tuple]:
            if kind == 4:
                return [(-1, 4, shard, np.sum([np.frombuffer(p, "<i8") for p in packed], axis=0).tobytes())]
            return predict(kind, shard, from_blocks, packed) if kind else count_words(kind, shard, from_blocks, packed, frequent)

        rows = stage(per_shard(per_block(self.blocks, send, MESSAGE), answer), "words")
        self.replies = rows.where("kind < 2")

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 + CLASSES)
            for batch in batches:
                for x in batch.column(0):
                    total = total + np.frombuffer(x.as_py(), "<f8")
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], names=["i", "x"])

        facts = np.zeros(2 + CLASSES)
        for r in rows.where("kind = 2").select("packed").mapInArrow(add_up, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect():
            facts[r.i] = r.x
        often = [unsqueeze(r.packed, "<u8", "<i8") for r in rows.where("kind = 3").select("packed").collect() if r.packed]  # 2 ** FREQUENT words at most
        word, count = (np.concatenate([x[i] for x in often]) if often else np.zeros(0, np.uint64 if i == 0 else np.int64) for i in (0, 1))
        letters = np.sum([np.frombuffer(r.packed, "<i8") for r in rows.where("kind = 4").select("packed").collect()], axis=0) + np.ones(256, np.int64)  # a row a shard
        self.lexicon = self.context.broadcast(Lexicon(word, count, facts[2:], int(facts[0]), int(facts[1]), in_order(letters)))

    def in_few_tasks(self, make: Callable[[], tuple[Callable, Callable]], schema: str) -> DataFrame:
        """A few large tasks: each gives all rows of visit(tokens, count, answer) for its blocks, then those of finish(task)."""
        shards, bits = self.shards, self.bits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            visit, finish = make()
            for _, table, got in each_block(batches):
                t = Tokens(table)
                yield from visit(t, *t.answers(got, shards, bits))
            yield from finish(TaskContext.get().partitionId())

        return with_replies(self.blocks, [self.replies]).coalesce(self.tasks).mapInArrow(run, schema)

    def count_bits(self) -> list[np.ndarray]:
        """The tables of the code and of the spelling, from all training texts."""
        lexicon = self.lexicon

        def make():
            tables, met = [new_table(), new_table()], np.zeros(len(lexicon.value.length), np.int32)

            def visit(t: Tokens, count: np.ndarray, answer: np.ndarray) -> list:
                text, at = t.some(t.train, lexicon.value, count, answer, 1)
                add_counts(tables[0], (d for a, b in chunks(len(at), CHUNK) for d in text.decisions(a, b, whole=False)))
                np.add(met, np.bincount(text.symbol[~text.match], minlength=len(met)), out=met, casting="same_kind")
                spelling = Spelling(t.text(at[(text.seen == 0) & t.is_word[at]]), lexicon.value.letters)
                add_counts(tables[1], (d for a, b in chunks(len(spelling.byte), CHUNK) for d in spelling.decisions(a, b)))
                return []

            def finish(task: int) -> Iterator[pa.RecordBatch]:
                for symbol, slot, bit in lexicon.value.steps():
                    np.add.at(tables[0][0], slot << 1 | bit, met[symbol])
                yield from table_rows(tables, task)

            return visit, finish

        out, step = [new_table(np.float32), new_table(np.float32)], (2 << TABLE_BITS) // SLICES
        for (part, i), x in tree_sum(self.in_few_tasks(make, STEP), self.tasks).items():
            out[part // PREDICTORS][part % PREDICTORS, i * step : (i + 1) * step] = x
        return [narrow(x) for x in out]

    def learn(self, tables: list[np.ndarray]) -> tuple[DataFrame, DataFrame, list[Mixer]]:
        """(rows of training texts, held-out texts in packed form, what is learned)."""
        shipped, lexicon = self.context.broadcast(tables), self.lexicon  # TABLE_BITS bounds it: 2 bytes a slot

        def make():
            learners, warm, plain = [Learner(), Learner()], False, Plain(shipped.value[0][0], lexicon.value)
            found = [without_own(table) for table in shipped.value]

            def visit(t: Tokens, count: np.ndarray, answer: np.ndarray) -> Iterator[pa.RecordBatch]:
                nonlocal warm
                lex = lexicon.value
                base = base_of(count, lex)
                letters = np.bincount(t.words.doc, weights=t.words.end - t.words.start + 1, minlength=t.docs).astype(np.int64) + 1
                if t.train.any():
                    text, at = t.some(t.train, lex, count, answer, 1)
                    once = np.nonzero((text.seen == 0) & t.is_word[at])[0]
                    spelling = Spelling(t.text(at[once]), lex.letters)
                    if not warm:  # the first texts of a task shouldn't cost more than the others
                        learners[0].read(found[0], text, len(at), None, plain)
                        learners[1].read(found[1], spelling, len(spelling.byte), None)
                        warm = True
                    cost, spelled = np.zeros(len(at)), np.zeros(len(spelling.byte))
                    learners[0].read(found[0], text, len(at), cost, plain)
                    learners[1].read(found[1], spelling, len(spelling.byte), spelled)
                    by_word = np.bincount(spelling.word, weights=spelled, minlength=len(once))
                    cost[once] += np.where(text.match[once], 0, by_word)
                    yield doc_rows(t.ids.filter(pa.array(t.train)), text, cost + text.fixed_bits(), count[at], base[at], letters[t.train])
                held = ~t.train
                if held.any():
                    text, at = t.some(held, lex, count, answer, 0)
                    yield held_row(t.ids.filter(pa.array(held)), text, answer[at], letters[held], t.text(at[text.unseen()]))

            return visit, lambda task: (learned_row(-1 - m, task, x.facts().tobytes()) for m, x in enumerate(learners))

        rows = stage(self.in_few_tasks(make, PASS), "learned")
        shipped.unpersist()
        facts = tree_sum(rows.where("part < 0").select("part", "slice", "source", "packed"), self.tasks)
        return rows.where("part = 1").select(*DOC), rows.where("part = 2").select("packed"), [Mixer(table, facts.get((-1 - m, 0))) for m, table in enumerate(tables)]


def base_of(count: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    return np.log10((count + 0.1) / (lexicon.tokens + 0.1 * (lexicon.distinct + 1)))


DOC = ("doc_id", "n_tokens", "n_known", "base_score", "score", "bits_per_byte")
DOC_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
PASS = "part int, slice int, source long, packed binary, doc_id long, n_tokens long, n_known long, base_score double, score double, bits_per_byte double"


def pass_batch(part: int, source: int | None, packed: bytes | None, docs: list[pa.Array] | None) -> pa.RecordBatch:
    n = len(docs[0]) if docs else 1
    head = [pa.array([part] * n, pa.int32()), pa.array([0] * n, pa.int32()), pa.array([source] * n, pa.int64()), pa.array([packed] * n, pa.binary())]
    return pa.RecordBatch.from_arrays([*head, *(docs or [pa.nulls(1, t) for t in DOC_TYPES])], names=["part", "slice", "source", "packed", *DOC])


def learned_row(part: int, task: int, packed: bytes) -> pa.RecordBatch:
    return pass_batch(part, task, packed, None)


def doc_columns(ids: pa.Array, text: Text, cost: np.ndarray, count: np.ndarray, base: np.ndarray, letters: np.ndarray) -> list[pa.Array]:
    def by_doc(value: np.ndarray) -> np.ndarray:
        return np.bincount(text.doc, weights=value, minlength=len(text.size))

    total = by_doc(cost)
    return [ids, pa.array(text.size), pa.array(by_doc(count > 0).astype(np.int64)), pa.array(by_doc(base)), pa.array(-total * np.log10(2)), pa.array(total / letters)]


def doc_rows(ids: pa.Array, text: Text, cost: np.ndarray, count: np.ndarray, base: np.ndarray, letters: np.ndarray) -> pa.RecordBatch:
    return pass_batch(1, None, None, doc_columns(ids, text, cost, count, base, letters))


def held_row(ids: pa.Array, text: Text, answer: np.ndarray, letters: np.ndarray, unseen: list[bytes]) -> pa.RecordBatch:
    """All that scoring needs of a block's held-out texts."""
    table = pa.table({"ids": pa.array([ids.to_pylist()], pa.list_(pa.int64())), "docs": [squeeze(text.size.astype("<i8"), letters.astype("<i8"))], "tokens": [squeeze(text.hash, text.seen.astype("<i8"), answer)], "unseen": pa.array([unseen], pa.list_(pa.binary()))})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return pass_batch(2, None, sink.getvalue().to_pybytes(), None)


def score_held(packed: bytes, lexicon: Lexicon, code: Mixer, letters: Mixer) -> list[pa.Array]:
    """The columns of a block's held-out texts, by the finished model."""
    row = pa.ipc.open_stream(packed).read_all().to_pylist()[0]
    size, length = unsqueeze(row["docs"], "<i8", "<i8")
    word, seen, answer = unsqueeze(row["tokens"], "<u8", "<i8", "u1")
    text = Text(lexicon, size, word, seen, answer)
    cost = code.cost(text, len(word)) + text.fixed_bits()
    if row["unseen"]:
        words = sorted(set(row["unseen"]))
        spelling = Spelling(words, lexicon.letters)
        bits = dict(zip(words, np.bincount(spelling.word, weights=letters.cost(spelling, len(spelling.byte)), minlength=len(words)).tolist()))
        cost[text.unseen()] += [bits[w] for w in row["unseen"]]
    return doc_columns(pa.array(row["ids"], pa.int64()), text, cost, seen, base_of(seen, lexicon), length)


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = 400_000) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte of every text.

    A training text's score is what it cost when the learner came to it; held-out texts are
    scored by the finished model.
    """
    plan = Plan(write_blocks(pick(df, id_col, text_col), id_col, text_col, block_words))
    plan.exchange()
    train, held, mixers = plan.learn(plan.count_bits())
    shipped, lexicon = plan.context.broadcast(mixers), plan.lexicon

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0):
                yield pa.RecordBatch.from_arrays(score_held(packed.as_py(), lexicon.value, *shipped.value), names=list(DOC))

    scored = held.mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double, bits_per_byte double")
    both = train.withColumn("held_out", F.lit(False)).unionByName(scored.withColumn("held_out", F.lit(True)))
    return both.withColumn("train_tokens", F.lit(plan.lexicon.value.tokens).cast("long")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
