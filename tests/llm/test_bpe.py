import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lodestring.llm import bpe, tokens
from lodestring.llm.tokens import BatchEncoder, encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
WORD_PATH = public_tokenizers.path("word_bpe_49k.json")
PIECES = ["a", "B", "the", "é", " ", "  ", "\n", " \n", "\t", "'s", "'", "1", "23", "<|endoftext|>", " ", "　", "é", "İ", "ß", "Σς", "漢字", "😀", "\x1c", "\x00", "​", "x.", "---", "\r\n", "﻿", "THEA!!", "***"]


def texts():
    r = random.Random(1)
    return ["", " ", "x" * 3000, "thea" * 500, "é" * 900] + ["".join(r.choice(PIECES) for _ in range(r.randint(0, 14))) for _ in range(4000)]


@pytest.fixture(scope="module")
def own():
    return bpe.RankArrayBpe(PATH, words=500)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_equals_the_library(own, library):
    for t in texts():
        want = library.encode(t, add_special_tokens=False).ids
        assert list(own.encode(t)) == want, repr(t)
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text(own, library, t):
    want = library.encode(t, add_special_tokens=False).ids
    assert list(own.encode(t)) == want
    assert own.decode(want) == t


def test_scan_and_heap_agree(own):
    r = random.Random(5)
    for _ in range(200):
        piece = "".join(r.choice("aeinrst é") for _ in range(r.randint(2, 120))).encode()
        assert own.merge(piece) == own.merge_long([own.byte_id[b] for b in piece])


@pytest.mark.parametrize("path", [PATH, WORD_PATH])
def test_batch_encoder_equals_the_library(path, monkeypatch):
    tok, enc = Tokenizer.from_file(path), BatchEncoder(path)
    assert enc.rule in ("prefix", "drop")
    cases = texts() + [None, "don't we'll WE'LL I'm 're'd x'y 's", "a\n\n b \n", "\n\n", " \t x", "1234 5a6", "x" * 33 + " " + "y" * 400]
    for most in (1 << 22, 300):  # the second cuts the longer texts, too
        monkeypatch.setattr(tokens, "BATCH_BYTES", most)
        for start in range(0, len(cases), 100):
            part = cases[start : start + 100]
            ids, ends = enc.encode(part)
            assert ends[-1] == len(ids)
            for t, a, z in zip(part, [0, *ends], ends):
                assert ids[a:z].tolist() == tok.encode(t or "", add_special_tokens=False).ids, repr(t)
    assert enc.encode([])[0].tolist() == [] and encoder(path) is encoder(path)


@given(st.lists(st.text(st.characters(max_codepoint=0x2FF), max_size=40), max_size=5))
@settings(max_examples=200, deadline=None)
def test_batches_of_any_text(library, batch):
    ids, ends = encoder(PATH).encode(batch)
    want = [library.encode(t, add_special_tokens=False).ids for t in batch]
    assert ids.tolist() == sum(want, []) and ends.tolist() == [sum(map(len, want[: i + 1])) for i in range(len(want))]


def test_operators(spark, library):
    rows = [(1, "the thea, the.", 5), (1, "the thea, the.", 5), (2, None, None), (None, "", 7), (3, "long " * 5000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    both = bpe.bpe_round_trip(df, PATH).collect()
    assert {(r.doc_id, tuple(r.ids), r.decoded) for r in both} == {(d, tuple(library.encode(t or "", add_special_tokens=False).ids), t or "") for d, t, _ in rows}
    again = bpe.bpe_decode(bpe.bpe_encode(df, PATH), PATH).collect()
    assert sorted((str(r.doc_id), r.decoded) for r in again) == sorted((str(r.doc_id), r.decoded) for r in both)
    assert bpe.bpe_encode(df.limit(0), PATH).collect() == []
    unknown = spark.createDataFrame([([464, None, 10**6, 262],), (None,), ([],)], "ids array<int>")
    assert [r.decoded for r in bpe.bpe_decode(unknown, PATH).collect()] == ["The the", "", ""]
