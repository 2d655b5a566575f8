"""Tokenizer alignment against a plain version, token by token."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lodestring.llm import alignment
from lodestring.llm.tokens import byte_alphabet

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "Some plain words, and 1234 numbers; don't stop.", "  two spaces  \n\n\tand tabs ", "", None, " ", "a", "é ﬁ ２ 漢字 \U0001f600 мир", "a ▁ sign of its own",
    "<|endoftext|> and <s> </s> <unk> <0x41>", "a\x00b", "\xa0odd spaces​", "Some plain words, and 1234 numbers; don't stop.", "word " * 3000, "x" * 5000,
]


def spans(ids, size):
    at, out = 0, []
    for i in ids:
        out.append((at, at + size[i], i))
        at += size[i]
    return out


def plain(texts):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte = {c: i for i, c in enumerate(byte_alphabet())}
    own_a = {i: bytes(byte[c] for c in t) for t, i in a.get_vocab().items() if i != 50256}
    own_b = {i: bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.piece_size())}
    size_a, size_b = ({i: len(x) for i, x in own.items()} for own in (own_a, own_b))
    docs, counts = [], Counter()
    for t in texts:
        ids_a, ids_b = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        if not t or not b"".join(own_a[i] for i in ids_a) == (" " + t).encode() == b"".join(own_b[i] for i in ids_b):
            docs.append(([], [], []))
            continue
        x, y = spans(ids_a, size_a), spans(ids_b, size_b)
        links, j = [], 0
        for s, e, i in x:
            while j and y[j][0] > s:
                j -= 1
            while y[j][1] <= s:
                j += 1
            k = j
            while k < len(y) and y[k][0] < e:
                links.append((i, y[k][2]))
                k += 1
        both = sorted({e for _, e, _ in x} & {e for _, e, _ in y})
        groups, start = [], 0
        for e in both:
            groups.append(",".join(str(i) for s, z, i in x if start <= s and z <= e) + "|" + ",".join(str(i) for s, z, i in y if start <= s and z <= e)) if len(x) < 2000 else None
            start = e
        counts.update(links)
        docs.append((x, y, links, both, groups))
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(n, best.get(j, 0))
    out = []
    for d in docs:
        links = d[2]
        digest = "" if not links else hashlib.sha256(";".join(d[4]).encode()).hexdigest() if len(d[0]) < 2000 else None
        out.append((len(d[0]), len(d[1]), len(d[3]) if links else 0, len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), digest))
    return out


@pytest.mark.parametrize("held", [1 << 22, 40])
def test_against_plain(spark, monkeypatch, held):
    monkeypatch.setattr(alignment, "HELD", held)
    rows = [(i if i else None, t, "x") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, links string").repartition(3)
    got = {r.doc_id or 0: r for r in alignment.align(df, A, B, with_groups=True).collect()}
    assert len(got) == len(rows)
    for i, want in enumerate(plain(TEXTS)):
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == want[:6], TEXTS[i]
        assert want[6] is None or r.groups_sha256 == want[6]
        assert r.groups_sha256 == (hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "")
    assert alignment.align(df.limit(0), A, B).collect() == []


def test_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 4000").orderBy("doc_id")
    rows = df.select("doc_id", "text").collect()
    got = [tuple(r)[1:] for r in alignment.align(df.repartition(6), A, B).orderBy("doc_id").collect()]
    assert got == [(*w[:6], w[6]) for w in plain([r.text for r in rows])]


def test_packed_keys():
    import numpy as np

    for ids in ([], [(1 << 32) + 5, 7], [(70000 << 32) + 3]):
        assert alignment.unpacked(alignment.packed(np.array(ids, np.int64))).tolist() == ids
