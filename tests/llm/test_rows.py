"""Quality rules, packing, token files and HTML, against plain versions."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lodestring.llm import html_text, packing, quality, token_store

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
DOCS = [(3, "Some plain words stand here. " * 30), (1, "the thea, x***"), (2, None), (2, ""), (None, "no id"), (1, "the thea, x***"), (9, "many words " * 6000)]


def plain_statistics(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "base_failed": len(words) < 20 or 100 * len(covered) > 30 * len(words)}


def test_quality_statistics(spark):
    r = random.Random(2)
    texts = [None, "", " \n\t", "one", "a b c d e f g h " * 3, "x y\n\nx y\n x y\n", "漢字 é b " * 20]
    for _ in range(80):
        texts.append("".join(r.choice(["a", "b ", "\n", "word ", "#|", "é ", "a b c d e f g h i ", "\x0b"]) for _ in range(r.randint(1, 90))))
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)] + [(0, None, "n")], "doc_id long, text string, kept string")
    got = quality.judge_quality(df).collect()
    assert len(got) == len(texts) + 1
    for row in got:
        assert {k: row[k] for k in plain_statistics(None)} == plain_statistics(texts[row.doc_id])
        assert not (row.base_failed and row.kept)
    assert quality.judge_quality(df.limit(0)).collect() == []


def test_quality_verdicts(spark):
    good = "A plain sentence with some words in it, and a few more words for good measure here.\nIt goes on a little."
    nav = good + "\nAll rights reserved."
    lines = ["Aviso legal del sitio.", "TOUS DROITS RéSERVéS", "Datenschutzerklärung lesen.", "Home » Help", "home about CONTACT login us", "a · b"]
    for x in lines:
        assert quality.failing(x.encode(), len(x.split()), quality.Rules()), x
    assert not quality.failing("He went home to search for help, about noon — « bien ».".encode(), 12, quality.Rules())
    bad = {"symbols": " ".join(f"word{i}***" for i in range(60)), "bars": " | ".join(f"word{i}" for i in range(60)), "shout": " ".join(f"WORD{i}!!" for i in range(60)), "salad": " ".join(f"word{i}" for i in range(60))}
    df = spark.createDataFrame([(0, good, 1, "x"), (1, nav, 1, None), *[(i + 2, t, 1, k) for i, (k, t) in enumerate(bad.items())]], "doc_id long, text string, n_chars long, lang string")
    kept = {r.doc_id: r for r in quality.clean_documents(df).collect()}
    assert sorted(kept) == [0, 1]
    assert kept[0].text == kept[1].text == good and kept[1].n_chars == len(good) and kept[1].lang is None


def test_packing(spark):
    tok = Tokenizer.from_file(WORDS)
    df = spark.createDataFrame([(d, t, 1) for d, t in DOCS], "doc_id long, text string, length int").repartition(3)
    rows = packing.pack(df, WORDS, with_ids=True).collect()
    want = Counter((d, tuple([*tok.encode(t or "", add_special_tokens=False).ids, 2])) for d, t in DOCS)
    pieces = {}
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert r.length == len(ids) <= 4096 and r.length & (r.length - 1) == 0 and r.offset == 0
        assert r.ids_crc32 == zlib.crc32(r.ids)
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, tuple(ids.tolist())))
    for (doc, ids), n in want.items():
        own = sorted(pieces[doc, len(ids)])
        assert sum((p for _, p in own[::n]), ()) == ids
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    by = sorted(rows, key=lambda r: r.sequence_id)
    assert [r.length for r in by] == sorted((r.length for r in rows), reverse=True)
    assert packing.pack(df.limit(0), WORDS).collect() == []
    assert packing.binary_lengths(13, 4) == [4, 4, 4, 1] and packing.binary_lengths(0, 4) == []


def test_token_files(spark):
    tok = Tokenizer.from_file(BYTE)
    df = spark.createDataFrame([(d, t, "c") for d, t in DOCS], "doc_id long, text string, shard string").repartition(3)
    rows = token_store.store_and_read(df, BYTE, with_ids=True).orderBy("start").collect()
    want = Counter((d, (*tok.encode(t or "", add_special_tokens=False).ids, 0)) for d, t in DOCS)
    assert Counter((r.doc_id, tuple(r.ids)) for r in rows) == want
    keys, at = [(r.doc_id is not None, r.doc_id or 0) for r in rows], 0
    assert keys == sorted(keys)
    for row in rows:
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(row.ids), zlib.crc32(np.array(row.ids, "<u4").tobytes()))
        at += row.n_tokens
    assert token_store.store_and_read(df.limit(0), BYTE).collect() == []


def test_simple8b_round_trip():
    r = np.random.default_rng(0)
    for ids in ([], [0], [0] * 500, [1] * 7, [70000] * 5, [2**31, 5], [2**40] * 3, range(100), r.integers(0, 50257, 1000), r.integers(0, 2**62, 300), np.where(r.random(5000) < 0.5, 0, r.integers(0, 3000, 5000))):
        ids = np.array(ids, np.uint64)
        words, escapes = token_store.encode_words(ids)
        assert (token_store.decode_words(words, escapes) == ids).all()
    assert len(token_store.encode_words(np.zeros(480, np.uint64))[0]) == 16
    assert len(token_store.encode_words(np.full(60, 1000))[0]) == 8 * 10


def test_html():
    page = "<html><head><title>T</title></head><body><h1>Head <b>line</b></h1><p>one <i>two</i>  three<p>four<br>five<div style='display:none'>no</div><ul><li>a<li>b<ol start=3><li>x<li>y</ol></li><li>c</ul><table><tr><th>Name<th>Val<tr><td>long name<td>1<br>2</table><pre>  x\n    y</pre>tail<script>var a='<p>';</script></body>"
    assert html_text.render(page) == "Head line\n\none two three\n\nfour\nfive\n\n- a\n- b\n  3. x\n  4. y\n- c\n\nName       Val\nlong name  1\n           2\n\n  x\n    y\n\ntail"
    assert html_text.render("<div>" * 50000 + "deep") == "deep"
    assert html_text.render("a &lt;b&gt; &amp;&#x41;<!-- c --> d<p hidden>no") == "a <b> &A d"
    assert html_text.render("<td>x<td>y</table>a</i></p>") is not None
    assert html_text.render(None) == html_text.render("") == html_text.render("<script>x") == ""


def test_html_keeps_all_words(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for r in html_text.extract_text(pages).collect():
        body = re.sub(r"(?s)<(script|style|head)\b.*?</\1>|<!--.*?-->", " ", r.html)
        plain = re.sub(r"<[^>]+>", " ", body)
        import html as h

        assert Counter(re.sub(r"^(- |\d+\. )", "", r.text, flags=re.M).split()) == Counter(h.unescape(plain).split())
    df = spark.createDataFrame([(1, None, "x"), (1, "<p>a", "x"), (1, "<p>a", "x")], "page_id long, html string, text string")
    assert [r.text for r in html_text.extract_text(df).collect()] == ["", "a", "a"]
    assert html_text.extract_text(df.limit(0)).collect() == []
