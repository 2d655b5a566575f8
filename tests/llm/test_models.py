"""Toxicity and language-model scores."""

import math
import random
from collections import Counter

import numpy as np

from lodestring.llm import blocks, lm, toxicity

SMALL = toxicity.Settings(features=(1 << 8, 1 << 12), steps=60)


def labelled(n=400):
    r = random.Random(4)
    vocab = ["".join(r.choice(["th", "er", "on", "an", "re", "he", "in"]) for _ in range(r.randint(1, 4))) for _ in range(500)]
    docs, labels = [], []
    for d in range(n):
        words = [r.choice(vocab) for _ in range(r.randint(5, 200))]
        bad = d % 5 == 0
        if bad:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["awful", "nastyword", "rotten"]))
        docs.append((d, " ".join(words), "x"))
        labels.append((d, int(bad)))
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled()
    df = spark.createDataFrame(docs, "doc_id long, text string, predicted string")
    lab = spark.createDataFrame([*labels, (10**6, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(df, lab, SMALL)
    truth = dict(labels)
    got = [r for r in toxicity.score(df, model, SMALL).collect() if toxicity.held_out(r.doc_id)]
    assert len(got) > 100
    assert sum(r.predicted == truth[r.doc_id] for r in got) >= 0.97 * len(got)
    clean = toxicity.drop_toxic(df, model, SMALL)
    assert clean.columns == df.columns and 0 < clean.count() < len(docs)
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "ab"), (3, "awful " * 30000)], "doc_id long, text string")
    rows = toxicity.score(odd, model, SMALL).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows) and rows[1].score == rows[2].score
    assert toxicity.score(odd.limit(0), model, SMALL).collect() == []


def test_held_out_rows_and_missing_labels_teach_nothing(spark):
    docs, labels = labelled(60)
    df = spark.createDataFrame(docs, "doc_id long, text string, x string")
    flipped = [(d, 1 - y if toxicity.held_out(d) else y) for d, y in labels]
    models = [toxicity.fit(df, spark.createDataFrame(x, "doc_id long, toxic int"), SMALL) for x in (labels, flipped)]
    assert np.array_equal(models[0].weights, models[1].weights) and models[0].intercept == models[1].intercept
    none = toxicity.fit(df, spark.createDataFrame([], "doc_id long, toxic int"), SMALL)
    assert {r.score for r in toxicity.score(df, none, SMALL).collect()} == {0.5}


def test_toxicity_line_is_the_least_loss():
    r = np.random.default_rng(3)
    y = (r.random(300) < 0.2).astype(float)
    z = 3 * y + r.normal(size=300) - 4
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))

    def loss(a, b):
        m = a * z + b
        return float(np.sum(np.logaddexp(0, m) - t * m) + 0.5 * ((a - 1) ** 2 + 0.1 * b * b))

    a, b = toxicity.line(z, y)
    assert all(loss(a, b) <= loss(a + da, b + db) + 1e-9 for da in (-0.01, 0, 0.01) for db in (-0.01, 0, 0.01))
    assert all(math.isfinite(x) for x in toxicity.line(np.where(y == 1, 50.0, -50.0), y))  # apart by any line


def test_toxicity_ratios_and_scores_equal_a_plain_version():
    s = toxicity.Settings(bits=10, sizes=(2, 3), features=(1 << 10,))
    texts = ["ab ab c", "", "B a", "cab"]
    distinct = toxicity.Distinct(1 << s.bits)
    for t in texts:
        padded = b" " + b" ".join(t.lower().encode().split()) + b" " if t else b""
        want = set()
        for n in s.sizes:
            for i in range(len(padded) - n + 1):
                acc = 0
                for c in padded[i : i + n]:
                    acc = (acc * 0x100000001B3 + c) % 2**64
                want.add((acc + n) * 0x9E3779B97F4A7C15 % 2**64 >> 64 - s.bits)
        assert set(distinct(toxicity.ngrams(t, s)).tolist()) == want
    pos, neg = np.array([3, 0, 5]), np.array([1, 2, 5])
    a, b = s.smoothing * 6 / 16, s.smoothing * 10 / 16
    for got, p, n in zip(toxicity.ratios(pos, neg, 6, 10, s), pos, neg):
        assert abs(got - (math.log((p + a) / (6 + a)) - math.log((n + b) / (10 + b)))) < 1e-12
    model = toxicity.Model(np.linspace(-1, 1, 1 << s.bits), -0.3)
    for t, got in zip(texts, toxicity.scorer(model, s)(texts)):
        z = -0.3 + sum(model.weights[f] for f in set(toxicity.ngrams(t, s).tolist()))
        assert abs(got - 1 / (1 + math.exp(-z))) < 1e-9


def test_toxicity_takes_one_text_an_id(spark):
    docs, labels = labelled(120)
    many = docs + [docs[0]] * 500
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    once, often = (toxicity.fit(spark.createDataFrame(d, "doc_id long, text string, x string"), lab, SMALL) for d in (docs, many))
    assert np.array_equal(once.weights, often.weights) and once.intercept == often.intercept


def corpus():
    r = random.Random(9)
    weights = [1 / (i + 1) for i in range(800)]
    vocab = ["".join(r.choice("aeiou") + r.choice("lnrst") for _ in range(r.randint(1, 4))) for _ in range(800)]
    rows = [(d, " ".join(r.choices(vocab, weights, k=r.randint(0, 120))).title()) for d in range(150)]
    return [*rows, (None, None), (7, ""), (8, "Zqé xw"), (8, "Zqé xw"), (200, "long" * 5000)]


def test_lm_scores(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD_WORDS", 4000)  # several shards
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1.5) for d, t in rows], "doc_id long, text string, score double").repartition(3)
    got = lm.score(df, block_words=500).collect()
    assert len(got) == len(rows)
    lower = lambda t: [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()] + ["\n"]
    train = Counter(w for (d, t), k in zip(rows, lm.in_training([d for d, _ in rows])) if k for w in lower(t))
    n, v = sum(train.values()), len(train)
    want = sorted((str(d), len(lower(t)), sum(w in train for w in lower(t)), round(sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in lower(t)), 6)) for d, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {n}
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert next(r for r in got if r.doc_id is None).held_out
    held = [r for r in got if r.held_out and r.n_tokens > 20]
    assert held and sum(r.score for r in held) > 1.1 * sum(r.base_score for r in held)  # words drawn one by one: nothing to gain on the base
    assert lm.score(df.limit(0)).collect() == []
    untaught = [(d, t, 1.5) for d, t in rows if d is None or not lm.in_training([d])[0]]
    alone = lm.score(spark.createDataFrame(untaught, "doc_id long, text string, score double")).collect()
    assert len(alone) == len(untaught) and {(r.train_tokens, r.n_known) for r in alone} == {(0, 0)} and all(math.isfinite(r.score) and r.score < 0 for r in alone)


def test_lm_beats_the_base_on_documents(spark):
    """On 1,000 documents; on 200 held-out texts lie 0.1 % below the base, which is no distribution over new words."""
    got = lm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    for held in (True, False):
        own = [r for r in got if r.held_out == held]
        assert sum(r.score for r in own) > sum(r.base_score for r in own)
    known = [r for r in got if r.held_out and r.n_known == r.n_tokens]
    assert known and sum(r.score for r in known) > sum(r.base_score for r in known)


def test_lm_tells_copies_from_the_rest(spark):
    """Texts that stand twice are told by their bits a byte, whichever block and task reads them."""
    r = random.Random(3)
    vocab = ["".join(r.choice(["th", "er", "on", "an", "re", "he", "in", "ou"]) for _ in range(r.randint(1, 4))) for _ in range(900)]
    rows = [(d, " ".join(r.choice(vocab) for _ in range(60))) for d in range(300)]
    rows += [(1000 + d, t) for d, t in rows[:40]]
    got = {x.doc_id: x.bits_per_byte for x in lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), block_words=2000).collect()}
    train = [d for d in range(300) if lm.in_training([d])[0]]
    twice = [got[d] for d in train if d < 40 and lm.in_training([1000 + d])[0]]
    once = [got[d] for d in train if d >= 40]
    assert max(twice) < 0.5 * min(once)


def test_lm_takes_the_code_under_no_context_by_symbol():
    rng = np.random.default_rng(5)
    word = np.sort(rng.integers(0, 1 << 63, 300).astype(np.uint64))
    count = (3000 // np.arange(1, 301)).astype(np.int64)
    often = count >= 40
    rare = count[~often]
    mass = np.bincount(lm.magnitude(rare), weights=rare, minlength=lm.CLASSES)
    lexicon = lm.Lexicon(word[often], count[often], mass, int(count.sum()), 300)
    pick = rng.choice(300, 4000, p=count / count.sum())
    text = lm.Text(lexicon, np.full(40, 100), word[pick], count[pick] - 1, rng.integers(0, 16, 4000).astype(np.uint8))
    whole, short = lm.new_table(), lm.new_table()
    lm.add_counts(whole, text.decisions(0, 4000))
    lm.add_counts(short, text.decisions(0, 4000, whole=False))
    met = np.bincount(text.symbol[~text.match], minlength=len(lexicon.length))
    for symbol, slot, bit in lexicon.steps():
        np.add.at(short[0], slot << 1 | bit, met[symbol].astype(np.int32))
    assert np.array_equal(whole, short) and whole[0].sum() > 8000
    table = lm.narrow(whole)
    plain = lm.Plain(table[0], lexicon)
    for a, b in zip(text.decisions(0, 4000), text.decisions(0, 4000, whole=False), strict=True):
        (x, gate), (y, same) = lm.look(table, a, True), lm.look(table, b, True, plain)
        assert np.array_equal(gate, same) and all(np.array_equal(u, v) for u, v in zip(x, y, strict=True))
        assert (b.slots[0] is None) == (b.symbol is not None)


def plain_cost(mixer, decisions):
    """The cost of decisions one by one, with Python's numbers."""
    total = []
    for d in decisions:
        for i in range(len(d.bit)):
            x, longest = [], 0
            for p in range(lm.PREDICTORS):
                pair = int(mixer.table[p][d.slots[p][i]])
                n0, n1 = (int(lm.count_of(np.array(c))) for c in (pair & 255, pair >> 8))
                x.append(round(math.log((n1 + lm.ADD) / (n0 + lm.ADD)) * lm.SCALE) / lm.SCALE)
                if n0 + n1:
                    longest = (p + 1) * lm.LEVELS + min((n0 + n1).bit_length(), lm.LEVELS - 1)
            gate = int(d.place[i]) * (lm.PREDICTORS + 1) * lm.LEVELS + longest
            mixed = sum(float(mixer.weights[p][gate]) * x[p] for p in range(lm.PREDICTORS))
            p1 = 1 / (1 + math.exp(-max(-20, min(20, mixed))))
            at = int(d.map[i]) * lm.MAP_CELLS + max(0, min(lm.MAP_CELLS - 1, round(2 * mixed) + lm.MAP_CELLS // 2))
            p1 += float(mixer.trust[at]) * (float(mixer.refined[at]) - p1)
            p1 = max(1e-6, min(1 - 1e-6, p1))
            total.append((int(d.item[i]), -math.log2(p1 if d.bit[i] else 1 - p1)))
    return total


def test_lm_costs_equal_a_plain_version():
    words = [bytes(w, "ascii") for w in ("anan", "tion", "er", "ananer", "x")]
    spelling, table = lm.Spelling(words), lm.new_table()
    lm.add_counts(table, spelling.decisions(0, len(spelling.byte)))
    plain = Counter()
    for d in spelling.decisions(0, len(spelling.byte)):
        for p, s in enumerate(d.slots):
            plain.update((p, int(2 * a + b)) for a, b in zip(s, d.bit))
    assert {(p, i): int(table[p, i]) for p, i in zip(*np.nonzero(table))} == plain
    learner = lm.Learner()
    learner.read(lm.narrow(table), spelling, len(spelling.byte), None)
    mixer = lm.Mixer(lm.narrow(table), learner.facts())
    new = lm.Spelling([b"tier", b"on", b"anan"])
    want = np.zeros(len(new.byte))
    for item, bits in plain_cost(mixer, new.decisions(0, len(new.byte))):
        want[item] += bits
    assert np.allclose(mixer.cost(new, len(new.byte)), want, rtol=1e-3, atol=1e-4)
    # the 256 values of one byte share a probability of 1
    letters = lm.Spelling([bytes([a]) for a in range(256)])
    first = mixer.cost(letters, len(letters.byte))[np.unique(letters.word, return_index=True)[1]]
    assert abs((2.0 ** -first).sum() - 1) < 1e-4


def test_lm_code_and_counts():
    r = random.Random(8)
    for n in (0, 1, 2, 3, 70):
        weight = [r.randint(1, 1000) for _ in range(n)]
        length = lm.code_lengths(weight)
        assert n < 2 or sum(2.0**-x for x in length) == 1
        assert all(length[i] <= length[j] for i in range(n) for j in range(n) if weight[i] > weight[j])
    word, count = np.array([5, 9, 2], np.uint64), np.array([50, 7, 9])
    lex = lm.Lexicon(word, count, np.zeros(lm.CLASSES), 66, 3)
    codes = [format(c, f"0{n}b") for c, n in zip(lex.code.tolist(), lex.length.tolist())]
    assert not any(a != b and b.startswith(a) for a in codes for b in codes)
    assert lex.symbols(np.array([5, 2, 9, 1, 1], np.uint64), np.array([50, 9, 7, 6, 0])).tolist() == [0, 1, 2, 3 + 2, lex.unseen]
    codes = np.arange(256)
    assert (lm.code_of(lm.count_of(codes)) == codes).all() and lm.count_of(codes[:32]).tolist() == list(range(32))


def test_lm_predictions_equal_a_plain_version():
    r = random.Random(6)
    blocks = [Counter((r.randint(0, 6), r.randint(0, 3)) for _ in range(r.randint(1, 12))) for _ in range(5)]
    taught = [{k: r.randint(0, n) for k, n in b.items()} for b in blocks]
    packed = []
    for b in taught:
        keys = sorted(b)
        packed.append(lm.squeeze(np.diff([c for c, _ in keys], prepend=0).astype("<u4"), np.array([x for _, x in keys], "<u2"), np.array([b[k] for k in keys], "<u2")))
    total = Counter()
    for b in taught:
        total.update(b)

    def best(context, without=None):
        """(the predicted word, how often, how often the next one) among a context's words."""
        n = {x: c - (without == (k, x)) for (k, x), c in total.items() if k == context}
        order = sorted(n, key=lambda x: (-n[x], without != (context, x), x))
        return order[0], n[order[0]], n[order[1]] if len(order) > 1 else 0

    got = lm.predict(1, 0, list(range(5)), packed)
    for (_, _, _, reply), b in zip(got, taught):
        for (context, x), byte in zip(sorted(b), lm.unsqueeze(reply, "u1")[0].tolist()):
            word, one, two = best(context)
            assert byte & 7 == lm.strength(np.array([one]), np.array([two]))[0] and (byte >> 3 & 1) == (word == x)
            if b[context, x]:
                word, one, two = best(context, (context, x))
                assert byte >> 4 & 7 == lm.strength(np.array([one]), np.array([two]))[0]
                assert not one or byte >> 7 == (word == x) or one == two


def test_toxicity_evidence_equals_a_plain_version():
    n = np.array([9, 4])
    by = np.array([[0, 9, 3, 1], [4, 4, 1, 0]])
    for i in range(by.shape[1]):
        want = 0.0
        for label in (0, 1):
            for seen in (by[:, i], n - by[:, i]):
                if seen[label]:
                    want += seen[label] * math.log(seen[label] * n.sum() / (seen.sum() * n[label]))
        assert math.isclose(toxicity.evidence(by, n)[i], want, abs_tol=1e-12)
    assert toxicity.strongest(by, n, SMALL)[1].tolist() == [0, 3, 2, 1]


def test_lm_spells_rare_bytes_in_fewer_decisions():
    """A code by the bytes' weights takes under 6 decisions a byte here, where bytes as they are take 8."""
    r = random.Random(2)
    words = ["".join(r.choices("etaoinsrhldcu", range(13, 0, -1), k=r.randint(2, 9))).encode() for _ in range(400)]
    weight = np.bincount(np.frombuffer(b" ".join([*words, b""]), np.uint8), minlength=256) + 1
    code = lm.in_order(weight)
    for letters, least, most in ((lm.LETTERS, 8, 8), (code, 1, 6)):
        spelling = lm.Spelling(words, letters)
        n = len(spelling.byte)
        taken, written = 0, [""] * n
        for d in spelling.decisions(0, n):
            taken += len(d.bit)
            for i, bit in zip(d.item.tolist(), d.bit.tolist()):
                written[i] += str(bit)
        assert least * n <= taken <= most * n
        by_code = {format(c, f"0{size}b"): b for b, (c, size) in enumerate(zip(letters.code.tolist(), letters.length.tolist()))}
        assert bytes(by_code[x] for x in written) == b"".join(w + b" " for w in words)
    # whatever the code, the costs of all bytes are those of a distribution
    table, learner = lm.new_table(), lm.Learner()
    spelling = lm.Spelling(words, code)
    lm.add_counts(table, spelling.decisions(0, len(spelling.byte)))
    spent = np.zeros(len(spelling.byte))
    learner.read(lm.without_own(lm.narrow(table)), spelling, len(spelling.byte), None)
    learner.read(lm.narrow(table), spelling, len(spelling.byte), spent)
    assert (spent > 0).all() and spent.sum() < 4.5 * len(spent)
    mixer, single = lm.Mixer(lm.narrow(table), learner.facts()), lm.Spelling([bytes([a]) for a in range(256)], code)
    first = mixer.cost(single, len(single.byte))[np.unique(single.word, return_index=True)[1]]
    assert abs((2.0**-first).sum() - 1) < 1e-3
    some = np.concatenate([plain_cost(mixer, [d]) for d in single.decisions(0, 40)])
    assert np.allclose(np.bincount(some[:, 0].astype(int), weights=some[:, 1]), mixer.cost(single, len(single.byte))[:40], rtol=1e-3, atol=1e-4)


def test_lm_keeps_near_steps_in_one_line():
    """The nodes of four steps under one context have slots of their own among 16 neighbours, the next four elsewhere."""
    code = lm.LETTERS
    symbol = np.arange(256)
    taken = [(n, bit, cells[0]) for n, bit, cells in code.steps(symbol, [np.full(256, 77, np.uint64)])]
    assert [n for n, _, _ in taken] == [256] * 8
    for a in (0, 4):
        lines = np.array([cell >> 5 for _, _, cell in taken[a : a + 4]])
        assert (lines == lines[0]).all() and len(np.unique(lines[0])) == (1 if a == 0 else len(np.unique(taken[3][2])))
    slots = np.concatenate([np.unique(cell >> 1) for _, _, cell in taken[:4]])
    assert len(slots) == len(set(slots.tolist())) == 15
    assert all(np.array_equal(cell & 1, bit) and np.array_equal(bit, symbol >> (7 - k) & 1) for k, (_, bit, cell) in enumerate(taken))


def test_lm_evidence_by_outcome_equals_the_table():
    rng = np.random.default_rng(3)
    table = rng.integers(0, 1 << 16, (lm.PREDICTORS, 1 << lm.TABLE_BITS)).astype(np.uint16)
    spelling = lm.Spelling([b"anan", b"tion", b"er", b"xylo"])
    for d in spelling.decisions(0, len(spelling.byte)):
        (x, gate), (y, same) = lm.look(table, d, True), lm.look(lm.without_own(table), d, True)
        assert np.array_equal(gate, same) and all(np.array_equal(u, v) for u, v in zip(x, y, strict=True))


def test_order_of_and_distinct_equal_numpys():
    rng = np.random.default_rng(4)
    few = rng.integers(0, 50, 3000).astype(np.uint64)
    cases = [np.zeros(0, np.uint64), np.array([7], np.uint64), few, few << np.uint64(58), few << np.uint64(40) | rng.integers(0, 3, 3000).astype(np.uint64), few << np.uint64(52) | rng.integers(0, 1 << 12, 3000).astype(np.uint64), rng.integers(0, 1 << 64, 3000, dtype=np.uint64), np.full(9, (1 << 64) - 1, np.uint64)]
    for values in cases:
        assert np.array_equal(blocks.order_of(values), np.argsort(values, kind="stable"))
        for got, want in zip(blocks.distinct(values), np.unique(values, return_inverse=True), strict=True):
            assert np.array_equal(got, want)
