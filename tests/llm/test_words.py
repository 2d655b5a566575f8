import numpy as np

from lodestring.llm import lm
from lodestring.llm.blocks import BYTE_KEY, Words, mix


def test_hashes_do_not_depend_on_the_place():
    """More words than are hashed at a time, among them a long one."""
    texts = [b" ".join(b"w%d" % (i % 700) for i in range(20_000)), b"", b"x" * 50_000 + b" w1\n", b"w2"]
    w = Words(texts)
    h = w.hashes()
    words = [w.data[a:b] for a, b in zip(w.start.tolist(), w.end.tolist())]
    assert words == b" ".join(texts).split() and len(h) == len(words)
    assert len(set(zip(words, h.tolist()))) == len(set(words)) == len(set(h.tolist()))
    power = np.multiply.accumulate(np.array([1, 0xD6E8FEB86659FD93, 0xD6E8FEB86659FD93], np.uint64))
    assert h[1] == mix(np.array([(BYTE_KEY[list(b"w1")] * power[:2]).sum(dtype=np.uint64) + np.uint64(2)], np.uint64))[0]


def test_predictions_by_counts():
    """Contexts 1 and 2; ties go to the smaller word."""
    key = np.array([1 << 16 | 5, 1 << 16 | 3, 1 << 16 | 5, 2 << 16 | 9, 2 << 16 | 4], np.uint64)
    found = lm.predicted(key, np.array([2, 3, 2, 1, 1], "<u2"))
    assert [bool(f & 8) for f in found.tolist()] == [True, False, True, False, True]
    assert found[0] == found[2]


def test_hashes_equal_a_plain_version():
    """Over stretches of 8,192 words, whose last one may be longer than all others, and of one."""
    factor, m = 0xD6E8FEB86659FD93, 1 << 64
    for texts in ([b"a bc  d"], [b"x yz " * 5000, b"", b"q" * 70_000], [b"a " * 8192], [b"a " * 8192 + b"bcd"]):
        w = Words(texts)
        words = [w.data[a:b] for a, b in zip(w.start.tolist(), w.end.tolist())]
        assert words == [x for t in texts for x in t.split()]
        plain = {}
        for x in set(words):
            h, power = len(x), 1
            for c in x:
                h, power = (h + int(BYTE_KEY[c]) * power) % m, power * factor % m
            plain[x] = h
        assert np.array_equal(w.hashes(), mix(np.array([plain[x] for x in words], np.uint64)))
