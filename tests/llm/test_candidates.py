from lodestring.llm import near_copies as N
from lodestring.llm import simhash

FIRST = 0x3A5C_0F96_71E2_4B8D


def test_simhash_finds_candidates(spark):
    """No two classes share a MinHash key; fingerprints are equal, near, in a chain or too far."""
    fps = {10: FIRST, 11: FIRST, 12: FIRST ^ 0xF, 13: FIRST ^ 0xFF, 14: FIRST ^ 0x1F00000, 15: ~FIRST, 16: ~FIRST ^ 1 << 40}
    rows = [(c, c, [100 * c, 100 * c + 1], f) for c, f in fps.items()] + [(20, 0, [], FIRST), (21, 12, [1200, 1201], FIRST ^ 0xF)]
    marked = spark.createDataFrame(rows, "doc_id long, cls long, keys array<long>, fp long")
    assert sorted(map(tuple, N.candidates(marked).collect())) == [(10, 10), (11, 10), (12, 10), (13, 10), (15, 15), (16, 15)]


def test_marks_have_the_fingerprints_of_simhash(spark):
    texts = ["", None, "one two three four five six", "One TWO three four five six", "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.fp % (1 << 64) for r in N.marks(df).orderBy("doc_id").collect()] == [simhash.fingerprint(t) for t in texts]


def test_simhash_and_minhash_lead_to_one_exact_check(spark):
    words = [f"w{i}" for i in range(400)]
    near = [*words[:200], "other", *words[201:]]
    df = spark.createDataFrame([(3, " ".join(words)), (1, " ".join(near)), (2, "a b c d"), (4, "A b  c d"), (5, "")], "doc_id long, text string")
    assert sorted(r.doc_id for r in N.keep_one(df).collect()) == [1, 2, 5]
