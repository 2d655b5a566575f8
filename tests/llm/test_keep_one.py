from lodestring.llm import simhash


def test_rows_that_share_an_id(spark):
    one, two, three = (" ".join(f"{p}{i}" for i in range(40)) for p in "abc")
    df = spark.createDataFrame([(1, one), (1, two), (2, two), (3, three), (0, three), (3, "else " + two[:20])], "doc_id long, text string")
    assert sorted(map(tuple, simhash.keep_one(df).collect())) == sorted([(1, one), (1, two), (0, three), (3, "else " + two[:20])])
