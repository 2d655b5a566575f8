"""Deterministic workloads: queries, synthetic corpora, synthetic strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.storage import checkpointed

# The multiplicative hash that seeds a string, and the linear congruential step.
SEED_FACTOR = 2654435761
STEP_FACTOR, STEP_ADD, MODULUS = 1664525, 1013904223, 1 << 32


def step(x: Column) -> Column:
    return (x * F.lit(STEP_FACTOR) + F.lit(STEP_ADD)).bitwiseAND(F.lit(MODULUS - 1))


def seeded(i: Column) -> Column:
    return ((i.cast("long") + 1) * F.lit(SEED_FACTOR)).bitwiseAND(F.lit(MODULUS - 1))


def synthetic_string(i: Column, length: int = 50) -> Column:
    """A reproducible lower-case string for row i."""
    start = F.struct(seeded(i).alias("x"), F.lit("").alias("s"))

    def add(acc: Column, _: Column) -> Column:
        x = step(acc["x"])
        return F.struct(x.alias("x"), F.concat(acc["s"], F.chr(F.lit(97) + x % 26)).alias("s"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(length)), start, add)["s"]


def numbered(ids: DataFrame) -> DataFrame:
    """(n, id, copy): row numbers from 0 in order of id, by a count for each range of ids; copy tells rows with one id apart.

    The ranges are written before they are read twice: Spark may cut them anew each time.
    """
    ranged = checkpointed(ids.sparkSession, ids.select("id").repartitionByRange("id").withColumn("part", F.spark_partition_id()))
    counts = ranged.groupBy("part").agg(F.count("*").alias("c"))  # a row a partition
    before = counts.select("part", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    within = Window.partitionBy("part").orderBy("id")
    own = ranged.withColumn("own", F.row_number().over(within) - 1).withColumn("copy", F.col("own") - F.rank().over(within) + 1)
    return own.join(before, "part").select((F.col("first") + F.col("own")).alias("n"), "id", "copy")


def with_value(drawn: DataFrame, rows: DataFrame, value: str, small: bool) -> DataFrame:
    """drawn (id, copy, ...) with the value of each row; only rows that are drawn leave their tasks where drawn is small."""
    ids = drawn.select("id").distinct()
    chosen = rows.select("id", value).join(F.broadcast(ids) if small else ids, "id", "left_semi")
    told = chosen.withColumn("copy", F.row_number().over(Window.partitionBy("id").orderBy(value)) - 1)
    return drawn.join(told, ["id", "copy"]).drop("id", "copy")


def generate_queries(base: DataFrame, n: int, length: int = 3, k: int = 10, mixed: bool = False, data_size: int | None = None, salt: int = 0) -> DataFrame:
    """(qid, p, qv, k): a piece at a uniform place of a random string, and another random row's vector.

    Of the first data_size rows, those with `length` letters or more (2 with mixed, where the
    piece has 2 to 4) are candidates. Choices are steps of a congruential generator seeded by
    qid, so any engine can repeat them.
    """
    spark = base.sparkSession
    rows = base if data_size is None else base.where(F.col("id") < data_size)
    long_enough = rows.where(F.length("s") >= (2 if mixed else length))
    strings, vectors = checkpointed(spark, numbered(long_enough)), checkpointed(spark, numbered(rows))
    n_strings, n_vectors = strings.count(), vectors.count()
    if not n_strings:
        raise ValueError("no string is long enough")
    high = lambda x: F.shiftright(x, 8)  # low bits of the generator repeat soon
    draw = spark.range(n).select(F.col("id").alias("qid"), step(seeded(F.col("id") + salt)).alias("a"))
    draw = draw.withColumn("b", step(F.col("a"))).withColumn("c", step(F.col("b"))).withColumn("d", step(F.col("c")))
    draw = draw.select("qid", (high(F.col("a")) % n_strings).alias("n"), high(F.col("b")).alias("b"), (high(F.col("c")) % n_vectors).alias("nv"), high(F.col("d")).alias("d"))
    small = n <= 1 << 20
    drawn = with_value(draw.join(strings, "n"), long_enough, "s", small)
    size = F.least(F.lit(4), F.length("s")) - 1 if mixed else F.lit(1)
    size = (F.lit(2) + F.col("d") % size if mixed else F.lit(length)).cast("int")
    placed = drawn.withColumn("size", size).withColumn("start", (F.col("b") % (F.length("s") - F.col("size") + 1) + 1).cast("int"))
    p = F.substring("s", F.col("start"), F.col("size"))
    asked = placed.select("qid", "nv", p.alias("p")).join(vectors.withColumnRenamed("n", "nv"), "nv")
    return with_value(asked, rows, "v", small).select("qid", "p", F.col("v").alias("qv"), F.lit(k).alias("k"))


def synthetic_corpus(spark: SparkSession, n: int = 100, dim: int = 128, least: int = 100, most: int = 500, seed: int = 42) -> DataFrame:
    """(id, s, v): uniform letters of uniform length, uniform vectors."""
    letters = F.transform(F.sequence(F.lit(1), F.col("size")), lambda i: F.chr(F.lit(97) + F.pmod(F.xxhash64("id", i, F.lit(seed)), F.lit(26))))
    numbers = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: (F.pmod(F.xxhash64("id", i, F.lit(seed + 1)), F.lit(1 << 24)) / (1 << 24)).cast("float"))
    sized = spark.range(n).withColumn("size", (F.lit(least) + F.pmod(F.xxhash64("id", F.lit(seed + 2)), F.lit(most - least + 1))).cast("int"))
    return sized.select("id", F.array_join(letters, "").alias("s"), numbers.alias("v"))


def split_inserts(base: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(base, inserts): the last n * percent // 100 rows by id are inserted after the build."""
    n = base.count()
    held = n * percent // 100
    if not held:
        return base, base.limit(0)
    edge = numbered(base.select("id")).where(F.col("n") == n - held).first()["id"]  # by counts of ranges
    return base.where(F.col("id") < edge), base.where(F.col("id") >= edge)
