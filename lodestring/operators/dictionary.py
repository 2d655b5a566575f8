"""The full dictionary of substrings, for corpora of short strings.

It holds every substring of every row, so it grows with the square of their lengths: build()
refuses strings over max_length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import all_substrings
from ..plans.storage import checkpointed
from .keyed import rows_of_keys, topk_by_keys
from .search import bounded, exact_topk_batch, largest_k


def substrings(base: DataFrame, max_length: int = 512) -> DataFrame:
    """(g, id) of all distinct substrings of every row."""
    longest = base.agg(F.max(F.length("s"))).first()[0] or 0
    if longest > max_length:
        raise ValueError(f"a string has {longest} characters; the dictionary takes {max_length}")
    return base.select("id", F.explode(F.array_distinct(F.transform(all_substrings(F.col("s")), lambda x: x["g"]))).alias("g")).select("g", "id")


class SubstringDictionary:
    """Exact-key lookup of whole patterns."""

    def __init__(self, base: DataFrame, entries: DataFrame, max_length: int = 512):
        self.base, self.entries, self.max_length = base, entries, max_length

    @staticmethod
    def build(base: DataFrame, max_length: int = 512) -> SubstringDictionary:
        return SubstringDictionary(base, substrings(base, max_length), max_length)

    def append(self, rows: DataFrame) -> SubstringDictionary:
        return SubstringDictionary(self.base.unionByName(rows), self.entries.unionByName(substrings(rows, self.max_length)), self.max_length)

    def save(self, path: str) -> None:
        self.base.write.mode("overwrite").parquet(f"{path}/base")
        self.entries.repartitionByRange("g").sortWithinPartitions("g", "id").write.mode("overwrite").parquet(f"{path}/entries")
        self.base.sparkSession.createDataFrame([(str(self.max_length),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/max_length")

    @staticmethod
    def load(spark, path: str) -> SubstringDictionary:
        return SubstringDictionary(spark.read.parquet(f"{path}/base"), spark.read.parquet(f"{path}/entries"), int(spark.read.text(f"{path}/max_length").first()[0]))

    def size_report(self) -> DataFrame:
        return self.entries.agg(F.countDistinct("g").alias("substrings"), F.count("*").alias("ids"))

    def search(self, queries: DataFrame) -> DataFrame:
        """(qid, rank, id, dist); the empty pattern stands for all rows."""
        keyed = queries.where("p <> ''").withColumn("g", F.col("p"))
        needed = checkpointed(self.base.sparkSession, keyed.select("g").distinct())
        rows = rows_of_keys(self.entries, needed, self.base.select("id", "v"), bounded(queries))
        found = topk_by_keys(rows, keyed, largest_k(queries))
        empty = queries.where("p = ''")
        return found if empty.isEmpty() else found.unionAll(exact_topk_batch(self.base, empty))
