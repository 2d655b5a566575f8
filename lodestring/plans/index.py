"""The hybrid index: base rows and posting rows as tables, and the choice of strategy."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import grams
from ..operators.keyed import rows_of_keys, topk_by_keys
from ..operators.postings import gram_frequencies, gram_rows, pattern_keys, rarest
from ..operators.search import bounded, exact_topk_batch, largest_k, postfilter_topk
from ..sources.files import check_dimension
from .storage import checkpointed, remove, stored_bytes


class GramIndex:
    """Posting rows of all substrings up to n_max letters, beside the base rows.

    Answers by postings are exact for patterns of any length: longer ones take their rarest
    n_max letters as key, and are verified on the string.
    """

    def __init__(self, base: DataFrame, postings: DataFrame, n_max: int, dim: int, stored: bool = False):
        self.base, self.postings, self.n_max, self.dim, self.stored = base, postings, n_max, dim, stored

    @staticmethod
    def build(base: DataFrame, n_max: int = 4) -> GramIndex:
        base = base.where("s IS NOT NULL AND v IS NOT NULL").select("id", "s", "v")
        return GramIndex(base, gram_rows(base, n_max), n_max, check_dimension(base))

    def append(self, rows: DataFrame, on_bad: str = "raise") -> GramIndex:
        """The index with more rows, equal to a rebuild. on_bad: raise or drop rows of another dimension."""
        rows = rows.where("s IS NOT NULL AND v IS NOT NULL").select("id", "s", "v")
        if on_bad == "drop":
            rows = rows.where(F.size("v") == self.dim)
        else:
            check_dimension(rows, expected=self.dim)
        return GramIndex(self.base.unionByName(rows), self.postings.unionByName(gram_rows(rows, self.n_max)), self.n_max, self.dim, self.stored)

    def save(self, path: str) -> None:
        """base, postings and meta; postings are dealt and sorted by substring, so a lookup prunes row groups."""
        self.base.write.mode("overwrite").parquet(f"{path}/base")
        self.postings.repartitionByRange("g", "id").sortWithinPartitions("g", "id").write.mode("overwrite").parquet(f"{path}/postings")
        meta = json.dumps({"n_max": self.n_max, "dim": self.dim, "strings": "lower-case letters"})
        self.base.sparkSession.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    def save_append(self, path: str, rows: DataFrame) -> None:
        """Adds rows to a saved index: new files alone, nothing is rewritten.

        Postings go first: a row counts from when it stands in base, and then it has all its
        postings. Rows of an append that died before that are added again by the next, and
        searches take posting rows that stand twice once.
        """
        rows = rows.where("s IS NOT NULL AND v IS NOT NULL").select("id", "s", "v")
        check_dimension(rows, expected=self.dim)
        gram_rows(rows, self.n_max).repartitionByRange("g", "id").sortWithinPartitions("g", "id").write.mode("append").parquet(f"{path}/postings")
        rows.write.mode("append").parquet(f"{path}/base")

    @staticmethod
    def load(spark: SparkSession, path: str) -> GramIndex:
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        return GramIndex(spark.read.parquet(f"{path}/base"), spark.read.parquet(f"{path}/postings"), meta["n_max"], meta["dim"], stored=True)

    def compact(self, path: str) -> GramIndex:
        """A copy of a saved index at another path, its appended files merged and sorted, posting rows once."""
        GramIndex(self.base, self.postings.join(self.base.select("id"), "id", "left_semi").select("g", "id").distinct(), self.n_max, self.dim).save(path)
        return GramIndex.load(self.base.sparkSession, path)

    @staticmethod
    def clear(spark: SparkSession, path: str) -> None:
        """Deletes a saved index."""
        remove(spark, path)

    @staticmethod
    def byte_report(spark: SparkSession, path: str) -> DataFrame:
        """(base_bytes, posting_bytes, ratio) of a saved index; ratio is all its bytes by those of the base."""
        base, postings = (stored_bytes(spark, f"{path}/{x}") for x in ("base", "postings"))
        return spark.createDataFrame([(base, postings, (base + postings) / base if base else None)], "base_bytes long, posting_bytes long, ratio double")

    def size_report(self) -> DataFrame:
        """(rows, string_chars, vector_values, posting_keys, posting_rows)"""
        data = self.base.agg(F.count("*").alias("rows"), F.sum(F.length("s")).alias("string_chars"), F.sum(F.size("v").cast("long")).alias("vector_values"))
        keys = self.postings.distinct().groupBy("g").agg(F.count("*").alias("n")).agg(F.count("*").alias("posting_keys"), F.coalesce(F.sum("n"), F.lit(0)).alias("posting_rows"))
        return data.join(F.broadcast(keys))  # a row each

    def find(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """((id, v, keys) of the rows that hold keys of the queries, (qid, g, df) with each query's rarest key).

        keys are those that a row holds, each once; s stands beside them if a pattern is longer than a key. The
        table is written once, so that counting and lookup share it; a row's keys stay together, as they meet the
        queries there.
        """
        keys = pattern_keys(queries, self.n_max)
        needed = checkpointed(self.base.sparkSession, keys.select("g").distinct())
        longer = not queries.where(F.length("p") > self.n_max).isEmpty()
        base = self.base if longer else self.base.select("id", "v")
        if bounded(queries) and not self.stored:
            found = self.rows_with(needed, ["id", "v", *(["s"] if longer else [])])
        else:
            found = rows_of_keys(self.postings.select("g", "id"), needed, base, bounded(queries))
        rows = checkpointed(self.base.sparkSession, found)
        return rows, rarest(keys, gram_frequencies(rows.select("id", F.explode("keys").alias("g"))))

    def rows_with(self, needed: DataFrame, names: list[str]) -> DataFrame:
        """The rows that hold some of a bounded number of substrings, from the strings: of a row's substrings the others go before there are rows of them."""
        listed = needed.agg(F.collect_set("g").alias("needed"))  # one row
        lengths = [r[0] for r in needed.select(F.length("g")).distinct().collect()]  # at most n_max
        if not lengths:
            return self.base.select(*names, F.array().cast("array<string>").alias("keys")).limit(0)
        own = F.flatten(F.array(*[grams(F.col("s"), n) for n in sorted(lengths)]))
        kept = F.array_intersect(own, F.col("needed"))  # each once
        return self.base.join(F.broadcast(listed)).select(*names, kept.alias("keys")).where(F.size("keys") > 0)

    def by_key(self, rows: DataFrame, keys: DataFrame, queries: DataFrame, most: int) -> DataFrame:
        """(qid, rank, id, dist) of the rows under each query's key that contain its pattern.

        Queries are shipped to the rows and meet them under their keys there: pairs are no rows of a join, and
        neither vectors nor strings are shuffled.
        """
        return topk_by_keys(rows, queries.join(keys.select("qid", "g"), "qid"), most, self.n_max)

    def search(self, queries: DataFrame, strategy: str = "auto", ef: int = 0, scan_share: float = 0.2) -> DataFrame:
        """(qid, rank, id, dist) by a strategy: auto, exact, prefilter or postfilter.

        auto sends a query whose rarest key stands in more than scan_share of the rows, or
        whose pattern is empty, to a scan of the base, and the others to postings.
        """
        if strategy == "exact":
            return exact_topk_batch(self.base, queries)
        if strategy == "postfilter":
            return postfilter_topk(self.base, queries, ef)
        most = largest_k(queries)
        if strategy == "prefilter":
            empty = queries.where("p = ''")
            if queries.where("p <> ''").isEmpty():
                return exact_topk_batch(self.base, empty)
            found = self.by_key(*self.find(queries), queries, most)
            return found if empty.isEmpty() else found.unionAll(exact_topk_batch(self.base, empty))
        if strategy != "auto":
            raise ValueError(f"no strategy {strategy}")
        n = self.base.count()
        rows, keys = self.find(queries)
        rare, common = keys.where(F.col("df") <= scan_share * n), keys.where(F.col("df") > scan_share * n)
        wide = queries.join(common, "qid", "left_semi").unionAll(queries.where("p = ''"))
        return self.by_key(rows, rare, queries, most).unionAll(exact_topk_batch(self.base, wide))
