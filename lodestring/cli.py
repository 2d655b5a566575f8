"""Command line: five files, a method, flags; prints recall and time of each operating point.

    python -m lodestring.cli strings vectors query_strings query_vectors ks METHOD [flags]
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession

from .operators import evaluate, search
from .operators.dictionary import SubstringDictionary
from .operators.generate import split_inserts
from .operators.states import StateIndex
from .plans.index import GramIndex
from .plans.storage import checkpointed
from .sources import load_corpus, load_queries, write_ground_truth, write_statistics

MODES = ("exact", "prefilter", "postfilter", "dictionary", "full", "delta", "auto")
EFS = (8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768, 1024)
log = logging.getLogger("lodestring")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestring")
    for name in ("strings", "vectors", "query_strings", "query_vectors", "ks"):
        p.add_argument(name)
    p.add_argument("mode", choices=MODES)
    p.add_argument("--debug", action="store_true")
    p.add_argument("--data-size", type=int)
    p.add_argument("--statistics-file")
    p.add_argument("--load-index")
    p.add_argument("--save-index")
    p.add_argument("--num-threads", type=int, default=8, help="shuffle partitions of the build")
    p.add_argument("--write-ground-truth")
    p.add_argument("--set-min-build-threshold", type=int, default=200)
    p.add_argument("--insert-percentage", type=int, default=0)
    p.add_argument("--growth-folder", help="builds the index over 10 to 100 percent of the rows there, and writes growth.csv with sizes and times")
    return p


def index_kind(args: argparse.Namespace) -> type:
    return {"dictionary": SubstringDictionary, "full": StateIndex, "delta": StateIndex}.get(args.mode, GramIndex)


def build_index(args: argparse.Namespace, base: DataFrame):
    kind = index_kind(args)
    return kind.build(base, args.mode, args.set_min_build_threshold) if kind is StateIndex else kind.build(base)


def open_index(spark: SparkSession, args: argparse.Namespace, base: DataFrame):
    return index_kind(args).load(spark, args.load_index) if args.load_index else build_index(args, base)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> list[dict]:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.debug else logging.INFO)
    spark = spark or SparkSession.builder.appName("lodestring").getOrCreate()
    corpus = checkpointed(spark, load_corpus(spark, args.strings, args.vectors, args.data_size))
    dim = len((corpus.select("v").first() or [[]])[0])
    queries = checkpointed(spark, load_queries(spark, args.query_strings, args.query_vectors, args.ks, dim or None))
    n = queries.count()
    rows, exact_us = evaluate.timed(lambda: search.exact_topk_batch(corpus, queries), n)
    truth = spark.createDataFrame(rows, search.RESULT)
    if args.write_ground_truth:
        write_ground_truth(truth, queries, args.write_ground_truth)
    base, inserts = split_inserts(corpus, args.insert_percentage)
    index = open_index(spark, args, base)
    if args.save_index:
        index.save(args.save_index)
    if args.insert_percentage:  # into a loaded index, too: it was built from the other rows
        index = index.append(inserts, args.mode, args.set_min_build_threshold) if isinstance(index, StateIndex) else index.append(inserts)
    points = []
    for ef in EFS if args.mode == "postfilter" else (0,):
        run = (lambda ef=ef: index.search(queries, args.mode, ef)) if isinstance(index, GramIndex) else (lambda: index.search(queries))
        found, us = evaluate.timed(run, n)
        recall = evaluate.recall(spark.createDataFrame(found, search.RESULT), truth).first().recall
        points.append({"ef_search": ef, "time_us": us, "recall": recall, "exact": exact_us})
        log.info("%s ef=%d: recall %s, %.0f us a query (exact %.0f)", args.mode, ef, recall, us, exact_us)
    if args.statistics_file:
        write_statistics(spark.createDataFrame(points, "ef_search int, time_us double, recall double, exact double"), args.statistics_file)
    if args.growth_folder:
        report = evaluate.growth(corpus, {args.mode: lambda rows: build_index(args, rows)}, args.growth_folder)
        report.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{args.growth_folder}/growth.csv")
    index.size_report().show()
    return points


if __name__ == "__main__":
    main()
