"""The registered queries of the core library, each with the DuckDB SQL for its rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import clean_email_body, escape_like, escape_wildcard, keep_letters, sanitize_name
from .operators import approximate, evaluate, generate, patterns, postings, search, states, suffix_blocks, suffixes
from .operators.cells import CellIndex, postfilter_by_bounds
from .operators.dictionary import SubstringDictionary
from .operators.graph import NeighbourGraph, graph_topk as search_graph
from .operators.states import StateIndex
from .plans.index import GramIndex
from .plans.storage import checkpointed, rewritten, shared_dir
from .sources.sinks import result_lists
from .sources.tables import corpus, default_queries, document_strings, part_corpus, part_strings, read
from .streaming.ingest import append_stream

EFS = [8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256, 384, 512, 768, 1024]

# --- SQL pieces -------------------------------------------------------------------------

LETTERS = "lower(regexp_replace({}, '[^a-zA-Z]', '', 'g'))"
BASE = f"base AS (SELECT doc_id AS id, {LETTERS.format('text')} AS s, embedding AS v FROM documents JOIN embeddings ON doc_id = vec_id WHERE {LETTERS.format('text')} <> '' AND embedding IS NOT NULL)"
PARTS = f"base AS (SELECT p_partkey AS id, {LETTERS.format('p_name')} AS s, embedding AS v FROM part JOIN embeddings ON p_partkey = vec_id WHERE {LETTERS.format('p_name')} <> '' AND embedding IS NOT NULL)"
STRINGS = f"base AS (SELECT doc_id AS id, {LETTERS.format('text')} AS s FROM documents WHERE {LETTERS.format('text')} <> '')"
PART_STRINGS = f"base AS (SELECT p_partkey AS id, {LETTERS.format('p_name')} AS s FROM part WHERE {LETTERS.format('p_name')} <> '')"
DIST = "sqrt(list_reduce(list_prepend(0.0::DOUBLE, list_transform(range(1, len({0}) + 1), lambda i: ({0}[i]::DOUBLE - {1}[i]::DOUBLE) * ({0}[i]::DOUBLE - {1}[i]::DOUBLE))), lambda x, y: x + y))"


def asked_sql(length: int = 3, k: str = "10", every: int = 50, start: int = 5) -> str:
    return f"queries AS (SELECT id AS qid, substring(s, {start}, {length}) AS p, v AS qv, CAST({k} AS INT) AS k FROM base WHERE id % {every} = 0 AND length(s) >= {start + length - 1})"


def topk_sql(matching: str = "contains(s, p)", rows: str = "base") -> str:
    dist = DIST.format("v", "qv")
    return f"topk AS (SELECT qid, rank, id, dist FROM (SELECT qid, k, id, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM (SELECT qid, k, id, {dist} AS dist FROM {rows} JOIN queries ON {matching})) WHERE rank <= k)"


def with_sql(*parts: str, select: str = "SELECT * FROM topk") -> str:
    return f"WITH {', '.join(parts)} {select}"


BATCH_SQL = with_sql(BASE, asked_sql(), topk_sql())
PART_BATCH_SQL = with_sql(PARTS, asked_sql(every=25, start=2), topk_sql())
NEAR = f"near AS (SELECT qid, p, k, id, s, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS near_rank FROM (SELECT qid, p, k, id, s, {DIST.format('v', 'qv')} AS dist FROM base, queries))"
SUBS = "subs AS (SELECT id, i, j, substring(s, i, j - i + 1) AS g FROM (SELECT id, s, i, unnest(range(i, length(s) + 1)) AS j FROM (SELECT id, s, unnest(range(1, length(s) + 1)) AS i FROM base)))"
MEMBERS = "places AS (SELECT g, string_agg(id || ':' || j, ',' ORDER BY id, j) AS spots FROM subs GROUP BY g), members AS (SELECT g, max_by(g, length(g)) OVER (PARTITION BY spots) AS state FROM places)"
STATE_ROWS = "state_rows AS (SELECT DISTINCT g AS state, id FROM subs WHERE g IN (SELECT state FROM members))"
EDGES = "edges AS (SELECT DISTINCT left(m.g, length(m.g) - 1) AS state, right(m.g, 1) AS ch, m.state AS target FROM members m WHERE left(m.g, length(m.g) - 1) IN (SELECT state FROM members))"

Query = Callable[[SparkSession, str], DataFrame]


def prepared(spark: SparkSession, sf_dir: str, make: Callable[[SparkSession, str], DataFrame] = corpus, **how) -> tuple[DataFrame, DataFrame]:
    """The corpus and its queries, each written once: strategies read them several times."""
    base = checkpointed(spark, make(spark, sf_dir))
    return base, checkpointed(spark, default_queries(base, **how))


_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with SQL for the same rows."""

    def put(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# --- corpus -----------------------------------------------------------------------------


@query(with_sql(BASE, select="SELECT count(*) AS n, CAST(sum(length(s)) AS BIGINT) AS total_length, CAST(min(len(v)) AS BIGINT) AS dim_min, CAST(max(len(v)) AS BIGINT) AS dim_max FROM base"))
def corpus_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).agg(F.count("*").alias("n"), F.sum(F.length("s")).cast("long").alias("total_length"), F.min(F.size("v")).cast("long").alias("dim_min"), F.max(F.size("v")).cast("long").alias("dim_max"))


@query(f"SELECT doc_id AS id, {LETTERS.format('text')} AS s FROM documents WHERE {LETTERS.format('text')} <> ''")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), keep_letters(F.col("text")).alias("s")).where("s <> ''")


@query("SELECT p_partkey, replace(replace(replace(p_name || '*?\\', '\\', '\\\\'), '*', '\\*'), '?', '\\?') AS wildcard, replace(replace(replace(p_name || '%_\\', '\\', '\\\\'), '%', '\\%'), '_', '\\_') AS liked, regexp_replace(lower(p_name || ' #1_a-'), '[^a-z0-9_-]+', '-', 'g') AS name FROM part")
def pattern_escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return read(spark, sf_dir, "part").select("p_partkey", escape_wildcard(F.concat(name, F.lit("*?\\"))).alias("wildcard"), escape_like(F.concat(name, F.lit("%_\\"))).alias("liked"), sanitize_name(F.concat(name, F.lit(" #1_a-"))).alias("name"))


@query("SELECT doc_id, trim(lower(regexp_replace(regexp_replace('> quoted ' || source || chr(10) || text, '(?m)^>.*\\n?', '', 'g'), '[^a-zA-Z0-9]+', ' ', 'g'))) AS body FROM documents")
def email_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("> quoted "), F.col("source"), F.lit("\n"), F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", clean_email_body(body).alias("body"))


# --- exact search -----------------------------------------------------------------------


@query(f"SELECT doc_id AS id FROM documents WHERE contains({LETTERS.format('text')}, 'ana')")
def substring_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_text(spark, sf_dir).where(F.contains("s", F.lit("ana"))).select("id")


@query(with_sql(BASE, f"near AS (SELECT b.id, {DIST.format('b.v', 'q.v')} AS dist FROM base b, base q WHERE q.id = 0 AND contains(b.s, 'ana'))", select="SELECT row_number() OVER (ORDER BY dist, id) AS rank, id, dist FROM near ORDER BY dist, id LIMIT 10"))
def exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = corpus(spark, sf_dir)
    found = read(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()
    return search.exact_topk(base, "ana", found[0] if found else [], 10)


@query(BATCH_SQL)
def exact_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.exact_topk_batch(*prepared(spark, sf_dir))


@query(BATCH_SQL)
def pattern_set_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All patterns in one pass over the strings."""
    return patterns.topk_by_patterns(*prepared(spark, sf_dir))


@query(with_sql(BASE, asked_sql(k="id % 7"), topk_sql()))
def variable_k_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, asked = prepared(spark, sf_dir)
    return search.exact_topk_batch(base, asked.withColumn("k", (F.col("qid") % 7).cast("int")))


@query(with_sql(BASE, asked_sql(k="5").replace("substring(s, 5, 3)", "''"), topk_sql()))
def empty_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, asked = prepared(spark, sf_dir, k=5)
    return GramIndex.build(base, 2).search(asked.withColumn("p", F.lit("")), "prefilter")


@query(with_sql(BASE, asked_sql(), topk_sql(), select="SELECT qid, string_agg(id, ' ' ORDER BY rank) AS ids FROM topk GROUP BY qid"))
def ground_truth_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = result_lists(exact_topk_batch(spark, sf_dir))
    return lists.select("qid", F.array_join(F.col("ids").cast("array<string>"), " ").alias("ids"))


@query(with_sql(BASE, asked_sql(), topk_sql(), select="SELECT * FROM topk WHERE rank <= 6"))
def capped_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filtered search with at most six candidates a query."""
    base, asked = prepared(spark, sf_dir)
    return search.filtered_topk(base, asked.withColumn("k", F.least("k", F.lit(6))), num_candidates=6)


# --- postings ---------------------------------------------------------------------------


@query(BATCH_SQL)
def prefilter_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, asked = prepared(spark, sf_dir)
    return GramIndex.build(base, 3).search(asked, "prefilter")


@query(with_sql(BASE, asked_sql(length=7), topk_sql()))
def long_pattern_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, asked = prepared(spark, sf_dir, length=7)
    return GramIndex.build(base, 3).search(asked, "prefilter")


@query(with_sql(BASE, asked_sql(length=2), topk_sql()))
def planned_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, asked = prepared(spark, sf_dir, length=2)
    return GramIndex.build(base, 3).search(asked)


@query(with_sql(STRINGS, "rows AS (SELECT DISTINCT id, substring(s, i, 2) AS g FROM (SELECT id, s, unnest(range(1, length(s))) AS i FROM base))", select="SELECT g, count(*) AS df, string_agg(id, ',' ORDER BY id) AS ids FROM rows GROUP BY g"))
def postings_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = postings.posting_lists(postings.gram_rows(document_strings(spark, sf_dir), 2, 2))
    return lists.select("g", F.size("ids").cast("long").alias("df"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query(with_sql(STRINGS, "rows AS (SELECT DISTINCT id, n, substring(s, i, n) AS g FROM (SELECT id, s, n, unnest(range(1, length(s) - n + 2)) AS i FROM base, (SELECT unnest([1, 2, 3]) AS n))), dfs AS (SELECT n, g, count(*) AS df FROM rows GROUP BY n, g UNION ALL SELECT 0, '', count(*) FROM base)", select="SELECT CAST(n AS BIGINT) AS n, count(*) AS n_substrings, median(CAST(df AS DOUBLE)) AS median_df, avg(df) AS avg_df FROM dfs GROUP BY n"))
def gram_df_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.depth_statistics(document_strings(spark, sf_dir), 3)


@query(with_sql(BASE, select="SELECT count(*) AS rows, CAST(sum(length(s)) AS BIGINT) AS string_chars, CAST(sum(len(v)) AS BIGINT) AS vector_values, (SELECT count(DISTINCT g) FROM grams) AS posting_keys, (SELECT count(*) FROM grams) AS posting_rows FROM base").replace(" SELECT count(*) AS rows", ", grams AS (SELECT DISTINCT id, substring(s, i, n) AS g FROM (SELECT id, s, n, unnest(range(1, length(s) - n + 2)) AS i FROM base, (SELECT unnest([1, 2]) AS n))) SELECT count(*) AS rows"))
def gram_index_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return GramIndex.build(corpus(spark, sf_dir), 2).size_report()


# --- rank, then filter ------------------------------------------------------------------


@query(with_sql(BASE, asked_sql(), NEAR, select="SELECT qid, rank, id, dist FROM (SELECT qid, k, id, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM near WHERE near_rank <= 100 AND contains(s, p)) WHERE rank <= k"))
def postfilter_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.postfilter_topk(*prepared(spark, sf_dir), ef=100)


@query(with_sql(BASE, asked_sql(), NEAR, select="SELECT qid, rank, id, dist FROM (SELECT qid, k, id, dist, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM near WHERE near_rank <= 100 AND contains(s, p)) WHERE rank <= k"))
def bounded_postfilter_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows; cells open in order of a lower bound until 100 rows are certain."""
    base, asked = prepared(spark, sf_dir)
    return postfilter_by_bounds(CellIndex.build(base), asked, ef=100)


CELLS = (
    "centres AS MATERIALIZED (SELECT row_number() OVER (ORDER BY md5(CAST(id AS VARCHAR)), id) - 1 AS cell, v AS center FROM base QUALIFY cell < 16)",
    f"filed AS MATERIALIZED (SELECT id, s, v, cell FROM (SELECT id, s, v, cell, row_number() OVER (PARTITION BY id ORDER BY {DIST.format('v', 'center')}, cell) AS n FROM base, centres) WHERE n = 1)",
    "counts AS (SELECT qid, cell, count(*) AS matching FROM filed JOIN queries ON contains(s, p) GROUP BY qid, cell)",
    f"visited AS (SELECT qid, cell FROM (SELECT qid, cell, k, coalesce(sum(coalesce(matching, 0)) OVER (PARTITION BY qid ORDER BY away, cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT qid, k, cell, {DIST.format('center', 'qv')} AS away FROM queries, centres) LEFT JOIN counts USING (qid, cell)) WHERE before < greatest(20, k))",
)


@query(with_sql(BASE, asked_sql(), *CELLS, topk_sql("contains(s, p) AND (qid, cell) IN (SELECT (qid, cell) FROM visited)", "filed")))
def budget_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered search that visits cells until 20 candidates with the pattern are met."""
    base, asked = prepared(spark, sf_dir)
    return CellIndex.build(base).within_budget(asked, num_candidates=20)


SWEEP = f"points AS (SELECT unnest({EFS}) AS ef_search), found AS (SELECT * FROM (SELECT ef_search, qid, k, id, row_number() OVER (PARTITION BY ef_search, qid ORDER BY dist, id) AS rank FROM near JOIN points ON near_rank <= greatest(ef_search, k) WHERE contains(s, p)) WHERE rank <= k), sizes AS (SELECT qid, count(*) AS n FROM topk GROUP BY qid), sweep AS (SELECT ef_search, avg(coalesce(hit, 0) / n) AS recall FROM sizes CROSS JOIN points LEFT JOIN (SELECT f.ef_search, f.qid, count(*) AS hit FROM found f JOIN topk t ON f.qid = t.qid AND f.id = t.id GROUP BY ALL) USING (ef_search, qid) GROUP BY ef_search)"


@query(with_sql(BASE, asked_sql(), topk_sql(), NEAR, SWEEP, select="SELECT ef_search, round(recall, 9) AS recall FROM sweep"))
def ef_sweep_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, asked = prepared(spark, sf_dir)
    truth = checkpointed(spark, search.topk_in_blocks(base, asked))  # k rows a query, read twice
    return search.ef_sweep(base, asked, truth, EFS).withColumn("recall", F.round("recall", 9))


@query(with_sql(BASE, asked_sql(), topk_sql(), NEAR, SWEEP, select="SELECT ef_search, time_us, recall FROM (SELECT ef_search, CAST(ef_search AS DOUBLE) AS time_us, round(recall, 9) AS recall FROM sweep) ORDER BY recall DESC, time_us LIMIT 1"))
def best_operating_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time stands for the rows read, ef, so that the result can be repeated."""
    stats = ef_sweep_recall(spark, sf_dir).select("ef_search", F.col("ef_search").cast("double").alias("time_us"), "recall")
    return evaluate.best_point(stats)


@query(with_sql(BASE, asked_sql(), topk_sql(), NEAR, "found AS (SELECT qid, id FROM (SELECT qid, k, id, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM near WHERE near_rank <= 64 AND contains(s, p)) WHERE rank <= k), sizes AS (SELECT qid, count(*) AS n FROM topk GROUP BY qid)", select="SELECT round(avg(coalesce(hit, 0) / n), 9) AS recall FROM sizes LEFT JOIN (SELECT qid, count(*) AS hit FROM found SEMI JOIN topk USING (qid, id) GROUP BY qid) USING (qid)"))
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, asked = prepared(spark, sf_dir)
    found = evaluate.recall(search.postfilter_topk(base, asked, ef=64), search.exact_topk_batch(base, asked))
    return found.select(F.round("recall", 9).alias("recall"))


@query(BATCH_SQL)
def merge_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, asked = prepared(spark, sf_dir)
    halves = [search.exact_topk_batch(base.where(F.col("id") % 2 == i), asked) for i in (0, 1)]
    return search.merge_topk(halves, asked)


# --- dictionary and states (short strings) ------------------------------------------------


@query(PART_BATCH_SQL)
def optquery_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, asked = prepared(spark, sf_dir, part_corpus, every=25, start=2)
    return SubstringDictionary.build(base).search(asked)


@query(with_sql(PART_STRINGS, SUBS, select="SELECT g, count(DISTINCT id) AS df, string_agg(DISTINCT id, ',' ORDER BY id) AS ids FROM subs GROUP BY g"))
def optquery_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = postings.posting_lists(SubstringDictionary.build(part_strings(spark, sf_dir)).entries)
    return lists.select("g", F.size("ids").cast("long").alias("df"), F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query(with_sql(PART_STRINGS, SUBS, MEMBERS, "grouped AS (SELECT state, count(*) AS n_substrings, min(length(g)) AS shortest FROM members GROUP BY state)", select="SELECT b.state, CAST(length(b.state) AS BIGINT) AS len, n_substrings, m.state AS link FROM grouped b LEFT JOIN members m ON m.g = right(b.state, shortest - 1)"))
def state_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return states.states(part_strings(spark, sf_dir))


@query(with_sql(PART_STRINGS, SUBS, MEMBERS, EDGES, select="SELECT target, count(*) AS n_edges, string_agg(DISTINCT state, ',' ORDER BY state) AS sources FROM edges GROUP BY target"))
def reverse_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = states.reverse_edges(states.transitions(part_strings(spark, sf_dir)))
    return edges.select("target", "n_edges", F.array_join("sources", ",").alias("sources"))


@query(with_sql(PART_STRINGS, SUBS, MEMBERS, STATE_ROWS, EDGES, "sizes AS (SELECT state, count(*) AS n FROM state_rows GROUP BY state)", select="SELECT state, successor, n FROM (SELECT e.state, e.target AS successor, n, row_number() OVER (PARTITION BY e.state ORDER BY n DESC, e.target) AS r FROM edges e JOIN sizes s ON s.state = e.target) WHERE r = 1"))
def largest_successor(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = checkpointed(spark, part_strings(spark, sf_dir))
    sizes = states.state_rows(base).groupBy("state").agg(F.count("*").alias("n"))
    return states.largest_successor(states.transitions(base), sizes)


@query(with_sql(PART_STRINGS, SUBS, MEMBERS, STATE_ROWS, select="SELECT count(*) AS total_ids FROM state_rows"))
def total_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.total_ids(states.state_rows(part_strings(spark, sf_dir)))


@query(with_sql(PART_STRINGS, SUBS, MEMBERS, STATE_ROWS, select="SELECT count(DISTINCT state) AS states, count(*) AS ids_total, count(*) AS ids_stored, CAST(0 AS BIGINT) AS shared, count(DISTINCT state) AS graphs FROM state_rows"))
def full_index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return StateIndex.build(checkpointed(spark, part_strings(spark, sf_dir)), "full").size_report()


# every state decides again each turn, from what its successors offered the turn before; after as many turns as the longest has letters nothing changes
CHOICE = (
    "sizes AS (SELECT state, count(*) AS n FROM state_rows GROUP BY state)",
    "large AS MATERIALIZED (SELECT state, n FROM sizes WHERE n >= 20)",
    "ways AS MATERIALIZED (SELECT DISTINCT e.state, target FROM edges e JOIN large a ON a.state = e.state JOIN large b ON b.state = target)",
    "turns AS (SELECT 0 AS turn, state, n, CAST(NULL AS VARCHAR) AS base, CAST(NULL AS VARCHAR) AS offer, CAST(NULL AS BIGINT) AS offer_n FROM large UNION ALL "
    "SELECT turn + 1, state, n, CASE WHEN n <= 2 * best_n THEN best END, CASE WHEN n <= 2 * best_n THEN best ELSE state END, CASE WHEN n <= 2 * best_n THEN best_n ELSE n END FROM "
    "(SELECT i.turn, i.state, i.n, b.best, b.best_n FROM turns i LEFT JOIN (SELECT w.state, arg_min(offer, (-offer_n, offer)) AS best, max(offer_n) AS best_n FROM ways w JOIN turns t ON t.state = target WHERE offer IS NOT NULL GROUP BY w.state) b ON b.state = i.state) WHERE turn <= (SELECT max(length(state)) FROM large))",
)


@query(with_sql(PART_STRINGS, SUBS, MEMBERS, STATE_ROWS, EDGES, *CHOICE, select="SELECT state, base, n, n - coalesce(offer_n, 0) * (base IS NOT NULL)::INT AS n_local, base IS NULL OR n - offer_n >= 20 AS has_graph FROM turns WHERE turn = (SELECT max(turn) FROM turns) UNION ALL SELECT state, NULL, n, n, false FROM sizes WHERE n < 20").replace("WITH base", "WITH RECURSIVE base", 1))
def smart_index_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each state is stored."""
    return StateIndex.build(checkpointed(spark, part_strings(spark, sf_dir)), threshold=20).layout


@query(PART_BATCH_SQL)
def delta_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, asked = prepared(spark, sf_dir, part_corpus, every=25, start=2)
    return StateIndex.build(base, threshold=20).search(asked)


@query(PART_BATCH_SQL)
def full_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, asked = prepared(spark, sf_dir, part_corpus, every=25, start=2)
    return StateIndex.build(base, "full").search(asked)


# --- states of long strings ---------------------------------------------------------------

def document_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = checkpointed(spark, document_strings(spark, sf_dir))
    return suffix_blocks.state_counts(rewritten(spark, suffixes.distinct_strings(every)[0], every), spent=True)


@query()
def document_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States and distinct substrings of all documents by length; SQL takes minutes for the array at sf0.01."""
    return document_counts(spark, sf_dir).where("states > 0").select("len", "states", "substrings")


@query()
def document_total_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of all states of all documents; SQL has no plain way to count rows by interval."""
    return document_counts(spark, sf_dir).agg(F.sum("states").alias("states"), F.sum("occurrences").alias("occurrences"), F.sum("ids").alias("total_ids"))


@query(with_sql(BASE, asked_sql(length=24), topk_sql()))
def suffix_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns of 24 letters by one lookup in the sorted places."""
    base, asked = prepared(spark, sf_dir, length=24)
    return suffixes.SuffixIndex.build(base).search(asked)


# --- inserts ----------------------------------------------------------------------------


@query(with_sql(BASE, "cut AS (SELECT count(*) * 30 // 100 AS held FROM base), numbered AS (SELECT row_number() OVER (ORDER BY id DESC) AS r FROM base)", select="SELECT count(*) FILTER (r > held) AS n_base, count(*) FILTER (r <= held) AS n_inserts FROM numbered, cut"))
def insert_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = generate.split_inserts(checkpointed(spark, corpus(spark, sf_dir)), 30)
    kind = old.select(F.lit(0).alias("new")).unionAll(new.select(F.lit(1).alias("new")))
    return kind.agg(F.sum(1 - F.col("new")).alias("n_base"), F.sum("new").alias("n_inserts"))


@query(BATCH_SQL)
def insert_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, asked = prepared(spark, sf_dir)
    old, new = generate.split_inserts(base, 30)
    return GramIndex.build(old, 3).append(new).search(asked, "prefilter")


@query(BATCH_SQL)
def saved_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build, save, append to the saved files, load, search."""
    base, asked = prepared(spark, sf_dir)
    old, new = generate.split_inserts(base, 10)
    path = scratch(spark, "index")
    index = GramIndex.build(old, 3)
    index.save(path)
    index.save_append(path, new)
    return GramIndex.load(spark, path).search(asked, "prefilter")


@query(BATCH_SQL)
def stream_append_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows arrive as a stream of files and are appended by micro-batches."""
    base, asked = prepared(spark, sf_dir)
    old, new = generate.split_inserts(base, 30)
    path = scratch(spark, "stream")
    GramIndex.build(old, 3).save(f"{path}/index")
    new.select("id", "s", "v").write.parquet(f"{path}/arrivals")
    rows = spark.readStream.schema("id long, s string, v array<float>").parquet(f"{path}/arrivals")
    append_stream(rows, f"{path}/index", f"{path}/progress").awaitTermination()
    return GramIndex.load(spark, f"{path}/index").search(asked, "prefilter")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lodestring/{name}-{uuid.uuid4().hex}"


# --- workloads --------------------------------------------------------------------------

STEP = "(({} * 1664525 + 1013904223) & 4294967295)"
SEEDED = "((({} + 1) * 2654435761) & 4294967295)"


@query(f"SELECT vec_id AS id, list_reduce(list_prepend({{'x': {SEEDED.format('vec_id')}, 's': ''}}, list_transform(range(50), lambda i: {{'x': 0::BIGINT, 's': ''}})), lambda a, b: {{'x': {STEP.format('a.x')}, 's': a.s || chr(CAST(97 + {STEP.format('a.x')} % 26 AS INT))}}).s AS s FROM embeddings")
def lcg_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), generate.synthetic_string(F.col("vec_id")).alias("s"))


GENERATED = (
    f"strings AS (SELECT s, row_number() OVER (ORDER BY id) - 1 AS n, count(*) OVER () AS total FROM base WHERE length(s) >= 3), vectors AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n, count(*) OVER () AS total FROM base), "
    f"a AS (SELECT qid, {STEP.format(SEEDED.format('qid'))} AS a FROM (SELECT unnest(range(100)) AS qid)), b AS (SELECT *, {STEP.format('a')} AS b FROM a), c AS (SELECT *, {STEP.format('b')} AS c FROM b)"
)


@query(with_sql(BASE, GENERATED, select="SELECT qid, substring(st.s, CAST((b >> 8) % (length(st.s) - 2) + 1 AS INT), 3) AS p, v.id AS vector_of, CAST(10 AS INT) AS k FROM c JOIN strings st ON st.n = (a >> 8) % st.total JOIN vectors v ON v.n = (c >> 8) % v.total"))
def query_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = checkpointed(spark, corpus(spark, sf_dir))
    made = generate.generate_queries(base.withColumn("v", F.array(F.col("id"))), 100)
    return made.select("qid", "p", F.col("qv")[0].alias("vector_of"), "k")


# --- approximate search -------------------------------------------------------------------


@query()
def lsh_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return approximate.lsh_topk(*prepared(spark, sf_dir))


@query()
def ivf_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, asked = prepared(spark, sf_dir)
    return approximate.InvertedFile.build(base).search(asked)


@query()
def graph_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank by a neighbour graph with a search width of 100, filter after."""
    base, asked = prepared(spark, sf_dir)
    return search_graph(NeighbourGraph.build(base), base, asked, ef=100)
