"""The registered queries of the text operators, on their whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, ann, bpe, centroids, html_text, lm, minhash, packing, quality, simhash, substring_dedup, token_store, toxicity
from .common import pick, read_table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pick(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def held_out(of: int, part: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % of == part


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = substring_dedup.substring_dedup(documents(spark, sf_dir))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(documents(spark, sf_dir))
    return near.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.bpe_round_trip(documents(spark, sf_dir), BYTE_BPE)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(documents(spark, sf_dir), with_text=False).drop("text")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), WORD_BPE)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", held_out(3, 1).alias("held_out"), "score", "predicted")


def op8_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = pick(read_table(spark, sf_dir, "pages"), "page_id", "html")
    return html_text.extract_text(pages).select("page_id", "text", F.length("text").cast("long").alias("n_chars"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_and_read(documents(spark, sf_dir), BYTE_BPE)


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = centroids.cluster(read_table(spark, sf_dir, "embeddings"))
    return done.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(documents(spark, sf_dir), BYTE_BPE, PIECE_BPE)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_simhash, op3_bpe, op4_quality_rules, op5_packing, op6_lm_scoring, op7_toxicity, op8_nearest_vectors, op9_html_text, op10_token_files, op11_centroid_clustering, op12_minhash, op13_tokenizer_alignment)}


WORDS_SQL = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP1_SQL = f"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL.format("coalesce(text, '')")} AS words FROM documents),
windows AS (SELECT r, doc_id, i, sha256(array_to_string(words[i:i + 19], ' ')) AS g FROM (SELECT *, unnest(range(1, len(words) - 18)) AS i FROM w WHERE len(words) >= 20)),
firsts AS (SELECT g, min((doc_id, i)) AS f FROM windows GROUP BY g),
gone AS (SELECT DISTINCT r, i + k AS n FROM (SELECT r, i FROM windows JOIN firsts USING (g) WHERE (doc_id, i) > f), (SELECT unnest(range(20)) AS k)),
lost AS (SELECT r, list(n) AS ns, count(*) AS n_removed FROM gone GROUP BY r)
SELECT doc_id, len(words) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(array_to_string(CASE WHEN n_removed IS NULL THEN words ELSE [words[j] FOR j IN range(1, len(words) + 1) IF NOT list_contains(ns, j)] END, ' ')) AS kept_sha256
FROM w LEFT JOIN lost USING (r)"""

_R = quality.Rules()
_LOW = "translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SEPARATED = " + ".join(f"length(line) - length(replace(line, '{c}', ''))" for c in quality.SEPARATORS)
_LINE_FAILS = f"""(100 * length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) > {_R.max_symbols} * k OR 100 * ({_SEPARATED}) > {_R.max_bars} * k
  OR 100 * (length(line) - length(replace(line, '!', ''))) > {_R.max_bangs} * k OR (k >= {_R.long_line} AND NOT regexp_matches(line, '[.,;:!?]'))
  OR 100 * len(list_filter({WORDS_SQL.format(_LOW)}, lambda w: list_contains({quality.MENU}, w))) > {_R.max_menu} * k
  OR {" OR ".join(f"contains({_LOW}, '{p}')" for p in quality.BOILERPLATE)})"""
OP4_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, {WORDS_SQL.format("t")} AS words FROM d),
windows AS (SELECT r, i, array_to_string(words[i:i + 7], ' ') AS g FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 9)),
repeats AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM windows) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM repeats, (SELECT unnest(range(8)) AS k) GROUP BY r),
lines AS (SELECT r, line, len({WORDS_SQL.format("line")}) AS k FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)),
judged AS (SELECT r, count(*) - count(DISTINCT line) AS dup, CAST(sum(CASE WHEN {_LINE_FAILS} THEN k ELSE 0 END) AS BIGINT) AS lost FROM lines WHERE k > 0 GROUP BY r),
base AS (SELECT doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(dup, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(words) - coalesce(lost, 0) AS n_words_cleaned
  FROM w LEFT JOIN covered USING (r) LEFT JOIN judged USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.max_repeat} * n_words AS base_failed,
  NOT (n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.max_repeat} * n_words) AND 100 * n_words_cleaned >= {_R.min_kept} * n_words AS kept, n_words_cleaned FROM base"""


_CENTROIDS = centroids.Settings()


def round_sql(i: int) -> str:
    """Assignment to the centroids c{i} and the centroids c{i + 1} that follow from it."""
    return f"""
a{i} AS MATERIALIZED (SELECT r, k, d FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY d, k) AS n FROM (SELECT r, k, CAST(sum((x - m) * (x - m)) AS BIGINT) AS d FROM v JOIN c{i} USING (j) GROUP BY r, k)) WHERE n = 1),
s{i} AS MATERIALIZED (SELECT k, j, CAST(sum(x) AS BIGINT) AS t, count(*) AS n FROM v JOIN a{i} USING (r) GROUP BY k, j),
c{i + 1} AS MATERIALIZED (SELECT k, j, CASE WHEN n IS NULL THEN m ELSE (t - ((t % n) + n) % n) // n END AS m FROM c{i} LEFT JOIN s{i} USING (k, j))"""


OP11_SQL = f"""
WITH e AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = {_CENTROIDS.dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS MATERIALIZED (SELECT r, j, CAST(floor({_CENTROIDS.scale} * CAST(x AS DOUBLE)) AS BIGINT) AS x FROM (SELECT r, unnest(embedding) AS x, unnest(range({_CENTROIDS.dim})) AS j FROM e)),
c0 AS MATERIALIZED (SELECT k, j, x AS m FROM v JOIN (SELECT r, row_number() OVER (ORDER BY sha256('{_CENTROIDS.salt}' || coalesce(CAST(vec_id AS VARCHAR), ''))) - 1 AS k FROM e QUALIFY k < {_CENTROIDS.clusters}) USING (r)),{",".join(round_sql(i) for i in range(_CENTROIDS.rounds + 1))},
sums AS (SELECT k, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM a{_CENTROIDS.rounds} GROUP BY k),
digests AS (SELECT k, sha256(string_agg(m, ',' ORDER BY j)) AS centroid_sha256 FROM c{_CENTROIDS.rounds} GROUP BY k)
SELECT vec_id, CAST(k AS INT) AS cluster, d AS distance, cluster_inertia, CAST((SELECT sum(d) FROM a{_CENTROIDS.rounds}) AS BIGINT) AS inertia, centroid_sha256
FROM e JOIN a{_CENTROIDS.rounds} USING (r) JOIN sums USING (k) JOIN digests USING (k)"""

OP12_SQL = f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, {WORDS_SQL.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS words FROM documents),
grams AS (SELECT r, doc_id, list_distinct([array_to_string(words[i:i + 4], ' ') FOR i IN range(1, greatest(len(words) - 4, 1) + 1)]) AS g FROM w WHERE len(words) > 0),
whole AS MATERIALIZED (SELECT g, min(r) AS c, len(g) AS n FROM (SELECT r, list_sort(g) AS g FROM grams) GROUP BY g),
one AS MATERIALIZED (SELECT c, n, unnest(g) AS g FROM whole),
pairs AS (SELECT a.c AS a, b.c AS b FROM one a JOIN one b ON a.g = b.g AND a.c < b.c AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
ways AS MATERIALIZED (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reached AS (SELECT c AS a, c AS b FROM whole UNION SELECT r.a, p.b FROM reached r JOIN ways p ON p.a = r.b),
members AS MATERIALIZED (SELECT r, c, n, doc_id FROM (SELECT r, doc_id, list_sort(g) AS g FROM grams) JOIN whole USING (g)),
lows AS (SELECT c, min(doc_id) AS low FROM members GROUP BY c),
roots AS (SELECT a AS c, min(low) AS component_id FROM reached JOIN lows ON lows.c = b GROUP BY a)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, CASE WHEN n IS NULL THEN w.doc_id ELSE component_id END AS component_id, (w.doc_id IS NOT DISTINCT FROM CASE WHEN n IS NULL THEN w.doc_id ELSE component_id END) AS kept
FROM w LEFT JOIN members USING (r) LEFT JOIN roots USING (c)"""


def oracle_sql() -> dict[str, str]:
    """Where SQL can express the operator; the others are tested against plain versions."""
    return {"op1_substring_dedup": OP1_SQL, "op4_quality_rules": OP4_SQL, "op11_centroid_clustering": OP11_SQL, "op12_minhash": OP12_SQL}
