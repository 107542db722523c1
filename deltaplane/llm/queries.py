"""The queries of this subpackage, over the tables of a folder, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaplane.llm import langid, licenses, mixing, packing, quality, simhash, substring, tokencount, topk, wavelet


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring.shared_passages(_documents(spark, folder))


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return tokencount.token_counts(_documents(spark, folder), _tokenizer("piece_bpe_32k.model"))


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    model = langid.train(docs.where(~held_out))
    return langid.label(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{folder}/embeddings.parquet"), k=5, every=50)


def op5_wavelet(spark: SparkSession, folder: str) -> DataFrame:
    shards = wavelet.write_shards(_documents(spark, folder), _tokenizer("word_bpe_49k.json"), end=1)
    return wavelet.read_documents(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op6_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.licence_scan(_documents(spark, folder))


def op7_curriculum(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken_in_order(_documents(spark, folder)).select("doc_id", "size", "source_size", "target", "taken")


def op7_training_order(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.training_order(_documents(spark, folder)).select("doc_id", "source", "pass", "position", "n_take")


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.stored(_documents(spark, folder), _tokenizer("byte_bpe_50k.json"), end=0)
    digests = pieces.select("doc_id", "start", "length", "doc_tokens", "part", "nth", F.crc32("ids").alias("ids_crc32"))
    return packing.place(pieces, digests).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op9_host_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.host_quality(_documents(spark, folder)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(_documents(spark, folder))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint_bits")), 16, "0").alias("fingerprint"), "component_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_substring_dedup, op2_token_counts, op3_language_id, op4_top_k, op5_wavelet, op6_licence_scan, op7_curriculum, op7_training_order, op8_packing, op9_host_quality, op10_simhash)}


TOP_K_SQL = """
WITH v AS (SELECT DISTINCT vec_id, CAST(list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS DOUBLE[]) AS v FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

CURRICULUM_SQL = """
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS BIGINT) AS weight FROM s),
c AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0)) / CAST(sum(weight) OVER after AS DOUBLE) AS unit
  FROM w WINDOW before AS (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), after AS (ORDER BY 3.0 * source_size / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
u AS (SELECT max(unit) AS unit FROM c),
t AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), weight * u.unit) AS target FROM w, u),
p AS (SELECT d.*, t.source_size, t.target, least(CAST(round(target) AS BIGINT), 3 * source_size) AS tape,
  sum(size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - size AS lead FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(least(greatest(tape - lead, 0), size) + least(greatest(tape - source_size - lead, 0), size) + least(greatest(tape - 2 * source_size - lead, 0), size) AS BIGINT) AS taken FROM p"""

QUALITY_SQL = """
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[ \\t-\\r]+'), lambda x: x <> '') AS words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS lines FROM d),
p AS (SELECT doc_id, i, array_to_string(words[i : i + 7], ' ') AS g FROM w, unnest(range(1, len(words) - 6)) AS r(i)),
a AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM p) WHERE n > 1),
k AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM a, range(0, 8) AS r(j) GROUP BY doc_id),
m AS (SELECT w.doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(k.n, 0) AS n_repeat_words FROM w LEFT JOIN k ON w.doc_id = k.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
f AS (SELECT *, base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_words OR word_chars < 2 * n_words OR word_chars > 14 * n_words AS failed FROM b),
h AS (SELECT source, CAST(count(*) AS DOUBLE) AS n, CAST(sum(CASE WHEN failed THEN 1 ELSE 0 END) AS DOUBLE) AS f FROM f WHERE source IS NOT NULL GROUP BY source),
x AS (SELECT sum(n) AS n, sum(f) AS f, count(*) AS hosts, sum(f * f / n) AS q, sum(f) / sum(n) AS m FROM h),
y AS (SELECT m, CASE WHEN f = 0 OR f = n THEN 1.0 ELSE (q - n * m * m) / n - m * (1 - m) * hosts / n END AS spread, f = 0 OR f = n AS flat FROM x),
z AS (SELECT m, CASE WHEN flat THEN 1.0 WHEN spread > 0 THEN least(greatest(m * (1 - m) / spread - 1, 1.0), 1e6) ELSE 1e6 END AS k FROM y),
v AS (SELECT source, (h.f + z.m * z.k) / (h.n + z.k) AS rate FROM h, z)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(v.rate, 0) < 0.5 AS kept FROM f LEFT JOIN v ON f.source = v.source"""


def oracle_sql() -> dict[str, str]:
    """For the queries that SQL can express; tokenizers, XXH64, chaining and learned models are beyond it."""
    return {"op4_top_k": TOP_K_SQL, "op7_curriculum": CURRICULUM_SQL, "op9_host_quality": QUALITY_SQL}
