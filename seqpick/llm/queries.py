"""The registered queries of the training-data operators, and SQL where SQL can express them.

Each query applies one operator with its production parameters to a whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, ctw, decontam, mixing, pii, quality, sharding, simhash, suffix, urltrees


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op2_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(_read(spark, sf_dir, "documents"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.scan(docs, _read(spark, sf_dir, "benchmark")).select("doc_id", *decontam.RESULT)


def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltrees.judge(_read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs).select("doc_id", "n_values", F.array_join("kinds", ",").alias("kinds"), "clean_text")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash.group(_read(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), simhash.hex_digits(F.col("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


def op7_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix.passages(_read(spark, sf_dir, "documents"))
    show = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws("-", x["start"].cast("string"), x["stop"].cast("string"))), ",")
    return got.select("doc_id", "n_words", "n_repeated", "n_removed", show("spans").alias("spans"), show("removed").alias("removed"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    forest = quality.fit(docs, _read(spark, sf_dir, "labels"))
    return quality.judge(docs, forest).select("doc_id", *quality.RESULT)


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.deal(_read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", *sharding.RESULT)


def op10_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_read(spark, sf_dir, "conversations")).select("conv_id", "turn", "part", "place", "role", "new_role", "action", "n_inserted", "rendered")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix, op2_ctw, op3_decontaminate, op4_urls, op5_pii, op6_simhash, op7_suffix, op8_quality, op9_shards, op10_chats)}


_OP3 = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)
), hit AS (SELECT r, i, n, item_id FROM dw JOIN bw USING (n, g)
), words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS p FROM hit) GROUP BY r
), items AS (SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS k FROM hit) GROUP BY r)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

_OP7 = r"""
WITH d AS (
  SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS first_id, count(*) OVER (PARTITION BY text) AS copies,
    regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents
), win AS (
  SELECT doc_id, s, array_to_string(w[s + 1:s + 50], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(0, len(w) - 50)) AS s FROM d WHERE doc_id = first_id AND len(w) >= 50)
), many AS (SELECT g, min(doc_id) AS least FROM win GROUP BY g HAVING count(DISTINCT doc_id) > 1
), hit AS (SELECT doc_id, s, doc_id <> least AS gone FROM win JOIN many USING (g)
), covered AS (
  SELECT DISTINCT doc_id, kind, p FROM (
    SELECT doc_id, 'spans' AS kind, unnest(generate_series(s, s + 49)) AS p FROM hit
    UNION ALL SELECT doc_id, 'removed', unnest(generate_series(s, s + 49)) FROM hit WHERE gone)
), island AS (
  SELECT doc_id, kind, min(p) AS a, max(p) + 1 AS b
  FROM (SELECT *, p - row_number() OVER (PARTITION BY doc_id, kind ORDER BY p) AS k FROM covered) GROUP BY doc_id, kind, k
), each AS (SELECT doc_id, kind, sum(b - a) AS n, string_agg(a || '-' || b, ',' ORDER BY a) AS s FROM island GROUP BY doc_id, kind
), full_copy AS (SELECT *, copies > 1 AND coalesce(len(w), 0) >= 50 AS c, coalesce(len(w), 0) AS n FROM d)
SELECT f.doc_id, CAST(f.n AS BIGINT) AS n_words,
  CAST(CASE WHEN c THEN f.n ELSE coalesce(x.n, 0) END AS BIGINT) AS n_repeated,
  CAST(CASE WHEN c AND f.doc_id <> first_id THEN f.n ELSE coalesce(y.n, 0) END AS BIGINT) AS n_removed,
  CASE WHEN c THEN '0-' || f.n ELSE coalesce(x.s, '') END AS spans,
  CASE WHEN c AND f.doc_id <> first_id THEN '0-' || f.n ELSE coalesce(y.s, '') END AS removed
FROM full_copy f LEFT JOIN (FROM each WHERE kind = 'spans') x ON x.doc_id = f.first_id LEFT JOIN (FROM each WHERE kind = 'removed') y ON y.doc_id = f.first_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": _OP3, "op7_suffix": _OP7}
