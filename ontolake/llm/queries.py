"""The registered queries of this subpackage: (spark, sf_dir) -> DataFrame, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, licenses, mixing, order_minhash, quality, secrets, tokenfiles, vector_dedup, warc
from .common import table


def op1_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.op1_nearest_neighbours(table(spark, sf_dir, "embeddings"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.op2_near_duplicates(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op3_license_scan(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op4_secret_scan(table(spark, sf_dir, "documents"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op6_bpe_round_trip(table(spark, sf_dir, "documents"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op5_source_mix(table(spark, sf_dir, "documents"))


def op7_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op7_warc_round_trip(table(spark, sf_dir, "pages"))


def op8_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op8_quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.op9_token_files(table(spark, sf_dir, "documents"))


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.op10_vector_dedup(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_nearest_neighbours, op2_near_duplicates, op3_license_scan, op4_secret_scan, op5_source_mix, op6_bpe_round_trip, op7_warc_round_trip, op8_quality_scores, op9_token_files, op10_vector_dedup)}

ORACLES: dict[str, str] = {
    "op1_nearest_neighbours": """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (
  SELECT vec_id, x FROM v WHERE vec_id IS NOT NULL AND x IS NOT NULL
    AND len(list_filter(x, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
p AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.x, b.x) AS score
  FROM u a JOIN u b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.vec_id % 50 = 0),
r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op7_warc_round_trip": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (
  SELECT payload_digest, min(page_id) AS first_id FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest,
       CASE WHEN f.first_id IS NULL OR f.first_id = d.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first_id <> d.page_id THEN f.first_id END AS refers_to
FROM d LEFT JOIN f ON f.payload_digest = d.payload_digest AND d.payload_bytes >= 100
""",
    "op10_vector_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (
  SELECT vec_id, label, x FROM v WHERE label IS NOT NULL AND x IS NOT NULL
    AND len(list_filter(x, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND list_sum(list_transform(x, lambda c: c * c)) > 0),
e AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
r(node, other) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT r.node, e.b FROM r JOIN e ON r.other = e.a),
d AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT r.node AS vec_id, coalesce(max(d.n), 0) AS n_links, min(r.other) AS component_id, min(r.other) = r.node AS kept
FROM r LEFT JOIN d ON d.a = r.node GROUP BY r.node
""",
}
