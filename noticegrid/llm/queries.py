"""The queries ``opN_<name>`` over the given tables, with their DuckDB texts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from noticegrid.llm import (
    centroids, exact_dedup, license_scan, link_trust, mixing, near_dup, oracles, packing, quality_trees, repetition, secret_scan,
    token_counts, toxicity, vector_codes,
)
from noticegrid.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


@query
def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


@query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


ORACLES["op3_exact_dedup"] = r"""
WITH prints AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256,
           length(coalesce(text, '')) AS n
    FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) = 1 AS kept,
       text_sha256
FROM prints
"""


@query
def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


ORACLES["op5_mixing"] = r"""
WITH rows AS (
    SELECT doc_id, source, coalesce('=' || source, '') AS key,
           CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens,
           CAST('0x' || substr(md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS place
    FROM documents
), totals AS (
    SELECT key, CAST(sum(n_tokens) AS BIGINT) AS tokens, count(*) AS docs FROM rows GROUP BY key
), ends AS (
    SELECT max(tokens) AS most, min(tokens) AS least FROM totals WHERE tokens > 0
), chosen AS (
    SELECT coalesce(min(k), 1024) AS k
    FROM ends, range(0, 1025) AS grid(k)
    WHERE pow(CAST(most AS DOUBLE) / least, 1 - k / 1024.0) <= 2.0
), given AS (
    SELECT key, tokens, docs, k,
           CASE WHEN tokens > 0 THEN CAST(floor(tokens * pow(CAST(most AS DOUBLE) / tokens, 1 - k / 1024.0) + 1e-6) AS BIGINT) ELSE 0 END AS given
    FROM totals, ends, chosen
), plan AS (
    SELECT *, CASE WHEN tokens = 0 THEN 1 ELSE given // tokens END AS whole,
           CASE WHEN tokens = 0 THEN 0 ELSE given % tokens END AS part,
           CAST(ceil(docs / 1000.0) AS BIGINT) AS blocks
    FROM given
), placed AS (
    SELECT r.*, p.* EXCLUDE (key), ((place >> 28) * blocks) >> 32 AS block,
           CAST(coalesce(sum(n_tokens) OVER (
               PARTITION BY r.key ORDER BY place, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
    FROM rows r JOIN plan p ON r.key = p.key
), copied AS (
    SELECT *, whole + CASE WHEN n_tokens > 0 AND before + n_tokens <= part THEN 1 ELSE 0 END AS copies FROM placed
)
SELECT doc_id, source, n_tokens, k / 1024.0::DOUBLE AS exponent, pass, block,
       CAST(pass * tokens + before AS DOUBLE) / CAST(greatest(given, 1) AS DOUBLE) AS mix_order
FROM copied, LATERAL (SELECT unnest(range(0, copies)) AS pass)
"""


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.licenses(table(spark, sf_dir, "documents"))


@query
def op7_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_trees.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op10_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(table(spark, sf_dir, "documents"))


@query
def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(table(spark, sf_dir, "embeddings"))


ORACLES["op11_clusters"] = oracles.clusters()


@query
def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_trust.judged(table(spark, sf_dir, "pages"))


ORACLES["op12_url_filter"] = oracles.judged()


@query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


ORACLES["op13_vector_codes"] = oracles.compressed()
