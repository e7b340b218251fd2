"""Bindings of the registry tables to the driver's test tables.

Each text is plain SQL that Spark and DuckDB both accept; ``__SHA__`` is the engine's own SHA-256
call. The Spark side builds DataFrames from them, the oracle side uses them as CTEs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noticegrid.session import prepare_registry

AS_OF = "1998-07-01 00:00:00"

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS = {
    "fx_sources": """
SELECT concat('src-', CAST(r_regionkey AS STRING)) AS id, r_name AS name,
  CASE r_regionkey WHEN 3 THEN 'page_watch' WHEN 4 THEN 'manual' ELSE 'json_listing' END AS adapter,
  (r_regionkey <> 4) AS enabled,
  CASE r_regionkey WHEN 1 THEN 'partial' WHEN 2 THEN 'failed' ELSE 'success' END AS health,
  CASE WHEN r_regionkey = 2 THEN NULL ELSE TIMESTAMP '1998-06-30 12:00:00' - CAST(r_regionkey AS INT) * INTERVAL '1' DAY END AS last_success_at
FROM region""",
    "fx_opportunities": """
SELECT o_orderkey AS id, concat('src-', CAST(n_regionkey AS STRING)) AS source_id,
  CASE WHEN o_orderkey % 7 = 0 THEN concat('cascade:', CAST(o_orderkey AS STRING)) ELSE concat('TOPIC-', CAST(o_orderkey AS STRING)) END AS external_id,
  concat('https://notices.example.org/', CAST(o_orderkey AS STRING)) AS canonical_url,
  concat(p_name, ' ', p_type) AS title, concat(p_brand, ' ', o_orderpriority) AS description,
  CASE WHEN o_orderkey % 17 = 0 THEN '' WHEN o_orderkey % 2 = 0 THEN c_mktsegment ELSE lower(c_mktsegment) END AS funder,
  o_orderpriority AS programme,
  CASE WHEN o_orderkey % 10 = 0 THEN 'funding_scheme' WHEN o_orderkey % 10 = 1 THEN 'advance_information' ELSE 'call' END AS record_kind,
  CASE WHEN o_orderkey % 5 = 0 THEN 'loan' ELSE 'grant' END AS instrument,
  CASE WHEN n_regionkey = 0 THEN 'eu' WHEN n_regionkey = 1 THEN 'finland' WHEN n_regionkey = 2 THEN 'other_region' ELSE 'unknown' END AS geographic_scope,
  CASE WHEN o_orderkey % 13 = 0 THEN 'cancelled' WHEN o_orderkey % 11 = 0 THEN 'unknown' WHEN o_orderstatus = 'P' THEN 'rolling'
       WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'closed' ELSE 'open' END AS source_status,
  CASE WHEN o_orderkey % 6 = 0 THEN 'two-stage' WHEN o_orderkey % 6 = 1 THEN 'multiple-cut-off' ELSE 'single-stage' END AS deadline_model,
  CAST(o_orderdate AS DATE) AS opens_on,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 120 AS INT) END AS deadline_on,
  CASE WHEN o_orderkey % 9 <> 0 AND o_orderkey % 3 = 1 THEN o_orderdate + CAST(o_orderkey % 120 AS INT) * INTERVAL '1' DAY + INTERVAL '12' HOUR END AS deadline_at,
  CAST(o_totalprice AS DECIMAL(20,2)) AS total_budget, 1 + CAST(o_orderkey % 3 AS INT) AS version,
  o_orderdate + INTERVAL '6' HOUR AS updated_at
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN part ON p_partkey = o_orderkey % 200""",
    "fx_reviews": """
SELECT doc_id AS opportunity_id,
  CASE WHEN quality = 1 AND toxic = 0 THEN 'eligible' WHEN quality = 1 THEN 'conditional' WHEN toxic = 1 THEN 'ineligible' ELSE 'unreviewed' END AS eligibility,
  'partner' AS city_role, 1 + CAST(doc_id % 2 AS INT) AS reviewed_source_version, 1 AS version FROM labels""",
    "fx_documents": """
SELECT p_partkey AS id, concat('https://docs.example.org/', CAST(p_partkey AS STRING)) AS url,
  CASE WHEN p_size % 10 = 0 THEN 'pending' WHEN p_size % 10 = 1 THEN 'failed' WHEN p_size % 10 = 2 THEN 'blocked' ELSE 'fetched' END AS state,
  CASE WHEN p_size % 10 IN (0,1,2) THEN 'not_extracted' WHEN p_type = 'PROMO' THEN 'partial_text' ELSE 'extracted' END AS extraction_status,
  p_brand AS parser, p_type AS media_type, CAST(floor(p_retailprice) AS BIGINT) AS byte_count,
  CASE WHEN p_size % 7 = 0 THEN NULL ELSE TIMESTAMP '1998-06-28 03:00:00' + CAST(p_size AS INT) * INTERVAL '2' HOUR END AS next_check_at,
  TIMESTAMP '1998-06-27 02:30:00' + CAST(p_size AS INT) * INTERVAL '1' HOUR AS checked_at,
  CASE WHEN p_size % 10 = 1 THEN 'TIMEOUT' WHEN p_size % 10 = 2 THEN 'ROBOTS_DISALLOWED'
       WHEN p_size = 10 THEN concat('RATE_LIMIT|https://h', CAST(p_partkey % 5 AS STRING), '.example.org|1998-07-0', CAST(1 + p_partkey % 8 AS STRING), 'T04:00:00') END AS error
FROM part""",
    "fx_opportunity_documents": """
SELECT l_orderkey AS opportunity_id, l_partkey AS document_id, MIN(l_linenumber) - 1 AS depth,
  MIN(l_linenumber) = 1 AS is_root, MAX(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) = 1 AS active,
  CASE WHEN MIN(l_linenumber) > 5 THEN 'depth_limit' END AS limitation, MIN(l_shipdate) AS first_seen_at,
  CASE WHEN MIN(l_linenumber) = 1 THEN 'call_content' WHEN MIN(l_linenumber) = 4 THEN 'faq_keyword_match' ELSE 'reference' END AS role
FROM lineitem GROUP BY l_orderkey, l_partkey""",
    "fx_links": """
SELECT p_partkey AS document_id, (p_partkey * 7 + 1) % (SELECT COUNT(*) FROM part) AS target_id, 'required_section' AS role, p_size % 4 <> 0 AS follow FROM part
UNION ALL SELECT p_partkey, (p_partkey * 13 + 5) % (SELECT COUNT(*) FROM part), 'attachment', p_size % 3 <> 0 FROM part
UNION ALL SELECT p_partkey, (p_partkey * 29 + 11) % (SELECT COUNT(*) FROM part), 'reference', p_size % 5 = 0 FROM part""",
    "fx_tags": """
SELECT o_orderkey AS opportunity_id, 'theme' AS kind, split_part(p_name, ' ', 1) AS value, 'rule' AS basis FROM orders JOIN part ON p_partkey = o_orderkey % 200
UNION ALL SELECT o_orderkey, 'region', n_name, 'source' FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "fx_changes": """
SELECT event_id AS id, user_id AS opportunity_id, event_type AS kind, ts AS created_at, props AS payload_json FROM events""",
    "fx_texts": """
SELECT doc_id, text, lang, source, n_chars, __SHA__ AS sha256 FROM documents""",
    "fx_blobs": """
SELECT sha256, MIN(doc_id) AS first_doc_id, COUNT(*) AS copies, MAX(n_chars) AS n_chars FROM fx_texts GROUP BY sha256""",
    "fx_observations": """
SELECT user_id % 50 AS source_id, ts AS observed_at, event_id, CAST(floor(value) AS BIGINT) % 3 AS text_hash FROM events""",
    # A document's current content: the text whose number it carries.
    "fx_contents": """
SELECT d.id, d.url, d.state, d.parser, t.sha256 AS current_sha256 FROM fx_documents d LEFT JOIN fx_texts t ON t.doc_id = d.id""",
}

# Such a join takes the few parts below the divisor; shuffled by it, all orders would fall on as many keys.
_REMAINDER = re.compile(r"\bJOIN part ON p_partkey = o_orderkey % (\d+)")
_SHA = {"spark": "sha2(text, 256)", "duckdb": "sha256(text)"}


def view_sql(name: str, dialect: str) -> str:
    return VIEWS[name].strip().replace("__SHA__", _SHA[dialect])


def referenced(sql: str, known: dict) -> list[str]:
    """Names of ``known`` that the text uses, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if name not in order and re.search(rf"\b{name}\b", text):
                visit(re.sub(rf"\b{name}\b", "", known[name]))
                order.append(name)

    visit(sql)
    return order


class Inputs:
    """Lazy DataFrames over one scale-factor folder; attribute access by table or view name."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = prepare_registry(spark), path.rstrip("/")
        self.as_of = AS_OF
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or (name not in TABLES and name not in VIEWS):
            raise AttributeError(name)
        if name not in self._cache:
            self._cache[name] = self._load(name)
        return self._cache[name]

    def _load(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.path}/{name}.parquet")
        sql = view_sql(name, "spark")
        used = {n: getattr(self, n) for n in (*TABLES, *VIEWS) if n != name and re.search(rf"\b{n}\b", sql)}
        if found := _REMAINDER.search(sql):
            below = int(found[1])
            used["part"] = F.broadcast(used["part"].filter(F.col("p_partkey").between(1 - below, below - 1)))
        # {name} placeholders bind DataFrames without touching the session's temp views.
        for n in used:
            sql = re.sub(rf"\b(FROM|JOIN) {n}\b", rf"\1 {{{n}}}", sql)
        return self.spark.sql(sql, **used)
