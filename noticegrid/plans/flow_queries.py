"""Joins, ordered groups, sets, graph, upsert and document flow over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticegrid.functions import fixed
from noticegrid.operators import aggregates as agg
from noticegrid.operators import documents as docs
from noticegrid.operators import faq, graph, lookups, ordered, quality, reconcile, registry, reviews, upsert
from noticegrid.plans.registry import SHARED, query
from noticegrid.plans.views import AS_OF

STAMP = f"TIMESTAMP '{AS_OF}'"

SHARED["ox_flow_links"] = "SELECT document_id, target_id, role FROM fx_links WHERE follow"
SHARED["ox_current_docs"] = """
SELECT c.id, c.url, c.parser, c.state, c.current_sha256, d.extraction_status, d.error FROM fx_contents c JOIN fx_documents d ON d.id = c.id"""


def current_docs(r):
    return r.fx_contents.join(r.fx_documents.select("id", "extraction_status", "error"), "id").select(
        "id", "url", "parser", "state", "current_sha256", "extraction_status", "error")


# --- joins ----------------------------------------------------------------------------------
@query("d06_code_labels", """
SELECT c_custkey AS id, COALESCE(n_name, CAST(code AS VARCHAR)) AS label FROM (
  SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN c_nationkey + 100 ELSE c_nationkey END AS code FROM customer) LEFT JOIN nation ON n_nationkey = code""")
def _(r):
    code = F.when(F.col("c_custkey") % 10 == 0, F.col("c_nationkey") + 100).otherwise(F.col("c_nationkey"))
    rows = r.customer.select(F.col("c_custkey").alias("id"), code.alias("label"))
    return lookups.code_labels(rows, r.nation, "n_nationkey", "n_name", "label")


SHARED["ox_faq"] = """
SELECT p_partkey AS document_id, 'topic-' || CAST(p_partkey AS VARCHAR) AS k1, ' TOPIC-' || CAST(p_partkey * 3 + 1 AS VARCHAR) AS k2 FROM part"""
SHARED["ox_faq_matches"] = """
SELECT o.id AS opportunity_id, f.document_id FROM ox_faq f JOIN fx_opportunities o ON upper(o.external_id) = upper(trim(f.k1))
UNION SELECT o.id, f.document_id FROM ox_faq f JOIN fx_opportunities o ON upper(o.external_id) = upper(trim(f.k2))"""


def faq_entries(r):
    words = F.array(F.concat(F.lit("topic-"), F.col("p_partkey")), F.concat(F.lit(" TOPIC-"), F.col("p_partkey") * 3 + 1), F.lit(""))
    return r.part.select(F.col("p_partkey").alias("document_id"), words.alias("keywords"))


@query("d07_faq_keywords", "SELECT opportunity_id, document_id FROM ox_faq_matches")
def _(r):
    return faq.keyword_matches(faq_entries(r), r.fx_opportunities)


@query("d08_current_links", """
SELECT l.document_id, l.target_id, l.role FROM (SELECT *, CASE WHEN target_id % 4 = 0 THEN 'old' ELSE 'x' || CAST(document_id AS VARCHAR) END AS source_sha256 FROM fx_links) l
JOIN fx_documents d ON d.id = l.document_id AND 'x' || CAST(d.id AS VARCHAR) = l.source_sha256 WHERE l.follow""")
def _(r):
    sha = F.concat(F.lit("x"), F.col("document_id"))
    links = r.fx_links.withColumn("source_sha256", F.when(F.col("target_id") % 4 == 0, "old").otherwise(sha))
    current = r.fx_documents.select("id", F.concat(F.lit("x"), F.col("id")).alias("current_sha256"))
    return lookups.current_links(links, current).select("document_id", "target_id", "role")


@query("d10_unknown_documents", """
SELECT DISTINCT 'https://docs.example.org/' || CAST(target_id * 2 AS VARCHAR) AS target_url, sha256('https://docs.example.org/' || CAST(target_id * 2 AS VARCHAR)) AS document_id
FROM fx_links WHERE follow AND target_id * 2 NOT IN (SELECT p_partkey FROM part)""")
def _(r):
    links = r.fx_links.withColumn("target_url", F.concat(F.lit("https://docs.example.org/"), F.col("target_id") * 2))
    return lookups.unknown_targets(links, r.fx_documents)


@query("d11_affected_notices", """
WITH c AS (SELECT id FROM ox_current_docs WHERE parser = 'Brand#3'),
s AS (SELECT id FROM ox_current_docs WHERE current_sha256 IN (SELECT current_sha256 FROM ox_current_docs WHERE id IN (SELECT id FROM c)) UNION SELECT id FROM c)
SELECT DISTINCT opportunity_id FROM fx_opportunity_documents WHERE active AND document_id IN (SELECT id FROM s)""")
def _(r):
    changed = r.fx_documents.filter("parser = 'Brand#3'").select(F.col("id").alias("document_id"))
    return lookups.affected_notices(changed, current_docs(r), r.fx_opportunity_documents)


SHARED["ox_faq_bridge"] = """
SELECT opportunity_id, document_id, true AS is_root, true AS active, 'faq_keyword_match' AS role FROM ox_faq_matches
UNION SELECT o.id, p_partkey, true, true, 'faq_keyword_match' FROM part JOIN fx_opportunities o ON o.id = p_partkey * 2"""


def faq_bridge(r, matches):
    old = r.part.join(r.fx_opportunities, F.col("id") == F.col("p_partkey") * 2).select(
        F.col("id").alias("opportunity_id"), F.col("p_partkey").alias("document_id"))
    return matches.union(old).distinct().select(
        "*", F.lit(True).alias("is_root"), F.lit(True).alias("active"), F.lit(faq.ROLE).alias("role"))


@query("d12_stale_matches", """
SELECT opportunity_id, document_id FROM ox_faq_bridge EXCEPT SELECT opportunity_id, document_id FROM ox_faq_matches""")
def _(r):
    matches = faq.keyword_matches(faq_entries(r), r.fx_opportunities)
    return faq.stale_matches(faq_bridge(r, matches), matches)


@query("d13_notice_document_export", """
SELECT o.id AS opportunity_id, od.document_id, od.depth, od.limitation, d.url, d.state, d.current_sha256, b.copies
FROM fx_opportunities o LEFT JOIN fx_opportunity_documents od ON od.opportunity_id = o.id AND od.active
LEFT JOIN ox_current_docs d ON d.id = od.document_id LEFT JOIN fx_blobs b ON b.sha256 = d.current_sha256""")
def _(r):
    return lookups.notice_document_export(r.fx_opportunities, r.fx_opportunity_documents, current_docs(r), r.fx_blobs).select(
        "opportunity_id", "document_id", "depth", "limitation", "url", "state", "current_sha256", "copies")


@query("d15_tags_on_notices", """
SELECT o.id, COALESCE(string_agg(DISTINCT t.value, ', ' ORDER BY t.value) FILTER (WHERE t.kind = 'theme'), '') AS themes,
  COALESCE(string_agg(DISTINCT t.value, ', ' ORDER BY t.value) FILTER (WHERE t.kind = 'region'), '') AS regions
FROM fx_opportunities o LEFT JOIN fx_tags t ON t.opportunity_id = o.id GROUP BY o.id""")
def _(r):
    return lookups.tags_on_notices(r.fx_opportunities.select("id"), r.fx_tags)


_FOREIGN_KEYS = [
    ("changes", "fx_changes", "opportunity_id", "fx_opportunities", "id"),
    ("bridge_notice", "fx_opportunity_documents", "opportunity_id", "fx_opportunities", "id"),
    ("bridge_document", "fx_opportunity_documents", "document_id", "fx_documents", "id"),
    ("links_target", "fx_links", "target_id", "fx_documents", "id"),
    ("reviews", "fx_reviews", "opportunity_id", "fx_opportunities", "id"),
    ("doubled_reviews", "fx_tags", "opportunity_id", "fx_reviews", "opportunity_id"),
]


@query("d16_orphans", " UNION ALL ".join(
    f"SELECT '{n}' AS foreign_key, COUNT(*) AS orphans FROM {c} WHERE {k} IS NOT NULL AND {k} NOT IN (SELECT {pk} FROM {p})" for n, c, k, p, pk in _FOREIGN_KEYS))
def _(r):
    parts = [
        quality.orphans(getattr(r, c), k, getattr(r, p), pk).agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(n).alias("foreign_key"), "orphans")
        for n, c, k, p, pk in _FOREIGN_KEYS]
    return reconcile.union_streams(*parts)


@query("d17_evidence", """
SELECT id, kind, CAST(json_extract_string(payload_json, '$.k') AS BIGINT) AS k FROM fx_changes WHERE opportunity_id = (SELECT MIN(user_id) FROM events)""")
def _(r):
    key = r.events.agg(F.min("user_id").alias("k")).first().k
    return lookups.evidence(r.fx_changes, key).select("id", "kind", F.variant_get("raw", "$.k", "bigint").alias("k"))


@query("d18_document_version", """
WITH v AS (SELECT MIN(id) AS id FROM ox_current_docs WHERE current_sha256 IS NOT NULL)
SELECT d.id, d.current_sha256 AS sha256, b.copies, (SELECT COUNT(*) FROM fx_links l, v WHERE l.document_id = v.id AND l.role <> 'attachment') AS links,
  (SELECT COUNT(*) FROM fx_links l, v WHERE l.document_id = v.id AND l.role <> 'attachment' AND l.follow) AS followed, CAST(1 AS BIGINT) AS versions
FROM ox_current_docs d JOIN v ON v.id = d.id JOIN fx_blobs b ON b.sha256 = d.current_sha256""")
def _(r):
    current, versions, linked, key = versioned(r)
    return lookups.document_version(current, versions, r.fx_blobs, linked, key).select(
        "id", "sha256", "copies", "links", "followed", "versions")


def versioned(r):
    """Documents, their versions, links by version, and the first document that has a content."""
    current = current_docs(r)
    held = current.filter("current_sha256 IS NOT NULL")
    versions = held.select(F.col("id").alias("document_id"), F.col("current_sha256").alias("sha256"))
    # Attachments were linked by an earlier version only.
    linked = r.fx_links.join(versions, "document_id").withColumn(
        "source_sha256", F.when(F.col("role") == "attachment", "earlier").otherwise(F.col("sha256"))).drop("sha256")
    return current, versions, linked, held.agg(F.min("id")).scalar()


@query("d18_version_history", """
WITH v AS (SELECT MIN(id) AS id FROM ox_current_docs WHERE current_sha256 IS NOT NULL)
SELECT d.id AS document_id, d.current_sha256 AS sha256, true AS is_current FROM ox_current_docs d JOIN v ON v.id = d.id UNION ALL SELECT id, 'earlier', false FROM v""")
def _(r):
    current, versions, _linked, key = versioned(r)
    earlier = versions.select("document_id", F.lit("earlier").alias("sha256"))
    return lookups.version_history(current, versions.unionByName(earlier), key).select("document_id", "sha256", "is_current")


@query("d18_version_links", """
WITH v AS (SELECT MIN(id) AS id FROM ox_current_docs WHERE current_sha256 IS NOT NULL)
SELECT l.document_id, l.target_id, l.role, l.follow FROM fx_links l JOIN v ON v.id = l.document_id WHERE l.role <> 'attachment'""")
def _(r):
    current, versions, linked, key = versioned(r)
    return lookups.version_links(current, versions, linked, key).select("document_id", "target_id", "role", "follow")


# --- ordered groups -------------------------------------------------------------------------
@query("f01_preferred_variant", """
SELECT user_id, event_id, event_type, variants, conflict FROM (SELECT user_id, event_id, event_type,
  ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY (event_type = 'purchase') DESC, ts DESC, event_id DESC) AS rn,
  COUNT(*) OVER (PARTITION BY user_id) AS variants, MIN(CAST(ts AS DATE)) OVER (PARTITION BY user_id) <> MAX(CAST(ts AS DATE)) OVER (PARTITION BY user_id) AS conflict
  FROM events) WHERE rn = 1""")
def _(r):
    rank = F.struct((F.col("event_type") == "purchase").alias("a"), F.col("ts").alias("b"), F.col("event_id").alias("c"))
    rows = r.events.select("user_id", "event_id", "event_type", "ts")
    return ordered.best_variant(rows, "user_id", rank, F.col("ts").cast("date")).select("user_id", "event_id", "event_type", "variants", "conflict")


@query("f02_stage_numbers", """
SELECT id, CAST(stage AS INT) AS stage, deadline_on - CAST((3 - stage) * 30 AS INT) AS due_on FROM fx_opportunities, (VALUES (1), (2), (3)) v(stage)
WHERE deadline_on IS NOT NULL""")
def _(r):
    def stage(days):
        return F.struct(F.date_sub("deadline_on", days).alias("due_on"))
    rows = r.fx_opportunities.filter("deadline_on IS NOT NULL").select("id", F.array(stage(60), stage(30), stage(0)).alias("deadlines"))
    return ordered.numbered_stages(rows, "deadlines", "id")


SHARED["ox_stages"] = """
SELECT l_orderkey, CAST(l_shipdate AS DATE) AS due_on, CASE WHEN l_linenumber % 2 = 0 THEN l_shipdate + INTERVAL '12' HOUR END AS due_at FROM lineitem"""


@query("f03_final_stage", """
SELECT l_orderkey, due_on, due_at FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY due_on DESC, due_at DESC NULLS LAST) AS rn FROM ox_stages) WHERE rn = 1""")
def _(r):
    stages = r.lineitem.select(
        "l_orderkey", F.col("l_shipdate").cast("date").alias("due_on"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_shipdate") + F.expr("INTERVAL '12' HOUR")).alias("due_at"))
    return ordered.final_stage(stages, "l_orderkey")


SHARED["ox_page_changes"] = """
SELECT source_id, event_id, text_hash, LAG(text_hash) OVER (PARTITION BY source_id ORDER BY observed_at, event_id) AS previous_hash FROM fx_observations"""
_CHANGE_KIND = """CASE WHEN previous_hash IS NULL THEN 'source_discovered' WHEN previous_hash <> text_hash THEN 'source_changed' ELSE 'same' END"""


@query("f04_page_changes", f"SELECT source_id, event_id, {_CHANGE_KIND} AS kind FROM ox_page_changes")
def _(r):
    return ordered.page_changes(r.fx_observations).select("source_id", "event_id", "kind")


@query("f04_page_changes_split", f"SELECT source_id, event_id, {_CHANGE_KIND} AS kind FROM ox_page_changes")
def _(r):
    # The same answer whatever the number of ranges.
    return ordered.page_changes(r.fx_observations, partitions=16).select("source_id", "event_id", "kind")


@query("f05_one_link_per_target", """
SELECT document_id, target_id, role, follow FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY document_id, target_id ORDER BY follow DESC, CASE WHEN follow THEN -position ELSE position END) AS rn
  FROM (SELECT document_id, target_id % 7 AS target_id, role, follow, CASE role WHEN 'required_section' THEN 0 WHEN 'attachment' THEN 1 ELSE 2 END AS position FROM fx_links)) WHERE rn = 1""")
def _(r):
    from noticegrid.functions.links import one_per_target

    position = F.when(F.col("role") == "required_section", 0).when(F.col("role") == "attachment", 1).otherwise(2)
    rows = r.fx_links.select("document_id", (F.col("target_id") % 7).alias("target_url"), "role", "follow", position.alias("position"))
    return one_per_target(rows, "document_id").select("document_id", F.col("target_url").alias("target_id"), "role", "follow")


@query("f06_repeated_cards", """
SELECT address, MIN(doc_id) AS first, COUNT(*) AS listings, COUNT(DISTINCT text) > 1 AS conflict
FROM (SELECT doc_id, concat(lang, source) AS text, sha256(text) AS address FROM documents) GROUP BY address""")
def _(r):
    # A text's digest stands for the card's address, its language and source for the content.
    cards = r.documents.select("doc_id", F.sha2("text", 256).alias("address"), F.concat("lang", "source").alias("content"))
    return ordered.repeated_cards(cards, "address", "doc_id", "content")


@query("f07_document_cap", """
SELECT opportunity_id, document_id, depth, CAST(rn AS INT) AS position, CASE WHEN rn = 4 THEN 'document_limit' ELSE limitation END AS limitation FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY opportunity_id ORDER BY depth, document_id) AS rn FROM fx_opportunity_documents) WHERE rn <= 4""")
def _(r):
    return ordered.capped_documents(r.fx_opportunity_documents, cap=3).select("opportunity_id", "document_id", "depth", "position", "limitation")


@query("f08_version_intervals", """
SELECT source_id, text_hash, MIN(observed_at) AS first_seen_at, MAX(observed_at) AS last_seen_at FROM fx_observations GROUP BY source_id, text_hash""")
def _(r):
    return ordered.version_intervals(r.fx_observations, "source_id", "text_hash", at="observed_at")


@query("f09_repeated_identifiers", """
SELECT id, doc_id, 'Duplicate identifier across pages' AS reason FROM (SELECT sha256(text) AS id, doc_id, MIN(doc_id) OVER (PARTITION BY sha256(text)) AS f FROM documents) WHERE doc_id <> f""")
def _(r):
    rows = r.documents.select(F.sha2("text", 256).alias("id"), "doc_id")
    return ordered.split_repeats(rows, "id", "doc_id")[1].withColumn("reason", F.lit("Duplicate identifier across pages"))


@query("f10_last_tag", """
SELECT opportunity_id, kind, value, arg_max(basis, position) AS basis FROM (
  SELECT opportunity_id, kind, value, basis, 2 AS position FROM fx_tags UNION ALL SELECT opportunity_id, kind, value, 'source', 1 FROM fx_tags WHERE kind = 'theme'
  UNION ALL SELECT opportunity_id, kind, value, 'rule', 3 FROM fx_tags WHERE kind = 'region' AND opportunity_id % 2 = 0) GROUP BY opportunity_id, kind, value""")
def _(r):
    tags = reconcile.union_streams(
        r.fx_tags.withColumn("position", F.lit(2)),
        r.fx_tags.filter("kind = 'theme'").withColumn("basis", F.lit("source")).withColumn("position", F.lit(1)),
        r.fx_tags.filter("kind = 'region' AND opportunity_id % 2 = 0").withColumn("basis", F.lit("rule")).withColumn("position", F.lit(3)))
    return ordered.last_tag(tags, "position")


# --- sets -----------------------------------------------------------------------------------
@query("h01_union_streams", """
SELECT CAST(id AS VARCHAR) AS external_id, title, CAST(NULL AS VARCHAR) AS lang FROM fx_opportunities
UNION ALL SELECT CAST(doc_id AS VARCHAR), text, lang FROM documents UNION ALL SELECT CAST(page_id AS VARCHAR), url, NULL FROM pages""")
def _(r):
    return reconcile.union_streams(
        r.fx_opportunities.select(F.col("id").cast("string").alias("external_id"), "title"),
        r.documents.select(F.col("doc_id").cast("string").alias("external_id"), F.col("text").alias("title"), "lang"),
        r.pages.select(F.col("page_id").cast("string").alias("external_id"), F.col("url").alias("title"))).select("external_id", "title", "lang")


@query("h02_reconcile_runs", """
WITH p AS (SELECT l_orderkey AS run, l_linenumber AS page, CASE WHEN l_orderkey % 5 = 0 AND l_linenumber > 2 THEN n + 1 WHEN l_orderkey % 7 = 0 THEN n + 1 ELSE n END AS total
  FROM (SELECT *, COUNT(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) JOIN orders ON o_orderkey = l_orderkey)
SELECT run, COUNT(*) AS seen, arg_min(total, page) AS expected, MIN(total) <> MAX(total) AS drift,
  CASE WHEN COUNT(*) <> arg_min(total, page) THEN 'failed' WHEN MIN(total) <> MAX(total) THEN 'partial' ELSE 'success' END AS status FROM p GROUP BY run""")
def _(r):
    lines = r.lineitem.select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("page"))
    totals = lines.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    key = F.col("run")
    total = F.when((key % 5 == 0) & (F.col("page") > 2), F.col("n") + 1).when(key % 7 == 0, F.col("n") + 1).otherwise(F.col("n"))
    known = r.orders.select(F.col("o_orderkey").alias("run"))
    return reconcile.reconcile_runs(lines.join(known, "run").join(totals, "run").withColumn("total", total), "run", "total")


@query("h03_topic_set_equality", """
SELECT side, COUNT(*) AS topics FROM (
  SELECT 'left' AS side, external_id FROM fx_opportunities WHERE id % 11 = 0 UNION ALL SELECT 'right', external_id FROM fx_opportunities WHERE id % 13 = 0 AND id % 11 <> 0) GROUP BY side""")
def _(r):
    # The manifest writes topics in lower case; each side lacks some of the other's.
    manifest = r.fx_opportunities.filter("id % 13 <> 0 OR id % 11 = 0").select(F.lower("external_id").alias("topic_id"))
    held = r.fx_opportunities.filter("id % 11 <> 0").select(F.upper("external_id").alias("k")).distinct()
    return reconcile.differences(manifest.select(F.upper("topic_id").alias("k")).distinct(), held).groupBy("side").agg(F.count(F.lit(1)).alias("topics"))


@query("h04_transfer_differences", """
WITH t AS (SELECT opportunity_id, kind, value FROM fx_tags WHERE NOT (kind = 'theme' AND opportunity_id % 100 = 1)
  UNION ALL SELECT opportunity_id, kind, value FROM fx_tags WHERE kind = 'region' AND opportunity_id % 1000 = 2)
SELECT opportunity_id, kind, value, 'left' AS side, CAST(1 AS BIGINT) AS copies FROM fx_tags WHERE kind = 'theme' AND opportunity_id % 100 = 1
UNION ALL SELECT opportunity_id, kind, value, 'right', CAST(1 AS BIGINT) FROM fx_tags WHERE kind = 'region' AND opportunity_id % 1000 = 2""")
def _(r):
    source = r.fx_tags.select("opportunity_id", "kind", "value")
    target = source.filter("NOT (kind = 'theme' AND opportunity_id % 100 = 1)").unionByName(
        source.filter("kind = 'region' AND opportunity_id % 1000 = 2"))
    return reconcile.differences(source, target)


@query("h05_affected_union", """
SELECT DISTINCT opportunity_id FROM fx_opportunity_documents WHERE active AND document_id IN (SELECT id FROM fx_documents WHERE parser IN ('Brand#3', 'Brand#5'))""")
def _(r):
    batches = [
        lookups.affected_notices(r.fx_documents.filter(F.col("parser") == p).select(F.col("id").alias("document_id")),
                                 None, r.fx_opportunity_documents, shared=False) for p in ("Brand#3", "Brand#5")]
    return reconcile.affected_union(*batches)


# --- graph ----------------------------------------------------------------------------------
@query("i01_root_documents", """
SELECT id AS opportunity_id, sha256(url) AS document_id, url, parser, title FROM (
  SELECT id, 'https://www.haeavustuksia.fi/api/haku/' || replace(external_id, ':', '%3A') || '/hakuilmoitus/' || s AS url, 'hae_json' AS parser, s AS title
  FROM fx_opportunities, (VALUES ('yleistiedot'), ('hakuaika'), ('perustiedot'), ('myontoperusteet'), ('arviointiperusteet'), ('lisaehdot')) v(s) WHERE source_id = 'src-1'
  UNION ALL SELECT id, canonical_url, CASE source_id WHEN 'src-2' THEN 'eura' WHEN 'src-0' THEN 'eu_source' ELSE 'web' END, 'Hakuilmoitus' FROM fx_opportunities WHERE source_id <> 'src-1')""")
def _(r):
    return graph.root_documents(r.fx_opportunities, "src-1", {"src-2": "eura", "src-0": "eu_source"})


SHARED["ox_reach"] = """
WITH RECURSIVE walk(opportunity_id, document_id, depth) AS (
  SELECT opportunity_id, document_id, 0 FROM fx_opportunity_documents WHERE is_root
  UNION SELECT w.opportunity_id, l.target_id, w.depth + 1 FROM walk w JOIN ox_flow_links l ON l.document_id = w.document_id WHERE w.depth < 5)
SELECT opportunity_id, document_id, MIN(depth) AS depth FROM walk GROUP BY opportunity_id, document_id"""


def followed(r):
    return r.fx_links.filter("follow")


def roots(r):
    return r.fx_opportunity_documents.filter("is_root")


@query("i02_bounded_reach", "SELECT opportunity_id, document_id, depth, CASE WHEN depth = 5 THEN 'depth_limit' END AS limitation FROM ox_reach")
def _(r):
    return graph.reach(roots(r), followed(r), 4, None).select("opportunity_id", "document_id", "depth", "limitation")


@query("i03_document_cap", """
SELECT opportunity_id, LEAST(COUNT(*), 11) AS documents, CASE WHEN COUNT(*) > 10 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS markers FROM ox_reach GROUP BY opportunity_id""")
def _(r):
    reached = graph.reach(roots(r), followed(r), 4, 10)
    return reached.groupBy("opportunity_id").agg(
        F.count(F.lit(1)).alias("documents"), F.count(F.when(F.col("limitation") == "document_limit", 1)).alias("markers"))


def old_bridge(r):
    return r.fx_opportunity_documents.select(
        "opportunity_id", "document_id", "depth", F.lit(None).cast("bigint").alias("parent_id"), "role", "limitation", "is_root", "active",
        F.col("first_seen_at").cast("timestamp_ntz").alias("first_seen_at"))


@query("i04_refreshed_bridge", f"""
SELECT COALESCE(o.opportunity_id, n.opportunity_id) AS opportunity_id, COALESCE(o.document_id, n.document_id) AS document_id,
  COALESCE(n.depth, o.depth) AS depth, COALESCE(o.is_root, false) AS is_root, n.document_id IS NOT NULL AS active,
  COALESCE(o.first_seen_at, {STAMP}) AS first_seen_at
FROM fx_opportunity_documents o FULL OUTER JOIN ox_reach n ON n.opportunity_id = o.opportunity_id AND n.document_id = o.document_id""")
def _(r):
    old = old_bridge(r)
    return graph.refresh_bridge(old, graph.reach(roots(r), followed(r), 4, None), r.as_of).select(
        "opportunity_id", "document_id", "depth", "is_root", "active", "first_seen_at")


@query("i05_incremental_refresh", f"""
WITH a AS (SELECT DISTINCT opportunity_id FROM fx_opportunity_documents WHERE active AND document_id IN (SELECT id FROM fx_documents WHERE parser = 'Brand#7'))
SELECT COALESCE(o.opportunity_id, n.opportunity_id) AS opportunity_id, COALESCE(o.document_id, n.document_id) AS document_id,
  CASE WHEN COALESCE(o.opportunity_id, n.opportunity_id) IN (SELECT opportunity_id FROM a) THEN n.document_id IS NOT NULL ELSE o.active END AS active
FROM fx_opportunity_documents o FULL OUTER JOIN (SELECT * FROM ox_reach WHERE opportunity_id IN (SELECT opportunity_id FROM a)) n
  ON n.opportunity_id = o.opportunity_id AND n.document_id = o.document_id""")
def _(r):
    changed = r.fx_documents.filter("parser = 'Brand#7'").select(F.col("id").alias("document_id"))
    affected = lookups.affected_notices(changed, None, r.fx_opportunity_documents, shared=False)
    return graph.refresh_notices(affected, old_bridge(r), followed(r), r.as_of, 4, None).select("opportunity_id", "document_id", "active")


# --- upsert ---------------------------------------------------------------------------------
SHARED["ox_current"] = """
SELECT id, source_id, title, version, updated_at, 'h' || CAST(id % 3 AS VARCHAR) AS content_hash FROM fx_opportunities WHERE id % 4 <> 3"""
SHARED["ox_incoming"] = """
SELECT id, CASE WHEN id % 10 = 9 THEN 'src-other' ELSE source_id END AS source_id, upper(title) AS title,
  CASE WHEN id % 6 < 3 THEN 'h' || CAST(id % 3 AS VARCHAR) ELSE 'new' END AS content_hash, id % 6 = 1 AS raw_changed FROM fx_opportunities WHERE id % 4 <> 0"""
SHARED["ox_foreign"] = "SELECT id, 'a-foreign' AS source_id, 'foreign' AS title, 'hf' AS content_hash, true AS raw_changed FROM fx_opportunities WHERE id % 4 <> 0 AND id % 8 < 4"
SHARED["ox_owned"] = """
SELECT id, source_id, title, content_hash, raw_changed FROM (SELECT n.*, ROW_NUMBER() OVER (PARTITION BY n.id ORDER BY COALESCE(n.source_id = c.source_id, false) DESC, n.source_id) AS rn
  FROM (SELECT * FROM ox_incoming UNION ALL SELECT * FROM ox_foreign) n LEFT JOIN ox_current c ON c.id = n.id) WHERE rn = 1"""
SHARED["ox_snapshot"] = f"""
SELECT COALESCE(c.id, n.id) AS id, CASE WHEN ch THEN n.source_id ELSE c.source_id END AS source_id, CASE WHEN ch THEN n.title ELSE c.title END AS title,
  CASE WHEN ch THEN n.content_hash ELSE c.content_hash END AS content_hash,
  CASE WHEN ch THEN COALESCE(c.version, 0) + 1 ELSE c.version END AS version, CASE WHEN ch THEN {STAMP} ELSE c.updated_at END AS updated_at,
  CASE WHEN c.id IS NULL THEN 'created' WHEN ch THEN 'updated' WHEN n.id IS NOT NULL AND n.source_id = c.source_id THEN 'seen' ELSE 'kept' END AS outcome
FROM (SELECT COALESCE(c.id, n.id) AS k, c.id IS NULL OR (n.id IS NOT NULL AND n.source_id = c.source_id AND (n.content_hash <> c.content_hash OR n.raw_changed)) AS ch
  FROM ox_current c FULL OUTER JOIN ox_owned n ON n.id = c.id) d LEFT JOIN ox_current c ON c.id = d.k LEFT JOIN ox_owned n ON n.id = d.k"""


def snapshot(r):
    current = r.fx_opportunities.filter("id % 4 <> 3").select(
        "id", "source_id", "title", "version", "updated_at", F.concat(F.lit("h"), F.col("id") % 3).alias("content_hash"))
    incoming = r.fx_opportunities.filter("id % 4 <> 0").select(
        "id", F.when(F.col("id") % 10 == 9, "src-other").otherwise(F.col("source_id")).alias("source_id"), F.upper("title").alias("title"),
        F.when(F.col("id") % 6 < 3, F.concat(F.lit("h"), F.col("id") % 3)).otherwise("new").alias("content_hash"), (F.col("id") % 6 == 1).alias("raw_changed"))
    # Half of the notices are listed by a second source as well.
    foreign = r.fx_opportunities.filter("id % 4 <> 0 AND id % 8 < 4").select(
        "id", F.lit("a-foreign").alias("source_id"), F.lit("foreign").alias("title"), F.lit("hf").alias("content_hash"), F.lit(True).alias("raw_changed"))
    return upsert.upsert(current, incoming.unionByName(foreign), r.as_of)


@query("j01_versioned_upsert", "SELECT id, source_id, title, content_hash, version, updated_at, outcome FROM ox_snapshot")
def _(r):
    return snapshot(r).select("id", "source_id", "title", "content_hash", "version", "updated_at", "outcome")


@query("j01_source_items", f"""
SELECT COALESCE(i.id, n.id) AS id, COALESCE(i.opportunity_id, n.opportunity_id) AS opportunity_id,
  CASE WHEN n.id IS NULL THEN i.raw_hash ELSE n.raw_hash END AS raw_hash, CASE WHEN n.id IS NULL THEN i.last_seen_at ELSE {STAMP} END AS last_seen_at
FROM (SELECT sha256(source_id || ':' || external_id) AS id, id AS opportunity_id, sha256(title) AS raw_hash, updated_at AS last_seen_at FROM fx_opportunities WHERE id % 3 <> 0) i
FULL OUTER JOIN (SELECT sha256(source_id || ':' || external_id) AS id, id + 5000000 AS opportunity_id, sha256(CASE WHEN id % 4 = 0 THEN title ELSE description END) AS raw_hash FROM fx_opportunities WHERE id % 5 <> 0) n ON n.id = i.id""")
def _(r):
    key = F.sha2(F.concat_ws(":", "source_id", "external_id"), 256)
    items = r.fx_opportunities.filter("id % 3 <> 0").select(
        key.alias("id"), "source_id", "external_id", F.col("id").alias("opportunity_id"), F.sha2("title", 256).alias("raw_hash"), F.col("updated_at").alias("last_seen_at"))
    # The publisher has moved every page, so unknown items get new notices and known ones keep theirs.
    incoming = r.fx_opportunities.filter("id % 5 <> 0").select(
        (F.col("id") + 5000000).alias("id"), "source_id", "external_id",
        F.sha2(F.when(F.col("id") % 4 == 0, F.col("title")).otherwise(F.col("description")), 256).alias("raw_hash"))
    rows = upsert.source_items(items, upsert.resolve_ids(incoming, items), r.as_of)
    return rows.select("id", "opportunity_id", "raw_hash", "last_seen_at")


@query("j02_child_replacement", """
SELECT opportunity_id, kind, value, basis FROM fx_tags WHERE opportunity_id NOT IN (SELECT id FROM ox_snapshot WHERE outcome IN ('created', 'updated'))
UNION ALL SELECT opportunity_id, kind, upper(value), 'source' FROM fx_tags WHERE opportunity_id IN (SELECT id FROM ox_snapshot WHERE outcome IN ('created', 'updated'))""")
def _(r):
    changed = snapshot(r).filter("outcome IN ('created', 'updated')").select("id")
    fresh = r.fx_tags.withColumn("value", F.upper("value")).withColumn("basis", F.lit("source"))
    return upsert.replace_children(r.fx_tags, fresh, changed).select("opportunity_id", "kind", "value", "basis")


@query("j03_change_log", f"""
SELECT (SELECT MAX(event_id) FROM events) + ROW_NUMBER() OVER (ORDER BY sha256(CAST(id AS VARCHAR))) AS id, id AS opportunity_id, source_id, outcome AS kind,
  {STAMP} AS created_at, '{{"title":"' || title || '"}}' AS payload_json FROM ox_snapshot WHERE outcome IN ('created', 'updated')""")
def _(r):
    last = r.events.agg(F.max("event_id").alias("m")).first().m
    return upsert.change_rows(snapshot(r), last, r.as_of, F.to_json(F.struct("title"))).select(
        "id", "opportunity_id", "source_id", "kind", "created_at", "payload_json")


# --- documents ------------------------------------------------------------------------------
# A fetched batch: the text numbered three past a document arrives for it.
SHARED["ox_fetched"] = """
SELECT d.id AS document_id, t.sha256, CASE WHEN d.id % 11 = 0 THEN 'partial_text' ELSE 'extracted' END AS extraction_status
FROM fx_documents d JOIN fx_texts t ON t.doc_id = CASE WHEN d.id % 5 = 0 THEN d.id ELSE d.id + 3 END"""
SHARED["ox_stored"] = """
SELECT DISTINCT sha256, 'extracted' AS extraction_status FROM fx_texts WHERE doc_id % 2 = 0 OR doc_id % 5 = 0"""
# Bodies come in the order of their documents; a content's parse before is the last one of the batch, else the stored one.
SHARED["ox_doc_steps"] = """
SELECT f.*, d.url, d.current_sha256, d.extraction_status AS stored_status, s.extraction_status AS stored_parse,
  LAG(f.extraction_status) OVER (PARTITION BY f.sha256 ORDER BY f.document_id) AS batch_parse
FROM ox_fetched f JOIN ox_current_docs d ON d.id = f.document_id LEFT JOIN ox_stored s ON s.sha256 = f.sha256"""
SHARED["ox_doc_events"] = """
SELECT * FROM (SELECT *, CASE WHEN current_sha256 IS NULL THEN 'document_added' WHEN current_sha256 = sha256 THEN 'document_reextracted' ELSE 'document_updated' END AS kind,
    current_sha256 AS previous_sha256, COALESCE(COALESCE(batch_parse, stored_parse) <> extraction_status, false) AS shared,
    CASE WHEN batch_parse IS NOT NULL AND (stored_parse IS NULL OR batch_parse <> stored_parse) THEN batch_parse ELSE stored_status END AS old_status FROM ox_doc_steps)
WHERE current_sha256 IS NULL OR current_sha256 <> sha256 OR shared OR old_status <> extraction_status"""


# Notices an event reaches: through its document, and through all that carry the content at that moment if the extraction changed.
SHARED["ox_carriers"] = """
SELECT c.id, c.current_sha256 AS sha256, -1 AS since, COALESCE(f.document_id, 1000000000) AS until FROM ox_current_docs c LEFT JOIN ox_fetched f ON f.document_id = c.id
UNION ALL SELECT document_id, sha256, document_id, 1000000000 FROM ox_fetched"""
SHARED["ox_reached"] = """
SELECT DISTINCT od.opportunity_id, e.document_id, e.kind, e.previous_sha256, e.sha256, e.url, e.extraction_status FROM ox_doc_events e JOIN fx_opportunity_documents od ON od.active AND (
  od.document_id = e.document_id OR (e.shared AND od.document_id IN (SELECT id FROM ox_carriers c WHERE c.sha256 = e.sha256 AND c.since < e.document_id AND c.until > e.document_id)))"""


def fetched(r):
    wanted = F.when(F.col("id") % 5 == 0, F.col("id")).otherwise(F.col("id") + 3)
    return r.fx_documents.select(F.col("id").alias("document_id"), wanted.alias("doc_id")).join(
        r.fx_texts.select("doc_id", "sha256", "text"), "doc_id").select(
        "document_id", "sha256", "text", F.when(F.col("document_id") % 11 == 0, "partial_text").otherwise("extracted").alias("extraction_status"))


def stored(r):
    return r.fx_texts.filter("doc_id % 2 = 0 OR doc_id % 5 = 0").select("sha256", F.lit("extracted").alias("extraction_status")).distinct()


def flow(r):
    return docs.document_flow(current_docs(r), fetched(r).drop("text"), stored(r))


def events(r):
    return flow(r)[0]


@query("j04_document_events", "SELECT document_id, kind, previous_sha256, sha256 FROM ox_doc_events")
def _(r):
    return events(r).select("document_id", "kind", "previous_sha256", "sha256")


@query("j04_new_blobs", """
SELECT sha256, arg_max(extraction_status, document_id) AS extraction_status FROM ox_fetched WHERE sha256 NOT IN (SELECT sha256 FROM ox_stored) GROUP BY sha256""")
def _(r):
    return docs.new_blobs(fetched(r), stored(r)).select("sha256", "extraction_status")


@query("j04_updated_blobs", """
SELECT s.sha256, COALESCE(f.extraction_status, s.extraction_status) AS extraction_status FROM ox_stored s
LEFT JOIN (SELECT sha256, arg_max(extraction_status, document_id) AS extraction_status FROM ox_fetched GROUP BY sha256) f ON f.sha256 = s.sha256""")
def _(r):
    return docs.updated_blobs(stored(r), fetched(r)).select("sha256", "extraction_status")


@query("j04_versions", f"""
SELECT document_id, sha256, MIN(seen_at) AS first_seen_at, MAX(seen_at) AS last_seen_at FROM (
  SELECT id AS document_id, current_sha256 AS sha256, TIMESTAMP '1998-06-27 00:00:00' AS seen_at FROM fx_contents WHERE current_sha256 IS NOT NULL
  UNION ALL SELECT document_id, sha256, {STAMP} FROM ox_fetched WHERE document_id % 4 <> 0
  UNION ALL SELECT id, current_sha256, {STAMP} FROM fx_contents WHERE id % 4 = 0 AND current_sha256 IS NOT NULL) GROUP BY document_id, sha256""")
def _(r):
    # Every fourth document answers that nothing was modified; the others send a body.
    then, now = (F.lit(at).cast("timestamp_ntz") for at in ("1998-06-27 00:00:00", r.as_of))
    documents = current_docs(r)
    versions = documents.filter("current_sha256 IS NOT NULL").select(
        F.col("id").alias("document_id"), F.col("current_sha256").alias("sha256"), then.alias("first_seen_at"), then.alias("last_seen_at"))
    same = documents.filter("id % 4 = 0").select(F.col("id").alias("document_id"), F.lit("not_modified").alias("kind"), now.alias("fetched_at"))
    bodies = fetched(r).filter("document_id % 4 <> 0").select("document_id", "sha256", now.alias("fetched_at"))
    return docs.new_versions(bodies.unionByName(docs.unmodified(documents, same)), versions)


@query("j04_link_replacement", """
SELECT document_id, CAST(target_id AS VARCHAR) AS target_url, MAX(role) AS role,
  CASE WHEN document_id % 3 = 0 THEN role_count > 0 AND target_id % 2 = 0 ELSE BOOL_OR(follow) END AS follow
FROM (SELECT *, COUNT(*) FILTER (WHERE target_id % 2 = 0) OVER (PARTITION BY document_id) AS role_count FROM fx_links) WHERE document_id % 3 <> 0 OR role_count > 0
GROUP BY document_id, target_id, role_count""")
def _(r):
    old = r.fx_links.groupBy("document_id", F.col("target_id").cast("string").alias("target_url")).agg(
        F.max("role").alias("role"), F.max("follow").alias("follow")).withColumn("source_sha256", F.lit("v1"))
    # Every third document was parsed again and now has only its even targets, all followed.
    even = F.col("target_url").cast("bigint") % 2 == 0
    parsed = old.filter((F.col("document_id") % 3 == 0) & even).withColumn("follow", F.lit(True))
    again = parsed.select("document_id").distinct()
    kept = old.filter("document_id % 3 <> 0").unionByName(old.join(again, "document_id", "left_semi"))
    return docs.replace_links(kept, parsed).select("document_id", "target_url", "role", "follow")


@query("j05_fan_out_versions", f"""
SELECT o.id, CAST(o.version + COALESCE(b.n, 0) AS INT) AS version, CASE WHEN b.n IS NULL THEN o.updated_at ELSE {STAMP} END AS updated_at FROM fx_opportunities o LEFT JOIN (
  SELECT opportunity_id, COUNT(*) AS n FROM ox_reached GROUP BY opportunity_id) b ON b.opportunity_id = o.id""")
def _(r):
    found, steps = flow(r)
    bumps = docs.notice_bumps(docs.reached_notices(found, r.fx_opportunity_documents, current_docs(r), steps))
    return docs.bumped(r.fx_opportunities, bumps, r.as_of).select("id", "version", "updated_at")


@query("j05_fan_out_log", """
SELECT ROW_NUMBER() OVER (ORDER BY sha256(CAST(e.opportunity_id AS VARCHAR) || '/' || CAST(e.document_id AS VARCHAR))) AS id, e.opportunity_id, e.document_id, e.kind, o.source_id,
  '{"document_id":' || e.document_id || ',"extraction_status":"' || e.extraction_status || '","previous_sha256":' || COALESCE('"' || e.previous_sha256 || '"', 'null') || ',"sha256":"' || e.sha256 || '","url":"' || e.url || '"}' AS payload_json
FROM ox_reached e JOIN fx_opportunities o ON o.id = e.opportunity_id""")
def _(r):
    found, steps = flow(r)
    _bumps, log = docs.fan_out(found, r.fx_opportunities, r.fx_opportunity_documents, 0, r.as_of, current_docs(r), steps)
    return log.select("id", "opportunity_id", "document_id", "kind", "source_id", "payload_json")


# --- reviews --------------------------------------------------------------------------------
# Review attempts: every event of a user is one, in time order.
SHARED["ox_review_events"] = """
SELECT e.event_id, e.user_id AS opportunity_id, e.ts AS arrived_at, CAST(e.event_id % 3 AS INT) AS expected_version,
  CASE WHEN e.event_id % 10 = 0 THEN 9 ELSE o.version END AS source_version,
  CASE e.event_type WHEN 'click' THEN 'unreviewed' ELSE 'eligible' END AS eligibility, CASE WHEN e.event_id % 4 = 0 THEN '' ELSE 'https://example.org/e' END AS evidence_url
FROM events e JOIN fx_opportunities o ON o.id = e.user_id"""


def review_events(r):
    source = r.fx_opportunities.select(F.col("id").alias("user_id"), "version")
    return r.events.join(source, "user_id").select(
        "event_id", F.col("user_id").alias("opportunity_id"), F.col("ts").alias("arrived_at"), (F.col("event_id") % 3).cast("int").alias("expected_version"),
        F.when(F.col("event_id") % 10 == 0, 9).otherwise(F.col("version")).alias("source_version"),
        F.when(F.col("event_type") == "click", "unreviewed").otherwise("eligible").alias("eligibility"),
        F.when(F.col("event_id") % 4 == 0, "").otherwise("https://example.org/e").alias("evidence_url"))


SHARED["ox_review_outcomes"] = """
WITH RECURSIVE ev AS (SELECT e.event_id, e.opportunity_id, e.expected_version, o.id IS NULL AS unknown,
    CASE WHEN e.eligibility <> 'unreviewed' AND e.evidence_url = '' THEN 'invalid' WHEN o.version <> e.source_version THEN 'conflict' ELSE 'candidate' END AS kind,
    ROW_NUMBER() OVER (PARTITION BY e.opportunity_id ORDER BY e.arrived_at, e.event_id) AS rn,
    COALESCE(r.version, 0) AS v0 FROM ox_review_events e JOIN fx_opportunities o ON o.id = e.opportunity_id LEFT JOIN fx_reviews r ON r.opportunity_id = e.opportunity_id),
s(opportunity_id, event_id, rn, v, outcome) AS (
  SELECT opportunity_id, event_id, rn, CASE WHEN kind = 'candidate' AND expected_version = v0 THEN v0 + 1 ELSE v0 END,
    CASE WHEN kind = 'invalid' THEN 'invalid' WHEN kind = 'candidate' AND expected_version = v0 THEN 'accepted' ELSE 'conflict' END FROM ev WHERE rn = 1
  UNION ALL SELECT e.opportunity_id, e.event_id, e.rn, CASE WHEN e.kind = 'candidate' AND e.expected_version = s.v THEN s.v + 1 ELSE s.v END,
    CASE WHEN e.kind = 'invalid' THEN 'invalid' WHEN e.kind = 'candidate' AND e.expected_version = s.v THEN 'accepted' ELSE 'conflict' END
  FROM s JOIN ev e ON e.opportunity_id = s.opportunity_id AND e.rn = s.rn + 1)
SELECT opportunity_id, event_id, outcome, CAST(v AS INT) AS review_version FROM s"""
SHARED["ox_accepted"] = """
SELECT o.opportunity_id, o.event_id, o.review_version, e.eligibility, e.source_version FROM ox_review_outcomes o
JOIN ox_review_events e ON e.event_id = o.event_id WHERE o.outcome = 'accepted'"""


def outcomes(r):
    return reviews.apply_reviews(review_events(r), r.fx_opportunities, r.fx_reviews)


@query("j06_review_outcomes", "SELECT opportunity_id, event_id, outcome, review_version FROM ox_review_outcomes")
def _(r):
    return outcomes(r).select("opportunity_id", "event_id", "outcome", "review_version")


@query("j06_reviews", """
SELECT COALESCE(r.opportunity_id, a.opportunity_id) AS opportunity_id, COALESCE(a.eligibility, r.eligibility) AS eligibility,
  COALESCE(a.source_version, r.reviewed_source_version) AS reviewed_source_version, COALESCE(a.review_version, r.version) AS version
FROM fx_reviews r FULL OUTER JOIN (SELECT opportunity_id, MAX(review_version) AS review_version, arg_max(eligibility, review_version) AS eligibility, arg_max(source_version, review_version) AS source_version
  FROM ox_accepted GROUP BY opportunity_id) a ON a.opportunity_id = r.opportunity_id""")
def _(r):
    return reviews.review_rows(outcomes(r), review_events(r), r.fx_reviews).select("opportunity_id", "eligibility", "reviewed_source_version", "version")


@query("j06_log", f"""
SELECT ROW_NUMBER() OVER (ORDER BY sha256(a.opportunity_id || '/' || a.review_version)) AS id, a.opportunity_id, o.source_id, 'reviewed' AS kind, {STAMP} AS created_at,
  '{{"eligibility":"' || a.eligibility || '","review_version":' || a.review_version || ',"source_version":' || a.source_version || '}}' AS payload_json
FROM ox_accepted a JOIN fx_opportunities o ON o.id = a.opportunity_id""")
def _(r):
    log = reviews.review_log(outcomes(r), review_events(r), r.fx_opportunities, 0, r.as_of)
    return log.select("id", "opportunity_id", "source_id", "kind", "created_at", "payload_json")


# --- runs, retirement, re-extraction --------------------------------------------------------
@query("j11_run_accounting", f"""
SELECT s.id AS source_id, COALESCE(n.seen, 0) AS seen, COALESCE(n.changed, 0) AS changed, COALESCE(x.rejected, 0) AS rejected, COALESCE(n.seen, 0) + COALESCE(x.rejected, 0) AS expected,
  CASE WHEN COALESCE(n.seen, 0) = 0 THEN 'failed' WHEN COALESCE(x.rejected, 0) > 0 THEN 'partial' ELSE 'success' END AS status,
  CASE WHEN COALESCE(n.seen, 0) > 0 AND COALESCE(x.rejected, 0) = 0 THEN {STAMP} ELSE s.last_success_at END AS last_success_at
FROM fx_sources s LEFT JOIN (SELECT source_id, COUNT(*) AS seen, COUNT(*) FILTER (WHERE outcome IN ('created', 'updated')) AS changed FROM ox_snapshot
  WHERE source_id <> 'src-2' GROUP BY source_id) n ON n.source_id = s.id
LEFT JOIN (SELECT source_id, COUNT(*) AS rejected FROM fx_opportunities WHERE funder = '' AND source_id IN ('src-0', 'src-1') GROUP BY source_id) x ON x.source_id = s.id WHERE s.enabled""")
def _(r):
    seen = snapshot(r).filter("source_id <> 'src-2'").select("source_id", "outcome")
    rejected = r.fx_opportunities.filter("funder = '' AND source_id IN ('src-0', 'src-1')").select("source_id")
    expected = seen.select("source_id").unionByName(rejected).groupBy("source_id").agg(F.count(F.lit(1)).alias("expected"))
    return upsert.run_rows(seen, rejected, expected, r.fx_sources, r.as_of).select(
        "source_id", "seen", "changed", "rejected", F.coalesce("expected", F.lit(0)).alias("expected"), "status", "last_success_at")


def retirement(r, manifest):
    """Bridge, bumps and log after a refresh whose manifest names the topics ``manifest``."""
    matches = faq.keyword_matches(faq_entries(r), r.fx_opportunities)
    bridge = faq_bridge(r, matches)
    return faq.retired(bridge, r.fx_opportunities, faq.stale_matches(bridge, matches), manifest, r.fx_opportunities, 0, 0, r.as_of)


def retired_bridge(r, manifest):
    """The bridge alone; the log that goes with it is not numbered for it."""
    matches = faq.keyword_matches(faq_entries(r), r.fx_opportunities)
    bridge = faq_bridge(r, matches)
    stale = faq.allowed_stale(faq.stale_matches(bridge, matches), manifest, r.fx_opportunities, 0)
    return faq.switched_off(bridge, stale).select("opportunity_id", "document_id", "active")


def manifest_topics(r):
    """The topics as the snapshot's manifest spells them: in upper case, some twice."""
    named = r.fx_opportunities.select(F.upper("external_id").alias("topic_id"))
    return named.unionByName(r.fx_opportunities.filter("id % 3 = 0").select(F.col("external_id").alias("topic_id")))


@query("j12_retired_associations", """
SELECT b.opportunity_id, b.document_id, m.opportunity_id IS NOT NULL AS active FROM ox_faq_bridge b
LEFT JOIN ox_faq_matches m ON m.opportunity_id = b.opportunity_id AND m.document_id = b.document_id""")
def _(r):
    return retired_bridge(r, manifest_topics(r))


@query("j12_gated_retirement", "SELECT opportunity_id, document_id, true AS active FROM ox_faq_bridge")
def _(r):
    # A manifest without every fifth topic is not a complete refresh, so nothing is retired.
    return retired_bridge(r, r.fx_opportunities.filter("id % 5 <> 0").select(F.col("external_id").alias("topic_id")))


@query("j12_unlink_log", f"""
SELECT ROW_NUMBER() OVER (ORDER BY sha256(CAST(b.opportunity_id AS VARCHAR) || '/' || CAST(b.document_id AS VARCHAR))) AS id, b.opportunity_id, b.document_id, 'document_unlinked' AS kind,
  '{fixed.FAQ_ACTOR}' AS actor, '{{"document_id":' || b.document_id || ',"reason":"{fixed.FAQ_UNLINKED}"}}' AS payload_json
FROM ox_faq_bridge b LEFT JOIN ox_faq_matches m ON m.opportunity_id = b.opportunity_id AND m.document_id = b.document_id WHERE m.opportunity_id IS NULL""")
def _(r):
    return retirement(r, manifest_topics(r))[2].select("id", "opportunity_id", "document_id", "kind", "actor", "payload_json")


@query("j13_reextraction", """
SELECT d.id, d.state, d.current_sha256, COALESCE(t.status, d.extraction_status) AS extraction_status FROM ox_current_docs d LEFT JOIN (
  SELECT DISTINCT sha256, CASE WHEN length(text) < 200 THEN 'partial_text' ELSE 'extracted' END AS status FROM fx_texts) t ON t.sha256 = d.current_sha256""")
def _(r):
    again = r.fx_texts.groupBy("sha256").agg(F.min(F.when(F.length("text") < 200, "partial_text").otherwise("extracted")).alias("extraction_status"))
    return docs.reextracted(current_docs(r), again).select("id", "state", "current_sha256", "extraction_status")


@query("j14_fetch_outcomes", """
SELECT id, CASE id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN CASE WHEN id % 2 = 0 THEN 'blocked' ELSE 'failed' END WHEN 4 THEN state ELSE 'fetched' END AS state,
  CASE id % 5 WHEN 0 THEN 'RATE_LIMIT|https://h.example.org|1998-07-02' WHEN 1 THEN 'TimeoutError' WHEN 4 THEN error WHEN 3 THEN 'DOCUMENT_DOWNLOAD_RETURNED_HTML'
    ELSE CASE WHEN id % 3 = 0 THEN 'DOCUMENT_DOWNLOAD_RETURNED_HTML' END END AS error,
  CASE id % 5 WHEN 0 THEN TIMESTAMP '1998-07-02 05:00:00' WHEN 4 THEN next_check_at ELSE TIMESTAMP '1998-07-02 00:00:00' END AS next_check_at,
  CASE WHEN id % 5 = 0 THEN CASE WHEN id % 2 = 0 THEN 3 ELSE 2 END WHEN id % 5 = 4 THEN 2 ELSE 3 END AS attempts,
  CASE WHEN id % 5 = 4 OR (id % 5 = 0 AND id % 2 = 1) THEN checked_at ELSE TIMESTAMP '1998-07-01 10:00:00' END AS checked_at,
  CASE WHEN id % 5 = 3 OR (id % 5 = 2 AND id % 3 = 0) THEN 'unreadable' ELSE extraction_status END AS extraction_status,
  CASE id % 5 WHEN 0 THEN CASE WHEN id % 2 = 0 THEN 429 END WHEN 1 THEN 503 WHEN 2 THEN 304 WHEN 3 THEN 200 END AS http_status,
  CASE WHEN id % 5 IN (2, 3) THEN TIMESTAMP '1998-07-01 10:00:00' ELSE TIMESTAMP '1998-06-01 00:00:00' END AS last_success_at FROM fx_documents""")
def _(r):
    k, even, html = F.col("id") % 5, F.col("id") % 2 == 0, (F.col("id") % 5 == 2) & (F.col("id") % 3 == 0)
    documents = r.fx_documents.withColumns({
        "attempts": F.lit(2), "url": F.when((k == 3) | html, F.concat("url", F.lit("/guide.pdf"))).otherwise(F.col("url")),
        "media_type": F.when(html, "text/html").otherwise("application/pdf"), "http_status": F.lit(None).cast("int"),
        "last_success_at": F.lit("1998-06-01 00:00:00").cast("timestamp_ntz"), "final_url": F.lit(None).cast("string")})
    outcomes = r.fx_documents.filter(k != 4).select(
        F.col("id").alias("document_id"),
        F.when(k == 0, "deferred").when(k == 1, "error").when(k == 2, "not_modified").otherwise("body").alias("kind"),
        F.lit("1998-07-01 10:00:00").cast("timestamp_ntz").alias("fetched_at"), F.lit("1998-07-02 05:00:00").cast("timestamp_ntz").alias("retry_at"),
        even.alias("attempted"), even.alias("blocked"), F.when(k == 1, 503).alias("http_status"),
        F.when(k == 0, "RATE_LIMIT|https://h.example.org|1998-07-02").otherwise("TimeoutError").alias("error_text"),
        # An answer that nothing was modified says nothing of the type; the stored content's counts.
        F.when(k == 3, "text/html").alias("media_type"), F.col("url").alias("final_url"))
    return docs.apply_outcomes(documents, outcomes).select(
        "id", "state", "error", "next_check_at", "attempts", "checked_at", "extraction_status", "http_status", "last_success_at")


@query("j15_retry_reset", """
SELECT id, CASE WHEN state IN ('failed', 'blocked') AND id IN (SELECT document_id FROM fx_opportunity_documents WHERE active AND limitation IS NULL) THEN NULL ELSE next_check_at END AS next_check_at
FROM fx_documents""")
def _(r):
    return docs.retry_reset(r.fx_documents, r.fx_opportunity_documents).select("id", "next_check_at")


@query("a14_reextraction_selection", """
SELECT id, parser FROM ox_current_docs WHERE current_sha256 IS NOT NULL AND parser IN ('Brand#3', 'Brand#4', 'Brand#5') AND extraction_status <> 'extracted'
  AND id IN (SELECT document_id FROM fx_links WHERE follow)""")
def _(r):
    ids = r.fx_links.filter("follow").select(F.col("document_id").alias("id"))
    return docs.reextraction_candidates(current_docs(r), ("Brand#3", "Brand#4", "Brand#5"), True, ids).select("id", "parser")


# --- quality --------------------------------------------------------------------------------
SHARED["ox_candidates"] = """
SELECT id, CASE WHEN id % 23 = 0 THEN '' ELSE external_id END AS external_id, CASE WHEN id % 29 = 0 THEN 'ftp://example.org/x' ELSE canonical_url END AS canonical_url, title, funder,
  CASE WHEN id % 31 = 0 THEN 'tender' ELSE record_kind END AS record_kind, instrument, source_status, geographic_scope,
  CASE WHEN id % 37 = 0 THEN -total_budget ELSE total_budget END AS total_budget FROM fx_opportunities"""
SHARED["ox_rejects"] = """
SELECT id, concat_ws('; ', CASE WHEN external_id = '' THEN 'external_id: required' END, CASE WHEN canonical_url LIKE 'ftp:%' THEN 'canonical_url: a public HTTP(S) source URL is required' END,
  CASE WHEN record_kind = 'tender' THEN 'record_kind: not an allowed value' END, CASE WHEN total_budget < 0 THEN 'total_budget: negative' END) AS reason FROM ox_candidates"""


def candidates(r):
    k = F.col("id")
    return r.fx_opportunities.select(
        "id", F.when(k % 23 == 0, "").otherwise(F.col("external_id")).alias("external_id"),
        F.when(k % 29 == 0, "ftp://example.org/x").otherwise(F.col("canonical_url")).alias("canonical_url"), "title", "funder",
        F.when(k % 31 == 0, "tender").otherwise(F.col("record_kind")).alias("record_kind"), "instrument", "source_status", "geographic_scope",
        F.when(k % 37 == 0, -F.col("total_budget")).otherwise(F.col("total_budget")).alias("total_budget"))


@query("v01_record_validation", "SELECT id, reason = '' AS valid FROM ox_rejects")
def _(r):
    return quality.with_reason(candidates(r)).select("id", F.col("reason").isNull().alias("valid"))


@query("v02_dead_letters", """
SELECT 'run-1' AS run_id, j.reason, '{"id":' || CAST(j.id AS VARCHAR) || ',"title":"' || c.title || '"}' AS raw_json FROM ox_rejects j JOIN ox_candidates c ON c.id = j.id WHERE j.reason <> ''""")
def _(r):
    _valid, rejected = quality.split_valid(candidates(r))
    return quality.dead_letters(rejected, "run-1", F.to_json(F.struct("id", "title")))


@query("v03_nonempty_collection", "SELECT source_id, COUNT(*) AS records FROM fx_opportunities GROUP BY source_id")
def _(r):
    return agg.counts_by(quality.require_rows(r.fx_opportunities), "source_id")


@query("v04_checksums", """
SELECT doc_id, sha256(text) = CASE WHEN doc_id % 40 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS intact FROM documents""")
def _(r):
    recorded = F.sha2(F.when(F.col("doc_id") % 40 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256)
    return r.documents.select("doc_id", quality.checksum_matches(F.col("text"), recorded).alias("intact"))


@query("v05_repeated_ids", "SELECT text, COUNT(*) AS n FROM documents GROUP BY text HAVING COUNT(*) > 1")
def _(r):
    rows = r.documents.withColumn("sha256", F.sha2("text", 256))
    repeated = quality.repeated_keys(rows, "sha256")
    return rows.join(repeated, "sha256").groupBy("sha256", "n").agg(F.min("text").alias("text")).select("text", "n")


@query("v07_short_content", """
SELECT doc_id, CASE WHEN length(trim(text)) < 100 THEN 'Page content too short; possible error or bot challenge' END AS reason FROM documents""")
def _(r):
    short = F.length(F.trim("text")) < 100
    return r.documents.select("doc_id", F.when(short, "Page content too short; possible error or bot challenge").alias("reason"))


@query("v08_report_cross_check", """
SELECT funder, COUNT(*) AS reported, COUNT(*) AS recounted, true AS equal FROM (SELECT lower(funder) AS funder FROM fx_opportunities WHERE funder <> '') GROUP BY funder""")
def _(r):
    base = registry.with_status(registry.with_expiry(r.fx_opportunities), r.as_of)
    report = agg.funder_directory(base).select(F.lower("funder").alias("funder"), "records")
    recount = r.fx_opportunities.filter("funder <> ''").groupBy(F.lower("funder").alias("funder")).agg(F.count(F.lit(1)).alias("records"))
    return quality.cross_check(report, recount, "funder", "records")
