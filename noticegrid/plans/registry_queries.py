"""Registry view, filters, joins, aggregates and pages over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticegrid.functions import codes, dates, fixed, status, text
from noticegrid.operators import aggregates as agg
from noticegrid.operators import paging, predicates, priorities, registry
from noticegrid.plans.registry import SHARED, query
from noticegrid.plans.views import AS_OF

TODAY = AS_OF[:10]

SHARED["ox_expiry"] = """
SELECT *, CASE WHEN deadline_on IS NULL THEN NULL WHEN deadline_at IS NOT NULL THEN deadline_at
  ELSE (CAST(deadline_on + 1 AS TIMESTAMP) AT TIME ZONE 'Europe/Helsinki') AT TIME ZONE 'UTC' END AS deadline_expires_at
FROM fx_opportunities"""
SHARED["ox_status"] = f"""
SELECT *, CASE WHEN source_status = 'cancelled' THEN 'cancelled'
  WHEN deadline_expires_at <= TIMESTAMP '{AS_OF}' THEN 'closed'
  WHEN deadline_at < TIMESTAMP '{AS_OF}' THEN 'closed'
  WHEN deadline_on < DATE '{TODAY}' THEN 'closed'
  WHEN source_status = 'closed' THEN 'closed'
  WHEN opens_on > DATE '{TODAY}' THEN 'forthcoming' ELSE source_status END AS effective_status
FROM ox_expiry"""
SHARED["ox_coverage"] = """
SELECT od.opportunity_id, COUNT(*) AS document_count,
  COUNT(*) FILTER (WHERE d.state = 'fetched') AS fetched_count,
  COUNT(*) FILTER (WHERE d.state = 'pending') AS pending_count,
  COUNT(*) FILTER (WHERE d.state IN ('failed', 'blocked')) AS failed_count,
  COUNT(*) FILTER (WHERE d.state = 'fetched' AND d.extraction_status <> 'extracted') AS text_issue_count,
  COUNT(*) FILTER (WHERE od.limitation IS NOT NULL) AS limited_count,
  COUNT(*) FILTER (WHERE od.is_root) AS root_count,
  COUNT(*) FILTER (WHERE od.is_root AND d.state = 'fetched' AND d.extraction_status = 'extracted') AS roots_fetched,
  MAX(d.checked_at) AS documents_checked_at
FROM fx_opportunity_documents od JOIN fx_documents d ON d.id = od.document_id WHERE od.active GROUP BY od.opportunity_id"""
SHARED["ox_registry"] = """
SELECT o.*, COALESCE(r.eligibility, 'unreviewed') AS eligibility, COALESCE(r.city_role, 'unknown') AS city_role,
  CASE WHEN r.opportunity_id IS NULL OR r.eligibility = 'unreviewed' OR r.reviewed_source_version <> o.version THEN 1 ELSE 0 END AS needs_review,
  s.name AS source_name, s.health AS source_health, s.last_success_at AS source_last_success_at,
  CASE WHEN c.opportunity_id IS NULL THEN 'not_started'
    WHEN c.failed_count > 0 OR c.text_issue_count > 0 OR c.limited_count > 0 THEN 'partial'
    WHEN c.pending_count > 0 THEN 'in_progress' ELSE 'collected_unverified' END AS content_state,
  COALESCE(c.document_count, 0) AS document_count, COALESCE(c.fetched_count, 0) AS fetched_count,
  COALESCE(c.pending_count, 0) AS pending_document_count, COALESCE(c.failed_count, 0) AS failed_document_count,
  COALESCE(c.text_issue_count, 0) AS document_text_issues, COALESCE(c.limited_count, 0) AS limited_document_count,
  COALESCE(c.root_count, 0) AS root_document_count, COALESCE(c.roots_fetched, 0) AS root_documents_fetched
FROM ox_status o JOIN fx_sources s ON s.id = o.source_id
LEFT JOIN fx_reviews r ON r.opportunity_id = o.id LEFT JOIN ox_coverage c ON c.opportunity_id = o.id"""

REGISTRY_COLUMNS = [
    "id", "source_id", "title", "funder", "effective_status", "eligibility", "city_role", "needs_review", "source_name",
    "source_health", "content_state", "document_count", "fetched_count", "pending_document_count",
    "failed_document_count", "document_text_issues", "limited_document_count", "root_document_count",
    "root_documents_fetched",
]
COLUMN_LIST = ", ".join(REGISTRY_COLUMNS)

# Rule groups over the test tables' own vocabulary: every supported field, overlaps, one unknown source.
GROUPS = priorities.validate_groups([
    {"id": 1, "name": "Cascade", "sources": ["src-0"], "rules": [{"source_id": ["src-0"], "external_id_prefix": ["cascade:"]}]},
    {"id": 2, "name": "Machinery or urgent", "sources": ["src-1", "src-2"],
     "rules": [{"funder": ["MACHINERY", "machinery"]}, {"programme": ["1-URGENT"]}]},
    {"id": 3, "name": "Ring titles", "sources": ["src-2", "src-9"], "rules": [{"title_contains": ["RING", "promo"]}]},
    {"id": 4, "name": "Schemes", "sources": ["src-3", "src-4"], "rules": [{"record_kind": ["funding_scheme"]}]},
    {"id": 5, "name": "No notices", "sources": ["src-8"], "rules": [{"source_id": ["src-8"]}]},
])
GROUP_SQL = {
    1: "source_id = 'src-0' AND external_id LIKE 'cascade:%'",
    2: "funder IN ('MACHINERY', 'machinery') OR programme = '1-URGENT'",
    3: "contains(lower(title), 'ring') OR contains(lower(title), 'promo')",
    4: "record_kind = 'funding_scheme'",
    5: "source_id = 'src-8'",
}
GROUP_NAMES = {g["id"]: g["name"] for g in GROUPS}


def view(r):
    return registry.registry_view(
        r.fx_opportunities, r.fx_sources, r.fx_reviews, r.fx_opportunity_documents, r.fx_documents, r.as_of)


def base(r):
    """Notices with status only: enough for filters that need no joins."""
    return registry.with_status(registry.with_expiry(r.fx_opportunities), r.as_of)


# --- status expressions ---------------------------------------------------------------------
@query("b23_effective_deadline", "SELECT id, deadline_on, deadline_at, deadline_expires_at FROM ox_expiry")
def _(r):
    # Two published stages per notice; the later one decides.
    early = F.struct(
        F.date_sub("deadline_on", 30).alias("due_on"), F.lit(None).cast("timestamp_ntz").alias("due_at"),
        F.lit("").alias("original"), F.lit("Europe/Helsinki").alias("timezone"))
    final = F.struct(
        F.col("deadline_on").alias("due_on"), F.col("deadline_at").alias("due_at"),
        F.lit("").alias("original"), F.lit("Europe/Helsinki").alias("timezone"))
    last = r.fx_opportunities.select(
        "id", dates.last_stage(F.filter(F.array(final, early), lambda d: d["due_on"].isNotNull())).alias("d"))
    return last.select(
        "id", F.col("d.due_on").alias("deadline_on"), F.col("d.due_at").alias("deadline_at"),
        F.when(F.col("d").isNotNull(), dates.expires_at(F.col("d.due_on"), F.col("d.due_at"), F.col("d.timezone")))
        .alias("deadline_expires_at"))


@query("b24_quality_flags", """
SELECT id, concat_ws(',', CASE WHEN deadline_on IS NULL THEN 'deadline_unknown' END, CASE WHEN funder = '' THEN 'eligibility_not_extracted' END,
  'listing_only', CASE WHEN deadline_model IN ('two-stage', 'multiple-cut-off') THEN 'stage_access_must_be_checked' END) AS flags
FROM fx_opportunities""")
def _(r):
    flags = text.quality_flags(F.array(F.lit("listing_only")), F.col("funder"), F.col("deadline_on"), F.col("deadline_model"))
    return r.fx_opportunities.select("id", F.array_join(flags, ",").alias("flags"))


@query("b25_effective_status", "SELECT id, effective_status FROM ox_status")
def _(r):
    return base(r).select("id", "effective_status")


@query("b26_review_status", "SELECT id, eligibility, city_role, needs_review FROM ox_registry")
def _(r):
    return registry.with_review(r.fx_opportunities, r.fx_reviews).select("id", "eligibility", "city_role", "needs_review")


@query("b27_content_state", "SELECT id, content_state FROM ox_registry")
def _(r):
    coverage = registry.document_coverage(r.fx_opportunity_documents, r.fx_documents)
    return registry.with_coverage(r.fx_opportunities, coverage).select("id", "content_state")


@query("b28_conflict_flag", """
SELECT id, CASE WHEN effective_status = 'closed' AND source_status IN ('open', 'forthcoming', 'rolling')
  THEN 'listed,source_status_conflicts_with_deadline' ELSE 'listed' END AS flags FROM ox_status""")
def _(r):
    return base(r).select("id", F.array_join(status.conflict_flags(F.array(F.lit("listed"))), ",").alias("flags"))


@query("b29_collection_level", """
SELECT id, CASE adapter WHEN 'page_watch' THEN 'page_changes' WHEN 'manual' THEN 'manual' ELSE 'structured' END AS collection_level
FROM fx_sources""")
def _(r):
    return r.fx_sources.select("id", status.collection_level(F.col("adapter")).alias("collection_level"))


@query("b19_cascade_flag", "SELECT id, source_id = 'src-0' AND starts_with(external_id, 'cascade:') AS cascade FROM fx_opportunities")
def _(r):
    return r.fx_opportunities.select("id", codes.is_cascade(F.col("source_id"), F.col("external_id"), "src-0").alias("cascade"))


@query("b45_reporting_projection", """
SELECT id, source_id, title, funder, effective_status, deadline_on, eligibility, needs_review, content_state, document_count,
  source_id = 'src-0' AND starts_with(external_id, 'cascade:') AS cascade FROM ox_registry
WHERE (record_kind = 'funding_scheme' OR effective_status IN ('open', 'rolling', 'forthcoming', 'unknown')) AND eligibility <> 'ineligible'""")
def _(r):
    return view(r).filter(predicates.bi_candidates()).select(
        "id", "source_id", "title", "funder", "effective_status", "deadline_on", "eligibility", "needs_review",
        "content_state", "document_count", codes.is_cascade(F.col("source_id"), F.col("external_id"), "src-0").alias("cascade"))


def _case(column, table):
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {column} END"


_LABELLED = ("effective_status", "geographic_scope", "eligibility", "source_health", "content_state", "record_kind", "instrument")


@query("b46_report_labels", "SELECT id, " + ", ".join(
    f"{_case(c, fixed.LABELS[c])} AS {c}" for c in _LABELLED) + " FROM ox_registry")
def _(r):
    return view(r).select("id", *(codes.report_labels(c).alias(c) for c in _LABELLED))


# --- filters --------------------------------------------------------------------------------
def _ids(df):
    return df.select("id")


@query("c01_title_search", "SELECT id FROM fx_opportunities WHERE contains(lower(title || ' ' || description), 'ring economy brand#2')")
def _(r):
    return _ids(predicates.filter_notices(r.fx_opportunities, q="RING economy Brand#2"))


@query("c02_equality_filters", """
SELECT id FROM ox_registry WHERE effective_status = 'closed' AND source_id = 'src-2' AND programme = '1-URGENT' AND geographic_scope = 'other_region'
  AND eligibility = 'unreviewed' AND instrument = 'grant' AND record_kind = 'call' AND content_state = 'partial'""")
def _(r):
    return _ids(predicates.filter_notices(
        view(r), status="closed", source="src-2", programme="1-URGENT", scope="other_region", eligibility="unreviewed",
        instrument="grant", record_kind="call", content_state="partial"))


@query("c03_funder_filter", "SELECT id, funder FROM fx_opportunities WHERE lower(funder) = lower('Machinery')")
def _(r):
    return predicates.filter_notices(r.fx_opportunities, funder="Machinery").select("id", "funder")


@query("c04_tag_filter", """
SELECT id FROM fx_opportunities o WHERE EXISTS (SELECT 1 FROM fx_tags t WHERE t.opportunity_id = o.id AND t.kind = 'theme' AND t.value = 'small')
  AND EXISTS (SELECT 1 FROM fx_tags t WHERE t.opportunity_id = o.id AND t.kind = 'region' AND t.value = 'NATION_2')""")
def _(r):
    return _ids(predicates.filter_notices(r.fx_opportunities, theme="small", region="NATION_2", tags=r.fx_tags))


@query("c05_needs_review", "SELECT id FROM ox_registry WHERE needs_review = 0")
def _(r):
    return _ids(predicates.filter_notices(registry.with_review(r.fx_opportunities, r.fx_reviews), needs_review=False))


@query("c06_deadline_range", "SELECT id, deadline_on FROM fx_opportunities WHERE deadline_on BETWEEN DATE '1998-01-01' AND DATE '1998-06-30'")
def _(r):
    return predicates.filter_notices(
        r.fx_opportunities, deadline_after="1998-01-01", deadline_before="1998-06-30").select("id", "deadline_on")


@query("c07_changed_since", "SELECT id, updated_at FROM fx_opportunities WHERE updated_at >= TIMESTAMP '1998-03-31 21:00:00'")
def _(r):
    return predicates.filter_notices(r.fx_opportunities, changed_since="1998-04-01T00:00:00+03:00").select("id", "updated_at")


@query("c08_content_search", """
SELECT id FROM fx_opportunities WHERE id IN (SELECT opportunity_id FROM fx_opportunity_documents WHERE active AND document_id IN (
  SELECT id FROM fx_contents WHERE current_sha256 IN (SELECT sha256 FROM fx_texts WHERE contains(lower(text), 'tionel'))))""")
def _(r):
    return _ids(predicates.filter_notices(
        r.fx_opportunities, content_q="TIONel", bridge=r.fx_opportunity_documents, contents=r.fx_contents, blobs=r.fx_texts))


@query("c09_cascade_filter", """
SELECT id, external_id, false AS cascade FROM fx_opportunities WHERE NOT (source_id = 'src-0' AND external_id LIKE 'cascade:%')
UNION ALL SELECT id, external_id, true FROM fx_opportunities WHERE source_id = 'src-0' AND external_id LIKE 'cascade:%'""")
def _(r):
    sides = [predicates.filter_notices(r.fx_opportunities, cascade=c, search_source="src-0")
             .select("id", "external_id", F.lit(c).alias("cascade")) for c in (True, False)]
    return sides[0].unionByName(sides[1])


@query("c10_priority_filter", f"SELECT id FROM fx_opportunities WHERE {GROUP_SQL[2]}")
def _(r):
    return _ids(predicates.filter_notices(r.fx_opportunities, priority=GROUPS[1]))


@query("c11_current_or_unknown", f"""
SELECT id FROM ox_expiry WHERE source_status NOT IN ('closed', 'cancelled')
  AND (deadline_expires_at IS NULL OR deadline_expires_at > TIMESTAMP '{AS_OF}')
  AND (deadline_at IS NULL OR deadline_at >= TIMESTAMP '{AS_OF}') AND (deadline_on IS NULL OR deadline_on >= DATE '{TODAY}')""")
def _(r):
    return _ids(registry.with_expiry(r.fx_opportunities).filter(status.current_or_unknown(r.as_of)))


@query("c12_bi_candidates", """
SELECT id FROM ox_registry WHERE (record_kind = 'funding_scheme' OR effective_status IN ('open', 'rolling', 'forthcoming', 'unknown'))
  AND eligibility <> 'ineligible'""")
def _(r):
    return _ids(registry.with_review(base(r), r.fx_reviews).filter(predicates.bi_candidates()))


@query("c13_in_scope_links", """
SELECT opportunity_id, document_id, limitation IS NULL AS in_scope FROM fx_opportunity_documents WHERE active""")
def _(r):
    return r.fx_opportunity_documents.filter("active").select(
        "opportunity_id", "document_id", predicates.in_scope().alias("in_scope"))


@query("c14_catalogue_rules", """
SELECT page_id FROM (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)
WHERE regexp_matches(url, '/(en|fr)/') AND NOT regexp_matches(title, '(?i)reaut|thhe') AND regexp_matches(title, '(?i)[aeiou]n')""")
def _(r):
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return r.pages.select("page_id", "url", title.alias("title")).filter(
        predicates.listed(F.col("url"), F.col("title"), include_url="/(en|fr)/", include_title="[aeiou]n", exclude_title="reaut|thhe")
    ).select("page_id")


@query("c15_due_documents", f"""
SELECT id FROM fx_documents WHERE (next_check_at IS NULL OR next_check_at <= TIMESTAMP '{AS_OF}') AND state IN ('pending', 'failed')""")
def _(r):
    return _ids(r.fx_documents.filter(predicates.due_for_check(r.as_of, ("pending", "failed"))))


@query("c16_deadline_soon", f"SELECT id, deadline_on FROM fx_opportunities WHERE deadline_on BETWEEN DATE '{TODAY}' AND DATE '{TODAY}' + 30")
def _(r):
    return r.fx_opportunities.filter(predicates.deadline_within(r.as_of)).select("id", "deadline_on")


@query("c17_point_lookup", f"SELECT {COLUMN_LIST} FROM ox_registry WHERE id = (SELECT MAX(o_orderkey) FROM orders)")
def _(r):
    key = r.orders.agg(F.max("o_orderkey").alias("k")).first().k
    one = r.fx_opportunities.filter(F.col("id") == key)
    bridge = r.fx_opportunity_documents.filter(F.col("opportunity_id") == key)
    return registry.registry_view(one, r.fx_sources, r.fx_reviews, bridge, r.fx_documents, r.as_of).select(*REGISTRY_COLUMNS)


# --- joins ----------------------------------------------------------------------------------
@query("d01_registry_view", f"SELECT {COLUMN_LIST} FROM ox_registry")
def _(r):
    return view(r).select(*REGISTRY_COLUMNS)


@query("d02_coverage_input", """
SELECT od.opportunity_id, od.document_id, od.is_root, od.limitation, d.state, d.extraction_status
FROM fx_opportunity_documents od JOIN fx_documents d ON d.id = od.document_id WHERE od.active""")
def _(r):
    docs = r.fx_documents.select(F.col("id").alias("document_id"), "state", "extraction_status")
    return r.fx_opportunity_documents.filter("active").join(docs, "document_id").select(
        "opportunity_id", "document_id", "is_root", "limitation", "state", "extraction_status")


@query("d03_document_detail", """
SELECT od.opportunity_id, od.document_id, od.depth, od.active, d.url, d.state, d.extraction_status, c.current_sha256, b.copies, b.n_chars
FROM fx_opportunity_documents od JOIN fx_documents d ON d.id = od.document_id JOIN fx_contents c ON c.id = d.id
LEFT JOIN fx_blobs b ON b.sha256 = c.current_sha256""")
def _(r):
    docs = r.fx_documents.join(r.fx_contents.select("id", "current_sha256"), "id")
    return registry.document_detail(r.fx_opportunity_documents, docs, r.fx_blobs).select(
        "opportunity_id", "document_id", "depth", "active", "url", "state", "extraction_status", "current_sha256", "copies", "n_chars")


@query("d04_tag_semi_join", """
SELECT id FROM fx_opportunities WHERE id IN (SELECT opportunity_id FROM fx_tags WHERE kind = 'region' AND value = 'NATION_7')""")
def _(r):
    return _ids(predicates.with_tag(r.fx_opportunities, r.fx_tags, "region", "NATION_7"))


@query("d05_nested_semi_joins", """
SELECT id, title FROM fx_opportunities WHERE id IN (SELECT opportunity_id FROM fx_opportunity_documents WHERE active AND document_id IN (
  SELECT id FROM fx_contents WHERE current_sha256 IN (SELECT sha256 FROM fx_texts WHERE contains(lower(text), 'ndhand'))))""")
def _(r):
    return predicates.with_content(
        r.fx_opportunities, r.fx_opportunity_documents, r.fx_contents, r.fx_texts, "ndHAND").select("id", "title")


@query("d09_missing_sources", """
SELECT * FROM (VALUES (3, 'src-9'), (5, 'src-8')) v(priority_id, source_id) WHERE source_id NOT IN (SELECT id FROM fx_sources)""")
def _(r):
    config = priorities.group_sources(r.spark, GROUPS)
    return priorities.missing_sources(config, r.fx_sources).select("priority_id", "source_id")


_MEMBERSHIP_SQL = " UNION ALL ".join(
    f"SELECT id AS opportunity_id, {i} AS priority_id, '{GROUP_NAMES[i]}' AS priority_name FROM fx_opportunities WHERE {cond}"
    for i, cond in GROUP_SQL.items())


@query("d14_rule_membership", _MEMBERSHIP_SQL)
def _(r):
    return priorities.memberships(r.fx_opportunities, GROUPS)


# --- aggregates -----------------------------------------------------------------------------
@query("e01_document_coverage", "SELECT * FROM ox_coverage")
def _(r):
    return registry.document_coverage(r.fx_opportunity_documents, r.fx_documents)


@query("e02_funder_directory", """
SELECT MIN(funder) AS funder, COUNT(*) AS records, COUNT(*) FILTER (WHERE record_kind = 'call') AS calls,
  COUNT(*) FILTER (WHERE record_kind = 'funding_scheme') AS schemes, COUNT(*) FILTER (WHERE record_kind = 'advance_information') AS advance_information,
  COUNT(*) FILTER (WHERE effective_status IN ('open', 'forthcoming', 'rolling')) AS open_or_forthcoming,
  COUNT(*) FILTER (WHERE effective_status = 'unknown') AS unknown_status
FROM ox_status WHERE funder <> '' GROUP BY lower(funder)""")
def _(r):
    return agg.funder_directory(base(r))


_DIRECTORY_SQL = " UNION ALL ".join(f"""
SELECT {i} AS priority_id, '{GROUP_NAMES[i]}' AS priority_name, COUNT(*) AS records,
  COUNT(*) FILTER (WHERE record_kind = 'call') AS calls, COUNT(*) FILTER (WHERE record_kind = 'funding_scheme') AS schemes,
  COUNT(*) FILTER (WHERE record_kind = 'advance_information') AS advance_information,
  COUNT(*) FILTER (WHERE effective_status IN ('open', 'forthcoming', 'rolling')) AS current,
  COUNT(*) FILTER (WHERE content_state = 'collected_unverified') AS collected_unverified FROM ox_registry WHERE {cond}"""
    for i, cond in GROUP_SQL.items())


@query("e03_priority_directory", _DIRECTORY_SQL)
def _(r):
    wanted = priorities.members(base(r), GROUPS)
    # Documents of other notices are not counted.
    coverage = registry.coverage_of(wanted, r.fx_opportunity_documents, r.fx_documents)
    return priorities.directory(registry.with_coverage(wanted, coverage), GROUPS)


@query("e03_priority_source_issues", f"""
SELECT v.priority_id, v.source_id FROM (VALUES (1,'src-0'),(2,'src-1'),(2,'src-2'),(3,'src-2'),(3,'src-9'),(4,'src-3'),(4,'src-4'),(5,'src-8')) v(priority_id, source_id)
JOIN fx_sources s ON s.id = v.source_id WHERE NOT s.enabled OR s.health <> 'success' OR s.last_success_at IS NULL
  OR s.last_success_at < TIMESTAMP '{AS_OF}' - INTERVAL '36' HOUR""")
def _(r):
    return priorities.source_issues(priorities.group_sources(r.spark, GROUPS), agg.source_health(r.fx_sources, r.as_of))


_FACET_SQL = " UNION ".join(f"SELECT '{c}' AS facet, CAST({c} AS VARCHAR) AS value FROM ox_registry" for c in agg.FACETS)


@query("e04_facets", f"""
SELECT * FROM ({_FACET_SQL}) UNION ALL SELECT DISTINCT kind, value FROM fx_tags
UNION ALL SELECT 'funder', MIN(funder) FROM fx_opportunities WHERE funder <> '' GROUP BY lower(funder)""")
def _(r):
    return agg.facets(view(r), r.fx_tags)


@query("e05_coverage_summary", """
SELECT 'calls' AS section, content_state AS key, COUNT(*) AS n FROM ox_registry GROUP BY content_state
UNION ALL SELECT 'documents', state, COUNT(*) FROM fx_documents GROUP BY state
UNION ALL SELECT 'current_documents', state, COUNT(*) FROM fx_documents WHERE id IN (
  SELECT document_id FROM fx_opportunity_documents WHERE active AND limitation IS NULL) GROUP BY state
UNION ALL SELECT 'originals', 'all', COUNT(*) FROM fx_blobs""")
def _(r):
    coverage = registry.document_coverage(r.fx_opportunity_documents, r.fx_documents)
    states = registry.with_coverage(r.fx_opportunities, coverage)
    return agg.coverage_summary(states, r.fx_documents, r.fx_opportunity_documents, r.fx_blobs)


@query("e06_filtered_total", "SELECT COUNT(*) AS total FROM ox_registry WHERE effective_status = 'closed' AND needs_review = 1")
def _(r):
    rows = predicates.filter_notices(registry.with_review(base(r), r.fx_reviews), status="closed", needs_review=True)
    return rows.agg(F.count(F.lit(1)).alias("total"))


@query("e07_counts_by_source_status_kind", """
SELECT source_id, effective_status, record_kind, COUNT(*) AS records FROM ox_status GROUP BY source_id, effective_status, record_kind""")
def _(r):
    return agg.counts_by(base(r), "source_id", "effective_status", "record_kind")


@query("e08_originals_by_media_type", """
SELECT d.media_type, COUNT(*) AS originals, CAST(SUM(d.byte_count) AS BIGINT) AS original_bytes, CAST(SUM(CAST(d.byte_count // 500 AS INT)) AS BIGINT) AS pages
FROM fx_documents d WHERE d.state = 'fetched' GROUP BY d.media_type""")
def _(r):
    return r.fx_documents.filter("state = 'fetched'").groupBy("media_type").agg(
        F.count(F.lit(1)).alias("originals"), F.sum("byte_count").alias("original_bytes"),
        F.sum(F.expr("byte_count div 500")).alias("pages"))


@query("e09_documents_by_parser_state", "SELECT parser, state, COUNT(*) AS documents FROM fx_documents GROUP BY parser, state")
def _(r):
    return agg.counts_by(r.fx_documents, "parser", "state", out="documents")


@query("e10_notices_with_role", """
SELECT COUNT(DISTINCT opportunity_id) AS notices FROM fx_opportunity_documents WHERE active AND role = 'faq_keyword_match'""")
def _(r):
    # Distinct ids first: the combine is map-side and the final count is one number per task.
    return r.fx_opportunity_documents.filter(F.col("active") & (F.col("role") == "faq_keyword_match")).select(
        "opportunity_id").distinct().agg(F.count(F.lit(1)).alias("notices"))


@query("e12_content_gaps", """
SELECT (SELECT COUNT(DISTINCT d.id) FROM fx_documents d JOIN fx_opportunity_documents od ON od.document_id = d.id JOIN ox_status o ON o.id = od.opportunity_id
    WHERE od.active AND od.limitation IS NULL AND d.state = 'pending' AND o.effective_status NOT IN ('closed', 'cancelled')) AS current_or_unknown_pending_documents,
  COUNT(*) FILTER (WHERE error = 'DOCUMENT_DOWNLOAD_RETURNED_HTML') AS attachment_urls_returning_html,
  COUNT(*) FILTER (WHERE error = 'DETAIL_REDIRECTED_TO_FRONT_PAGE') AS details_redirecting_to_front_pages,
  COUNT(*) FILTER (WHERE state = 'pending' AND error LIKE 'RATE_LIMIT|%') AS rate_limit_deferred_documents,
  (SELECT COUNT(*) FROM ox_flagged WHERE parser = 'eu_source' AND first_doc_id % 3 = 0) AS eu_entries_without_published_body,
  (SELECT COUNT(*) FROM ox_flagged WHERE parser = 'eu_faq_source' AND first_doc_id % 4 = 1) AS faq_entries_without_published_question_or_answer FROM fx_documents""")
def _(r):
    pending = agg.pending_of_current(base(r), r.fx_opportunity_documents, r.fx_documents)
    return agg.one_row(agg.content_gaps(r.fx_documents), pending, agg.flag_gaps(*flagged_contents(r)))


SHARED["ox_flagged"] = """
SELECT CASE WHEN c.id % 2 = 0 THEN 'eu_source' ELSE 'eu_faq_source' END AS parser, b.first_doc_id FROM fx_contents c JOIN fx_blobs b ON b.sha256 = c.current_sha256"""


def flagged_contents(r):
    """Documents of two parsers, and contents of which a third and a fourth carry the flags of missing bodies."""
    documents = r.fx_contents.withColumn("parser", F.when(F.col("id") % 2 == 0, "eu_source").otherwise("eu_faq_source"))
    k = F.col("first_doc_id")
    flags = F.array_compact(F.array(F.when(k % 3 == 0, fixed.TOPIC_BODY_MISSING), F.when(k % 4 == 1, fixed.FAQ_TEXT_MISSING)))
    return documents, r.fx_blobs.withColumn("flags_json", F.to_json(flags))


@query("e13_table_counts", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, COUNT(*) AS n FROM {t}" for t in ("fx_sources", "fx_opportunities", "fx_documents", "fx_tags", "fx_changes", "fx_blobs")))
def _(r):
    return agg.table_counts({t: getattr(r, t) for t in ("fx_sources", "fx_opportunities", "fx_documents", "fx_tags", "fx_changes", "fx_blobs")})


SHARED["ox_priority"] = f"""
SELECT od.document_id, MIN(CASE WHEN o.source_status IN ('open', 'forthcoming', 'rolling')
    AND (o.deadline_expires_at IS NULL OR o.deadline_expires_at > TIMESTAMP '{AS_OF}')
    AND (o.deadline_at IS NULL OR o.deadline_at >= TIMESTAMP '{AS_OF}') AND (o.deadline_on IS NULL OR o.deadline_on >= DATE '{TODAY}') THEN 0
  WHEN o.source_status = 'unknown' THEN 1 ELSE 2 END) AS priority, MIN(od.depth) AS depth
FROM fx_opportunity_documents od JOIN ox_expiry o ON o.id = od.opportunity_id WHERE od.active AND od.limitation IS NULL GROUP BY od.document_id"""


@query("e14_fetch_priority", "SELECT * FROM ox_priority")
def _(r):
    return agg.fetch_priority(r.fx_opportunity_documents, registry.with_expiry(r.fx_opportunities), r.as_of)


SHARED["ox_health"] = f"""
SELECT *, last_success_at IS NULL OR last_success_at < TIMESTAMP '{AS_OF}' - INTERVAL '36' HOUR AS stale,
  CASE adapter WHEN 'page_watch' THEN 'page_changes' WHEN 'manual' THEN 'manual' ELSE 'structured' END AS collection_level FROM fx_sources"""


@query("e15_source_health", "SELECT id, name, health, enabled, stale, collection_level FROM ox_health")
def _(r):
    return agg.source_health(r.fx_sources, r.as_of).select("id", "name", "health", "enabled", "stale", "collection_level")


@query("e15_health_summary", """
SELECT CASE WHEN COUNT(*) FILTER (WHERE enabled AND (stale OR health <> 'success')) > 0 THEN 'degraded' ELSE 'current' END AS status,
  string_agg(id, ',' ORDER BY id) FILTER (WHERE enabled AND (stale OR health <> 'success')) AS issues,
  COUNT(*) FILTER (WHERE collection_level = 'structured') AS structured_sources,
  COUNT(*) FILTER (WHERE collection_level = 'page_changes') AS page_monitors FROM ox_health""")
def _(r):
    return agg.health_summary(agg.source_health(r.fx_sources, r.as_of))


@query("e16_review_measures", "SELECT COUNT(DISTINCT id) AS notices, COUNT(DISTINCT id) FILTER (WHERE needs_review = 1) AS to_review FROM ox_registry")
def _(r):
    return agg.review_measures(registry.with_review(r.fx_opportunities, r.fx_reviews))


@query("e17_funder_sources", """
SELECT MIN(funder) AS funder, string_agg(DISTINCT source_name, ' · ' ORDER BY source_name) AS sources
FROM ox_registry WHERE funder <> '' GROUP BY lower(funder)""")
def _(r):
    return agg.funder_sources(registry.with_source(r.fx_opportunities, r.fx_sources))


@query("e18_report_summary", "SELECT COUNT(*) AS total, " + ", ".join(
    f"COUNT(*) FILTER (WHERE effective_status = '{s}') AS status_{s}" for s in fixed.SOURCE_STATUSES) + """,
  COUNT(*) FILTER (WHERE record_kind = 'funding_scheme') AS schemes, COUNT(*) FILTER (WHERE record_kind = 'advance_information') AS advance_information, """
  + ", ".join(f"COUNT(*) FILTER (WHERE content_state = '{s}') AS content_{s}" for s in ("collected_unverified", "partial", "in_progress"))
  + " FROM ox_registry")
def _(r):
    coverage = registry.document_coverage(r.fx_opportunity_documents, r.fx_documents)
    return agg.report_summary(registry.with_coverage(base(r), coverage))


@query("e19_group_combinations", f"""
SELECT COALESCE(combination, 'none') AS combination, COUNT(*) AS records FROM (
  SELECT o.id, string_agg(m.priority_name, ' · ' ORDER BY m.priority_name) AS combination FROM fx_opportunities o
  LEFT JOIN ({_MEMBERSHIP_SQL}) m ON m.opportunity_id = o.id GROUP BY o.id) GROUP BY 1""")
def _(r):
    names = F.create_map(*(F.lit(x) for item in GROUP_NAMES.items() for x in item))
    member = F.transform(priorities.membership_array(GROUPS), lambda i: F.element_at(names, i))
    return agg.group_combinations(r.fx_opportunities, member)


@query("e20_quality_counters", """
SELECT COUNT(*) FILTER (WHERE content_state = 'collected_unverified') AS without_issues,
  COUNT(*) FILTER (WHERE failed_document_count > 0) AS with_failures, COUNT(*) FILTER (WHERE limited_document_count > 0) AS with_limits
FROM ox_registry WHERE effective_status IN ('open', 'forthcoming', 'rolling')""")
def _(r):
    current = base(r).filter(F.col("effective_status").isin(*fixed.CURRENT_STATUSES))
    coverage = registry.document_coverage(r.fx_opportunity_documents, r.fx_documents)
    return agg.quality_counters(registry.with_coverage(current, coverage))


@query("e21_version_bumps", """
SELECT od.document_id, COUNT(*) AS version_bumps FROM fx_opportunity_documents od JOIN fx_documents d ON d.id = od.document_id
WHERE od.active AND d.state = 'fetched' AND d.extraction_status = 'partial_text' GROUP BY od.document_id""")
def _(r):
    changed = r.fx_documents.filter("state = 'fetched' AND extraction_status = 'partial_text'").select(F.col("id").alias("document_id"))
    return agg.fan_out(changed, r.fx_opportunity_documents)


# --- pages ----------------------------------------------------------------------------------
@query("g01_offset_page", f"""
SELECT {COLUMN_LIST} FROM ox_registry WHERE effective_status IN ('closed', 'open') AND needs_review = 1 AND deadline_on >= DATE '1996-01-01'
ORDER BY id LIMIT 100 OFFSET 40""")
def _(r):
    def narrow(v):
        return predicates.filter_notices(
            v.filter(F.col("effective_status").isin("closed", "open")), needs_review=True, deadline_after="1996-01-01")
    return paging.registry_page(
        r.fx_opportunities, r.fx_sources, r.fx_reviews, r.fx_opportunity_documents, r.fx_documents, r.as_of, narrow, 40, 100
    ).select(*REGISTRY_COLUMNS)


@query("g01_page_info", """
SELECT n AS total, CAST(CASE WHEN n > 140 THEN 140 END AS BIGINT) AS next_offset FROM (
  SELECT COUNT(*) AS n FROM ox_registry WHERE effective_status IN ('closed', 'open') AND needs_review = 1 AND deadline_on >= DATE '1996-01-01')""")
def _(r):
    rows = predicates.filter_notices(view(r).filter(F.col("effective_status").isin("closed", "open")), needs_review=True, deadline_after="1996-01-01")
    return paging.page_info(rows, 40, 100)


@query("g02_change_page", """
WITH w AS (SELECT MAX(id) - 100 AS m FROM fx_changes),
p AS (SELECT c.*, COUNT(*) OVER () AS n, ROW_NUMBER() OVER (ORDER BY id) AS rn FROM (SELECT * FROM fx_changes, w WHERE id > 150 AND id <= m ORDER BY id LIMIT 201) c)
SELECT id, opportunity_id, kind, created_at, CAST(m AS BIGINT) AS through_id, n > 200 AS has_more, MAX(id) OVER () AS next_after_id FROM p WHERE rn <= 200""")
def _(r):
    top = r.events.agg(F.max("event_id").alias("m")).first().m
    return paging.change_page(r.fx_changes, after_id=150, through_id=top - 100, limit=200).select(
        "id", "opportunity_id", "kind", "created_at", "through_id", "has_more", "next_after_id")


@query("g03_latest_runs", "SELECT id, created_at FROM fx_changes ORDER BY created_at DESC, id LIMIT 50")
def _(r):
    return paging.latest(r.fx_changes, "created_at", "id").select("id", "created_at")


@query("g04_fetch_candidates", f"""
SELECT d.id, p.priority, p.depth FROM fx_documents d JOIN ox_priority p ON p.document_id = d.id
WHERE d.next_check_at IS NULL OR d.next_check_at <= TIMESTAMP '{AS_OF}' ORDER BY p.priority, p.depth, d.id LIMIT 500""")
def _(r):
    ranked = agg.fetch_priority(r.fx_opportunity_documents, registry.with_expiry(r.fx_opportunities), r.as_of)
    return paging.fetch_candidates(r.fx_documents, ranked, predicates.due_for_check(r.as_of)).select("id", "priority", "depth")


@query("g05_report_order", """
SELECT id, effective_status, deadline_on, title FROM ox_status ORDER BY
  CASE effective_status WHEN 'open' THEN 0 WHEN 'rolling' THEN 1 WHEN 'forthcoming' THEN 2 WHEN 'unknown' THEN 3 WHEN 'closed' THEN 4 ELSE 5 END,
  deadline_on NULLS LAST, title, id""")
def _(r):
    return paging.report_order(base(r)).select("id", "effective_status", "deadline_on", "title")


@query("g06_notice_documents", """
SELECT od.opportunity_id, od.document_id, od.depth, od.role, d.url, d.state FROM fx_opportunity_documents od JOIN fx_documents d ON d.id = od.document_id
WHERE od.active AND od.opportunity_id = (SELECT MIN(l_orderkey) FROM lineitem WHERE l_returnflag <> 'R') ORDER BY od.depth, d.url""")
def _(r):
    key = r.lineitem.filter("l_returnflag <> 'R'").agg(F.min("l_orderkey").alias("k")).first().k
    return paging.notice_documents(
        registry.document_detail(r.fx_opportunity_documents, r.fx_documents.join(r.fx_contents.select("id", "current_sha256"), "id"), r.fx_blobs),
        key).select("opportunity_id", "document_id", "depth", "role", "url", "state")
