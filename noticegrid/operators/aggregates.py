"""Directory, coverage and report aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticegrid.functions import fixed, status
from noticegrid.functions.text import fold
from noticegrid.operators.predicates import in_scope
from noticegrid.operators.registry import count_when


def funder_directory(view: DataFrame) -> DataFrame:
    """Case-collapsed funder names with counts by kind and status."""
    kind, state = F.col("record_kind"), F.col("effective_status")
    return (
        view.filter(F.col("funder") != "")
        .groupBy(fold(F.col("funder")).alias("_key"))
        .agg(
            F.min("funder").alias("funder"),
            F.count(F.lit(1)).alias("records"),
            count_when(kind == "call").alias("calls"),
            count_when(kind == "funding_scheme").alias("schemes"),
            count_when(kind == "advance_information").alias("advance_information"),
            count_when(state.isin(*fixed.CURRENT_STATUSES)).alias("open_or_forthcoming"),
            count_when(state == "unknown").alias("unknown_status"),
        )
        .drop("_key")
    )


FACETS = (
    "programme", "source_id", "record_kind", "instrument", "effective_status", "geographic_scope", "eligibility",
    "content_state",
)


def facets(view: DataFrame, tags: DataFrame) -> DataFrame:
    """Distinct (facet, value) rows: one unpivot over the view's combinations, plus tags and collapsed funders."""
    pairs = F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in FACETS))
    # Combinations are few where facets are; they combine before the shuffle and before the unpivot.
    columns = view.select(*FACETS).distinct().select(F.explode(pairs).alias("p")).select("p.*").distinct()
    tag_values = tags.filter(F.col("kind").isin("theme", "region")).select(F.col("kind").alias("facet"), "value").distinct()
    funders = (
        view.filter(F.col("funder") != "").groupBy(fold(F.col("funder")).alias("_k"))
        .agg(F.min("funder").alias("value")).select(F.lit("funder").alias("facet"), "value")
    )
    return columns.unionByName(tag_values).unionByName(funders)


def counts_by(df: DataFrame, *keys: str, out: str = "records") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def labelled_counts(df: DataFrame, section: str, key: str) -> DataFrame:
    return df.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(section).alias("section"), "key", "n"
    )


def coverage_summary(view: DataFrame, documents: DataFrame, bridge: DataFrame, blobs: DataFrame) -> DataFrame:
    """Notices by content state, documents by state (all and in scope), and number of originals."""
    scope = documents.join(
        bridge.filter(in_scope()).select("document_id").distinct(), documents.id == F.col("document_id"), "left_semi"
    )
    originals = blobs.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("originals").alias("section"), F.lit("all").alias("key"), "n"
    )
    return (
        labelled_counts(view, "calls", "content_state")
        .unionByName(labelled_counts(documents, "documents", "state"))
        .unionByName(labelled_counts(scope, "current_documents", "state"))
        .unionByName(originals)
    )


def fetch_priority(bridge: DataFrame, notices: DataFrame, as_of: str) -> DataFrame:
    """Per in-scope document: best class over its notices (0 current, 1 unknown, 2 other) and least depth."""
    current = F.col("source_status").isin(*fixed.CURRENT_STATUSES) & status.current_or_unknown(as_of)
    ranked = notices.select(
        F.col("id").alias("opportunity_id"),
        F.when(current, 0).when(F.col("source_status") == "unknown", 1).otherwise(2).alias("class"),
    )
    links = bridge.filter(in_scope()).select("opportunity_id", "document_id", "depth")
    return links.join(ranked, "opportunity_id").groupBy("document_id").agg(
        F.min("class").alias("priority"), F.min("depth").alias("depth")
    )


def source_health(sources: DataFrame, as_of: str, stale_hours: int = 36) -> DataFrame:
    limit = F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL '{int(stale_hours)}' HOUR")
    return sources.withColumn(
        "stale", F.col("last_success_at").isNull() | (F.col("last_success_at") < limit)
    ).withColumn("collection_level", status.collection_level(F.col("adapter")))


def health_summary(health: DataFrame) -> DataFrame:
    """Overall status, ids of enabled sources with an issue, and counts by level."""
    issue = F.col("enabled") & (F.col("stale") | (F.col("health") != "success"))
    return health.agg(
        F.when(count_when(issue) > 0, "degraded").otherwise("current").alias("status"),
        # The registry holds one row per configured source.
        F.array_join(F.array_sort(F.collect_list(F.when(issue, F.col("id")))), ",").alias("issues"),
        count_when(F.col("collection_level") == "structured").alias("structured_sources"),
        count_when(F.col("collection_level") == "page_changes").alias("page_monitors"),
    )


def review_measures(view: DataFrame) -> DataFrame:
    """Distinct notices and review backlog.

    The view has one row per notice, but reports may join it to child rows first, so ids are
    reduced to one row each before they are counted.
    """
    per_notice = view.groupBy("id").agg(F.max("needs_review").alias("needs_review"))
    return per_notice.agg(F.count(F.lit(1)).alias("notices"), count_when(F.col("needs_review") == 1).alias("to_review"))


def funder_sources(view: DataFrame) -> DataFrame:
    """Names of the sources that supply each funder.

    Pairs are reduced to distinct (funder, source) before any list is built, so a list is at most
    as long as the source registry.
    """
    pairs = view.filter(F.col("funder") != "").groupBy(fold(F.col("funder")).alias("funder_key"), "source_name").agg(
        F.min("funder").alias("funder"))
    return pairs.groupBy("funder_key").agg(
        F.min("funder").alias("funder"),
        F.array_join(F.array_sort(F.collect_list("source_name")), " · ").alias("sources"),
    ).select("funder", "sources")


def report_summary(view: DataFrame) -> DataFrame:
    """Totals per status, kind and content state in one row."""
    def equal(column, value, name):
        return count_when(F.col(column) == value).alias(name)

    return view.agg(
        F.count(F.lit(1)).alias("total"),
        *(equal("effective_status", s, f"status_{s}") for s in fixed.SOURCE_STATUSES),
        equal("record_kind", "funding_scheme", "schemes"),
        equal("record_kind", "advance_information", "advance_information"),
        *(equal("content_state", s, f"content_{s}") for s in ("collected_unverified", "partial", "in_progress")),
    )


def quality_counters(view: DataFrame) -> DataFrame:
    """Current notices without issues, with failures and with limits; the last two may overlap."""
    current = view.filter(F.col("effective_status").isin(*fixed.CURRENT_STATUSES))
    return current.agg(
        count_when(F.col("content_state") == "collected_unverified").alias("without_issues"),
        count_when(F.col("failed_document_count") > 0).alias("with_failures"),
        count_when(F.col("limited_document_count") > 0).alias("with_limits"),
    )


def group_combinations(notices: DataFrame, membership: Column, none_label: str = "none") -> DataFrame:
    """Notices per exact combination of groups."""
    text = F.array_join(F.array_sort(membership), " · ")
    return counts_by(notices.select(F.when(text == "", none_label).otherwise(text).alias("combination")), "combination")


def fan_out(changed: DataFrame, bridge: DataFrame) -> DataFrame:
    """Version bumps that each changed document causes over its active notices."""
    links = bridge.filter("active").select("opportunity_id", "document_id")
    return links.join(changed.select("document_id"), "document_id").groupBy("document_id").agg(
        F.count(F.lit(1)).alias("version_bumps")
    )


def content_gaps(documents: DataFrame) -> DataFrame:
    """Error and deferral classes of the documents, in one scan."""
    error = F.col("error")
    return documents.agg(
        count_when(error == fixed.DOWNLOAD_RETURNED_HTML).alias("attachment_urls_returning_html"),
        count_when(error == fixed.REDIRECTED_TO_FRONT).alias("details_redirecting_to_front_pages"),
        count_when((F.col("state") == "pending") & error.startswith("RATE_LIMIT|")).alias("rate_limit_deferred_documents"),
    )


def flag_gaps(documents: DataFrame, blobs: DataFrame) -> DataFrame:
    """Documents by the flags (``flags_json``) of their current content: entries without a published body or answer."""
    def flagged(parser, flag, name):
        return count_when((F.col("parser") == parser) & F.col("flags_json").contains(flag)).alias(name)

    contents = documents.select("parser", F.col("current_sha256").alias("sha256")).filter(
        F.col("parser").isin("eu_source", "eu_faq_source")).join(blobs.select("sha256", "flags_json"), "sha256")
    return contents.agg(
        flagged("eu_source", fixed.TOPIC_BODY_MISSING, "eu_entries_without_published_body"),
        flagged("eu_faq_source", fixed.FAQ_TEXT_MISSING, "faq_entries_without_published_question_or_answer"),
    )


def pending_of_current(notices: DataFrame, bridge: DataFrame, documents: DataFrame) -> DataFrame:
    """Distinct pending in-scope documents of notices that are neither closed nor cancelled."""
    open_ids = notices.filter(~F.col("effective_status").isin("closed", "cancelled")).select(
        F.col("id").alias("opportunity_id"))
    wanted = bridge.filter(in_scope()).select("opportunity_id", "document_id").join(open_ids, "opportunity_id", "left_semi")
    pending = documents.filter("state = 'pending'").join(
        wanted.select("document_id"), documents.id == F.col("document_id"), "left_semi")
    return pending.agg(F.count(F.lit(1)).alias("current_or_unknown_pending_documents"))


def one_row(*counters: DataFrame) -> DataFrame:
    """One-row counter tables side by side."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), counters)
    return stacked.agg(*(F.max(c).alias(c) for c in stacked.columns))


def _section_of(sets: dict[str, list[str]], columns: list[str]) -> Column:
    """The section that a row's grouping id stands for; a column outside a set has its bit on, the first column the highest."""
    bits = {c: 1 << (len(columns) - 1 - i) for i, c in enumerate(columns)}
    named = {name: sum(b for c, b in bits.items() if c not in keys) for name, keys in sets.items()}
    found = None
    for name, number in named.items():
        found = F.when(F.col("_gid") == number, name) if found is None else found.when(F.col("_gid") == number, name)
    return found


def _grouped(rows: DataFrame, sets: dict[str, list[str]], **measures) -> DataFrame:
    """All sections of one relation in one scan: ``section``, the grouping columns, ``n`` and further measures."""
    columns = list(dict.fromkeys(c for keys in sets.values() for c in keys))
    grouped = rows.groupingSets([[F.col(c) for c in keys] for keys in sets.values()], *columns).agg(
        F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_gid"), *(m.alias(name) for name, m in measures.items()))
    return grouped.withColumn("section", _section_of(sets, columns))


def notice_sections(notices: DataFrame) -> DataFrame:
    """``section, key, n`` over notices: by source, status, kind and content state, all, and distinct funders."""
    rows = notices.select("source_id", "effective_status", "record_kind", "content_state", F.nullif(fold(F.col("funder")), F.lit("")).alias("_funder"))
    sets = {"by_source": ["source_id"], "by_status": ["effective_status"], "by_record_kind": ["record_kind"],
            "call_coverage": ["content_state"], "funder_names": ["_funder"], "opportunities": []}
    names = F.col("section") == "funder_names"
    key = F.coalesce(*(F.col(c) for c in ("source_id", "effective_status", "record_kind", "content_state")), F.lit("all"))
    n = F.when(names, F.col("_funder").isNotNull().cast("bigint")).otherwise(F.col("n"))
    return _grouped(rows, sets).groupBy("section", F.when(names, "all").otherwise(key).alias("key")).agg(F.sum(n).alias("n"))


def document_sections(documents: DataFrame) -> DataFrame:
    """``section, key, n`` over documents: states, parsers, extraction, formats of originals, and error classes."""
    fetched, error = F.col("state") == "fetched", F.col("error")
    gaps = {
        "attachment_urls_returning_html": error == fixed.DOWNLOAD_RETURNED_HTML,
        "details_redirecting_to_front_pages": error == fixed.REDIRECTED_TO_FRONT,
        "rate_limit_deferred_documents": (F.col("state") == "pending") & error.startswith("RATE_LIMIT|"),
    }
    sets = {"documents": ["state"], "documents_by_parser_state": ["parser", "state"], "text_extraction": ["extraction_status"], "formats": ["media_type"], "gaps": []}
    grouped = _grouped(
        documents, sets, **{k: count_when(c) for k, c in gaps.items()}, originals=count_when(fetched),
        original_bytes=F.sum(F.when(fetched, F.col("byte_count"))), pages=F.sum(F.when(fetched, F.col("page_count"))))

    def row(section, key, n):
        return F.struct(F.lit(section).alias("section") if isinstance(section, str) else section.alias("section"), key.alias("key"), n.cast("bigint").alias("n"))

    counts = F.array(row(F.col("section"), F.coalesce(F.concat_ws("/", "parser", "state", "extraction_status")), F.col("n")))
    formats = F.when(F.col("originals") > 0, F.array(*(row(f"document_formats.{m}", F.col("media_type"), F.col(m)) for m in ("originals", "original_bytes", "pages"))))
    missing = F.array(*(row("source_content_gaps", F.lit(g), F.col(g)) for g in gaps))
    rows = F.when(F.col("section") == "formats", formats).when(F.col("section") == "gaps", missing).otherwise(counts)
    return grouped.select(F.explode(rows).alias("r")).select("r.*")


def source_sections(sources: DataFrame) -> DataFrame:
    """``section, key, n`` over sources: how many, how many structured, and those whose last run did not succeed."""
    counted = sources.agg(F.count(F.lit(1)).alias("all"), count_when(F.col("collection_level") == "structured").alias("structured")).select(
        F.explode(F.array(
            F.struct(F.lit("source_count").alias("section"), F.lit("all").alias("key"), F.col("all").alias("n")),
            F.struct(F.lit("structured_sources").alias("section"), F.lit("all").alias("key"), F.col("structured").alias("n")))).alias("r")).select("r.*")
    issues = sources.filter(F.col("enabled") & (F.col("health") != "success")).select(
        F.lit("source_issues").alias("section"), F.col("id").alias("key"), F.lit(1).cast("bigint").alias("n"))
    return counted.unionByName(issues)


def counters(row: DataFrame, section: str) -> DataFrame:
    """The columns of a one-row table as ``section, key, n``."""
    pairs = F.array(*(F.struct(F.lit(section).alias("section"), F.lit(c).alias("key"), F.col(c).cast("bigint").alias("n")) for c in row.columns))
    return row.select(F.explode(pairs).alias("r")).select("r.*")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n") for name, t in tables.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
