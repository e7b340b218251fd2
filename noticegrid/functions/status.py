"""Status, review and content-state expressions of the registry view."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def instant(as_of: str) -> Column:
    """The evaluation instant as a naive UTC literal."""
    return F.lit(as_of).cast("timestamp_ntz")


def effective_status(as_of: str) -> Column:
    """Published status overridden by dates; an exact expiry counts from its own instant."""
    at, today = instant(as_of), F.lit(as_of[:10]).cast("date")
    return (
        F.when(F.col("source_status") == "cancelled", F.lit("cancelled"))
        .when(F.col("deadline_expires_at") <= at, F.lit("closed"))
        .when(F.col("deadline_at") < at, F.lit("closed"))
        .when(F.col("deadline_on") < today, F.lit("closed"))
        .when(F.col("source_status") == "closed", F.lit("closed"))
        .when(F.col("opens_on") > today, F.lit("forthcoming"))
        .otherwise(F.col("source_status"))
    )


def needs_review(review_id: str, eligibility: str, reviewed: str, version: str = "version") -> Column:
    return F.when(
        F.col(review_id).isNull() | (F.col(eligibility) == "unreviewed") | (F.col(reviewed) != F.col(version)), 1
    ).otherwise(0)


def content_state() -> Column:
    """Problems outrank pending work; nothing here claims completeness."""
    return (
        F.when(F.col("document_count").isNull(), "not_started")
        .when((F.col("failed_count") > 0) | (F.col("text_issue_count") > 0) | (F.col("limited_count") > 0), "partial")
        .when(F.col("pending_count") > 0, "in_progress")
        .otherwise("collected_unverified")
    )


def conflict_flags(flags: Column) -> Column:
    """Add the conflict flag where dates close a notice that its source still calls open."""
    clash = (F.col("effective_status") == "closed") & F.col("source_status").isin("open", "forthcoming", "rolling")
    return F.when(clash, F.array_append(flags, F.lit("source_status_conflicts_with_deadline"))).otherwise(flags)


def current_or_unknown(as_of: str) -> Column:
    """Notices that may still be current: not closed or cancelled, and no date has passed."""
    at, today = instant(as_of), F.lit(as_of[:10]).cast("date")
    return (
        ~F.col("source_status").isin("closed", "cancelled")
        & (F.col("deadline_expires_at").isNull() | (F.col("deadline_expires_at") > at))
        & (F.col("deadline_at").isNull() | (F.col("deadline_at") >= at))
        & (F.col("deadline_on").isNull() | (F.col("deadline_on") >= today))
    )


def collection_level(adapter: Column) -> Column:
    return (
        F.when(adapter == "page_watch", "page_changes").when(adapter == "manual", "manual").otherwise("structured")
    )


def next_daily_check(stamp: Column) -> Column:
    """The next UTC midnight after ``stamp``."""
    return F.date_add(stamp.cast("date"), 1).cast("timestamp_ntz")
