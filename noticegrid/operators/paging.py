"""Sorted pages: offset, keyset with a frozen watermark, and fixed report orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noticegrid.functions.codes import status_rank
from noticegrid.operators.registry import (
    coverage_of, with_coverage, with_expiry, with_review, with_source, with_status,
)

OFFSET_LIMIT = 1_000_000
PAGE_LIMIT = 1_000


def offset_page(view: DataFrame, offset: int = 0, limit: int = 100) -> DataFrame:
    """One page by id. Spark keeps offset + limit rows per task, so both have an upper bound."""
    if not 0 <= offset <= OFFSET_LIMIT or not 1 <= limit <= PAGE_LIMIT:
        raise ValueError("offset or limit out of range")
    return view.orderBy("id").offset(offset).limit(limit)


def page_info(view: DataFrame, offset: int, limit: int) -> DataFrame:
    """One row: ``total`` rows of the filtered view, and the ``next_offset`` if more follow the page."""
    return view.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.when(F.col("total") > offset + limit, F.lit(offset + limit)).cast("bigint").alias("next_offset"))


def registry_page(opportunities, sources, reviews, bridge, documents, as_of, narrow, offset=0, limit=100) -> DataFrame:
    """Page of the registry view with coverage computed for the page's notices only.

    ``narrow`` filters on notice, source and review columns; it runs before the page is cut, and
    the large bridge is then reduced to at most ``limit`` notices before it is aggregated.
    """
    view = with_review(with_source(with_status(with_expiry(opportunities), as_of), sources), reviews)
    page = offset_page(narrow(view), offset, limit)
    return with_coverage(page, coverage_of(page, bridge, documents))


def change_page(changes: DataFrame, after_id: int = 0, through_id: int | None = None, limit: int = 200) -> DataFrame:
    """Keyset page of the change log, each row with the page's watermark, cursor and look-ahead flag.

    Without ``through_id`` the watermark is the current maximum, read once, so later pages that pass
    it on do not see newer rows.
    """
    if through_id is None:
        through_id = changes.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first().m
    rows = changes.filter((F.col("id") > after_id) & (F.col("id") <= through_id)).orderBy("id").limit(limit + 1)
    # limit + 1 rows at most, so one window over them is bounded.
    page = Window.partitionBy(F.lit(0))
    rows = rows.withColumn("_rank", F.row_number().over(page.orderBy("id")))
    return rows.select(
        *changes.columns, "_rank", F.lit(through_id).cast("bigint").alias("through_id"),
        (F.count(F.lit(1)).over(page) > limit).alias("has_more"),
        F.max(F.when(F.col("_rank") <= limit, F.col("id"))).over(page).alias("next_after_id"),
    ).filter(F.col("_rank") <= limit).drop("_rank")


def latest(df: DataFrame, stamp: str, key: str, limit: int = 50) -> DataFrame:
    return df.orderBy(F.col(stamp).desc(), F.col(key)).limit(limit)


def fetch_candidates(documents: DataFrame, priority: DataFrame, due, limit: int = 500) -> DataFrame:
    """Next documents to fetch by (class, depth, id)."""
    return (
        documents.filter(due).join(priority, documents.id == priority.document_id)
        .orderBy("priority", "depth", "id").limit(limit).drop("document_id")
    )


def report_order(view: DataFrame) -> DataFrame:
    """Status rank, then deadline with missing ones last, then title and id."""
    return view.orderBy(
        status_rank(F.col("effective_status")), F.col("deadline_on").asc_nulls_last(), F.col("title"), F.col("id")
    )


def notice_documents(detail: DataFrame, notice, include_history: bool = False) -> DataFrame:
    """Documents of one notice by depth and address."""
    rows = detail.filter(F.col("opportunity_id") == notice)
    if not include_history:
        rows = rows.filter("active")
    return rows.orderBy("depth", "url")
