"""Optional, conjunctive filters over the registry view."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticegrid.functions import fixed
from noticegrid.functions.codes import is_cascade
from noticegrid.functions.text import contains_folded, fold
from noticegrid.operators.priorities import group_predicate

EQUALITY = {
    "status": "effective_status", "source": "source_id", "programme": "programme", "scope": "geographic_scope",
    "eligibility": "eligibility", "instrument": "instrument", "record_kind": "record_kind",
    "content_state": "content_state",
}


def title_text(q: str) -> Column:
    return contains_folded(F.concat_ws(" ", "title", "description"), q)


def funder_is(name: str) -> Column:
    return fold(F.col("funder")) == name.casefold()


def utc_naive(value: str) -> str:
    """A timestamp with an offset as naive UTC; a missing offset is an error."""
    stamp = datetime.fromisoformat(value.replace("Z", "+00:00"))
    if stamp.tzinfo is None:
        raise ValueError("changed_since must include timezone")
    return stamp.astimezone(timezone.utc).replace(tzinfo=None).isoformat(sep=" ")


def with_tag(view: DataFrame, tags: DataFrame, kind: str, value: str) -> DataFrame:
    hits = tags.filter((F.col("kind") == kind) & (F.col("value") == value)).select(F.col("opportunity_id").alias("id"))
    return view.join(hits, "id", "left_semi")


def with_content(view: DataFrame, bridge: DataFrame, contents: DataFrame, blobs: DataFrame, q: str) -> DataFrame:
    """Notices with an active document whose current text contains the literal.

    Texts are scanned once, by content; hits travel through documents and bridge as semi joins, so
    a document shared by many notices is searched once.
    """
    texts = blobs.filter(contains_folded(F.col("text"), q)).select("sha256")
    documents = contents.join(texts, contents.current_sha256 == texts.sha256, "left_semi").select("id")
    notices = (
        bridge.filter("active").select("opportunity_id", "document_id")
        .join(documents, F.col("document_id") == documents.id, "left_semi")
        .select(F.col("opportunity_id").alias("id"))
    )
    return view.join(notices, "id", "left_semi")


def filter_notices(
    view: DataFrame, *, q=None, funder=None, theme=None, region=None, needs_review=None, deadline_before=None,
    deadline_after=None, changed_since=None, cascade=None, priority=None, content_q=None, tags=None, bridge=None,
    contents=None, blobs=None, search_source=fixed.SEARCH_SOURCE, **equal,
) -> DataFrame:
    """Apply the given filters; omitted ones do not restrict."""
    unknown = set(equal) - set(EQUALITY)
    if unknown:
        raise ValueError(f"Unsupported filters: {sorted(unknown)}")
    conditions = [F.col(EQUALITY[k]) == v for k, v in equal.items() if v]
    if cascade is not None:
        flag = is_cascade(F.col("source_id"), F.col("external_id"), search_source)
        conditions.append(flag if cascade else ~flag)
    if priority is not None:
        conditions.append(group_predicate(priority))
    if q:
        conditions.append(title_text(q))
    if funder:
        conditions.append(funder_is(funder))
    if needs_review is not None:
        conditions.append(F.col("needs_review") == int(needs_review))
    if deadline_before:
        conditions.append(F.col("deadline_on") <= F.lit(deadline_before).cast("date"))
    if deadline_after:
        conditions.append(F.col("deadline_on") >= F.lit(deadline_after).cast("date"))
    if changed_since:
        conditions.append(F.col("updated_at") >= F.lit(utc_naive(changed_since)).cast("timestamp_ntz"))
    for condition in conditions:
        view = view.filter(condition)
    for kind, value in (("theme", theme), ("region", region)):
        if value:
            view = with_tag(view, tags, kind, value)
    if content_q:
        view = with_content(view, bridge, contents, blobs, content_q)
    return view


def bi_candidates() -> Column:
    """Schemes and possibly current calls that no review has ruled out."""
    status = F.col("effective_status").isin(*fixed.CURRENT_STATUSES, "unknown")
    return ((F.col("record_kind") == "funding_scheme") | status) & (F.col("eligibility") != "ineligible")


def in_scope() -> Column:
    return F.col("active") & F.col("limitation").isNull()


def listed(url: Column, title: Column, *, include_url=None, include_title=None, exclude_title=None) -> Column:
    """Catalogue rules: the address as written, titles without regard to case."""
    keep = F.lit(True)
    if include_url:
        keep = keep & url.rlike(include_url)
    if exclude_title:
        keep = keep & ~title.rlike(f"(?iu){exclude_title}")
    if include_title:
        keep = keep & title.rlike(f"(?iu){include_title}")
    return keep


def due_for_check(as_of: str, states: tuple[str, ...] | None = None) -> Column:
    due = F.col("next_check_at").isNull() | (F.col("next_check_at") <= F.lit(as_of).cast("timestamp_ntz"))
    return due & F.col("state").isin(*states) if states else due


def deadline_within(as_of: str, days: int = 30) -> Column:
    today = F.lit(as_of[:10]).cast("date")
    return F.col("deadline_on").between(today, F.date_add(today, days))
