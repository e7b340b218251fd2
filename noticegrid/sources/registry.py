"""Pluggable adapters: name -> function from landed rows to a batch of records and rejects."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticegrid.functions import fixed
from noticegrid.functions.record import FIELDS, payload
from noticegrid.functions.text import digest
from noticegrid.sources import config as settings
from noticegrid.sources import listing, pages, search


def no_totals(measured: dict) -> tuple[int | None, list[str], str | None]:
    """Of a source that advertises nothing, nothing can differ."""
    return None, [], None


@dataclass
class Batch:
    """What one source gives, as one lazy table.

    ``rows`` have the record's columns, their ``raw`` form, the ``reason`` where they are rejected,
    and ``listed``, which is false for rows that only stand for an empty page. ``order`` is the place
    in the batch. ``unique``: a second row of an identifier is rejected. ``measures`` are aggregates
    that are observed while the rows are written; ``judge`` turns them into the advertised number of
    rows, warnings, and what is wrong with the batch as a whole.
    """

    rows: DataFrame
    order: list[Column] = field(default_factory=list)
    unique: bool = False
    measures: dict[str, Column] = field(default_factory=dict)
    judge: Callable[[dict], tuple[int | None, list[str], str | None]] = no_totals

    @property
    def records(self) -> DataFrame:
        return self.rows.filter("listed AND reason IS NULL")

    @property
    def rejected(self) -> DataFrame:
        return self.rows.filter("listed AND reason IS NOT NULL")


def shaped(rows: DataFrame) -> DataFrame:
    """Rows of any adapter with the columns of a batch; missing ones are null, listed is true."""
    listed = F.coalesce("listed", F.lit(True)) if "listed" in rows.columns else F.lit(True)
    rows = rows if "reason" in rows.columns else rows.withColumn("reason", F.lit(None).cast("string"))
    return rows.withColumns({"listed": listed, "raw": F.coalesce("raw", F.lit("{}"))})


def rejects(rows: DataFrame, *evidence: str) -> DataFrame:
    """Rejected rows of ``reason`` and evidence columns in the shape of a batch, without a record."""
    raw = F.to_json(F.struct(*evidence))
    nothing = [F.lit(None).cast(kind).alias(name) for name, (kind, _) in FIELDS.items()]
    return rows.select(raw.alias("raw"), "reason", F.lit(True).alias("listed"), *nothing)


ADAPTERS: dict[str, Callable[..., Batch]] = {}


def adapter(name: str):
    def add(fn):
        if name in ADAPTERS:
            raise ValueError(f"Adapter {name} is already registered")
        ADAPTERS[name] = fn
        return fn

    return add


def read_source(name: str, landed: DataFrame, config: dict) -> Batch:
    if name not in ADAPTERS:
        raise ValueError(f"Unknown adapter {name}")
    return ADAPTERS[name](landed, config)


def paged_totals(measured: dict) -> tuple[int | None, list[str], str | None]:
    expected, listed = measured["expected"], measured["listed"]
    warnings = [fixed.TOTAL_CHANGED] if measured["least"] != measured["most"] else []
    problem = fixed.EMPTY_PAGE if measured["gaps"] else None
    if listed != expected:
        problem = f"Pages list {listed} rows, {expected} are advertised"
    return expected, warnings, problem


@adapter("paged_listing")
def _paged(landed, config):
    rows = listing.paged_records(listing.checked_rows(landed), config["as_of"])
    measures = {
        "expected": F.min_by("expected", "page"), "least": F.min("expected"), "most": F.max("expected"),
        "listed": F.count_if("listed"), "gaps": F.count_if(~F.col("listed") & (F.col("page") < F.col("last_page"))),
    }
    return Batch(shaped(rows), [F.col("page"), F.col("position")], True, measures, paged_totals)


@adapter("embedded_listing")
def _embedded(landed, config):
    rows = listing.embedded_records(listing.checked_embedded(listing.embedded_rows(landed)))
    return Batch(shaped(rows), [F.col("position"), F.col("external_id")], False, {"expected": F.count_if("listed")}, lambda m: (m["expected"], [], None))


@adapter("search_api")
def _search(landed, config):
    evidence = ("reference", "url", "content", "summary", "metadata")
    accepted, rejected = search.split_identities(landed)
    preferred = search.preferred_variants(accepted)
    preferred = preferred.withColumn("raw", F.to_json(F.struct(F.array(F.struct(*evidence)).alias("documents"))))
    rows = search.search_records(preferred).unionByName(rejects(rejected, *evidence), allowMissingColumns=True)
    return Batch(shaped(rows), [F.col("external_id"), F.col("raw")])


@adapter("post_metadata")
def _posts(landed, config):
    rows = pages.post_records(landed.withColumn("raw", F.to_json(F.struct(*landed.columns))), config)
    return Batch(shaped(rows), [F.col("id"), digest(F.col("raw"))], True)


@adapter("post_calls")
def _calls(landed, config):
    rows = pages.post_calls(landed.withColumn("raw", F.to_json(F.struct(*landed.columns))), config["taxonomy"], config)
    return Batch(shaped(rows), [F.col("id"), digest(F.col("raw"))], True)


@adapter("catalogue")
def _catalogue(landed, config):
    cards = pages.catalogue_cards(landed, config)
    evidence = [c for c in cards.columns if c != "page_id"]
    distinct = pages.distinct_cards(cards).withColumn("raw", F.to_json(F.struct(*evidence)))
    rows = pages.catalogue_records(distinct, config, config.get("details"))
    rows = rows.withColumn("reason", F.when(F.col("conflict"), fixed.REPEATED_CARD))
    unusable = rejects(pages.card_rejects(landed, config), "listing_url", "position", "href", "title")
    return Batch(shaped(rows.unionByName(unusable, allowMissingColumns=True)), [F.col("external_id"), digest(F.col("raw"))])


@adapter("configured_pages")
def _configured(landed, config):
    rows = pages.configured_pages(landed.withColumn("raw", F.to_json(F.struct("url", F.sha2("html", 256).alias("html_sha256")))), config["entries"], config)
    unusable = rejects(pages.configured_page_rejects(landed, config["entries"], config), "page_id", "url")
    return Batch(shaped(rows.unionByName(unusable, allowMissingColumns=True)), [F.col("external_id"), digest(F.col("raw"))])


@adapter("expert_import")
def _import(landed, config):
    """All lines or none: one that is malformed or invalid stops the import with a ``ValueError``."""
    return Batch(shaped(settings.import_records(landed).withColumn("raw", payload())), [F.col("external_id")])
