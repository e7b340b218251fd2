"""Configuration sources and imports: source registry, rule groups, expert records, FAQ pages."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticegrid.functions import record as rec
from noticegrid.functions.codes import first_value
from noticegrid.operators.priorities import validate_groups
from noticegrid.operators.quality import repeated_keys, split_valid

DESCRIPTIVE = ("name", "url", "adapter", "category", "coverage", "owner", "enabled")


def sync_sources(current: DataFrame, entries: DataFrame, descriptive: tuple[str, ...] = DESCRIPTIVE) -> DataFrame:
    """Configured columns replace the stored ones; run state stays; unlisted sources stay as they are."""
    if repeated_keys(entries, "id").head(1):
        raise ValueError("Source IDs must be unique")
    state = [c for c in current.columns if c not in ("id", *descriptive)]
    old = current.select("id", *(F.col(c).alias(f"_old_{c}") for c in descriptive if c in current.columns), *state)
    new = entries.select("id", *descriptive, F.lit(True).alias("_listed"))
    merged = old.join(new, "id", "full_outer")
    columns = [F.when(F.col("_listed"), F.col(c)).otherwise(F.col(f"_old_{c}") if c in current.columns else F.lit(None)).alias(c)
               for c in descriptive]
    health = [F.coalesce(F.col(c), F.lit("not_run")).alias(c) if c == "health" else F.col(c) for c in state]
    return merged.select("id", *columns, *health)


def load_groups(spark: SparkSession, path: str) -> list[dict]:
    """Rule groups from a JSON file: a configuration of a few entries, validated as a whole."""
    text = spark.read.text(path, wholetext=True).first().value
    return validate_groups(json.loads(text))


def import_records(lines: DataFrame) -> DataFrame:
    """Expert records: every line must be valid, or nothing is imported."""
    shaped = rec.record(lines, keep=("_corrupt",) if "_corrupt" in lines.columns else (), **_given(lines))
    if "_corrupt" in shaped.columns:
        broken = shaped.filter(F.col("_corrupt").isNotNull())
        if broken.head(1):
            raise ValueError("Import file has malformed lines")
        shaped = shaped.drop("_corrupt")
    valid, rejected = split_valid(shaped)
    first = rejected.select("reason", "external_id").head(1)
    if first:
        raise ValueError(f"Import rejected: {first[0].reason} ({first[0].external_id})")
    return valid


def _given(lines: DataFrame) -> dict[str, Column]:
    out = {}
    for name, (kind, default) in rec.FIELDS.items():
        if name in lines.columns:
            fallback = F.array().cast(kind) if default == [] else F.lit(default).cast(kind)
            out[name] = F.coalesce(F.col(name).cast(kind), fallback)
    return out


def faq_entries(pages: DataFrame) -> DataFrame:
    """Unique FAQ entries of the landed pages with normalised keywords; the earliest page wins."""
    rows = pages.select("page_no", "checked_at", F.posexplode("results").alias("position", "r"))
    meta = F.col("r.metadata")
    keywords = F.transform(
        F.coalesce(F.try_element_at(meta, F.lit("keyword")), F.array().cast("array<string>")),
        lambda k: F.upper(F.trim(k)))
    slim = rows.select(
        F.col("r.reference").alias("reference"),
        F.coalesce(F.nullif(first_value(meta, "url"), F.lit("")), F.col("r.url")).alias("url"),
        first_value(meta, "question").alias("question"), keywords.alias("keywords"), "checked_at", "page_no", "position",
        meta.alias("metadata"))
    rest = [c for c in slim.columns if c != "reference"]
    return slim.groupBy("reference").agg(
        F.min_by(F.struct(*rest), F.struct("page_no", "position")).alias("_e")).select("reference", "_e.*")


def manifest_check(entries: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: unique ``entries``, what the snapshot's manifest (``unique_entries``) has, and whether they agree.

    Only a complete snapshot may retire associations (``faq.may_retire``); a missing manifest is none.
    """
    expected = manifest.agg(F.max("unique_entries")).scalar()
    return entries.agg(F.count(F.lit(1)).alias("entries")).withColumn("expected", expected).withColumn(
        "complete", F.coalesce(F.col("entries") == F.col("expected"), F.lit(False)))
