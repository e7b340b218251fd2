"""The normalised record: shape, derived fields and validation rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticegrid.functions import dates, fixed, text, urls

DEADLINE = "struct<due_on:date,due_at:timestamp_ntz,original:string,timezone:string>"
TAG = "struct<kind:string,value:string,basis:string>"

# Column, type and default of every record field; adapters give only what they know.
FIELDS = {
    "external_id": ("string", None), "canonical_url": ("string", None), "title": ("string", None),
    "description": ("string", ""), "funder": ("string", ""), "programme": ("string", ""),
    "record_kind": ("string", "call"), "instrument": ("string", "grant"), "language": ("string", "fi"),
    "source_status": ("string", "unknown"), "opens_on": ("date", None), "deadline_on": ("date", None),
    "deadline_at": ("timestamp_ntz", None), "deadline_expires_at": ("timestamp_ntz", None),
    "deadline_model": ("string", "unknown"), "total_budget": ("decimal(20,2)", None),
    "grant_max": ("decimal(20,2)", None), "funding_rate": ("decimal(5,2)", None), "currency": ("string", None),
    "eligibility_text": ("string", ""), "geographic_scope": ("string", "unknown"),
    "detail_level": ("string", "listing"), "quality_flags": ("array<string>", []),
    "deadlines": (f"array<{DEADLINE}>", []), "tags": (f"array<{TAG}>", []),
}


def record(df: DataFrame, keep: tuple[str, ...] = (), **columns: Column) -> DataFrame:
    """Give ``df`` the record shape; ``keep`` names provenance columns that stay."""
    unknown = set(columns) - set(FIELDS)
    if unknown:
        raise ValueError(f"Unknown record fields: {sorted(unknown)}")
    out = []
    for name, (kind, default) in FIELDS.items():
        fallback = F.array() if default == [] else F.lit(default)
        out.append(columns.get(name, fallback).cast(kind).alias(name))
    return df.select(*keep, *out)


def rule_tags(title: Column, description: Column) -> Column:
    themes = text.rule_themes(F.concat_ws(" ", title, description))
    return F.transform(themes, lambda t: F.struct(
        F.lit("theme").alias("kind"), t.alias("value"), F.lit("rule").alias("basis")))


def last_tag_wins(tags: Column) -> Column:
    """One tag per (kind, value) at its first position, with the last basis given."""

    def same(a, b):
        return (a["kind"] == b["kind"]) & (a["value"] == b["value"])

    keys = F.array_distinct(F.transform(tags, lambda t: F.struct(t["kind"].alias("kind"), t["value"].alias("value"))))
    return F.transform(keys, lambda k: F.element_at(F.filter(tags, lambda t: same(t, k)), -1))


def enrich(records: DataFrame) -> DataFrame:
    """Rule tags, effective deadline with expiry, and derived quality flags."""
    # Staged as columns: what is used several times, or inside a lambda, is evaluated once.
    rows = records.withColumns({"_last": dates.last_stage(F.col("deadlines")), "_rules": rule_tags(F.col("title"), F.col("description"))})
    rows = rows.withColumn("_tags", F.concat("tags", "_rules"))
    given = F.col("_last").isNotNull()
    zone_issue = given & F.col("_last.due_at").isNull() & ~dates.known_zone(F.col("_last.timezone"))
    flags = F.when(zone_issue, F.array_append("quality_flags", F.lit("deadline_timezone_needs_review"))).otherwise(
        F.col("quality_flags"))
    rows = rows.withColumns({
        "tags": last_tag_wins(F.col("_tags")),
        "deadline_on": F.when(given, F.col("_last.due_on")).otherwise(F.col("deadline_on")),
        "deadline_at": F.when(given, F.col("_last.due_at")).otherwise(F.col("deadline_at")),
        "deadline_expires_at": F.when(
            given, dates.expires_at(F.col("_last.due_on"), F.col("_last.due_at"), F.col("_last.timezone"))
        ).otherwise(F.col("deadline_expires_at")),
        "quality_flags": flags,
    }).drop("_last", "_rules", "_tags")
    return rows.withColumn("quality_flags", text.quality_flags(
        F.col("quality_flags"), F.col("eligibility_text"), F.col("deadline_on"), F.col("deadline_model")))


PAYLOAD = tuple(FIELDS)


def payload(columns: tuple[str, ...] = PAYLOAD) -> Column:
    """Canonical JSON of the record; its hash decides whether the publisher changed anything."""
    return text.canonical_json({c: F.col(c) for c in columns})


def identified(records: DataFrame) -> DataFrame:
    """Canonical address and the stable id that follows from it."""
    return records.withColumn("canonical_url", urls.canonical_url(F.col("canonical_url"))).withColumn(
        "id", urls.canonical_id(F.col("canonical_url")))


def problems(present: set[str]) -> Column:
    """Array of violated rules over the record columns that are present; empty means valid."""
    rules = []

    def rule(name, condition, message):
        if name in present:
            rules.append(F.when(condition, F.lit(message)))

    for name in ("external_id", "canonical_url", "title"):
        rule(name, F.col(name).isNull() | (F.length(name) == 0), f"{name}: required")
    for name, limit in fixed.LIMITS.items():
        rule(name, F.length(name) > limit, f"{name}: longer than {limit}")
    rule("canonical_url", F.col("canonical_url").isNotNull() & ~urls.is_public(F.col("canonical_url")),
         "canonical_url: a public HTTP(S) source URL is required")
    enums = {
        "record_kind": fixed.RECORD_KINDS, "instrument": fixed.INSTRUMENTS, "source_status": fixed.SOURCE_STATUSES,
        "geographic_scope": fixed.SCOPES, "detail_level": fixed.DETAIL_LEVELS,
    }
    for name, allowed in enums.items():
        rule(name, ~F.coalesce(F.col(name).isin(*allowed), F.lit(False)), f"{name}: not an allowed value")
    for name in ("total_budget", "grant_max", "funding_rate"):
        rule(name, F.col(name) < 0, f"{name}: negative")
    rule("funding_rate", F.col("funding_rate") > 100, "funding_rate: above 100")
    if "deadlines" in present:
        rules.append(F.when(dates.impossible(F.col("deadlines")), F.lit("deadlines: a date outside the calendar")))
    if "tags" in present:
        def bad(t):
            return ~t["kind"].isin(*fixed.TAG_KINDS) | ~t["basis"].isin(*fixed.TAG_BASES) | (F.length(t["value"]) > 200)
        rules.append(F.when(F.exists("tags", bad), F.lit("tags: not an allowed label")))
    return F.array_compact(F.array(*rules))
