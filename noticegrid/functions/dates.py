"""Deadline parsing and expiry. Published calendar days are kept; no time is invented."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noticegrid.functions import fixed
from noticegrid.functions.text import let
from noticegrid.functions.fixed import EN_DATE, FI_DATE, FI_RANGE, ISO_DATE, KNOWN_ZONE, MONTHS


def parse_time(value: Column) -> Column:
    """Date-only text gives null; a longer text must carry an offset, and is returned in naive UTC."""
    offset = r"[+-]\d{2}:\d{2}(?::\d{2})?$"

    def shifted(text, tail):
        minutes = F.substring(tail, 2, 2).try_cast("int") * 60 + F.substring(tail, 5, 2).try_cast("int")
        sign = F.when(tail.startswith("-"), -1).otherwise(1)
        local = F.regexp_replace(text, offset, "").try_cast("timestamp_ntz")
        return F.when(text.rlike(r"[T ].*" + offset), (local - F.make_dt_interval(mins=minutes * sign)).cast("timestamp_ntz"))

    # Each text is rewritten and searched once, whatever is read from it.
    plain = F.regexp_replace(F.regexp_replace(value, r"([+-]\d{2})(\d{2})$", "$1:$2"), "Z$", "+00:00")
    utc = let(plain, lambda text: let(F.regexp_extract(text, offset, 0), lambda tail: shifted(text, tail)))
    return F.when(F.length(value) > 10, utc)


def has_time_without_offset(value: Column) -> Column:
    """True for a time whose zone is unknown; such a row is rejected rather than guessed."""
    return (F.length(value) > 10) & parse_time(value).isNull()


def unusable(value: Column) -> Column:
    """Reason to reject a published date or time; null where there is none or it can be read."""
    day = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}"), F.left(value, F.lit(10)).try_cast("date"))
    return F.when(F.length(value) > 0, F.when(day.isNull(), fixed.NO_SUCH_DAY).when(has_time_without_offset(value), fixed.NO_OFFSET))


def due(value: Column, timezone: str = "UTC") -> Column:
    """Published day, exact time where one was published, the original text and its zone."""
    return F.struct(
        F.left(value, F.lit(10)).try_cast("date").alias("due_on"),
        parse_time(value).alias("due_at"),
        value.alias("original"),
        F.lit(timezone).alias("timezone"),
    )


def to_utc(local: Column, zone: Column) -> Column:
    """Naive local time to naive UTC."""
    return F.convert_timezone(zone, F.lit("UTC"), local)


def local_day(instant: Column, zone: str = "Europe/Helsinki") -> Column:
    """The publisher's calendar day of a naive UTC instant."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), instant).cast("date")


def published_day(value: Column, zone: str = "Europe/Helsinki", at: Column | None = None) -> Column:
    """Local day of an exact time, else the published day itself. ``at`` is the time if it is parsed already."""
    return F.coalesce(local_day(parse_time(value) if at is None else at, zone), F.left(value, F.lit(10)).try_cast("date"))


def known_zone(zone: Column) -> Column:
    return zone.rlike(KNOWN_ZONE)


def expires_at(due_on: Column, due_at: Column, zone: Column) -> Column:
    """Exact time, else the next local midnight in the publisher's zone, as naive UTC."""
    safe = F.when(known_zone(zone), zone).otherwise(F.lit("UTC"))
    return F.coalesce(due_at, to_utc(F.date_add(due_on, 1).cast("timestamp_ntz"), safe))


def last_stage(deadlines: Column) -> Column:
    """The latest deadline by (day, time); a missing time sorts before any time."""
    ranked = F.array_max(
        F.transform(
            deadlines,
            lambda d: F.struct(
                d["due_on"].alias("due_on"),
                F.coalesce(d["due_at"], F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")).alias("rank"),
                d["due_at"].alias("due_at"),
                d["timezone"].alias("timezone"),
            ),
        )
    )
    return ranked


def _day(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")).try_cast("date")


def _at(day: Column, hour: Column, minute: Column, zone: Column) -> Column:
    """Exact time only where hour and minute were published."""
    local = F.concat(day.cast("string"), F.lit(" "), F.lpad(hour, 2, "0"), F.lit(":"), minute).try_cast("timestamp_ntz")
    return F.when(F.length(hour) > 0, to_utc(local, zone))


def _matches(label: Column, pattern: str) -> Column:
    return F.regexp_extract_all(label, F.lit(pattern), F.lit(0))


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group)


def impossible(found: Column) -> Column:
    """Whether a list of ``dates_in_label`` holds a date that no calendar has, such as 31.2.; such a record is rejected."""
    return F.coalesce(F.exists(found, lambda d: d["due_on"].isNull()), F.lit(False))


def dates_in_label(label: Column, timezone: str) -> Column:
    """Dates of an identified date field, never of arbitrary text.

    Formats are tried in order: Finnish ``d.m.yyyy``, ISO, English month names. A literal CET or
    CEST is taken as its fixed offset even where it disagrees with daylight saving.
    """
    literal_zone = (
        F.when(label.rlike(r"\bCEST\b"), "Etc/GMT-2").when(label.rlike(r"\bCET\b"), "Etc/GMT-1").otherwise(timezone)
    )

    def entry(day, at, original, zone):
        return F.struct(day.alias("due_on"), at.alias("due_at"), original.alias("original"), zone.alias("timezone"))

    def finnish(m):
        day = _day(_part(m, FI_DATE, 3), _part(m, FI_DATE, 2), _part(m, FI_DATE, 1))
        return entry(day, _at(day, _part(m, FI_DATE, 4), _part(m, FI_DATE, 5), F.lit(timezone)), m, F.lit(timezone))

    def iso(m):
        day = _day(_part(m, ISO_DATE, 1), _part(m, ISO_DATE, 2), _part(m, ISO_DATE, 3))
        at = _at(day, _part(m, ISO_DATE, 4), _part(m, ISO_DATE, 5), literal_zone)
        return entry(day, at, F.trim(label), literal_zone)

    def english(m):
        month = F.array_position(F.lit(list(MONTHS)), F.lower(_part(m, EN_DATE, 2))).cast("string")
        day = _day(_part(m, EN_DATE, 3), month, _part(m, EN_DATE, 1))
        at = _at(day, _part(m, EN_DATE, 4), _part(m, EN_DATE, 5), literal_zone)
        return entry(day, at, F.trim(label), literal_zone)

    # A short range such as 18.2.-11.3.2026 takes its year from the end, unless that reverses it.
    start = _day(_part(label, FI_RANGE, 5), _part(label, FI_RANGE, 2), _part(label, FI_RANGE, 1))
    end = _day(_part(label, FI_RANGE, 5), _part(label, FI_RANGE, 4), _part(label, FI_RANGE, 3))
    opening = entry(start, F.lit(None).cast("timestamp_ntz"), _part(label, FI_RANGE, 0), F.lit(timezone))
    with_start = let(F.transform(_matches(label, FI_DATE), finnish), lambda fi: F.when(
        (F.size(fi) == 1) & (start <= end), F.array_prepend(fi, opening)).otherwise(fi))
    # Label without a digit has no date; this keeps the patterns off most texts.
    return F.when(label.rlike(r"\d"), let(with_start, lambda fi: F.when(F.size(fi) > 0, fi).otherwise(
        let(F.transform(_matches(label, ISO_DATE), iso), lambda found: F.when(F.size(found) > 0, found).otherwise(
            F.transform(_matches(label, EN_DATE), english)))))).otherwise(F.array())
