"""Validation, dead letters and integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticegrid.functions.record import problems


def with_reason(records: DataFrame) -> DataFrame:
    """``reason`` lists the violated rules; null for a valid record."""
    found = problems(set(records.columns))
    return records.withColumn("reason", F.when(F.size(found) > 0, F.array_join(found, "; ")))


def split_valid(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    marked = with_reason(records)
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL")


def dead_letters(rejected: DataFrame, run_id: str, raw: Column | None = None) -> DataFrame:
    """Rejected rows with reason and raw evidence."""
    raw = F.to_json(F.struct(*(c for c in rejected.columns if c != "reason"))) if raw is None else raw
    return rejected.select(F.lit(run_id).alias("run_id"), "reason", raw.alias("raw_json"))


def require_rows(df: DataFrame) -> DataFrame:
    """An empty collection is a failure, never a success."""
    if not df.head(1):
        raise ValueError("Unexpected empty collection; source must be checked")
    return df


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def checksum_matches(content: Column, sha256: Column) -> Column:
    return F.sha2(content, 256) == sha256


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose foreign key has no parent."""
    return child.filter(F.col(key).isNotNull()).join(
        parent.select(F.col(parent_key).alias(key)), key, "left_anti")


def cross_check(report: DataFrame, recount: DataFrame, key: str, measure: str) -> DataFrame:
    """Differences between reported numbers and a recount from detail rows."""
    a = report.select(F.col(key), F.col(measure).alias("reported"))
    b = recount.select(F.col(key), F.col(measure).alias("recounted"))
    return a.join(b, key, "full_outer").select(
        key, F.coalesce("reported", F.lit(0)).alias("reported"), F.coalesce("recounted", F.lit(0)).alias("recounted"),
        F.coalesce("reported", F.lit(0)).eqNullSafe(F.coalesce("recounted", F.lit(0))).alias("equal"))
