"""Set operations and reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_streams(*streams: DataFrame) -> DataFrame:
    """Record streams of all sources in one shape; fields a source lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), streams)


def reconcile_runs(rows: DataFrame, run: str, expected: str) -> DataFrame:
    """Rows seen per run against the first advertised total; drift warns, a mismatch fails.

    ``rows`` has the page's advertised total on every row; the first page's total is expected.
    """
    per_run = rows.groupBy(run).agg(
        F.count(F.lit(1)).alias("seen"), F.min_by(expected, "page").alias("expected"),
        (F.min(expected) != F.max(expected)).alias("drift"))
    status = F.when(F.col("seen") != F.col("expected"), "failed").when(F.col("drift"), "partial").otherwise("success")
    return per_run.withColumn("status", status)


def differences(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Rows found on one side only, with their side. Compares multisets by counted rows.

    One shuffle for both directions, and equal rows collapse map-side.
    """
    columns = list(keys) or a.columns
    sides = a.select(*columns, F.lit(1).alias("_n")).unionByName(b.select(*columns, F.lit(-1).alias("_n")))
    return sides.groupBy(*columns).agg(F.sum("_n").alias("_n")).filter("_n <> 0").withColumn(
        "side", F.when(F.col("_n") > 0, "left").otherwise("right")).withColumn("copies", F.abs("_n")).drop("_n")


def same_rows(a: DataFrame, b: DataFrame, *keys: str) -> bool:
    return not differences(a, b, *keys).head(1)


def affected_union(*batches: DataFrame) -> DataFrame:
    """Distinct ids over all batches."""
    return union_streams(*batches).distinct()
