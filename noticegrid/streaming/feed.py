"""Incremental change feed and run alerts as Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def change_stream(spark: SparkSession, path: str, schema, after_id: int = 0, through_id: int | None = None) -> DataFrame:
    """Stream over the append-only change log; the id bounds are pushed to the file scan."""
    rows = spark.readStream.schema(schema).parquet(path).filter(F.col("id") > after_id)
    return rows if through_id is None else rows.filter(F.col("id") <= through_id)


def consume(stream: DataFrame, output: str, checkpoint: str) -> None:
    """Process what is there and stop; a later call with the same checkpoint resumes after it."""
    query = (
        stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start(output))
    query.awaitTermination()


def problem_runs(runs: DataFrame, as_of: str | None = None, hours: int = 2) -> DataFrame:
    """Failed and partial runs; with ``as_of``, only those of the last ``hours``."""
    rows = runs.filter(F.col("status").isin("failed", "partial"))
    if as_of is None:
        return rows
    at = F.lit(as_of).cast("timestamp_ntz")
    return rows.filter(F.col("finished_at") > at - F.expr(f"INTERVAL '{int(hours)}' HOUR"))


def hourly_sources(runs: DataFrame) -> DataFrame:
    """Distinct successful sources per hour: the reduced input of every look-back window."""
    return runs.filter("status = 'success'").select(
        F.date_trunc("hour", "finished_at").cast("timestamp_ntz").alias("hour"), "source_id").distinct()


def silence_windows(runs: DataFrame, hours: int = 36) -> DataFrame:
    """Distinct successful sources of each look-back window, evaluated hourly (batch form).

    Rows are reduced to distinct (hour, source) before they are copied into the windows, so the
    copying grows with hours and sources, not with runs.
    """
    shifted = hourly_sources(runs).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(hours))))
    at = (F.col("hour") + F.make_dt_interval(hours=F.col("step"))).cast("timestamp_ntz")
    pairs = shifted.select(at.alias("evaluated_at"), "source_id").distinct()
    return pairs.groupBy("evaluated_at").agg(F.count(F.lit(1)).alias("successful_sources"))


def silence_stream(runs: DataFrame, hours: int = 36, late: str = "1 hour") -> DataFrame:
    """Streaming form, exact: one row per look-back window and source, then sources per window.

    ``runs``: (finished_at timestamp, source_id, status). A window comes out once the watermark,
    ``late`` behind the latest run, has passed its end; later windows wait for it.
    """
    by_source = (
        runs.filter("status = 'success'").withWatermark("finished_at", late)
        .groupBy(F.window("finished_at", f"{hours} hours", "1 hour"), "source_id").agg(F.count(F.lit(1)).alias("runs")))
    return by_source.groupBy("window").agg(F.count(F.lit(1)).alias("successful_sources")).select(
        F.col("window.end").alias("evaluated_at"), "successful_sources")
