"""Ordered-group operators.

Where the answer is a best row or a bound, an aggregate with map-side combine replaces the window,
so that a group of any size never meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noticegrid.session import previous_in_group

LIMIT_MARK = "document_limit"


def best_variant(rows: DataFrame, key: str, rank: Column, deadline: Column) -> DataFrame:
    """Highest-ranked row per key, number of variants, and whether their deadlines disagree."""
    rest = [c for c in rows.columns if c != key]
    return rows.withColumn("_d", deadline).groupBy(key).agg(
        F.max_by(F.struct(*rest), rank).alias("_r"), F.count(F.lit(1)).alias("variants"),
        (F.min("_d") != F.max("_d")).alias("conflict"),
    ).select(key, "_r.*", "variants", "conflict")


def numbered_stages(rows: DataFrame, deadlines: str, *keep: str) -> DataFrame:
    """One row per deadline, numbered from 1 in published order."""
    return rows.select(*keep, F.posexplode(deadlines).alias("_pos", "d")).select(
        *keep, (F.col("_pos") + 1).alias("stage"), "d.*")


def final_stage(stages: DataFrame, key: str, due_on: str = "due_on", due_at: str = "due_at") -> DataFrame:
    """Last stage by (day, time); a missing time sorts before any time of the day."""
    rank = F.struct(due_on, F.coalesce(F.col(due_at), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")))
    return stages.groupBy(key).agg(F.max_by(F.struct(due_on, due_at), rank).alias("_d")).select(key, "_d.*")


def page_changes(observations: DataFrame, order: tuple[str, ...] = ("observed_at", "event_id"), partitions: int | None = None) -> DataFrame:
    """Each observation against the previous one of its source: discovered, changed or same."""
    rows = previous_in_group(observations, "source_id", list(order), "text_hash", "previous_hash", partitions=partitions)
    kind = F.when(F.col("previous_hash").isNull(), "source_discovered").when(
        F.col("previous_hash") != F.col("text_hash"), "source_changed").otherwise("same")
    return rows.withColumn("kind", kind)


def capped_documents(rows: DataFrame, cap: int = 250) -> DataFrame:
    """First ``cap`` documents per notice in reach order, plus one marker row for the rest.

    The rank filter is applied before the shuffle as well (window group limit), so a notice with
    very many candidates sends at most ``cap`` + 1 rows per task.
    """
    order = Window.partitionBy("opportunity_id").orderBy("depth", "document_id")
    ranked = rows.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= cap + 1)
    return ranked.withColumn(
        "limitation", F.when(F.col("position") == cap + 1, LIMIT_MARK).otherwise(F.col("limitation")))


def version_intervals(observations: DataFrame, *keys: str, at: str) -> DataFrame:
    """First and last sighting of each version; gaps are not split."""
    return observations.groupBy(*keys).agg(F.min(at).alias("first_seen_at"), F.max(at).alias("last_seen_at"))


def split_repeats(rows: DataFrame, key: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(first, repeated) rows per identifier; AQE splits the join for an identifier repeated very often."""
    firsts = rows.groupBy(key).agg(F.min(order).alias("_first"))
    marked = rows.join(firsts, key)
    return (marked.filter(F.col(order) == F.col("_first")).drop("_first"),
            marked.filter(F.col(order) != F.col("_first")).drop("_first"))


def last_tag(tags: DataFrame, position: str) -> DataFrame:
    """One tag per (notice, kind, value); the last basis wins."""
    return tags.groupBy("opportunity_id", "kind", "value").agg(F.max_by("basis", position).alias("basis"))


def repeated_cards(cards: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """First card per address; ``conflict`` where a repeat has different content."""
    return cards.groupBy(key).agg(
        F.min(order).alias("first"), F.count(F.lit(1)).alias("listings"), (F.min(content) != F.max(content)).alias("conflict"))
