"""FAQ association by keyword, and its retirement after a complete refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticegrid.functions import fixed
from noticegrid.functions.text import canonical_json
from noticegrid.operators.reconcile import same_rows
from noticegrid.session import dense_ids

ROLE = "faq_keyword_match"


def keyword_matches(entries: DataFrame, topics: DataFrame) -> DataFrame:
    """(notice, document) pairs whose keyword equals the topic id, ignoring case and outer blanks.

    ``entries``: (document_id, keywords); ``topics``: (id, external_id). Keywords are distinct per
    entry before the join, so a repeated keyword adds no rows to the shuffle. No topic id is blank, so
    blank keywords, which would all meet in one task, stay out of it.
    """
    words = entries.select("document_id", F.explode(F.array_distinct(
        F.transform("keywords", lambda k: F.upper(F.trim(k))))).alias("_key")).filter("_key <> ''")
    named = topics.select(F.col("id").alias("opportunity_id"), F.upper("external_id").alias("_key"))
    return words.join(named, "_key").select("opportunity_id", "document_id").distinct()


def stale_matches(bridge: DataFrame, current: DataFrame) -> DataFrame:
    """Earlier keyword matches that the current snapshot no longer has."""
    previous = bridge.filter((F.col("role") == ROLE) & F.col("is_root")).select("opportunity_id", "document_id")
    return previous.join(current.select("opportunity_id", "document_id"), ["opportunity_id", "document_id"], "left_anti")


def may_retire(manifest_topics: DataFrame, topics: DataFrame, warnings: int) -> bool:
    """Only a warning-free refresh over exactly the registry's topics may retire associations."""
    a = manifest_topics.select(F.upper("topic_id").alias("k")).distinct()
    b = topics.select(F.upper("external_id").alias("k")).distinct()
    return warnings == 0 and same_rows(a, b)


def allowed_stale(stale: DataFrame, manifest_topics: DataFrame, topics: DataFrame, warnings: int) -> DataFrame:
    """``stale`` behind its gate: an incomplete refresh retires nothing."""
    return stale if may_retire(manifest_topics, topics, warnings) else stale.limit(0)


def retired(bridge: DataFrame, notices: DataFrame, stale: DataFrame, manifest_topics: DataFrame, topics: DataFrame, warnings: int, last_id: int, as_of: str):
    """``retire`` behind its gate: an incomplete refresh leaves bridge and notices alone and writes no log."""
    return retire(bridge, notices, allowed_stale(stale, manifest_topics, topics, warnings), last_id, as_of)


def switched_off(bridge: DataFrame, stale: DataFrame) -> DataFrame:
    """The bridge with the stale associations switched off; history stays. Nothing is logged or staged."""
    marked = bridge.join(stale.withColumn("_stale", F.lit(True)), ["opportunity_id", "document_id"], "left")
    off = F.coalesce("_stale", F.lit(False))
    return marked.withColumn("is_root", F.col("is_root") & ~off).withColumn("active", F.col("active") & ~off).drop("_stale")


def retire(bridge: DataFrame, notices: DataFrame, stale: DataFrame, last_id: int, as_of: str):
    """(bridge, version bumps, change rows) with the stale associations switched off; history stays."""
    keys = ["opportunity_id", "document_id"]
    bumps = stale.groupBy("opportunity_id").agg(F.count(F.lit(1)).alias("bumps"))
    log = stale.join(notices.select(F.col("id").alias("opportunity_id"), "source_id"), "opportunity_id").select(
        *keys, "source_id", F.lit("document_unlinked").alias("kind"), F.lit(as_of).cast("timestamp_ntz").alias("created_at"),
        F.lit(fixed.FAQ_ACTOR).alias("actor"),
        canonical_json({"document_id": F.col("document_id"), "reason": F.lit(fixed.FAQ_UNLINKED)}).alias("payload_json"))
    return switched_off(bridge, stale), bumps, dense_ids(log, F.concat_ws("/", *keys), last_id)
