"""Batch application of review attempts with optimistic concurrency."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noticegrid.functions import fixed
from noticegrid.functions.text import canonical_json
from noticegrid.session import dense_ids, materialise


def static_kind() -> Column:
    """What an attempt is before its turn: invalid, conflict, or a candidate for acceptance."""
    evidence = (F.col("eligibility") == "unreviewed") | (F.length("evidence_url") > 0)
    known = F.col("eligibility").isin(*fixed.ELIGIBILITIES)
    return F.when(~(evidence & known), "invalid").when(
        F.col("_notice_version").isNull() | (F.col("_notice_version") != F.col("source_version")), "conflict"
    ).otherwise("candidate")


def apply_reviews(attempts: DataFrame, notices: DataFrame, reviews: DataFrame, partitions: int | None = None) -> DataFrame:
    """Outcome of every attempt, and the review version after it.

    A candidate is accepted when its expected version is the notice's review version at its turn,
    which then rises by one. Turns depend on each other, but only through that one number: a run of
    attempts maps an entry version to an exit version. Attempts are range-partitioned by (notice,
    arrival), so that one notice may spread over many tasks; each task reports that map for its
    runs, joins over its rows give every run its entry version, and a second pass settles the
    attempts. No notice is gathered anywhere.
    """
    spark = attempts.sparkSession
    parts = partitions or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["opportunity_id", "arrived_at", "event_id"]
    current = notices.select(F.col("id").alias("opportunity_id"), F.col("version").alias("_notice_version"))
    start = reviews.select("opportunity_id", F.col("version").alias("_start"))
    rows = attempts.join(current, "opportunity_id", "left").join(start, "opportunity_id", "left").select(
        *order, "expected_version", static_kind().alias("kind"), F.coalesce("_start", F.lit(0)).alias("start"))
    ranged = materialise(
        rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("run", F.spark_partition_id()))
    entries = _entry_versions(ranged)
    settled = ranged.join(entries, ["opportunity_id", "run"]).repartition("opportunity_id", "run").sortWithinPartitions(
        "opportunity_id", "run", "arrived_at", "event_id")
    key = dict(ranged.dtypes)
    return settled.mapInPandas(
        _settle, f"opportunity_id {key['opportunity_id']}, event_id {key['event_id']}, outcome string, review_version int")


def _accepted(outcomes: DataFrame, attempts: DataFrame) -> DataFrame:
    done = outcomes.filter("outcome = 'accepted'").select("opportunity_id", "event_id", "review_version")
    return done.join(attempts.select("opportunity_id", "event_id", "eligibility", "source_version"), ["opportunity_id", "event_id"])


def review_rows(outcomes: DataFrame, attempts: DataFrame, reviews: DataFrame) -> DataFrame:
    """Review table after the attempts: of each notice the last accepted one, else what was there."""
    last = _accepted(outcomes, attempts).groupBy("opportunity_id").agg(
        F.max("review_version").alias("_version"), F.max_by("eligibility", "review_version").alias("_eligibility"),
        F.max_by("source_version", "review_version").alias("_source"))
    fresh = {"eligibility": "_eligibility", "reviewed_source_version": "_source", "version": "_version"}
    joined = reviews.join(last, "opportunity_id", "full_outer")
    return joined.select(*(F.coalesce(fresh[c], c).alias(c) if c in fresh else F.col(c) for c in reviews.columns))


def review_log(outcomes: DataFrame, attempts: DataFrame, notices: DataFrame, last_id: int, as_of: str) -> DataFrame:
    """Change-log rows of kind ``reviewed``, one for every accepted attempt."""
    rows = _accepted(outcomes, attempts).join(notices.select(F.col("id").alias("opportunity_id"), "source_id"), "opportunity_id")
    payload = canonical_json({c: F.col(c) for c in ("eligibility", "review_version", "source_version")})
    rows = rows.select(
        "opportunity_id", "source_id", F.lit("reviewed").alias("kind"), F.lit(as_of).cast("timestamp_ntz").alias("created_at"),
        payload.alias("payload_json"), "review_version")
    return dense_ids(rows, F.concat_ws("/", "opportunity_id", "review_version"), last_id)


def _entry_versions(ranged: DataFrame) -> DataFrame:
    """Entry version of every (notice, run).

    Within a run the exit version is the entry version plus the length of the chain of expected
    versions it meets in order. Only runs of notices that span several need the map of entries to
    exits; its rows are joined as they are (``_visited``), never gathered.
    """
    runs = ranged.groupBy("opportunity_id", "run").agg(F.min("start").alias("start"))
    span = runs.groupBy("opportunity_id").agg(F.count(F.lit(1)).alias("_spans"))
    single = runs.join(span, "opportunity_id").filter("_spans = 1").select("opportunity_id", "run", F.col("start").alias("entry"))
    split = span.filter("_spans > 1").select("opportunity_id")
    candidates = ranged.join(split, "opportunity_id", "left_semi").filter("kind = 'candidate'").repartition(
        "opportunity_id", "run").sortWithinPartitions("opportunity_id", "run", "arrived_at", "event_id")
    key = dict(ranged.dtypes)["opportunity_id"]
    maps = materialise(candidates.mapInPandas(_exit_map, f"opportunity_id {key}, run int, entry int, exit int"))
    ordered = materialise(runs.join(split, "opportunity_id", "left_semi"))
    exits = _visited(maps, ordered.groupBy("opportunity_id").agg(F.min("start").alias("start")))
    # One row per run: at most one per partition for a notice.
    before = Window.partitionBy("opportunity_id").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    entry = F.coalesce(F.last("exit", ignorenulls=True).over(before), F.col("start"))
    return single.unionByName(ordered.join(exits, ["opportunity_id", "run"], "left").select("opportunity_id", "run", entry.alias("entry")))


def _visited(maps: DataFrame, starts: DataFrame) -> DataFrame:
    """``opportunity_id, run, exit`` of the runs that change a notice's version on its way from ``start``.

    A row of a map is a place: the run where a notice arrives with that entry. From it the way leads
    to the next run that has the exit as an entry; all others leave it as it is. The places on the
    way from the start are found by pointer doubling, so n runs take about log2(n) joins.
    """
    place = ["opportunity_id", "run", "entry"]
    none = F.lit(None).cast("int")
    here = maps.select("opportunity_id", F.col("entry").alias("version"), "run", F.col("run").alias("_at"), none.alias("entry"), F.lit(0).alias("_asks"))
    leaving = maps.select("opportunity_id", F.col("exit").alias("version"), "run", none.alias("_at"), "entry", F.lit(1).alias("_asks"))
    starting = starts.select("opportunity_id", F.col("start").alias("version"), F.lit(-1).alias("run"), none.alias("_at"), none.alias("entry"), F.lit(1).alias("_asks"))
    # Per notice and version at most two rows a run.
    later = Window.partitionBy("opportunity_id", "version").orderBy("run", "_asks").rowsBetween(1, Window.unboundedFollowing)
    found = here.unionByName(leaving).unionByName(starting).withColumn("next_run", F.first("_at", ignorenulls=True).over(later))
    asked = materialise(found.filter("_asks = 1 AND next_run IS NOT NULL").select("opportunity_id", "run", "entry", "next_run", F.col("version").alias("next_entry")))
    reached = asked.filter("run = -1").select("opportunity_id", F.col("next_run").alias("run"), F.col("next_entry").alias("entry"))
    jumps = asked.filter("run >= 0")
    while jumps.head(1):
        onward = reached.join(jumps, place).select("opportunity_id", F.col("next_run").alias("run"), F.col("next_entry").alias("entry"))
        reached = materialise(reached.unionByName(onward))
        second = jumps.select("opportunity_id", F.col("run").alias("next_run"), F.col("entry").alias("next_entry"), F.col("next_run").alias("_run"), F.col("next_entry").alias("_entry"))
        jumps = materialise(jumps.join(second, ["opportunity_id", "next_run", "next_entry"]).select(
            *place, F.col("_run").alias("next_run"), F.col("_entry").alias("next_entry")))
    return reached.join(maps, place).select("opportunity_id", "run", "exit")


def _runs(batches, columns):
    """Rows of consecutive (notice, run) groups across Arrow batches, one row at a time."""
    for pdf in batches:
        yield from pdf[columns].itertuples(index=False, name=None)


def _exit_map(batches):
    """(entry, exit) versions of each run, for the entries that change anything.

    ``follows[v]`` lists the entries that stand at version v; an attempt expecting v moves them on.
    """
    key, follows = None, {}

    def emit():
        rows = [(*key, entry, version) for version, entries in follows.items() for entry in entries if entry != version]
        return pd.DataFrame(rows, columns=["opportunity_id", "run", "entry", "exit"])

    for notice, run, expected in _runs(batches, ["opportunity_id", "run", "expected_version"]):
        if key != (notice, run):
            if key:
                yield emit()
            key, follows, met = (notice, run), {}, set()
        moved = follows.pop(expected, [])
        if expected not in met:
            met.add(expected)
            moved.append(expected)
        follows.setdefault(expected + 1, []).extend(moved)
        met.add(expected)
    if key:
        yield emit()


def _settle(batches):
    key, version = None, 0
    for pdf in batches:
        out = []
        for notice, run, event, kind, expected, entry in pdf[
            ["opportunity_id", "run", "event_id", "kind", "expected_version", "entry"]
        ].itertuples(index=False, name=None):
            if key != (notice, run):
                key, version = (notice, run), entry
            accepted = kind == "candidate" and expected == version
            version += accepted
            outcome = "accepted" if accepted else "invalid" if kind == "invalid" else "conflict"
            out.append((notice, event, outcome, version))
        yield pd.DataFrame(out, columns=["opportunity_id", "event_id", "outcome", "review_version"])
