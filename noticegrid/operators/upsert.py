"""Versioned upsert of notices, child replacement, the change log and run accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticegrid.session import dense_ids


def resolve_ids(incoming: DataFrame, items: DataFrame) -> DataFrame:
    """Notice id per incoming record: a known source item keeps its notice even if its address changed.

    With a ``raw_hash``, ``raw_changed`` tells whether a known item's raw form differs.
    """
    keyed = incoming.withColumn("item_id", F.sha2(F.concat_ws(":", "source_id", "external_id"), 256))
    known = items.select(F.col("id").alias("item_id"), F.col("opportunity_id").alias("_known"), F.col("raw_hash").alias("_old_raw"))
    rows = keyed.join(known, "item_id", "left").withColumn("id", F.coalesce("_known", "id")).drop("_known")
    if "raw_hash" in rows.columns:
        rows = rows.withColumn("raw_changed", F.coalesce(F.col("_old_raw") != F.col("raw_hash"), F.lit(False)))
    return rows


def source_items(items: DataFrame, resolved: DataFrame, as_of: str) -> DataFrame:
    """Source items after a batch: raw hash and last sighting of every item seen, whoever owns its notice.

    ``resolved``: rows of ``resolve_ids`` with ``raw_hash``. A new item points to its record's notice.
    """
    stamp = F.lit(as_of).cast("timestamp_ntz")
    last = resolved.groupBy("item_id").agg(*(F.max_by(c, F.struct("raw_hash", "id")).alias(f"_{c}") for c in ("source_id", "external_id", "id", "raw_hash")))
    seen = F.col("_raw_hash").isNotNull()
    joined = items.withColumnRenamed("id", "item_id").join(last, "item_id", "full_outer")
    return joined.select(
        F.col("item_id").alias("id"), F.coalesce("source_id", "_source_id").alias("source_id"),
        F.coalesce("external_id", "_external_id").alias("external_id"), F.coalesce("opportunity_id", "_id").alias("opportunity_id"),
        F.when(seen, F.col("_raw_hash")).otherwise(F.col("raw_hash")).alias("raw_hash"),
        F.when(seen, stamp).otherwise(F.col("last_seen_at")).alias("last_seen_at"))


def owned(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """One record per notice: its owner's, else that of the first source by name, which a new notice gets.

    Of several records of one source that with the least hash, so partitions never decide.
    """
    owner = current.select("id", F.col("source_id").alias("_owner"))
    rest = [c for c in incoming.columns if c != "id"]
    foreign = ~F.coalesce(F.col("source_id") == F.col("_owner"), F.lit(False))
    ranked = incoming.join(owner, "id", "left").withColumn("_rank", F.struct(foreign, "source_id", "content_hash"))
    return ranked.groupBy("id").agg(F.min_by(F.struct(*rest), "_rank").alias("_r")).select("id", "_r.*")


def last_per_notice(incoming: DataFrame, order: str) -> DataFrame:
    """The last record per notice and source within a batch."""
    rest = [c for c in incoming.columns if c not in ("id", "source_id")]
    return incoming.groupBy("id", "source_id").agg(F.max_by(F.struct(*rest), order).alias("_r")).select(
        "id", "source_id", "_r.*")


def upsert(current: DataFrame, incoming: DataFrame, as_of: str, order: str | None = None) -> DataFrame:
    """New snapshot, with ``outcome`` created, updated, seen or kept.

    ``incoming``: rows of notices and sources with ``content_hash`` and ``raw_changed``, plus any
    of the snapshot's columns. Of several rows of one notice and source the last by ``order`` counts
    (``collection`` takes them one after the other instead). Only the owning source changes a notice; another source with the same
    address leaves it as it is. One full outer join; the caller writes it to a new path and swaps.
    """
    incoming = owned(current, incoming if order is None else last_per_notice(incoming, order))
    stamp = F.lit(as_of).cast("timestamp_ntz")
    fields = [c for c in current.columns if c in incoming.columns and c != "id"]
    state = [c for c in current.columns if c not in fields and c != "id"]
    new = incoming.select("id", F.col("raw_changed").alias("_raw"), F.lit(True).alias("_in"), *(F.col(c).alias(f"_n_{c}") for c in fields))
    joined = current.withColumn("_old", F.lit(True)).join(new, "id", "full_outer")
    created = F.col("_old").isNull()
    owner = F.col("_in").isNotNull() & (created | (F.col("source_id") == F.col("_n_source_id")))
    differs = ~F.col("content_hash").eqNullSafe(F.col("_n_content_hash")) | F.coalesce("_raw", F.lit(False))
    changed = owner & (created | differs)
    outcome = F.when(created, "created").when(changed, "updated").when(owner, "seen").otherwise("kept")
    joined = joined.withColumn("_changed", changed).withColumn("outcome", outcome)
    columns = [F.when(F.col("_changed"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in fields]
    derived = {
        "version": F.when(F.col("_changed"), F.coalesce("version", F.lit(0)) + 1).otherwise(F.col("version")),
        "updated_at": F.when(F.col("_changed"), stamp).otherwise(F.col("updated_at")),
    }
    if "first_seen_at" in state:
        derived["first_seen_at"] = F.coalesce("first_seen_at", stamp)
    if "last_seen_at" in state:
        derived["last_seen_at"] = F.when(F.col("outcome") != "kept", stamp).otherwise(F.col("last_seen_at"))
    rest = [derived.get(c, F.col(c)).alias(c) for c in state]
    return joined.select("id", *columns, *rest, "outcome")


def replace_children(old: DataFrame, new: DataFrame, changed: DataFrame, key: str = "opportunity_id") -> DataFrame:
    """Children of changed notices are replaced as a whole; all others stay."""
    ids = changed.select(F.col("id").alias(key))
    return old.join(ids, key, "left_anti").unionByName(new.join(ids, key, "left_semi"))


def change_rows(snapshot: DataFrame, last_id: int, as_of: str, payload) -> DataFrame:
    """Log rows for created and updated notices, with consecutive ids after ``last_id``."""
    rows = snapshot.filter(F.col("outcome").isin("created", "updated")).select(
        F.col("id").alias("opportunity_id"), "source_id", F.col("outcome").alias("kind"),
        F.lit(as_of).cast("timestamp_ntz").alias("created_at"), payload.alias("payload_json"))
    return dense_ids(rows, F.col("opportunity_id"), last_id)


def run_rows(seen: DataFrame, rejected: DataFrame, expected: DataFrame, sources: DataFrame, as_of: str) -> DataFrame:
    """One accounting row per collected source.

    ``seen``: (source_id, outcome) of every record; ``rejected``: (source_id); ``expected``:
    (source_id, expected). A run is failed with nothing seen, partial with rejects or a count
    mismatch, else success; only success moves ``last_success_at``.
    """
    a = seen.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("seen"), F.count(F.when(F.col("outcome").isin("created", "updated"), 1)).alias("changed"))
    b = rejected.groupBy("source_id").agg(F.count(F.lit(1)).alias("rejected"))
    runs = sources.filter("enabled").select(F.col("id").alias("source_id"), F.col("last_success_at").alias("_previous"))
    runs = runs.join(a, "source_id", "left").join(b, "source_id", "left").join(expected, "source_id", "left")
    runs = runs.fillna(0, ["seen", "changed", "rejected"])
    status = F.when(F.col("seen") == 0, "failed").when(
        (F.col("rejected") > 0) | (F.col("expected") != F.col("seen") + F.col("rejected")), "partial").otherwise("success")
    message = F.when(F.col("seen") == 0, "Unexpected empty collection; source must be checked").when(
        F.col("rejected") > 0, F.concat(F.col("rejected"), F.lit(" records rejected")))
    runs = runs.withColumn("status", status).withColumn("message", message)
    return runs.withColumn(
        "last_success_at", F.when(F.col("status") == "success", F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("_previous"))
    ).drop("_previous")
