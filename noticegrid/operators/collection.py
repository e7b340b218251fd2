"""One collection run of a source: landed responses become the next version of the registry.

The responses are read once. While that batch is staged, the same pass observes what the run has to
account for: rows, rejects, advertised totals. Everything after works on the staged table. Snapshot,
children, log, rejects, run row and source health are committed together (see ``sinks.store``), so a
run that is lost leaves the version before it, and one that is repeated under its id changes nothing.
"""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from noticegrid.functions import fixed
from noticegrid.functions.record import DEADLINE, FIELDS, TAG, enrich, identified, payload, problems
from noticegrid.functions.text import digest
from noticegrid.session import dense_ids, materialise, previous_in_group, short_lived_shuffles
from noticegrid.sinks.store import Store
from noticegrid.sources.registry import Batch, read_source

CHILDREN = ("tags", "deadlines")
PLAIN = {name: kind for name, (kind, _) in FIELDS.items() if name not in CHILDREN}
TABLES = {
    "opportunities": "id string, source_id string, " + ", ".join(f"{n} {k}" for n, k in PLAIN.items())
    + ", content_hash string, version int, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, updated_at timestamp_ntz",
    "source_items": "id string, source_id string, external_id string, opportunity_id string, raw_hash string, raw_json string, last_seen_at timestamp_ntz",
    "tags": "opportunity_id string, kind string, value string, basis string",
    "deadlines": "opportunity_id string, stage int, due_on date, due_at timestamp_ntz, original string, timezone string",
    "changes": "opportunity_id string, source_id string, kind string, created_at timestamp_ntz, payload_json string, raw_json string, id bigint",
    "rejections": "run_id string, reason string, raw_json string",
    "runs": "run_id string, source_id string, started_at timestamp_ntz, status string, message string, expected bigint, seen bigint, changed bigint, rejected bigint",
    "health": "source_id string, health string, last_error string, last_attempt_at timestamp_ntz, last_success_at timestamp_ntz",
}


def create(spark: SparkSession, root: str) -> Store:
    """A store with all registry tables, empty."""
    store = Store(spark, root)
    store.commit(store.manifest(), {name: store.write(name, spark.createDataFrame([], schema)) for name, schema in TABLES.items()})
    return store


def staged_batch(batch: Batch, source_id: str) -> tuple[DataFrame, dict]:
    """(staged rows, observed measures): the one pass over the landed responses.

    Each row has its record with derived fields, hashes and identity, its place in the batch and, if
    it is rejected, the ``reason``. Validation adds to the reasons of the adapter.
    """
    staged, repeated, measured = _staged(batch, source_id)
    return marked(staged, repeated), measured


def _staged(batch: Batch, source_id: str) -> tuple[DataFrame, DataFrame | None, dict]:
    """(staged rows, ``n`` of those that repeat an identifier, measures); ``n`` numbers the staged rows."""
    # Equal rows have places of their own as well; the table is staged, so they keep them.
    rows = identified(enrich(batch.rows)).withColumn("seq", F.struct(*batch.order, F.monotonically_increasing_id().alias("_n")))
    found = problems(set(FIELDS))
    rows = rows.withColumn("reason", F.coalesce("reason", F.nullif(F.array_join(found, "; "), F.lit(""))))
    item = digest(F.concat(F.lit(source_id + ":"), F.col("external_id")))
    # The log writes the payload again from the fields; only its hash is staged.
    rows = rows.withColumns({"raw_hash": digest(F.col("raw")), "item_id": item, "content_hash": digest(payload())})
    observed = Observation()
    rows = rows.observe(
        observed, F.count_if(F.col("listed") & F.col("reason").isNull()).alias("seen"),
        F.count_if(F.col("listed") & F.col("reason").isNotNull()).alias("rejected"), *(c.alias(n) for n, c in batch.measures.items()),
    )
    kept = ["listed", "reason", "raw", "seq", "id", "item_id", "content_hash", "raw_hash", *FIELDS]
    staged = materialise(rows.select(*kept), "zstd").filter("listed").drop("listed").withColumn("n", F.col("seq._n"))
    measured = dict(observed.get)
    return (staged, *repeats(staged, measured)) if batch.unique else (staged, None, measured)


def repeats(staged: DataFrame, measured: dict) -> tuple[DataFrame | None, dict]:
    """Every row of an identifier but the first is rejected, whether or not the first one is usable."""
    narrow = staged.select("seq", "n", "external_id", F.col("reason").isNull().alias("usable")).filter("external_id IS NOT NULL")
    firsts = narrow.groupBy("external_id").agg(F.min("seq").alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    observed = Observation()
    later = narrow.join(firsts, "external_id").filter(F.col("seq") > F.col("first")).observe(
        observed, F.count_if("usable").alias("repeated"), F.count(F.lit(1)).alias("rows"))
    repeated = materialise(later.select("n"), "zstd")
    n = observed.get["repeated"] or 0
    return repeated if observed.get["rows"] else None, {**measured, "seen": measured["seen"] - n, "rejected": measured["rejected"] + n}


def marked(staged: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """Staged rows with the reason that repeats are rejected for."""
    if repeated is None:
        return staged
    again = repeated.withColumn("_again", F.lit(fixed.REPEATED_IDENTIFIER))
    return staged.join(again, "n", "left").withColumn("reason", F.coalesce("_again", "reason")).drop("_again")


def transitions(rows: DataFrame, current: DataFrame, items: DataFrame, source_id: str, unique: bool = False) -> DataFrame:
    """``id, item, n, seq, own, kind`` of every usable record of ``rows``; no kind without a change.

    A known item keeps its notice, whatever its address is now; a new one has the notice of its first
    record. Each record is compared with the state that the one before it left: another content, or
    another raw form of its item, is a change. Only the owner of a notice changes it. ``unique``: of an
    item the first row counts alone. Only records that share a notice need their order, so ``seq`` is
    null for the others; notices with very many records are split by ranges (``previous_in_group``).
    ``item`` is the item's id as bytes.
    """
    hashes = {"_content_new": F.unhex("content_hash"), "_raw_new": F.unhex("raw_hash")}
    narrow = rows.select("id", F.unhex("item_id").alias("item"), "n", "seq", "reason", *(c.alias(n) for n, c in hashes.items()))
    if unique:
        rest = F.struct(*(c for c in narrow.columns if c not in ("item", "seq")))
        narrow = narrow.groupBy("item").agg(F.min_by(rest, "seq").alias("_r")).select("item", "_r.*").filter("reason IS NULL")
        notice = F.col("id")
    else:
        narrow = narrow.filter("reason IS NULL")
        narrow, notice = narrow.join(narrow.groupBy("item").agg(F.min_by("id", "seq").alias("_first")), "item"), F.col("_first")
    known = items.select(F.unhex("id").alias("item"), F.col("opportunity_id").alias("_known"), F.unhex("raw_hash").alias("_raw"))
    narrow = narrow.join(known, "item", "left").select(
        F.coalesce("_known", notice).alias("id"), "item", "n", "_content_new", F.coalesce(F.col("_raw") != F.col("_raw_new"), F.lit(False)).alias("_raw_differs"))
    held = current.select("id", F.col("source_id").alias("_owner"), F.unhex("content_hash").alias("_content"))
    compared = materialise(narrow.join(held, "id", "left").select(
        "id", "item", "n", F.coalesce(F.col("_owner") == source_id, F.lit(True)).alias("own"), F.col("_owner").isNull().alias("_new"),
        F.coalesce(F.col("_content") != F.col("_content_new"), F.lit(True)).alias("_differs"), "_raw_differs"), "zstd")

    def kind(new, changed):
        return F.when(F.col("own") & changed, F.when(new, "created").otherwise("updated")).alias("kind")

    shared = materialise(compared.groupBy("id").agg(F.count(F.lit(1)).alias("_rows")).filter("_rows > 1").select("id"))
    none = F.lit(None).cast(rows.schema["seq"].dataType).alias("seq")
    alone = compared.select("id", "item", "n", none, "own", kind(F.col("_new"), F.col("_new") | F.col("_differs") | F.col("_raw_differs")))
    if shared.isEmpty():
        return alone
    together = compared.join(shared, "id", "left_semi").join(rows.select("n", "seq", *(c.alias(n) for n, c in hashes.items())), "n")
    by_notice = previous_in_group(together, "id", ["seq"], "_content_new", "_before")
    new = F.col("_new") & F.col("_before").isNull()
    differs = new | F.coalesce(F.col("_before") != F.col("_content_new"), F.col("_differs"))
    # Each pass stages its rows, so the second one takes only what the first has not settled.
    settled = by_notice.select("id", "item", "n", "seq", "own", new.alias("_new"), differs.alias("_changed"), "_raw_differs", "_raw_new")
    by_item = previous_in_group(settled, "item", ["seq"], "_raw_new", "_before")
    changed = F.col("_changed") | F.coalesce(F.col("_before") != F.col("_raw_new"), F.col("_raw_differs"))
    ordered = by_item.select("id", "item", "n", "seq", "own", kind(F.col("_new"), changed))
    return materialise(alone.join(shared, "id", "left_anti").unionByName(ordered), "zstd")


def last_of(steps: DataFrame, key: str, *more) -> DataFrame:
    """``key, n`` of the last record of each, and further aggregates."""
    return steps.groupBy(key).agg(F.max(F.struct("seq", "n"))["n"].alias("n"), *more)


def next_snapshot(current: DataFrame, rows: DataFrame, steps: DataFrame, source_id: str, as_of: str) -> DataFrame:
    """All notices after the batch: the last record's fields, one version more for every change."""
    stamp = F.lit(as_of).cast("timestamp_ntz")
    last = rows.select("n", *(F.col(c).alias(f"_n_{c}") for c in PLAIN), F.unhex("content_hash").alias("_n_content_hash"))
    winners = last_of(steps, "id", F.count("kind").alias("_changes"), F.max("own").alias("_own")).join(last, "n").drop("n")
    # Fields of notices that stay as they are need not be shuffled.
    moved = winners.select("id", "_changes", "_own", *(F.when(F.col("_changes") > 0, F.col(c)).alias(c) for c in last.columns if c != "n"))
    joined = current.join(moved, "id", "full_outer")
    changed = F.coalesce(F.col("_changes") > 0, F.lit(False))
    seen = F.coalesce("_own", F.lit(False))
    return joined.select(
        "id", F.coalesce("source_id", F.lit(source_id)).alias("source_id"),
        *(F.when(changed, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in PLAIN),
        F.when(changed, F.lower(F.hex("_n_content_hash"))).otherwise(F.col("content_hash")).alias("content_hash"),
        (F.coalesce("version", F.lit(0)) + F.coalesce("_changes", F.lit(0))).cast("int").alias("version"),
        F.coalesce("first_seen_at", stamp).alias("first_seen_at"),
        F.when(seen, stamp).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.when(changed, stamp).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def next_items(items: DataFrame, rows: DataFrame, steps: DataFrame, source_id: str, as_of: str) -> DataFrame:
    """Source items after the batch: every item seen has its last raw form, whoever owns its notice."""
    last = last_of(steps, "item", F.min("id").alias("_notice")).withColumnRenamed("n", "_last")
    forms = rows.select(
        F.unhex("item_id").alias("item"), "n", F.col("external_id").alias("_external"), F.unhex("raw_hash").alias("_hash"), F.col("raw").alias("_json"))
    # By the item, as the items are joined by it; of its rows the last one stays.
    fresh = forms.join(last, "item").filter(F.col("n") == F.col("_last")).drop("n", "_last")
    held = items.select(F.unhex("id").alias("item"), *(c for c in items.columns if c not in ("id", "raw_hash")), F.unhex("raw_hash").alias("raw_hash"))
    joined = held.join(fresh, "item", "full_outer")
    return joined.select(
        F.lower(F.hex("item")).alias("id"), F.coalesce("source_id", F.lit(source_id)).alias("source_id"), F.coalesce("external_id", "_external").alias("external_id"),
        F.coalesce("opportunity_id", "_notice").alias("opportunity_id"), F.lower(F.hex(F.coalesce("_hash", "raw_hash"))).alias("raw_hash"),
        F.coalesce("_json", "raw_json").alias("raw_json"),
        F.when(F.col("_hash").isNotNull(), F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
    )


def children(last: DataFrame) -> dict[str, DataFrame]:
    """Tag and deadline rows of ``opportunity_id, tags, deadlines``; stages count from one."""
    tags = last.select("opportunity_id", F.explode("tags").alias("t")).select("opportunity_id", "t.*")
    stages = last.select("opportunity_id", F.posexplode("deadlines").alias("stage", "d")).select("opportunity_id", (F.col("stage") + 1).alias("stage"), "d.*")
    return {"tags": tags, "deadlines": stages}


def collect(store: Store, source_id: str, landed: DataFrame | None, config: dict, *, run_id: str, as_of: str) -> dict:
    """Run one source and commit; the run's row as a dict.

    ``config`` names the ``adapter`` and holds its settings. A run without a usable record has
    failed and leaves notices alone; rejects, warnings or a total that does not add up make it
    partial; only success moves ``last_success_at``. A job that Spark gives up is a failed run with
    the message of its error. A ``run_id`` that is committed is not run again.
    """
    base = store.manifest()
    spark = store.table("runs", base).sparkSession
    again = store.table("runs", base).filter(F.col("run_id") == run_id).head(1)
    if again:
        return again[0].asDict()
    with short_lived_shuffles(spark):
        return _collected(store, base, spark, source_id, landed, config, run_id, as_of)


def _collected(store: Store, base: dict, spark: SparkSession, source_id: str, landed: DataFrame | None, config: dict, run_id: str, as_of: str) -> dict:
    batch, staged, repeated, measured, problem = None, None, None, {}, None
    try:
        batch = read_source(config["adapter"], landed, config)
        staged, repeated, measured = _staged(batch, source_id)
        expected, warnings, problem = batch.judge(measured)
    except (PySparkException, ValueError) as error:
        told = error.getMessage() or error.getCondition() if isinstance(error, PySparkException) else str(error)
        expected, warnings, problem = None, [], f"{type(error).__name__}: {told}"[:1200]
    seen, rejected, changed = measured.get("seen", 0), measured.get("rejected", 0), 0
    tables = {}
    if staged is not None and rejected:
        rows = marked(staged.select("n", "reason", "raw"), repeated).filter("reason IS NOT NULL")
        tables["rejections"] = store.appended("rejections", rows.select(
            F.lit(run_id).alias("run_id"), "reason", F.col("raw").alias("raw_json")), base)
    if seen:
        applied, changed = apply_rows(store, base, staged, source_id, as_of, batch.unique)
        tables.update(applied)
    elif problem is None:
        problem = fixed.EMPTY_RUN
    status = "failed" if not seen else "partial" if rejected or warnings or problem else "success"
    message = problem or "; ".join(sorted(set(warnings))) or (f"{rejected} {fixed.ROWS_REJECTED}" if rejected else None)
    run = {
        "run_id": run_id, "source_id": source_id, "started_at": as_of, "status": status, "message": message, "expected": expected,
        "seen": seen, "changed": changed, "rejected": rejected,
    }
    typed = spark.createDataFrame([tuple(run.values())], TABLES["runs"].replace("started_at timestamp_ntz", "started_at string")).withColumn(
        "started_at", F.col("started_at").cast("timestamp_ntz"))
    tables["runs"] = store.appended("runs", typed, base)
    tables["health"] = store.write("health", next_health(store.table("health", base), typed))
    store.commit(base, tables)
    return run


def apply_rows(store: Store, base: dict, rows: DataFrame, source_id: str, as_of: str, unique: bool) -> tuple[dict, int]:
    """(folders of the changed tables, number of changes) for the staged rows of a batch.

    Which of them are usable is settled among keys and hashes; the wide columns come in by ``n``.
    """
    current, items = store.table("opportunities", base), store.table("source_items", base)
    steps = transitions(rows, current, items, source_id, unique)
    tables = {
        "opportunities": store.write("opportunities", next_snapshot(current, rows, steps, source_id, as_of)),
        "source_items": store.write("source_items", next_items(items, rows, steps, source_id, as_of)),
    }
    moved = steps.filter("kind IS NOT NULL")
    last = last_of(moved, "id").withColumnRenamed("id", "opportunity_id")
    changed_ids = moved.select(F.col("id").alias("opportunity_id")).distinct()
    for name in CHILDREN:
        fresh = children(last.join(rows.select("n", *CHILDREN), "n"))[name]
        tables[name] = store.write(name, store.table(name, base).join(changed_ids, "opportunity_id", "left_anti").unionByName(fresh))
    highest = store.table("changes", base).agg(F.max("id").alias("id")).first().id or 0
    # Numbered before the wide columns come in, so that they are written once.
    steps_moved = moved.select(F.col("id").alias("opportunity_id"), "n", "kind")
    numbered = dense_ids(steps_moved, F.concat_ws("/", "opportunity_id", "n"), highest)
    log = numbered.join(rows.drop("id"), "n").withColumns({"payload_json": payload(), "raw_json": F.col("raw")}).select(
        "opportunity_id", F.lit(source_id).alias("source_id"), "kind", F.lit(as_of).cast("timestamp_ntz").alias("created_at"),
        "payload_json", "raw_json", "id")
    tables["changes"] = store.appended("changes", log, base)
    return tables, moved.count()


def next_health(health: DataFrame, run: DataFrame) -> DataFrame:
    """One row a source: state and error of its last run, and when it last succeeded."""
    fresh = run.select("source_id", F.col("status").alias("_status"), F.col("message").alias("_message"), F.col("started_at").alias("_at"))
    joined = health.join(fresh, "source_id", "full_outer")
    ran = F.col("_status").isNotNull()
    return joined.select(
        "source_id", F.coalesce("_status", "health").alias("health"), F.when(ran, F.col("_message")).otherwise(F.col("last_error")).alias("last_error"),
        F.coalesce("_at", "last_attempt_at").alias("last_attempt_at"),
        F.when(F.col("_status") == "success", F.col("_at")).otherwise(F.col("last_success_at")).alias("last_success_at"),
    )


__all__ = ["DEADLINE", "TABLES", "TAG", "collect", "create", "next_health", "next_items", "next_snapshot", "staged_batch", "transitions"]
