"""Collection runs: from landed responses to committed versions."""

import json

import pytest
from pyspark.sql import functions as F

from noticegrid.functions import fixed
from noticegrid.operators import collection
from noticegrid.session import shared_dir
from noticegrid.sinks.store import SEGMENTS, Conflict, Store
from noticegrid.sources import landed

AT = "2026-09-01 06:00:00"
LISTING = {"adapter": "paged_listing", "as_of": AT}


@pytest.fixture()
def store(spark):
    return collection.create(spark, shared_dir(spark, "registry"))


def row(number, title="Round", **fields):
    return {"hakuasianAsianumero": number, "nimi": {"fi": title}, **fields}


def pages(spark, *listed, total=None, last=None):
    bodies = [
        json.dumps({"pageNo": i + 1, "totalCount": total if total is not None else sum(map(len, listed)), "pageCount": last or len(listed), "hakuilmoitukset": rows})
        for i, rows in enumerate(listed)
    ]
    path = shared_dir(spark, "landed")
    spark.createDataFrame([(b,) for b in bodies], "value string").repartition(3).write.text(path)
    return landed.read_json(spark, path, landed.LISTING)


def run(store, spark, name, *listed, source="src", at=AT, **options):
    return collection.collect(store, source, pages(spark, *listed, **options), LISTING, run_id=name, as_of=at)


def test_rejects_have_reasons_and_the_rest_goes_on(spark, store):
    got = run(
        store, spark, "r1",
        [row("a", hakuAlkaaDateTimeUtc="2026-09-08T21:00:00Z"), row("b", hakuPaattyyDateTimeUtc="2026-09-08T21:00:00")],
        [row("a"), row("c", hakuPaattyyDateTimeUtc="2026-02-31"), row(None), row("d", title="")], [row("b")],
    )
    assert (got["status"], got["seen"], got["changed"], got["rejected"], got["expected"]) == ("partial", 1, 1, 6, 7)
    reasons = sorted((str(json.loads(r.raw_json).get("hakuasianAsianumero")), r.reason) for r in store.table("rejections").collect())
    assert reasons == sorted([
        ("b", fixed.NO_OFFSET), ("a", fixed.REPEATED_IDENTIFIER), ("c", fixed.NO_SUCH_DAY), ("None", fixed.NO_IDENTIFIER),
        ("d", "title: required"), ("b", fixed.REPEATED_IDENTIFIER)])
    assert [str(r.opens_on) for r in store.table("opportunities").collect()] == ["2026-09-09"]
    assert store.table("health").first().last_success_at is None


def test_totals_that_do_not_add_up(spark, store):
    short = run(store, spark, "r1", [row("a")], total=2)
    assert (short["status"], short["seen"], short["expected"], short["message"]) == ("partial", 1, 2, "Pages list 1 rows, 2 are advertised")
    gap = run(store, spark, "r2", [row("a")], [], last=3)
    assert (gap["status"], gap["message"]) == ("partial", fixed.EMPTY_PAGE)
    body = [json.dumps({"pageNo": n, "totalCount": t, "pageCount": 2, "hakuilmoitukset": [row(f"x{n}")]}) for n, t in ((1, 2), (2, 3))]
    path = shared_dir(spark, "landed")
    spark.createDataFrame([(b,) for b in body], "value string").write.text(path)
    drift = collection.collect(store, "src", landed.read_json(spark, path, landed.LISTING), LISTING, run_id="r3", as_of=AT)
    assert (drift["status"], drift["message"], drift["expected"]) == ("partial", fixed.TOTAL_CHANGED, 2)


def test_a_repeated_run_and_an_unchanged_listing_change_nothing(spark, store):
    first = run(store, spark, "r1", [row("a"), row("b")])
    assert (first["status"], first["changed"]) == ("success", 2)
    held = store.version()
    assert run(store, spark, "r1", [row("a", title="Other")])["changed"] == 2 and store.version() == held
    again = run(store, spark, "r2", [row("a"), row("b")], at="2026-09-02 06:00:00")
    assert (again["changed"], store.table("changes").count()) == (0, 2)
    notices = store.table("opportunities").collect()
    assert {(r.version, str(r.updated_at), str(r.last_seen_at)) for r in notices} == {(1, AT, "2026-09-02 06:00:00")}
    foreign = run(store, spark, "r3", [row("a", title="Theirs")], source="second")
    assert (foreign["seen"], foreign["changed"], store.table("source_items").count()) == (1, 0, 3)
    assert {r.title for r in store.table("opportunities").collect()} == {"Round"}


def test_a_lost_run_leaves_the_version_before(spark, store, monkeypatch):
    run(store, spark, "r1", [row("a")])
    before = {name: sorted(map(str, store.table(name).collect())) for name in collection.TABLES}
    held, write, count = store.version(), Store.write, []

    def lost(self, name, rows):
        count.append(name)
        if len(count) > 2:
            raise KeyboardInterrupt
        return write(self, name, rows)

    monkeypatch.setattr(Store, "write", lost)
    with pytest.raises(KeyboardInterrupt):
        run(store, spark, "r2", [row("a", title="New"), row("b")])
    monkeypatch.undo()
    assert count[:2] == ["opportunities", "source_items"] and store.version() == held
    assert before == {name: sorted(map(str, store.table(name).collect())) for name in collection.TABLES}
    assert run(store, spark, "r2", [row("a", title="New"), row("b")])["changed"] == 2


def test_failed_runs_keep_notices_and_success_moves_the_last_success(spark, store):
    run(store, spark, "r1", [row("a")])
    empty = run(store, spark, "r2", [], at="2026-09-02 06:00:00")
    broken = collection.collect(
        store, "src", spark.createDataFrame([("<html>Temporarily unavailable</html>",)], "html string"), {"adapter": "embedded_listing"},
        run_id="r3", as_of="2026-09-03 06:00:00")
    assert [(r["status"], r["seen"]) for r in (empty, broken)] == [("failed", 0)] * 2
    assert empty["message"] == fixed.EMPTY_RUN and "preRenderData" in broken["message"]
    health = store.table("health").first()
    assert (health.health, str(health.last_success_at), str(health.last_attempt_at)) == ("failed", AT, "2026-09-03 06:00:00")
    assert store.table("opportunities").count() == 1 and store.table("runs").count() == 3


def test_the_last_record_of_a_notice_wins_and_each_change_counts(spark, store):
    lines = [("a", "https://example.org/1", "One"), ("a", "https://example.org/1", "Two"), ("b", "https://example.org/1/?utm_x=1", "Two"), ("c", "https://example.org/3", "Three")]
    table = spark.createDataFrame(lines, "external_id string, canonical_url string, title string").coalesce(1)

    def landed_rows(df, config):
        from noticegrid.functions.record import record
        from noticegrid.sources.registry import Batch, shaped

        rows = record(df.withColumn("raw", F.to_json(F.struct("*"))).withColumn("n", F.monotonically_increasing_id()), keep=("raw", "n"), **{c: F.col(c) for c in df.columns})
        return Batch(shaped(rows), [F.col("n")])

    from noticegrid.sources import registry

    registry.ADAPTERS["lines"] = landed_rows
    try:
        got = collection.collect(store, "src", table, {"adapter": "lines"}, run_id="r1", as_of=AT)
        notices = {r.external_id: (r.title, r.version) for r in store.table("opportunities").collect()}
        # The third record has another external id, hence another content, though the title is the same.
        assert got["changed"] == 4 and notices == {"b": ("Two", 3), "c": ("Three", 1)}
        kinds = [(r.kind, json.loads(r.payload_json)["title"]) for r in store.table("changes").collect()]
        assert sorted(kinds) == [("created", "One"), ("created", "Three"), ("updated", "Two"), ("updated", "Two")]
        moved = spark.createDataFrame([("a", "https://example.org/moved", "Two")], table.schema)
        assert collection.collect(store, "src", moved, {"adapter": "lines"}, run_id="r2", as_of=AT)["changed"] == 1
        assert store.table("opportunities").count() == 2  # a known item keeps its notice
    finally:
        del registry.ADAPTERS["lines"]


def test_writers_from_one_version_conflict_and_long_tables_are_merged(spark, store):
    base = store.manifest()
    more = store.appended("runs", store.table("runs", base), base)
    store.commit(base, {"runs": more})
    with pytest.raises(Conflict):
        store.commit(base, {"runs": more})
    assert len(store.manifest()["tables"]["runs"]["paths"]) == 2
    wide = {**base, "tables": {**base["tables"], "runs": {**more, "paths": more["paths"] * (SEGMENTS // 2)}}}
    assert len(store.appended("runs", store.table("runs", base), wide)["paths"]) == 1


def test_wide_columns_are_staged_once(spark, store):
    import glob
    import os

    before = len(spark.sparkContext.__dict__.get("_noticegrid_stages", []))
    run(store, spark, "r1", [row("a"), row("b"), row("a", title="Other")])
    folders = [p for p in spark.sparkContext._noticegrid_stages[before:] if "/stage/" in p and os.path.isdir(p)]
    wide = [p for p in folders if {"raw", "raw_json", "payload_json"} & set(spark.read.parquet(p).columns)]
    assert len(wide) == 1 and "payload_json" not in spark.read.parquet(wide[0]).columns
    assert glob.glob(wide[0] + "/*.zstd.parquet")
    # The payload that the log writes from the staged fields is the one that was hashed.
    log = store.table("changes").select("id", F.col("opportunity_id"), F.sha2("payload_json", 256).alias("h"))
    held = store.table("opportunities").select(F.col("id").alias("opportunity_id"), "content_hash")
    assert {r.h == r.content_hash for r in log.join(held, "opportunity_id").collect()} == {True}
    assert sorted(r.id for r in log.collect()) == [1, 2]


def test_a_run_leaves_no_shuffle_files_and_orders_only_shared_notices(spark, store):
    """Shuffles of finished steps filled the disk; records alone in their notice were ranged and staged twice."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        return {name for name in manager.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in name}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, before, stages = spark.conf.get(key, None), shuffled(), len(spark.sparkContext._noticegrid_stages)
    got = run(store, spark, "r1", [row("a"), row("b"), row("a", title="Other"), row("c", hakuPaattyyDateTimeUtc="2026-02-31"), row("c")])
    assert (got["seen"], got["changed"], got["rejected"]) == (2, 2, 3)
    assert not shuffled() - before and spark.conf.get(key, None) == setting
    tables = [spark.read.parquet(p).columns for p in spark.sparkContext._noticegrid_stages[stages:] if "/stage/" in p]
    assert tables and not any("_range" in columns for columns in tables)
    # A repeated row is told by its number, so rejects and usable rows need no join of wide rows by their place.
    assert sum("external_id" in columns for columns in tables) == 1
    items = {r.external_id: (len(r.id), json.loads(r.raw_json)["nimi"]["fi"]) for r in store.table("source_items").collect()}
    assert items == {"a": (64, "Round"), "b": (64, "Round")}
