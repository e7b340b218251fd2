"""The paths taken for keys too large for one task give the same answers."""

import os
import random

from pyspark.sql import functions as F

from noticegrid.operators import ordered, reconcile, reviews
from noticegrid.session import dense_ids, shared_dir


def test_hot_source_is_split(spark):
    rnd = random.Random(5)
    rows = [(0 if rnd.random() < 0.6 else rnd.randrange(9), i // 3, i, rnd.randrange(3)) for i in range(3000)]
    df = spark.createDataFrame(rows, "source_id bigint, observed_at bigint, event_id bigint, text_hash bigint")
    last, want = {}, []
    for source, at, event, value in sorted(rows):
        before = last.get(source)
        want.append((source, event, "source_discovered" if before is None else "same" if before == value else "source_changed"))
        last[source] = value
    for parts in (2, 13):
        got = ordered.page_changes(df, partitions=parts).select("source_id", "event_id", "kind").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def brute_reviews(attempts, notices, start):
    out, state = {}, dict(start)
    for notice, at, event, expected, source, eligibility, evidence in sorted(attempts, key=lambda a: (a[0], a[1], a[2])):
        version = state.get(notice, 0)
        if eligibility != "unreviewed" and not evidence:
            outcome = "invalid"
        elif notices.get(notice) != source or expected != version:
            outcome = "conflict"
        else:
            outcome, version = "accepted", version + 1
        state[notice] = version
        out[event] = (outcome, version)
    return out


def test_reviews_of_a_hot_notice_match_sequential_application(spark):
    rnd = random.Random(11)
    attempts = []
    for event in range(4000):
        notice = 1 if rnd.random() < 0.5 else rnd.randrange(40)
        attempts.append((notice, rnd.randrange(100000), event, rnd.randrange(6) if rnd.random() < 0.7 else event % 25,
                         1 if rnd.random() < 0.9 else 2, rnd.choice(["eligible", "unreviewed"]), rnd.choice(["", "https://e.org"])))
    notices, start = {n: 1 for n in range(38)}, {1: 3, 2: 1}
    df = spark.createDataFrame(
        attempts, "opportunity_id bigint, arrived_at bigint, event_id bigint, expected_version int, source_version int, eligibility string, evidence_url string")
    n = spark.createDataFrame(list(notices.items()), "id bigint, version int")
    r = spark.createDataFrame(list(start.items()), "opportunity_id bigint, version int")
    for partitions in (17, 300):  # the hot notice spans a few ranges, and more than a hundred
        got = {x.event_id: (x.outcome, x.review_version) for x in reviews.apply_reviews(df, n, r, partitions=partitions).collect()}
        assert got == brute_reviews(attempts, notices, start)


def test_ids_are_consecutive_and_repeatable(spark):
    df = spark.range(1000).withColumn("k", F.concat(F.lit("n"), "id")).drop("id")
    a, b = ([(r.k, r.id) for r in dense_ids(df.repartition(n), F.col("k"), 500).orderBy("id").collect()] for n in (3, 11))
    assert a == b and [i for _, i in a] == list(range(501, 1501))


def test_differences_count_copies(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (3,)], "x int")
    assert sorted((r.x, r.side, r.copies) for r in reconcile.differences(a, b).collect()) == [(1, "left", 1), (2, "left", 1), (3, "right", 1)]


def test_coverage_survives_a_document_in_every_notice(spark):
    from noticegrid.operators.registry import document_coverage

    bridge = spark.range(5000).select(F.col("id").alias("opportunity_id"), F.lit(7).cast("bigint").alias("document_id"),
                                      F.lit(None).cast("string").alias("limitation"), F.lit(True).alias("is_root"), F.lit(True).alias("active"))
    docs = spark.createDataFrame([(7, "fetched", "partial_text")], "id bigint, state string, extraction_status string")
    row = document_coverage(bridge, docs).agg(F.count("*").alias("n"), F.sum("text_issue_count").alias("t")).first()
    assert (row.n, row.t) == (5000, 5000)


def test_filters_and_columns_reach_the_scan(spark, inputs):
    from noticegrid.operators.predicates import filter_notices

    path = shared_dir(spark, "stored")
    inputs.fx_opportunities.write.parquet(path)
    stored = spark.read.parquet(path)
    df = filter_notices(stored, source="src-1", record_kind="call", deadline_after="1998-01-01").select("id")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(source_id,src-1)" in plan and "GreaterThanOrEqual(deadline_on" in plan
    schema = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "title" not in schema and "description" not in schema


def test_capped_rank_is_limited_before_the_shuffle(inputs):
    plan = ordered.capped_documents(inputs.fx_opportunity_documents, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 1


def test_landed_bodies_are_compressed_in_bounded_files(spark, inputs):
    import glob

    from noticegrid.plans.source_queries import landed_lines

    bodies = spark.range(0, 50, 1, 1).select(F.repeat(F.lit("%22title%22"), F.lit(1000)).alias("body"))
    path = landed_lines(inputs, bodies, lines=20)
    files = glob.glob(path + "/*.txt.gz")
    assert len(files) == 3  # 20, 20 and 10 bodies
    assert sum(map(os.path.getsize, files)) < 50 * 11_000 / 20
    assert sorted(r.value for r in spark.read.text(path).collect()) == ["%22title%22" * 1000] * 50


def test_embedded_payload_is_parsed_once(spark):
    from noticegrid.sources import listing

    pages = spark.createDataFrame([("<html>",)], "html string")
    plan = listing.embedded_rows(pages)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def test_views_do_not_shuffle_orders_by_a_remainder(spark, data):
    from noticegrid.plans.views import Inputs

    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        for name in ("fx_opportunities", "fx_tags"):
            plan = getattr(Inputs(spark, data), name)._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "hashpartitioning((o_orderkey" not in plan
    finally:
        spark.conf.set(key, before)


def test_documents_without_content_meet_no_content_join(spark):
    from noticegrid.operators import lookups, registry

    documents = spark.createDataFrame([(1, "a", "u1"), (2, None, "u2"), (3, None, "u3"), (4, "x", "u4")], "id bigint, current_sha256 string, url string")
    blobs = spark.createDataFrame([("a", 5), ("b", 1)], "sha256 string, copies bigint")
    bridge = spark.createDataFrame(
        [(7, 1, True), (7, 2, True), (8, 3, True), (8, 4, False)], "opportunity_id bigint, document_id bigint, active boolean").selectExpr("*", "1 AS depth", "'r' AS role", "null AS limitation")
    notices = spark.createDataFrame([(7, "t"), (8, "t"), (9, "t")], "id bigint, title string")
    rows = lookups.notice_document_export(notices, bridge, documents, blobs)
    got = rows.select("opportunity_id", "document_id", "url", "current_sha256", "copies").collect()
    assert {tuple(r) for r in got} == {(7, 1, "u1", "a", 5), (7, 2, "u2", None, None), (8, 3, "u3", None, None), (9, None, None, None, None)}
    detail = registry.document_detail(bridge, documents, blobs)
    assert {(r.document_id, r.copies) for r in detail.collect()} == {(1, 5), (2, None), (3, None), (4, None)}
    # Contents are joined with the documents that have one, not with the bridge.
    for df in (rows, detail):
        assert "isnotnull(current_sha256" in df._jdf.queryExecution().optimizedPlan().toString()
