"""What a step shuffles, stages or sends to the driver does not grow faster than its input."""

from pyspark.sql import functions as F

from noticegrid.functions import dates, html, urls
from noticegrid.operators import documents as docs
from noticegrid.operators import faq, graph
from noticegrid.session import dense_ids
from noticegrid.sources import landed, listing, search

AT = "2026-09-10 06:00:00"


def staged(spark):
    """Tables staged so far, oldest first."""
    return spark.sparkContext.__dict__.setdefault("_noticegrid_stages", [])


def changed_documents(spark):
    events = spark.createDataFrame(
        [(1, "document_updated", "a", "b", True, "https://x.example.org/1", "extracted", (None, 1, "b"), False, 7),
         (2, "document_added", None, "c", False, "https://x.example.org/2", "extracted", (None, 2, "c"), False, 8)],
        "document_id bigint, kind string, previous_sha256 string, sha256 string, shared boolean, url string, extraction_status string, "
        "at struct<fetched_at:timestamp_ntz,document_id:bigint,sha256:string>, again boolean, step bigint")
    bridge = spark.createDataFrame([(10, 1, True), (10, 3, True), (11, 1, False), (12, 2, True), (10, 2, True)], "opportunity_id bigint, document_id bigint, active boolean")
    documents = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id bigint, current_sha256 string")
    notices = spark.createDataFrame([(i, "src") for i in (10, 11, 12)], "id bigint, source_id string")
    return events, notices, bridge, documents


def test_fan_out_numbers_keys_alone(spark):
    events, notices, bridge, documents = changed_documents(spark)
    before = len(staged(spark))
    bumps, log = docs.fan_out(events, notices, bridge, 0, AT, documents)
    tables = [spark.read.parquet(path).columns for path in staged(spark)[before:]]
    assert tables and not any({"url", "payload_json", "sha256", "_h"} & set(columns) for columns in tables)
    assert {(r.opportunity_id, r.bumps) for r in bumps.collect()} == {(10, 2), (12, 1)}
    rows = log.select("id", "opportunity_id", "document_id", "kind", "source_id", "sha256").collect()
    assert {tuple(r)[1:] for r in rows} == {
        (10, 1, "document_updated", "src", "b"), (10, 2, "document_added", "src", "c"), (12, 2, "document_added", "src", "c")}
    assert sorted(r.id for r in rows) == [1, 2, 3]


def test_bumps_alone_stage_nothing(spark):
    events, _notices, bridge, documents = changed_documents(spark)
    before = len(staged(spark))
    hits = docs.reached_notices(events, bridge, documents)
    assert {(r.opportunity_id, r.bumps) for r in docs.notice_bumps(hits).collect()} == {(10, 2), (12, 1)}
    assert len(staged(spark)) == before


def test_ids_follow_the_hash_order(spark):
    rows = dense_ids(spark.range(500).withColumnRenamed("id", "n"), F.col("n"), 40, hex_digits=1).collect()
    want = spark.range(500).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h")).orderBy("h").collect()
    assert [r.n for r in sorted(rows, key=lambda r: r.id)] == [r.id for r in want]
    assert sorted(r.id for r in rows) == list(range(41, 541))


def test_steps_of_a_level_are_three_numbers(spark):
    links = spark.createDataFrame([(1, 2, "b"), (1, 3, "a"), (2, 4, None), (3, 4, "c"), (4, 1, "a")], "document_id bigint, target_id bigint, role string")
    roots = spark.createDataFrame([(7, 1), (8, 3), (8, 2)], "opportunity_id bigint, document_id bigint")
    want = {
        (7, 1, 0, None, "call_content", None, 1), (7, 2, 1, 1, "b", None, 2), (7, 3, 1, 1, "a", None, 3), (7, 4, 2, 2, None, None, 4),
        (8, 2, 0, None, "call_content", None, 1), (8, 3, 0, None, "call_content", None, 2), (8, 4, 1, 2, None, None, 3), (8, 1, 2, 4, "a", None, 4)}
    columns = ["opportunity_id", "document_id", "depth", "parent_id", "role", "limitation", "position"]
    named = spark.createDataFrame([(i, i + 1, f"r{i:05d}") for i in range(100, 1300)], links.schema)  # more roles than a way has numbers for
    for more in (links, links.unionByName(named)):
        got = graph.reach(roots, more, 4, None)
        assert {tuple(r) for r in got.select(*columns).collect()} == want
    packed, _place, _role = graph._packing(links)
    assert links.withColumn("place", F.lit(3)).select(packed.alias("w")).schema["w"].dataType.typeName() == "long"


def test_capped_levels_get_partitions_by_their_notices(spark):
    placed = spark.range(5000).select(F.col("id").alias("opportunity_id"))
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert graph._partitions(placed, 10) == few and graph._partitions(placed, 10, rows=1000) == 55


def test_times_and_posts_are_parsed_once(spark):
    df = spark.createDataFrame([("2026-09-10T06:00:00+0300", "<p>Deadline <b>1 June</b></p><nav><p>x</p></nav>")], "t string, h string")
    plan = df.select(dates.parse_time(F.col("t")).alias("v"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_replace(") <= 3
    got = df.select(html.labelled_text(F.col("h"), "p,li,tr").alias("b"), html.element_texts(F.col("h"), "p,li,tr").alias("labels"),
                    html.semantic_text(F.col("h")).alias("text"), dates.parse_time(F.col("t")).cast("string").alias("t")).first()
    assert (got.b.labels, got.b.text) == (got.labels, got.text) and got.t == "2026-09-10 03:00:00"


def test_canonical_addresses_keep_their_ids(spark):
    urls_ = ["HTTPS://E.org/a//?b=2&a=%31&utm_x=1#f", "https://e.org", "https://e.org/?x=a+b&y=%zz&=v", "ftp://e.org/", None, "https://u@e.org/"]
    rows = spark.createDataFrame([(u,) for u in urls_], "u string").select(
        urls.canonical_url(F.col("u")).alias("c"), urls.notice_id(F.col("u")).alias("i"), urls.canonical_id(urls.canonical_url(F.col("u"))).alias("j")).select(
        "*", urls.canonical_url(F.col("c")).alias("cc")).collect()
    assert rows[0].c == "https://e.org/a?a=1&b=2" and all(r.c == r.cc and r.i == r.j for r in rows)
    assert [r.c is None for r in rows] == [False, False, False, True, True, True]


def test_a_well_packed_table_is_not_broadcast(spark, tmp_path):
    """A file of repeated values is far smaller than its rows, which would pass through the driver."""
    from noticegrid.plans.views import Inputs

    n = 2_000_000
    spark.range(0, n, 1, 1).selectExpr("id AS c_custkey", "0 AS c_nationkey", "'M' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(0, n, 1, 1).selectExpr("id AS o_orderkey", "id AS o_custkey", "repeat(cast(id AS string), 5) AS o").write.parquet(f"{tmp_path}/orders.parquet")
    r = Inputs(spark, str(tmp_path))
    plan = r.orders.join(r.customer, r.orders.o_custkey == r.customer.c_custkey)._jdf.queryExecution()
    assert plan.optimizedPlan().children().apply(1).stats().sizeInBytes() > 10 * n
    assert "Broadcast" not in plan.executedPlan().toString()


def test_a_retired_bridge_alone_stages_nothing(spark):
    notices = spark.createDataFrame([(10, "TOPIC-1", "s"), (11, "Topic-2", "s")], "id bigint, external_id string, source_id string")
    entries = spark.createDataFrame([(1, [" topic-1 ", "", "TOPIC-1"]), (2, ["", None])], "document_id bigint, keywords array<string>")
    matches = faq.keyword_matches(entries, notices)
    bridge = spark.createDataFrame([(10, 1, True, True, faq.ROLE), (11, 2, True, True, faq.ROLE)],
                                   "opportunity_id bigint, document_id bigint, is_root boolean, active boolean, role string")
    topics, before = notices.selectExpr("lower(external_id) AS topic_id"), len(staged(spark))
    for warnings, want in ((0, {(10, True), (11, False)}), (1, {(10, True), (11, True)})):
        stale = faq.allowed_stale(faq.stale_matches(bridge, matches), topics, notices, warnings)
        assert {(r.opportunity_id, r.active) for r in faq.switched_off(bridge, stale).collect()} == want
    assert len(staged(spark)) == before


def test_metadata_values_are_parsed_before_the_stage(spark, tmp_path):
    """Behind it, each condition and field of the documents parsed every value again."""
    lines = ['{"reference": "1", "metadata": {"type": ["1"], "identifier": "T-1", "deadlineDate": null}}',
             '{"reference": "2", "metadata": {"type": "8", "callccm2Id": ["7", "9"]}}', '{"reference": "cut']
    (tmp_path / "lines.txt").write_text("\n".join(lines))
    documents, rejected = landed.read_search(spark, str(tmp_path))
    accepted, _ = search.split_identities(documents)
    preferred = search.preferred_variants(accepted)
    assert "from_json(" not in preferred._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.topic, r.reference) for r in preferred.collect()} == {("T-1", "1"), ("cascade:7", "2")}
    assert {r.reference: r.metadata for r in documents.collect()} == {
        "1": {"type": ["1"], "identifier": ["T-1"], "deadlineDate": [None]}, "2": {"type": ["8"], "callccm2Id": ["7", "9"]}}
    assert [r.raw for r in rejected.collect()] == [lines[2]]


def test_tasks_of_registry_queries_are_bounded(spark, data):
    from noticegrid.plans.views import Inputs

    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", "8m")
    session.conf.set("spark.sql.shuffle.partitions", "64")
    Inputs(session, data)
    assert session.conf.get("spark.sql.files.maxPartitionBytes") == "8m"  # the session's own setting stays
    rows = session.range(3_000_000).select(F.sha2(F.col("id").cast("string"), 256).alias("k")).repartition("k")
    assert rows.rdd.getNumPartitions() >= 11  # about 200 MB in parts of 16; by the number of cores they would be 8


def test_a_transfer_broadcasts_no_customers(spark, data, tmp_path):
    """Of the views that it copies only nations and the few parts below the divisor pass through the driver."""
    import re

    from noticegrid.plans.catalog import QUERIES
    from noticegrid.plans.views import Inputs

    n = 400_000
    for table in ("region", "nation", "part", "events"):
        spark.read.parquet(f"{data}/{table}.parquet").write.parquet(f"{tmp_path}/{table}.parquet")
    spark.range(0, n, 1, 1).selectExpr("id AS c_custkey", "id % 25 AS c_nationkey", "'MACHINERY' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(0, n, 1, 1).selectExpr(
        "id AS o_orderkey", f"(id * 7919) % {n} AS o_custkey", "'F' AS o_orderstatus", "id / 7.0D AS o_totalprice", "'1-URGENT' AS o_orderpriority",
        "TIMESTAMP_NTZ '1996-01-01 00:00:00' + CAST(id % 900 AS INT) * INTERVAL '1' DAY AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    r = Inputs(spark, str(tmp_path))
    for view in (r.fx_opportunities, r.fx_tags):
        plan = view._jdf.queryExecution().executedPlan().toString()
        sent = {re.search(r"[a-z]_(?:cust|nation|part|order)key", part)[0] for part in plan.split("BroadcastExchange")[1:]}
        assert sent <= {"n_nationkey", "p_partkey"}
    rows = QUERIES["m09_transfer"](spark, str(tmp_path)).collect()
    assert {tuple(x) for x in rows} == {(t, True) for t in ("sources", "opportunities", "tags", "changes")}


def test_a_listed_notice_does_not_carry_its_page(spark):
    """Rows wait for Python on disk; with its page's payload each row is as large as the page."""
    page = ('{"preRenderData": {"hankehaku": [{"id": "1", "otsikko": "One", "kuvaus": "<b>x</b>", "viranomainen": "7", "maakunnat": ["3", "4"]}, {"id": "2", "otsikko": "Two"}],'
            ' "koodisto": {"maakunta": {"3": {"fi": "Pirkanmaa"}}, "viranomainen": {"7": {"fi": "Keskus"}}}}}')
    pages = spark.createDataFrame([(page,)], "body string").select(
        F.concat(F.lit("<script>"), F.replace(F.url_encode("body"), F.lit("+"), F.lit("%20")), F.lit("</script>")).alias("html"))
    read = listing.embedded_rows(pages)
    rows = listing.embedded_records(listing.checked_embedded(read))
    above = rows._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert "Python" in above and "data#" not in above and "notices#" not in above and "codes#" not in above.split("ArrowEvalPython")[0]
    got = {r.external_id: (r.expected, r.funder, [t.value for t in r.tags], r.geographic_scope) for r in rows.collect()}
    assert got == {"1": (2, "Keskus", ["Pirkanmaa", "4"], "pirkanmaa"), "2": (2, "", [], "unknown")}
