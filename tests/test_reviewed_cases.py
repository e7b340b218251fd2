"""Cases that an earlier version got wrong."""

import pytest
from pyspark.sql import functions as F

from noticegrid.functions import codes, dates, html, text
from noticegrid.operators import documents as docs
from noticegrid.operators import graph, lookups, upsert
from noticegrid.session import clear_stages, dense_ids, materialise, shared_dir
from noticegrid.sources import landed, pages

T1 = "2026-09-10 06:00:00"


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_links_of_the_chosen_version_alone(spark):
    documents = spark.createDataFrame([(1, "new")], "id bigint, current_sha256 string")
    versions = spark.createDataFrame([(1, "old"), (1, "new")], "document_id bigint, sha256 string")
    blobs = spark.createDataFrame([("old", "a"), ("new", "b")], "sha256 string, text string")
    links = spark.createDataFrame([(1, "old", True), (1, "old", False), (1, "new", True)], "document_id bigint, source_sha256 string, follow boolean")
    row = lookups.document_version(documents, versions, blobs, links, 1).first()
    assert (row.links, row.followed, row.versions) == (1, 1, 2)
    row = lookups.document_version(documents, versions, blobs, links, 1, "old").first()
    assert (row.links, row.followed) == (2, 1)


def test_flag_counters_read_the_flags_of_the_current_content(spark):
    from noticegrid.operators import aggregates

    documents = spark.createDataFrame(
        [(1, "eu_source", "a"), (2, "eu_source", "a"), (3, "eu_source", "b"), (4, "eu_faq_source", "c"), (5, "eu_faq_source", "a"), (6, "eu_source", None), (7, "pdf", "a")],
        "id bigint, parser string, current_sha256 string")
    blobs = spark.createDataFrame(
        [("a", '["x", "full_eu_conditions_not_present_in_source_entry"]'), ("b", None), ("c", '["full_faq_question_or_answer_not_published"]')],
        "sha256 string, flags_json string")
    row = aggregates.flag_gaps(documents, blobs).first()
    assert (row.eu_entries_without_published_body, row.faq_entries_without_published_question_or_answer) == (2, 1)
    assert tuple(aggregates.flag_gaps(documents.limit(0), blobs).first()) == (0, 0)


def test_two_sources_of_one_notice_give_one_row(spark):
    columns = "id string, source_id string, title string, content_hash string, version int, updated_at timestamp_ntz"
    incoming = "id string, source_id string, title string, content_hash string, raw_changed boolean"
    both = spark.createDataFrame([("n", "s2", "B", "h2", False), ("n", "s1", "A", "h1", False)], incoming)
    first = upsert.upsert(spark.createDataFrame([], columns), both, T1)
    assert [(r.source_id, r.version, r.outcome) for r in first.collect()] == [("s1", 1, "created")]
    current = spark.createDataFrame([("n", "s2", "B", "h2", 4, None)], columns)
    again = upsert.upsert(current, both, T1).collect()
    assert [(r.source_id, r.version, r.outcome) for r in again] == [("s2", 4, "seen")]


def test_raw_change_follows_from_the_stored_item(spark):
    item = F.sha2(F.lit("s:x"), 256)
    items = spark.range(1).select(item.alias("id"), F.lit("s").alias("source_id"), F.lit("x").alias("external_id"), F.lit("old-id").alias("opportunity_id"),
                                  F.lit("r1").alias("raw_hash"), F.lit(None).cast("timestamp_ntz").alias("last_seen_at"))
    rows = spark.createDataFrame([("new-id", "s", "x", "r2"), ("other", "s", "y", "r3")], "id string, source_id string, external_id string, raw_hash string")
    resolved = upsert.resolve_ids(rows, items)
    assert {(r.external_id, r.id, r.raw_changed) for r in resolved.collect()} == {("x", "old-id", True), ("y", "other", False)}
    after = {(r.external_id, r.opportunity_id, r.raw_hash) for r in upsert.source_items(items, resolved, T1).collect()}
    assert after == {("x", "old-id", "r2"), ("y", "other", "r3")}


def test_reextraction_reaches_every_carrier(spark):
    documents = spark.createDataFrame([(1, "c", "extracted"), (2, "c", "extracted")], "id bigint, current_sha256 string, extraction_status string")
    schema = "sha256 string, text string, extraction_status string, page_count int"
    blobs = spark.createDataFrame([("c", "worse text", "extracted", 3)], schema)
    fetched = spark.createDataFrame([("c", "better text", "extracted", 3)], schema).withColumn("document_id", F.lit(1).cast("bigint"))
    events = docs.document_events(documents, fetched, blobs)
    assert [(r.document_id, r.kind, r.shared) for r in events.collect()] == [(1, "document_reextracted", True)]
    bridge = spark.createDataFrame([("n1", 1, True), ("n2", 2, True)], "opportunity_id string, document_id bigint, active boolean")
    notices = spark.createDataFrame([("n1", "s"), ("n2", "s")], "id string, source_id string")
    bumps, log = docs.fan_out(events, notices, bridge, 0, T1, documents)
    assert {(r.opportunity_id, r.bumps) for r in bumps.collect()} == {("n1", 1), ("n2", 1)}
    payload = '{"document_id":1,"extraction_status":"extracted","previous_sha256":"c","sha256":"c","url":null}'
    assert {r.payload_json for r in log.collect()} == {payload}
    assert docs.updated_blobs(blobs, fetched).first().text == "better text"


def test_media_types(spark):
    body = lambda s: F.encode(F.lit(s), "UTF-8")
    assert one(spark, codes.media_type(body("PK\x03\x04 none"), F.lit("application/octet-stream"))) == "application/octet-stream"
    assert one(spark, codes.media_type(body("PK\x03\x04 word/document.xml"), F.lit("x"))).endswith("wordprocessingml.document")


def test_blank_entities(spark):
    for blank in ("&#8195;", "&#x2003;", "&#xA0;", "&nbsp;", "&#160", "&emsp13;"):
        assert one(spark, text.published_text(F.lit(f"<p>{blank}</p>"))) is False, blank
    for shown in ("&amp;", "&#65;", "&#1600;", "&#x2003a;"):
        assert one(spark, text.published_text(F.lit(f"<p>{shown}</p>"))) is True, shown


def test_full_case_folding(spark):
    for value, needle in (("ΟΔΟΣ", "οδοσ"), ("οδος", "ΟΔΟΣ"), ("ﬁn", "FIN"), ("FIN", "ﬁn"), ("straße", "STRASSE"), ("ŉ", "ʼn")):
        assert one(spark, text.contains_folded(F.lit(value), needle)), (value, needle)


def test_impossible_dates_are_told(spark):
    found = dates.dates_in_label(F.lit("haku 31.2.2026"), "Europe/Helsinki")
    assert one(spark, dates.impossible(found)) is True
    assert one(spark, dates.impossible(dates.dates_in_label(F.lit("28.2.2026"), "Europe/Helsinki"))) is False


def test_titles_without_tags_lose_their_entities(spark):
    assert one(spark, html.unescaped(F.lit("Call A &amp; B"))) == "Call A & B"
    assert one(spark, html.unescaped(F.lit("plain"))) == "plain"


def test_metadata_may_be_a_plain_string(spark):
    path = shared_dir(spark, "lines")
    lines = ['{"reference":"a","metadata":{"type":"1","identifier":["X-1"]}}', "{broken", '{"reference":"b","metadata":{"type":["8"]}}']
    spark.createDataFrame([(line,) for line in lines], "value string").write.text(path)
    documents, rejected = landed.read_search(spark, path)
    assert {(r.reference, r.metadata["type"][0]) for r in documents.collect()} == {("a", "1"), ("b", "8")}
    assert [r.raw for r in rejected.collect()] == ["{broken"]


def test_dropped_cards_and_pages_have_reasons(spark):
    page = "<main><div class=c><a href='/x'>T</a></div><div class=c>no link</div><div class=c><a href='/y'></a></div></main>"
    rows = spark.createDataFrame([(1, "https://e.org/list", page), (2, "https://e.org/s", "<main>short</main>"), (3, "https://e.org/n", "<p>none</p>")],
                                 "page_id bigint, url string, html string")
    config = {"name": "S", "card_selector": ".c", "link_selector": "a"}
    got = {(r.position, r.reason) for r in pages.card_rejects(rows.filter("page_id = 1"), config).collect()}
    assert got == {(1, "Card without a link"), (2, "Card without a title")}
    entries = rows.select("url", F.lit("t").alias("title"), F.lit("call").alias("record_kind"))
    reasons = {r.page_id: r.reason for r in pages.configured_page_rejects(rows.filter("page_id > 1"), entries, {"name": "S"}).collect()}
    assert reasons[2].startswith("Page content too short") and reasons[3].startswith("Expected main content")


@pytest.mark.parametrize("body", ["<li>" * 100_000 + "x", "<div>" * 30_000 + "</q>" * 30_000 + "x"])
def test_deep_pages(spark, body):
    rows = spark.createDataFrame([(body,)], "h string")
    row = rows.select(html.clean_html(F.col("h")).alias("c"), html.semantic_text(F.col("h")).alias("s")).first()
    assert row.c == row.s == "x"


def test_references_of_deep_and_quoted_json(spark):
    deep = "[" * 3000 + '"x"' + "]" * 3000
    odd = r'{"a\"b": ["c\\", true, null, 1.50, "d,e"]}'
    rows = spark.createDataFrame([(deep,), (odd,)], "j string").select(html.json_references(F.col("j")).alias("r")).collect()
    assert rows[0].r == ["x"] and sorted(rows[1].r) == sorted(['a"b', "c\\", "True", "1.5", "d,e"])


def test_reach_without_a_limit_equals_a_walk(spark):
    edges = {(i, (i * k + 1) % 40, "r") for i in range(40) for k in (3, 7, 11)}
    roots = [(n, (n * 5) % 40) for n in range(6)] + [(0, 9)]
    links = spark.createDataFrame(list(edges), "document_id bigint, target_id bigint, role string")
    start = spark.createDataFrame(roots, "opportunity_id bigint, document_id bigint")
    want = {}
    for n in range(6):
        frontier = {d for m, d in roots if m == n}
        depth = dict.fromkeys(frontier, 0)
        for level in range(1, 4):
            frontier = {t for d, t, _ in edges if d in frontier} - set(depth)
            depth.update(dict.fromkeys(frontier, level))
        want.update({(n, d): v for d, v in depth.items()})
    got = graph.reach(start, links, 2, None).collect()
    assert {(r.opportunity_id, r.document_id): r.depth for r in got} == want
    assert all((r.limitation == "depth_limit") == (r.depth == 3) for r in got)
    capped = graph.reach(start, links, 2, 250).collect()
    assert {(r.opportunity_id, r.document_id, r.position) for r in capped} == {(r.opportunity_id, r.document_id, r.position) for r in got}


def test_stages_can_be_cleared(spark):
    clear_stages(spark)
    rows = materialise(spark.range(5))
    assert rows.count() == 5 and clear_stages(spark) == 1
    with pytest.raises(ValueError):
        dense_ids(spark.range(3), F.col("id"), 0, "n", hex_digits=6)


def test_the_last_record_of_a_source_wins_whatever_the_partitions(spark):
    current = spark.createDataFrame([], "id bigint, source_id string, title string, content_hash string, version int, updated_at timestamp_ntz")
    rows = spark.createDataFrame(
        [(1, "s", f"T{i}", f"h{9 - i}", False, i) for i in range(8)] + [(1, "t", "other", "h", False, 99)],
        "id bigint, source_id string, title string, content_hash string, raw_changed boolean, place int")
    for parts in (1, 3, 8):
        assert [r.title for r in upsert.upsert(current, rows.repartition(parts, "place"), T1, "place").collect()] == ["T7"]
        assert [r.title for r in upsert.upsert(current, rows.repartition(parts, "place"), T1).collect()] == ["T7"]  # the least hash
