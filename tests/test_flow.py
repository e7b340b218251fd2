"""Upserts, shared documents, FAQ retirement, streams and sinks on small inputs."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from noticegrid.operators import documents as docs
from noticegrid.operators import faq, paging, priorities, quality, upsert
from noticegrid.operators.aggregates import funder_directory
from noticegrid.operators.predicates import filter_notices, utc_naive
from noticegrid.session import shared_dir
from noticegrid.sinks import export
from noticegrid.sources import config, landed, listing, pages, search
from noticegrid.streaming import feed, watch

CURRENT = "id string, source_id string, title string, content_hash string, version int, updated_at timestamp_ntz, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz"
INCOMING = "id string, source_id string, title string, content_hash string, raw_changed boolean"
T0, T1 = dt.datetime(2024, 1, 1), "2024-02-01 00:00:00"


def test_upsert_is_idempotent_and_respects_the_owner(spark):
    empty = spark.createDataFrame([], CURRENT)
    first = upsert.upsert(empty, spark.createDataFrame([("a", "s1", "T", "h", False)], INCOMING), T1)
    assert [(r.outcome, r.version) for r in first.collect()] == [("created", 1)]
    stored = spark.createDataFrame(first.drop("outcome").collect(), CURRENT)
    again = upsert.upsert(stored, spark.createDataFrame([("a", "s1", "T", "h", False)], INCOMING), T1).first()
    other = upsert.upsert(stored, spark.createDataFrame([("a", "s2", "X", "z", True)], INCOMING), T1).first()
    raw = upsert.upsert(stored, spark.createDataFrame([("a", "s1", "T", "h", True)], INCOMING), T1).first()
    assert (again.outcome, again.version) == ("seen", 1)
    assert (other.outcome, other.version, other.title) == ("kept", 1, "T")
    assert (raw.outcome, raw.version) == ("updated", 2)


def test_known_item_keeps_its_notice_when_the_address_changes(spark):
    incoming = spark.createDataFrame([("new-id", "s1", "EXT")], "id string, source_id string, external_id string")
    item = incoming.select(F.sha2(F.lit("s1:EXT"), 256).alias("id"), F.lit("old-id").alias("opportunity_id"), F.lit("r").alias("raw_hash"))
    assert upsert.resolve_ids(incoming, item).first().id == "old-id"


def test_shared_document_raises_every_notice_once(spark):
    notices = spark.range(106).select(F.col("id").cast("string").alias("id"), F.lit("s").alias("source_id"), F.lit(1).alias("version"), F.lit(T0).cast("timestamp_ntz").alias("updated_at"))
    bridge = spark.range(105).select(F.col("id").cast("string").alias("opportunity_id"), F.lit("d").alias("document_id"), F.lit(True).alias("active"))
    fetched = spark.createDataFrame([("d", "sha1", "extracted")], "document_id string, sha256 string, extraction_status string")
    stored = spark.createDataFrame([("d", None, "not_extracted")], "id string, current_sha256 string, extraction_status string")
    blobs = spark.createDataFrame([], "sha256 string, extraction_status string")
    events = docs.document_events(stored, fetched, blobs)
    bumps, log = docs.fan_out(events, notices, bridge, 10, T1)
    assert log.filter("kind = 'document_added'").count() == 105
    assert {(r.version, r["n"]) for r in docs.bumped(notices, bumps, T1).groupBy("version").agg(F.count("*").alias("n")).collect()} == {(2, 105), (1, 1)}
    known = spark.createDataFrame([("d", "sha1", "extracted")], stored.schema)
    assert docs.document_events(known, fetched, spark.createDataFrame([("sha1", "extracted")], blobs.schema)).count() == 0


def test_links_of_a_new_version_replace_and_keep_history(spark):
    schema = "document_id string, source_sha256 string, target_url string, title string, role string, follow boolean"
    old = spark.createDataFrame([("d", "v1", "a", "A", "reference", True), ("d", "v1", "b", "B", "reference", True), ("e", "v1", "c", "C", "reference", True)], schema)
    parsed = spark.createDataFrame([("d", "v1", "a", "A2", "attachment", True), ("d", "v1", "n", "N", "reference", False)], schema)
    got = {(r.document_id, r.target_url): (r.title, r.follow) for r in docs.replace_links(old, parsed).collect()}
    assert got == {("d", "a"): ("A2", True), ("d", "b"): ("B", False), ("d", "n"): ("N", False), ("e", "c"): ("C", True)}


def test_faq_retirement_needs_a_complete_refresh(spark):
    topics = spark.createDataFrame([("o", "TOPIC-1")], "id string, external_id string")
    entries = spark.createDataFrame([("f", [" topic-1 ", "TOPIC-1"])], "document_id string, keywords array<string>")
    current = faq.keyword_matches(entries, topics)
    assert [tuple(r) for r in current.collect()] == [("o", "f")]
    bridge = spark.createDataFrame([("o", "f", True, True, faq.ROLE), ("o", "g", True, True, faq.ROLE)], "opportunity_id string, document_id string, is_root boolean, active boolean, role string")
    named = spark.createDataFrame([("topic-1",)], "topic_id string")
    assert faq.may_retire(named, topics, 0) and not faq.may_retire(named, topics, 1)
    assert not faq.may_retire(spark.createDataFrame([("x",)], "topic_id string"), topics, 0)
    notices = spark.createDataFrame([("o", "eu")], "id string, source_id string")
    new_bridge, bumps, log = faq.retire(bridge, notices, faq.stale_matches(bridge, current), 5, T1)
    assert {(r.document_id, r.active, r.is_root) for r in new_bridge.collect()} == {("f", True, True), ("g", False, False)}
    assert bumps.first().bumps == 1 and log.first().id == 6


def notice_rows(spark):
    return spark.createDataFrame([
        ("1", "eu-funding", "cascade:42", "FSTP", "SITRA", "call", "unknown"), ("2", "eu-funding", "HORIZON-01", "FSTP", "Sitra", "funding_scheme", "unknown"),
        ("3", "test", "cascade:43", "FSTP", "", "call", "open"), ("4", "test", "myr", "MYR", "", "advance_information", "unknown"),
    ], "id string, source_id string, external_id string, title string, funder string, record_kind string, effective_status string")


def test_cascade_filter_and_directory(spark):
    rows = notice_rows(spark).withColumn("description", F.lit(""))
    assert filter_notices(rows, cascade=True).count() == 1 and filter_notices(rows, cascade=False).count() == 3
    assert filter_notices(rows, q="%").count() == 0 and filter_notices(rows, funder="Sitra").count() == 2
    only = [r.asDict() for r in funder_directory(rows).collect()]
    assert only == [{"funder": "SITRA", "records": 2, "calls": 1, "schemes": 1, "advance_information": 0, "open_or_forthcoming": 0, "unknown_status": 2}]
    with pytest.raises(ValueError):
        filter_notices(rows, colour="red")
    with pytest.raises(ValueError):
        utc_naive("2026-01-01T12:00:00")


def test_rule_groups_reject_unusable_configuration(spark, tmp_path):
    good = [{"id": 1, "name": "A", "sources": ["s"], "rules": [{"source_id": ["s"]}]}]
    assert priorities.validate_groups(good) == good
    for bad in ([], good * 2, [{**good[0], "rules": []}], [{**good[0], "rules": [{}]}], [{**good[0], "rules": [{"sql": ["1=1"]}]}], [{**good[0], "rules": [{"funder": []}]}]):
        with pytest.raises(ValueError):
            priorities.validate_groups(bad)
    path = tmp_path / "groups.json"
    path.write_text(json.dumps(good, indent=1))
    assert config.load_groups(spark, str(path)) == good


def test_watermark_freezes_later_pages(spark):
    log = spark.range(1, 11)
    first = paging.change_page(log, 0, None, 4).collect()
    assert [r.id for r in first] == [1, 2, 3, 4] and first[0].has_more and first[0].through_id == 10
    grown = spark.range(1, 21)
    rest = paging.change_page(grown, first[0].next_after_id, first[0].through_id, 100).collect()
    assert [r.id for r in rest] == list(range(5, 11)) and not rest[0].has_more
    with pytest.raises(ValueError):
        paging.offset_page(log, 0, 1001)


def test_embedded_listing_fails_on_drift(spark):
    def read(page):
        return listing.embedded_rows(spark.createDataFrame([(page,)], "html string")).collect()

    with pytest.raises(Exception, match="not found"):
        read("<html>Temporarily unavailable</html>")
    with pytest.raises(Exception, match="empty"):
        read("<script>%7B%22preRenderData%22%3A%7B%22hankehaku%22%3A%5B%5D%7D%7D</script>")


def test_newer_variant_wins_and_conflicts_are_flagged(spark):
    def meta(day, queue):
        return {"type": ["1"], "identifier": ["TEST-1"], "title": ["Call"], "deadlineDate": [day], "esDA_QueueDate": [queue], "DATASOURCE": ["SEDIA"]}
    raw = spark.createDataFrame([("a", "u", "c", "", meta("2030-01-01", "2026-01-01")), ("b", "u", "c", "", meta("2026-09-30", "2026-02-01")),
                                 ("f", "u", "c", "", {"type": ["2"], "identifier": ["FAQ"]})], landed.SEARCH_DOCUMENT)
    ok, bad = search.split_identities(raw)
    row = search.search_records(search.preferred_variants(ok)).first()
    assert [d.original for d in row.deadlines] == ["2026-09-30"] and "conflicting_source_deadlines" in row.quality_flags
    assert row.programme == "TEST" and [r.reference for r in bad.collect()] == ["f"]


def card_pages(spark, *bodies):
    rows = [(i, "https://example.org/calls", f"<main>{b}</main>") for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def card(title, target="grant"):
    return f'<article><h4><a href="/{target}">{title}</a></h4><span class="due">Deadline 24.09.2026</span><p>Published information.</p></article>'


CARDS = {"name": "Nordic", "card_selector": "article", "link_selector": "h4 a", "date_selector": ".due", "exclude_title": "invitation to tender", "language": "en"}


def test_catalogue_repeats_and_conflicts(spark):
    good = pages.distinct_cards(pages.catalogue_cards(card_pages(
        spark, card("Grant") + card("Invitation to tender", "tender"), card("Grant") + card("Another", "grant2")), CARDS))
    rows = {r.external_id: r for r in pages.catalogue_records(good, CARDS).collect()}
    assert set(rows) == {"https://example.org/grant", "https://example.org/grant2"}
    assert rows["https://example.org/grant"].deadlines[0].due_on == dt.date(2026, 9, 24)
    assert rows["https://example.org/grant"].source_status == "unknown" and rows["https://example.org/grant"].listings == 2
    bad = pages.distinct_cards(pages.catalogue_cards(card_pages(spark, card("Grant"), card("Changed grant")), CARDS))
    assert bad.first().conflict
    with pytest.raises(Exception, match="cards missing"):
        pages.catalogue_cards(card_pages(spark, "<p>Loading</p>"), CARDS).collect()


def test_details_replace_listings_and_failures_are_flagged(spark):
    cards = pages.distinct_cards(pages.catalogue_cards(card_pages(spark, card("Old", "broken") + card("New", "good")), CARDS))
    details = spark.createDataFrame([("https://example.org/good", "Public organisations can apply: project plan.")], "target string, body string")
    rows = {r.title: r for r in pages.catalogue_records(cards, CARDS, details).collect()}
    assert rows["New"].detail_level == "full" and "project plan" in rows["New"].description
    assert "detail_fetch_failed_listing_retained" in rows["Old"].quality_flags


def test_rolling_statement_overrides_the_period(spark):
    page = ('<main><h1>Partnership financing</h1><p class="period">1.1.2024 - 31.12.2030</p><p class="rolling">Jatkuva haku: hankesuunnitelmat voi toimittaa '
            'ilman määräpäivää.</p><p>Hakijan tulee osallistua ekosysteemin yhteiseen tutkimus- ja kehittämistyöhön.</p></main>')
    df = spark.createDataFrame([(1, "https://example.org/grant/", page)], "page_id bigint, url string, html string")
    entries = spark.createDataFrame([("https://example.org/grant", None, "call")], "url string, title string, record_kind string")
    row = pages.configured_pages(df, entries, {"name": "T", "date_selector": ".period", "date_is_period": True, "rolling_selector": ".rolling"}).first()
    assert (row.source_status, row.deadline_model, row.deadlines, row.title) == ("rolling", "rolling", [], "Partnership financing")
    twice = entries.union(entries)
    with pytest.raises(Exception, match="Duplicate configured"):
        pages.configured_pages(df, twice, {"name": "T"}).collect()


def test_import_is_all_or_nothing(spark, tmp_path):
    good = {"external_id": "A", "canonical_url": "https://example.org/a", "title": "T"}
    def lines(*rows):
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.jsonl"
        path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
        return landed.read_json(spark, str(path), landed.RECORD_LINE)
    assert config.import_records(lines(good)).count() == 1
    with pytest.raises(ValueError, match="title"):
        config.import_records(lines(good, {**good, "title": ""}))
    with pytest.raises(ValueError, match="malformed"):
        config.import_records(lines(good, "{broken"))
    with pytest.raises(ValueError, match="empty collection"):
        quality.require_rows(spark.createDataFrame([], "x int"))


def test_source_sync_keeps_run_state(spark):
    current = spark.createDataFrame([("a", "Old", "ok", T0)], "id string, name string, health string, last_success_at timestamp_ntz")
    entries = spark.createDataFrame([("a", "New"), ("b", "B")], "id string, name string")
    rows = {r.id: r for r in config.sync_sources(current, entries, ("name",)).collect()}
    assert (rows["a"].name, rows["a"].health, rows["a"].last_success_at) == ("New", "ok", T0) and rows["b"].health == "not_run"
    with pytest.raises(ValueError):
        config.sync_sources(current, entries.union(entries), ("name",))


def test_change_feed_resumes(spark):
    log, out, state = (shared_dir(spark, p) for p in ("log", "out", "state"))
    for start in (0, 10):
        spark.range(start, start + 10).write.mode("append").parquet(log)
        feed.consume(feed.change_stream(spark, log, "id bigint", 2, 16), out, state)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(3, 17))


def test_keyed_state_remembers_the_last_hash(spark):
    landing, out, state = (shared_dir(spark, p) for p in ("obs", "out", "state"))
    schema = "source_id bigint, observed_at timestamp_ltz, event_id bigint, text_hash bigint"
    runs = [[(1, 1, 1), (2, 2, 1)], [(1, 3, 1), (2, 4, 5)], [(1, 5, 7)]]
    for day, rows in enumerate(runs, 1):
        stamped = [(s, dt.datetime(2024, 1, day), e, h) for s, e, h in rows]
        spark.createDataFrame(stamped, schema).coalesce(1).write.mode("append").parquet(landing)
        feed.consume(watch.watch_changes(spark.readStream.schema(schema).parquet(landing)), out, state)
    kinds = {r.event_id: r.kind for r in spark.read.schema(watch.OUTPUT).parquet(out).collect()}
    assert kinds == {1: "source_discovered", 2: "source_discovered", 3: "same", 4: "source_changed", 5: "source_changed"}


def test_silence_stream_agrees_with_the_batch_form(spark, inputs, data):
    from __spark_entry__ import queries

    streamed = {r.evaluated_at: r.successful_sources for r in queries()["j09_silence_stream"](spark, data).collect()}
    batch = {r.evaluated_at: r.successful_sources for r in queries()["j09_silence_windows"](spark, data).collect()}
    shared = [k for k in streamed if k in batch]
    assert len(shared) > 100 and all(abs(streamed[k] - batch[k]) <= 1 for k in shared)


def test_contents_are_checked_and_named_by_hash(spark):
    path = shared_dir(spark, "contents")
    blobs = spark.createDataFrame([("ehdot",)], "text string").select(
        F.sha2("text", 256).alias("sha256"), "text", F.encode("text", "UTF-8").alias("original"), F.lit("application/pdf").alias("media_type"))
    row = export.write_contents(blobs, path).first()
    assert open(os.path.join(path, row.original_file), "rb").read() == b"ehdot" and row.original_file.endswith(".pdf")
    with pytest.raises(Exception, match="checksum"):
        export.write_contents(blobs.withColumn("sha256", F.lit("0" * 64)), shared_dir(spark, "contents"))


def test_indexes_are_escaped_and_keep_empty_notices(spark):
    rows = spark.createDataFrame([
        ("n1", "A <b>", 1, 1, "https://e.org/?a=1&b=2", "failed", "not_extracted", None, "Timeout", None),
        ("n1", "A <b>", 2, 0, "https://e.org/0", "fetched", "extracted", "abc", None, None), ("n2", "Empty", None, None, None, None, None, None, None, None)],
        "opportunity_id string, title string, document_id bigint, depth int, url string, state string, extraction_status string, current_sha256 string, error string, limitation string")
    path = shared_dir(spark, "calls")
    export.write_indexes(export.index_fragments(rows), path, partitions=2)
    files = sorted(os.listdir(path))
    text = "".join(open(os.path.join(path, f), encoding="utf-8").read() for f in files)
    assert {f.split(".")[0] for f in files} == {"n1", "n2"} and "A &lt;b&gt;" in text and "a=1&amp;b=2" in text
    assert text.index("https://e.org/0") < text.index("a=1&amp;b=2") and "ei ole vielä aloitettu" in text and "Puute: Timeout" in text


def test_csv_starts_with_a_mark_and_escapes_formulas(spark):
    path = shared_dir(spark, "csv")
    row = spark.createDataFrame([('=HYPERLINK("https://evil.test")', " x ", 1)], "title string, b string, c int")
    export.write_csv(row.coalesce(1), path, ["title", "b"], bom=True)
    part = next(f for f in os.listdir(path) if f.startswith("part"))
    lines = open(os.path.join(path, part), encoding="utf-8").read().splitlines()
    assert lines[0] == "\ufefftitle,b" and lines[1] == '"\'=HYPERLINK(""https://evil.test"")", x '


def test_transfer_refuses_a_used_target_and_another_version(spark):
    target = shared_dir(spark, "target")
    tables = {"t": spark.range(5)}
    assert export.transfer(tables, target, "0007", "0007") == {"t": True}
    with pytest.raises(ValueError, match="not empty"):
        export.transfer(tables, target, "0007", "0007")
    with pytest.raises(ValueError, match="versions differ"):
        export.transfer(tables, shared_dir(spark, "target"), "0007", "0006")


def test_registry_export_never_claims_completeness(spark):
    view = notice_rows(spark)
    facts = export.export_registry(view, spark.createDataFrame([("s",)], "id string"), shared_dir(spark, "export"), "0007", T1).first()
    assert facts.counts == {"opportunities": 4, "sources": 1} and facts.completeness_verified is False


def test_missing_attachment_and_bodies(spark):
    from noticegrid.functions import links

    rows = spark.createDataFrame([("https://e.org/f", {"question": ["Q"], "answer": ["<p>&nbsp;</p>"], "nid": ["12"]}, "extracted", [], [])],
                                 "url string, metadata map<string,array<string>>, status string, flags array<string>, links array<struct<url:string,title:string,role:string,follow:boolean,parser:string>>")
    row = links.faq_completeness(rows).first()
    assert row.status == "partial_text" and row.links[0].follow and row.links[0].parser == "eu_faq_detail"
