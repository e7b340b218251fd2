"""Small literal cases with known answers."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from noticegrid.functions import codes, dates, fixed, html, links, text, urls
from noticegrid.functions import record as rec


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def label(spark, value, zone="Europe/Helsinki"):
    return one(spark, d=dates.dates_in_label(F.lit(value), zone)).d


def test_date_only_expiry_follows_daylight_saving(spark):
    def expiry(day):
        return one(spark, e=dates.expires_at(F.lit(day).cast("date"), F.lit(None).cast("timestamp_ntz"), F.lit("Europe/Helsinki"))).e

    assert expiry("2026-06-30") == dt.datetime(2026, 6, 30, 21)
    assert expiry("2026-12-31") == dt.datetime(2026, 12, 31, 22)


def test_two_stages_take_the_later_and_invent_no_time(spark):
    stages = F.array(dates.due(F.lit("2026-09-30"), "Europe/Helsinki"), dates.due(F.lit("2027-02-15T17:00:00+01:00")))
    rows = rec.record(spark.range(1), external_id=F.lit("C"), canonical_url=F.lit("https://example.org/1"), title=F.lit("T"),
                      deadlines=stages, deadline_model=F.lit("two-stage"))
    row = rec.enrich(rows).first()
    assert row.deadline_on == dt.date(2027, 2, 15) and row.deadline_at == dt.datetime(2027, 2, 15, 16)
    assert row.deadlines[0].due_at is None and "stage_access_must_be_checked" in row.quality_flags


def test_unknown_zone_is_flagged_and_read_as_utc(spark):
    due = dates.due(F.lit("2026-06-30"), "UTC (source offset)")
    rows = rec.record(spark.range(1), external_id=F.lit("C"), canonical_url=F.lit("https://example.org/1"), title=F.lit("T"), deadlines=F.array(due))
    row = rec.enrich(rows).first()
    assert "deadline_timezone_needs_review" in row.quality_flags
    assert row.deadline_expires_at == dt.datetime(2026, 7, 1)


def test_explicit_zones_are_kept(spark):
    found = label(spark, "Call closes: 30 September 2026, 17.00 CEST", "Europe/Brussels")
    assert found[0].due_at == dt.datetime(2026, 9, 30, 15) and found[0].original.startswith("Call closes")
    assert label(spark, "2026-09-27 23:00: CET", "Europe/Brussels")[0].due_at == dt.datetime(2026, 9, 27, 22)
    assert label(spark, "Deadline 18 June 2026", "Europe/Brussels")[0].due_at is None
    assert label(spark, "Every September") == [] and label(spark, "1.–15.9.") == []


def test_short_ranges(spark):
    assert [d.due_on for d in label(spark, "18.2.-11.3.2026")] == [dt.date(2026, 2, 18), dt.date(2026, 3, 11)]
    assert len(label(spark, "18.12.-11.3.2026")) == 1


def test_listing_days_are_local(spark):
    assert one(spark, d=dates.published_day(F.lit("2026-09-08T21:00:00Z"))).d == dt.date(2026, 9, 9)
    assert one(spark, d=dates.published_day(F.lit("2026-09-08"))).d == dt.date(2026, 9, 8)
    assert one(spark, t=dates.parse_time(F.lit("2023-09-20T17:00:00.000+0000"))).t == dt.datetime(2023, 9, 20, 17)
    assert one(spark, t=dates.has_time_without_offset(F.lit("2023-09-20T17:00:00"))).t is True


def test_identity_urls(spark):
    def canonical(url):
        return one(spark, u=urls.canonical_url(F.lit(url))).u

    assert canonical("HTTPS://Example.org/calls/1/?utm_source=t#page") == "https://example.org/calls/1"
    assert canonical("https://example.org?b=2&a=1&c=") == "https://example.org/?a=1&b=2"
    assert canonical("https://example.org/x?q=a+b%2Fc&z=%C3%A4*~") == "https://example.org/x?q=a+b%2Fc&z=%C3%A4%2A~"
    for bad in ("ftp://example.org/", "https://user:pw@example.org/", "https:///x", "not a url"):
        assert canonical(bad) is None
    a, b = (one(spark, i=urls.notice_id(F.lit(u))).i for u in ("https://example.org/calls/1/?utm_source=t#page", "https://example.org/calls/1"))
    assert a == b == str(uuid.uuid5(uuid.NAMESPACE_URL, "https://example.org/calls/1"))


@pytest.mark.parametrize("href,expected", [
    ("../annex.pdf?b=2&a=&fbclid=9#p2", "https://example.org/calls/annex.pdf?b=2&a="),
    ("/rules", "https://example.org/rules"), ("//Other.org/x", "https://other.org/x"),
    ("./a/../b/", "https://example.org/calls/2026/b/"), ("?page=2", "https://example.org/calls/2026/index.html?page=2"),
    ("https://example.org/x?a=1&amp;b=2", "https://example.org/x?a=1&b=2"), ("mailto:a@example.org", None), ("javascript:void(0)", None),
])
def test_document_urls(spark, href, expected):
    base = F.lit("https://example.org/calls/2026/index.html")
    assert one(spark, u=urls.document_url(F.lit(href), base)).u == expected


def test_literal_search_and_case_folding(spark):
    rows = spark.createDataFrame([("Ääkköset",), ("100 % grant",), ("Straße",)], "t string")
    def hits(q):
        return rows.filter(text.contains_folded(F.col("t"), q)).count()
    assert hits("ÄÄKKÖSET") == 1 and hits("%") == 1 and hits("_") == 0 and hits("STRASSE") == 1


def test_status_words_amounts_and_cells(spark):
    row = one(spark, w=codes.status_word(F.lit(" Päättynyt ")), u=codes.status_word(F.lit("ehkä")),
              a=codes.amount(F.lit("1\u00a0200 000,50")), b=codes.amount(F.lit("ei")), c=codes.safe_cell(F.lit('=HYPERLINK("x")')),
              d=codes.safe_cell(F.lit("\t+1")), e=codes.safe_cell(F.lit("a=b")))
    assert (row.w, row.u, float(row.a), row.b) == ("closed", "unknown", 1200000.5, None)
    assert row.c.startswith("'=") and row.d.startswith("'\t") and row.e == "a=b"


def test_accordions_and_hidden_parts(spark):
    page = '<main><nav>Menu</nav><template><p>Only  cities &amp; towns</p></template><script>x()</script><p>Body<!-- c -->text</p></main>'
    row = one(spark, s=html.semantic_text(F.lit(page)), c=html.clean_html(F.lit(page)), p=html.clean_html(F.lit(" plain &amp; ")))
    assert row.s == "Only cities & towns\nBody\ntext"
    assert "Only" not in row.c and row.c.startswith("Menu") and row.p == "plain &amp;"


def policy(spark, page, url="https://example.org/call"):
    df = spark.createDataFrame([(url, page)], "url string, html string").select("url", html.document_part(F.col("html")).alias("p")).select("url", "p.*")
    found = links.one_per_target(links.policy_links(df, "links", "url", "url"), "url")
    return {r.target_url: r for r in found.collect()}


def test_link_policy(spark):
    found = policy(spark, '''<main><p>Long call text.</p><template><a href="/rules">Conditions and guidelines</a></template>
      <a href="/about">About us</a><a href="/privacy">Privacy terms</a><a href="/budget.xlsm">Budget</a>
      <p>Complete funding conditions are available <strong><a href="/item/73">here</a></strong>.</p>
      <p>Our organisation: <a href="/org">here</a>.</p><img src="/uploads/Call-calendar-1.png" alt="Calendar"><img src="/logo.png" alt="Logo"></main>''')
    base = "https://example.org"
    assert {u for u, r in found.items() if r.follow} == {
        base + "/rules", base + "/budget.xlsm", base + "/item/73", base + "/uploads/Call-calendar-1.png"}
    assert found[base + "/uploads/Call-calendar-1.png"].role == "required_section"
    assert found[base + "/budget.xlsm"].role == "attachment" and "funding conditions" in found[base + "/item/73"].title
    assert not found[base + "/privacy"].follow and base + "/logo.png" not in found


def test_json_lines_reach_nested_json_and_addresses(spark):
    doc = '{"a": [1, {"b": "{\\"c\\": \\"see https://example.org/x.\\"}"}], "url": "https://example.org/d", "text": "Doc", "e": [], "h": "<p>Hi <a href=\\"/t\\">t</a></p>"}'
    row = one(spark, j=html.json_lines(F.lit(doc))).j
    assert row.text.split("\n")[:3] == ["a[0]: 1", "a[1].b.c: see https://example.org/x.", "url: https://example.org/d"]
    assert "e: []" in row.text and "h: Hi\nt" in row.text
    assert [(li.href, li.label) for li in row.links] == [
        ("https://example.org/d", "Doc"), ("https://example.org/x", "a[1].b.c"), ("https://example.org/d", "url"), ("/t", "t")]


def test_chunks_are_the_whole_text(spark):
    row = one(spark, c=text.chunks(F.lit("abcdefg"), 3), e=text.chunks(F.lit(""), 3))
    assert [(p.part_number, p.text) for p in row.c] == [(1, "abc"), (2, "def"), (3, "g")] and row.e == []


def test_record_rules(spark):
    rows = rec.record(spark.range(1), external_id=F.lit(""), canonical_url=F.lit("https://example.org/1"), title=F.lit("x" * 1001),
                      funding_rate=F.lit(101), record_kind=F.lit("tender"))
    found = rows.select(rec.problems(set(rows.columns)).alias("p")).first().p
    assert found == ["external_id: required", "title: longer than 1000", "record_kind: not an allowed value", "funding_rate: above 100"]


def test_last_tag_wins(spark):
    tags = F.array(*(F.struct(F.lit("theme").alias("kind"), F.lit(v).alias("value"), F.lit(b).alias("basis")) for v, b in (("A", "source"), ("B", "source"), ("A", "rule"))))
    assert [(t.value, t.basis) for t in one(spark, t=rec.last_tag_wins(tags)).t] == [("A", "rule"), ("B", "source")]


def test_fixed_tables_are_consistent():
    assert set(fixed.STATUS_WORDS.values()) <= set(fixed.SOURCE_STATUSES)
    assert set(fixed.STATUS_RANK) == set(fixed.SOURCE_STATUSES)
