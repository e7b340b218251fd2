"""Landed sources, streams and sinks. Landed files are derived from the test tables first."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticegrid.functions import text, urls
from noticegrid.functions import record as rec
from noticegrid.operators import aggregates as agg
from noticegrid.operators import lookups, priorities, reconcile, registry
from noticegrid.plans.registry import SHARED, query
from noticegrid.plans.registry_queries import GROUPS, GROUP_SQL, base, flagged_contents, view
from noticegrid.plans.views import AS_OF
from noticegrid.session import shared_dir
from noticegrid.sinks import export
from noticegrid.sources import config as conf
from noticegrid.sources import landed, listing, pages, registry as adapters, search
from noticegrid.streaming import feed, watch


PAGE_LINES = 500  # bodies in a file where each lists about 100 notices


def landed_lines(r, df, column="body", lines=20_000):
    """Write derived response bodies as text files, one body per line, and give their folder.

    Compressed text cannot be split, so no file has more than ``lines`` bodies.
    """
    path = shared_dir(r.spark, "landed")
    df.select(column).write.option("maxRecordsPerFile", lines).text(path, compression="gzip")
    return path


def iso(stamp):
    return F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'.000Z'")


# --- A01 ------------------------------------------------------------------------------------
def listing_pages(r):
    """Listing pages of 100 neighbouring keys; the advertised total is the page's own row count."""
    lang = F.struct(F.col("title").alias("fi"), F.lit(None).cast("string").alias("sv"), F.lit("x").alias("en"))
    row = F.struct(
        F.col("external_id").alias("hakuasianAsianumero"), lang.alias("nimi"),
        F.struct(F.lit("").alias("fi"), F.lit(None).cast("string").alias("sv"), F.col("description").alias("en")).alias("kuvaus"),
        iso(F.col("opens_on").cast("timestamp_ntz") + F.expr("INTERVAL '21' HOUR")).alias("hakuAlkaaDateTimeUtc"),
        iso(F.col("deadline_at")).alias("hakuPaattyyDateTimeUtc"),
        F.when(F.col("source_status") == "rolling", "Jatkuva").otherwise("Kertaluontoinen").alias("hakuTyyppi"),
        F.struct(F.struct(F.col("funder").alias("fi")).alias("nimi")).alias("vastuullinenJarjestajaOrganisaatio"))
    grouped = r.fx_opportunities.groupBy(F.floor(F.col("id") / 100).cast("int").alias("pageNo")).agg(
        F.count(F.lit(1)).alias("totalCount"), F.lit(1).alias("pageCount"), F.collect_list(row).alias("hakuilmoitukset"))
    return grouped.select(F.to_json(F.struct("pageNo", "totalCount", "pageCount", "hakuilmoitukset")).alias("body"))


@query("a01_paged_listing", f"""
SELECT external_id, floor(id / 100)::INT AS page, title, description, funder,
  CAST(((CAST(opens_on AS TIMESTAMP) + INTERVAL '21' HOUR) AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Helsinki' AS DATE) AS opens_on,
  CAST((deadline_at AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Helsinki' AS DATE) AS due_on, deadline_at AS due_at,
  CASE WHEN deadline_at < TIMESTAMP '{AS_OF}' THEN 'closed' WHEN opens_on + 1 > DATE '{AS_OF[:10]}' THEN 'forthcoming' WHEN source_status = 'rolling' THEN 'rolling' ELSE 'open' END AS source_status
FROM fx_opportunities""")
def _(r):
    read = landed.read_json(r.spark, landed_lines(r, listing_pages(r), lines=PAGE_LINES), landed.LISTING)
    rows = listing.paged_records(listing.paged_rows(read), r.as_of)
    first = F.try_element_at("deadlines", F.lit(1))
    return rows.select("external_id", "page", "title", "description", "funder", "opens_on", first["due_on"].alias("due_on"), first["due_at"].alias("due_at"), "source_status")


# --- A02 ------------------------------------------------------------------------------------
def embedded_pages(r, start=None, end=None):
    """HTML pages with a percent-encoded payload of about 100 notices and their code lists."""
    start = F.col("opens_on").cast("string") if start is None else start
    end = F.col("deadline_on").cast("string") if end is None else end
    row = F.struct(
        F.col("id").cast("string").alias("id"),
        F.element_at(F.array(*map(F.lit, ("avoin", "tulossa", "paattynyt", "muu"))), (F.col("id") % 4).cast("int") + 1).alias("tila"),
        F.struct(start.alias("alku"), end.alias("loppu")).alias("hakuaika"),
        F.col("title").alias("otsikko"), F.concat(F.col("description"), F.lit(" + 100% ääkköset")).alias("kuvaus"), F.lit("EAKR").alias("rahasto"),
        (F.col("id") % 3).cast("string").alias("viranomainen"), F.lit("ALUE").alias("alue"),
        F.array((F.col("id") % 5).cast("string")).alias("maakunnat"),
        F.concat(F.lit("1 "), F.col("id") % 900 + 100, F.lit(",50")).alias("kokonaistuki"))
    def named(name):
        return F.struct(F.lit(name).alias("fi"))
    codes = F.struct(
        F.create_map(F.lit("0"), named("Pirkanmaa"), F.lit("1"), named("Uusimaa")).alias("maakunta"),
        F.create_map(F.lit("0"), named("Liitto"), F.lit("1"), named("Keskus")).alias("viranomainen"))
    grouped = r.fx_opportunities.groupBy(F.floor(F.col("id") / 100).alias("page")).agg(F.collect_list(row).alias("hankehaku"))
    data = F.to_json(F.struct(F.struct(F.col("hankehaku"), codes.alias("koodisto")).alias("preRenderData")))
    quoted = F.replace(F.url_encode(data), F.lit("+"), F.lit("%20"))
    return grouped.select(F.concat(F.lit("<html><head><script>var a=1;</script></head><body><script>"), quoted, F.lit("</script></body></html>")).alias("html"))


@query("a02_embedded_listing", """
SELECT CAST(id AS VARCHAR) AS external_id, title, description || ' + 100% ääkköset' AS description,
  CASE id % 3 WHEN 0 THEN 'Liitto' WHEN 1 THEN 'Keskus' ELSE '2' END AS funder, CASE id % 5 WHEN 0 THEN 'pirkanmaa' ELSE 'other_region' END AS geographic_scope,
  CASE id % 5 WHEN 0 THEN 'Pirkanmaa' WHEN 1 THEN 'Uusimaa' ELSE CAST(id % 5 AS VARCHAR) END AS region,
  CASE id % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'forthcoming' WHEN 2 THEN 'closed' ELSE 'unknown' END AS source_status,
  CAST(1000 + id % 900 + 100 + 0.5 AS DOUBLE) AS total_budget, opens_on, deadline_on AS due_on FROM fx_opportunities""")
def _(r):
    read = r.spark.read.text(landed_lines(r, embedded_pages(r), "html", PAGE_LINES)).withColumnRenamed("value", "html")
    rows = listing.embedded_records(listing.embedded_rows(read))
    return rows.select(
        "external_id", "title", "description", "funder", "geographic_scope", F.element_at("tags", 1)["value"].alias("region"), "source_status",
        F.col("total_budget").cast("double").alias("total_budget"), "opens_on", F.try_element_at("deadlines", F.lit(1))["due_on"].alias("due_on"))


# --- A03, A13, E11 --------------------------------------------------------------------------
def search_documents(r):
    """Several variants per topic: every event is a raw document about its user."""
    k = F.col("event_id")
    topic = F.concat(F.lit("HORIZON-"), F.col("user_id"))
    kind = F.when(k % 50 == 0, "2").when(F.col("user_id") % 10 == 3, "8").otherwise("1")
    return r.events.select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("reference"), F.lit("https://data.example.org/t").alias("url"),
        F.concat(F.lit("Call by "), "event_type").alias("content"), F.lit("").alias("summary"),
        F.map_from_arrays(
            F.array(*map(F.lit, ("type", "identifier", "callccm2Id", "title", "status", "deadlineDate", "DATASOURCE", "esDA_QueueDate"))),
            F.array(
                F.array(kind), F.array(topic), F.array(F.col("user_id").cast("string")), F.array(F.concat(F.lit("Topic "), F.col("user_id"))),
                F.array(F.concat(F.lit("3109450"), k % 4)), F.array(F.date_format(F.date_trunc("day", "ts"), "yyyy-MM-dd'T'HH:mm:ss'.000+0000'")),
                F.array(F.when(k % 2 == 0, "SEDIA").otherwise("MIRROR")), F.array(F.date_format("ts", "yyyy-MM-dd")))).alias("metadata"))


SHARED["ox_variants"] = """
SELECT user_id, event_id, event_type, ts, CASE WHEN user_id % 10 = 3 THEN 'cascade:' || CAST(user_id AS VARCHAR) ELSE 'HORIZON-' || CAST(user_id AS VARCHAR) END AS topic FROM events WHERE event_id % 50 <> 0"""
SHARED["ox_preferred"] = """
SELECT topic AS external_id, CASE WHEN starts_with(topic, 'cascade:') THEN 'Call by ' || event_type ELSE 'Topic ' || CAST(user_id AS VARCHAR) END AS title, 'Call by ' || event_type AS description,
  CASE event_id % 4 WHEN 1 THEN 'forthcoming' WHEN 2 THEN 'open' WHEN 3 THEN 'closed' ELSE 'unknown' END AS source_status, date_trunc('day', ts)::TIMESTAMP AS due_at, variants, conflict
FROM (SELECT *, COUNT(*) OVER (PARTITION BY topic) AS variants, MIN(CAST(ts AS DATE)) OVER (PARTITION BY topic) <> MAX(CAST(ts AS DATE)) OVER (PARTITION BY topic) AS conflict,
  ROW_NUMBER() OVER (PARTITION BY topic ORDER BY event_id % 2 = 0 DESC, CAST(ts AS DATE) DESC, event_id DESC) AS rn FROM ox_variants) WHERE rn = 1"""


def search_result(rows):
    return rows.select("external_id", "title", "description", "source_status", F.element_at("deadlines", 1)["due_at"].alias("due_at"), "variants", "conflict")


@query("a03_search_documents", "SELECT * FROM ox_preferred")
def _(r):
    # Every third line writes its type as a plain string; a line cut short is rejected.
    body = F.to_json(F.struct("*"))
    plain = F.when(F.col("reference").endswith("3"), F.regexp_replace(body, r'"type":\["(\w+)"\]', '"type":"$1"')).otherwise(body)
    lines = search_documents(r).select(plain.alias("body")).unionByName(r.region.select(F.lit('{"reference": "cut').alias("body")))
    read, _unreadable = landed.read_search(r.spark, landed_lines(r, lines))
    accepted, _rejected = search.split_identities(read)
    return search_result(search.search_records(search.preferred_variants(accepted)))


@query("a03_search_rejects", "SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS reference, 'Not a supported funding topic type' AS reason FROM events WHERE event_id % 50 = 0")
def _(r):
    _accepted, rejected = search.split_identities(search_documents(r))
    return rejected.select("reference", "reason")


def stored_items(r):
    """Stored evidence: documents of one topic and day in one raw JSON text."""
    grouped = search_documents(r).withColumn("_day", F.col("metadata")["esDA_QueueDate"][0]).groupBy(
        F.col("metadata")["identifier"][0].alias("external_id"), "_day").agg(F.collect_list(F.struct("reference", "url", "content", "summary", "metadata")).alias("documents"))
    return grouped.select("external_id", F.to_json(F.struct("documents")).alias("raw_json"))


@query("a13_reread_evidence", "SELECT * FROM ox_preferred")
def _(r):
    accepted, _rejected = search.split_identities(search.reread(stored_items(r)))
    return search_result(search.search_records(search.preferred_variants(accepted)))


@query("e11_raw_variants", "SELECT COUNT(*) AS raw_documents FROM events")
def _(r):
    count = F.json_array_length(F.get_json_object("raw_json", "$.documents"))
    return stored_items(r).agg(F.sum(count).alias("raw_documents"))


# --- A04, A05 -------------------------------------------------------------------------------
def posts(r):
    k = F.col("page_id")
    def block(name, value):
        return F.concat(F.lit(f'<div class="single-meta--{name}"><p class="single-meta__data">'), value, F.lit("</p></div>"))
    body = F.concat(
        F.when(k % 7 == 0, "").otherwise(F.concat(
            block("program", F.lit("Tuottavuus")), block("start-datetime", F.concat((k % 28 + 1).cast("string"), F.lit(".6.2026 12:00"))),
            block("end-datetime", F.concat((k % 28 + 1).cast("string"), F.lit(".9.2026 12:00"))), block("status", F.when(k % 2 == 0, "Avoinna").otherwise("Päättynyt")))),
        F.lit("<p>Deadline for applications: 8 July 2026 (17.00 CET)</p><p>Deadline for startups: 14 September 2026</p>"), F.col("html"))
    statuses = F.when(k % 6 == 5, F.array(F.lit(500), F.lit(501))).when(k % 6 == 4, F.array().cast("array<int>")).otherwise(
        F.array(F.when(k % 2 == 0, 500).otherwise(501)))
    link = F.concat(F.lit("https://www.example.org/post/"), k)
    return r.pages.select(
        k.alias("id"), F.when(k % 11 == 0, "page").otherwise("funding_request").alias("type"), F.lit("publish").alias("status"), link.alias("link"),
        F.lit("2026-01-01T00:00:00").alias("modified_gmt"), F.struct(F.concat(F.lit("Post &amp; <b>call</b> "), k).alias("rendered")).alias("title"),
        F.struct(body.alias("rendered")).alias("content"), statuses.alias("status_ids"))


@query("a04_post_metadata", """
SELECT page_id AS id, CASE WHEN page_id % 11 = 0 THEN 'Not a published funding request' WHEN page_id % 7 = 0 THEN 'Funding metadata missing; parser review required' END AS reason,
  'Post &' || chr(10) || 'call' || chr(10) || CAST(page_id AS VARCHAR) AS title, CASE WHEN page_id % 7 = 0 THEN '' ELSE 'Tuottavuus' END AS programme,
  CASE WHEN page_id % 7 = 0 THEN 'unknown' WHEN page_id % 2 = 0 THEN 'open' ELSE 'closed' END AS source_status,
  CASE WHEN page_id % 7 <> 0 THEN make_date(2026, 6, page_id % 28 + 1) END AS opens_on,
  CASE WHEN page_id % 7 <> 0 THEN make_timestamp(2026, 9, page_id % 28 + 1, 9, 0, 0) END AS due_at FROM pages""")
def _(r):
    path = landed_lines(r, posts(r).select(F.to_json(F.struct("*")).alias("body")))
    rows = pages.post_records(landed.read_json(r.spark, path, landed.POST), {"post_type": "funding_request", "funder": "Sitra"})
    return rows.select("id", "reason", "title", "programme", "source_status", "opens_on", F.try_element_at("deadlines", F.lit(1))["due_at"].alias("due_at"))


@query("a05_post_calls", """
SELECT page_id AS id, CASE WHEN page_id % 11 = 0 THEN 'Duplicate or unsupported WordPress record' WHEN page_id % 6 = 5 THEN 'Conflicting WordPress call statuses' END AS reason,
  CASE WHEN page_id % 6 = 4 THEN 'unknown' WHEN page_id % 6 = 5 THEN 'closed' WHEN page_id % 2 = 0 THEN 'open' ELSE 'closed' END AS source_status,
  DATE '2026-07-08' AS due_on, TIMESTAMP '2026-07-08 16:00:00' AS due_at FROM pages""")
def _(r):
    # The taxonomy is a fixed list of terms; the posts come from the pages.
    taxonomy = r.spark.createDataFrame([(500, "Open call"), (501, "Closed call")], "id int, name string")
    rows = pages.post_calls(posts(r), taxonomy, {"name": "Mobility", "post_type": "funding_request"})
    first = F.try_element_at("deadlines", F.lit(1))
    return rows.select("id", "reason", "source_status", first["due_on"].alias("due_on"), first["due_at"].alias("due_at"))


# --- A06, A07, A09 --------------------------------------------------------------------------
CATALOGUE = {"name": "Nordic", "selector": "body", "card_selector": "nav li", "link_selector": "a", "exclude_title": "^the", "language": "en"}


@query("a06_catalogue_cards", """
SELECT DISTINCT a.page_id, CASE WHEN rtrim(a.href, '/') = '' THEN lower(u.scheme) || '://' || u.host || '/' ELSE lower(u.scheme) || '://' || u.host || rtrim(a.href, '/') END AS target,
  arg_min(a.label, a.position) AS title FROM ox_anchors a JOIN ox_page_urls u ON u.page_id = a.page_id
WHERE a.label <> '' AND NOT starts_with(lower(a.label), 'the') GROUP BY ALL""")
def _(r):
    cards = pages.catalogue_cards(r.pages, CATALOGUE)
    return cards.groupBy("page_id", "target").agg(F.min_by("title", "position").alias("title"))


@query("a06_catalogue_records", """
WITH c AS (SELECT lower(u.scheme) || '://' || u.host || rtrim(a.href, '/') AS target, a.page_id, a.label, ROW_NUMBER() OVER (PARTITION BY a.page_id, a.href ORDER BY a.position) AS rn
  FROM ox_anchors a JOIN ox_page_urls u ON u.page_id = a.page_id WHERE a.label <> '' AND NOT starts_with(lower(a.label), 'the'))
SELECT target AS external_id, arg_min(label, page_id) AS title, COUNT(*) AS listings, COUNT(DISTINCT label) > 1 AS conflict, 'unknown' AS source_status FROM c WHERE rn = 1 GROUP BY target""")
def _(r):
    cards = pages.distinct_cards(pages.catalogue_cards(r.pages, CATALOGUE))
    return pages.catalogue_records(cards, CATALOGUE).select("external_id", "title", "listings", "conflict", "source_status")


@query("a07_configured_pages", """
WITH e AS (SELECT canonical, MIN(page_id) AS k FROM ox_page_ids GROUP BY canonical)
SELECT p.page_id, CASE WHEN e.k % 2 = 0 THEN 'Scheme ' || e.k ELSE trim(replace(regexp_extract(p.html, '<h1>([^<]*)</h1>', 1), '&amp;', '&')) END AS title,
  CASE WHEN e.k % 3 = 0 THEN 'call' ELSE 'funding_scheme' END AS record_kind, p.canonical AS external_id
FROM ox_page_ids p JOIN e ON e.canonical = p.canonical WHERE length(regexp_replace(regexp_extract(p.html, '(?s)<article>.*</article>'), '<[^<>]*>', '', 'g')) > 130""")
def _(r):
    # One entry per address, written with another fragment or a tracking parameter than the page has.
    one = r.pages.groupBy(urls.canonical_url(F.col("url")).alias("key")).agg(F.min_by(F.struct("page_id", "url"), "page_id").alias("e"))
    k, url = F.col("e.page_id"), F.regexp_replace("e.url", "#.*", "#other")
    entries = one.select(
        F.when(url.contains("?") & ~url.contains("#"), F.concat(url, F.lit("&utm_campaign=x"))).otherwise(url).alias("url"),
        F.when(k % 2 == 0, F.concat(F.lit("Scheme "), k)).alias("title"), F.when(k % 3 == 0, "call").otherwise("funding_scheme").alias("record_kind"))
    rows = pages.configured_pages(r.pages, entries, {"name": "Schemes", "selector": "article"})
    return rows.select("page_id", "title", "record_kind", "external_id")


@query("a09_watched_pages", """
SELECT page_id, sha256(t) AS text_hash, CASE WHEN length(t) < 100 THEN 'Page content too short; possible error or bot challenge' END AS reason
FROM (SELECT page_id, string_agg(piece, chr(10) ORDER BY pos) FILTER (WHERE piece <> '') AS t FROM (SELECT page_id, pos, trim(replace(replace(replace(replace(p, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), ' ' || chr(9) || chr(10) || chr(13)) AS piece
  FROM (SELECT page_id, unnest(string_split_regex(art, '<[^<>]*>')) AS p, generate_subscripts(string_split_regex(art, '<[^<>]*>'), 1) AS pos FROM (
    SELECT page_id, regexp_replace(regexp_extract(html, '(?s)<article>.*</article>'), '(?s)<!--.*?-->', '<i>', 'g') AS art FROM pages))) GROUP BY page_id)""")
def _(r):
    return pages.watched_pages(r.pages).select("page_id", "text_hash", "reason")


# --- A08, A10, A11, A12 ---------------------------------------------------------------------
@query("a08_expert_import", """
SELECT external_id, canonical_url, title, funder, 'unknown' AS source_status, 'manual' AS detail_level, CAST(1 AS INT) AS flags FROM fx_opportunities""")
def _(r):
    line = F.to_json(F.struct(
        "external_id", "canonical_url", "title", "funder", "programme", F.lit("unknown").alias("source_status"), F.lit("manual").alias("detail_level"),
        F.array(F.lit("expert_entry")).alias("quality_flags")))
    path = landed_lines(r, r.fx_opportunities.select(line.alias("body")))
    rows = conf.import_records(landed.read_json(r.spark, path, landed.RECORD_LINE))
    return rows.select("external_id", "canonical_url", "title", "funder", "source_status", "detail_level", F.size("quality_flags").alias("flags"))


def faq_pages(r):
    """FAQ pages of 50 entries; every seventh entry is listed again on the next page."""
    k = F.col("p_partkey")
    entry = F.struct(
        F.concat(F.lit("FAQ-"), k).alias("reference"), F.concat(F.lit("https://faq.example.org/"), k).alias("url"),
        F.create_map(F.lit("question"), F.array("p_name"), F.lit("keyword"), F.array(F.concat(F.lit(" topic-"), k, F.lit(" ")), F.lower("p_brand"))).alias("metadata"))
    page = F.floor(k / 50).cast("int")
    rows = r.part.select(F.explode(F.when(k % 7 == 0, F.array(page, page + 1)).otherwise(F.array(page))).alias("page_no"), entry.alias("e"))
    grouped = rows.groupBy("page_no").agg(F.collect_list("e").alias("results"), F.count(F.lit(1)).alias("totalResults"))
    return grouped.select(F.to_json(F.struct("page_no", F.lit("1998-06-30T12:00:00").alias("checked_at"), "totalResults", "results")).alias("body"))


@query("a10_faq_entries", """
SELECT 'FAQ-' || CAST(p_partkey AS VARCHAR) AS reference, 'https://faq.example.org/' || CAST(p_partkey AS VARCHAR) AS url, p_name AS question,
  'TOPIC-' || CAST(p_partkey AS VARCHAR) || ',' || upper(p_brand) AS keywords, CAST(p_partkey // 50 AS INT) AS page_no FROM part""")
def _(r):
    read = landed.read_json(r.spark, landed_lines(r, faq_pages(r), lines=PAGE_LINES), landed.FAQ_PAGE)
    return conf.faq_entries(read).select("reference", "url", "question", F.array_join("keywords", ",").alias("keywords"), "page_no")


@query("a10_faq_manifest", "SELECT COUNT(*) AS entries, COUNT(*) AS expected, true AS complete FROM part")
def _(r):
    # The snapshot's manifest is landed beside its pages, which list some entries twice.
    manifest = r.part.agg(F.count(F.lit(1)).alias("unique_entries")).select(F.to_json(F.struct("unique_entries")).alias("body"))
    read = landed.read_json(r.spark, landed_lines(r, faq_pages(r), lines=PAGE_LINES), landed.FAQ_PAGE)
    return conf.manifest_check(conf.faq_entries(read), landed.read_json(r.spark, landed_lines(r, manifest), "unique_entries bigint"))


@query("a11_synced_sources", """
SELECT 'src-' || CAST(r_regionkey AS VARCHAR) AS id, CASE WHEN r_regionkey = 4 THEN r_name ELSE 'New ' || r_name END AS name,
  CASE WHEN r_regionkey = 4 THEN 'manual' ELSE 'catalogue' END AS adapter, CASE r_regionkey WHEN 1 THEN 'partial' WHEN 2 THEN 'failed' ELSE 'success' END AS health FROM region
UNION ALL SELECT 'src-new-' || CAST(r_regionkey AS VARCHAR), r_name, 'page_watch', 'not_run' FROM region""")
def _(r):
    listed = r.region.filter("r_regionkey <> 4").select(F.concat(F.lit("src-"), "r_regionkey").alias("id"), F.concat(F.lit("New "), "r_name").alias("name"), F.lit("catalogue").alias("adapter"))
    fresh = r.region.select(F.concat(F.lit("src-new-"), "r_regionkey").alias("id"), F.col("r_name").alias("name"), F.lit("page_watch").alias("adapter"))
    entries = listed.unionByName(fresh).withColumn("enabled", F.lit(True))
    return conf.sync_sources(r.fx_sources, entries, ("name", "adapter", "enabled")).select("id", "name", "adapter", "health")


@query("a12_rule_groups", " UNION ALL ".join(f"SELECT {i} AS priority_id, COUNT(*) AS records FROM fx_opportunities WHERE {c} HAVING COUNT(*) > 0" for i, c in GROUP_SQL.items()))
def _(r):
    import json

    path = shared_dir(r.spark, "config")
    r.spark.createDataFrame([(json.dumps(GROUPS),)], "value string").coalesce(1).write.text(path)
    groups = conf.load_groups(r.spark, path)
    return priorities.memberships(r.fx_opportunities, groups).groupBy("priority_id").agg(F.count(F.lit(1)).alias("records"))


# --- streams --------------------------------------------------------------------------------
@query("j07_change_feed", """
SELECT id, kind FROM fx_changes WHERE id > 100 AND id <= (SELECT MAX(event_id) FROM events) - 50""")
def _(r):
    top = r.events.agg(F.max("event_id").alias("m")).first().m
    log, out, state = (shared_dir(r.spark, p) for p in ("log", "feed", "state"))
    changes = r.fx_changes.select("id", "kind")
    # Two arrivals; the second call resumes after the first.
    for part in ("id % 2 = 0", "id % 2 = 1"):
        changes.filter(part).write.mode("append").parquet(log)
        feed.consume(feed.change_stream(r.spark, log, changes.schema, 100, top - 50), out, state)
    return r.spark.read.schema(changes.schema).parquet(out)


@query("j08_streamed_page_changes", """
SELECT source_id, event_id, CASE WHEN previous_hash IS NULL THEN 'source_discovered' WHEN previous_hash <> text_hash THEN 'source_changed' ELSE 'same' END AS kind FROM ox_page_changes""")
def _(r):
    landing, out, last, state = (shared_dir(r.spark, p) for p in ("observed", "changes", "last", "state"))
    rows = r.fx_observations
    at = F.unix_micros(F.col("observed_at").cast("timestamp_ltz"))
    middle = rows.agg(F.percentile_approx(at, 0.5).alias("m")).first().m
    for part in (at <= middle, at > middle):
        rows.filter(part).write.mode("append").parquet(landing)
        watch.detect_changes(r.spark.readStream.schema(rows.schema).parquet(landing), out, last, state)
    return r.spark.read.schema(watch.OUTPUT).parquet(out).select("source_id", "event_id", "kind")


SHARED["ox_runs"] = """
SELECT event_id, user_id % 20 AS source_id, ts AS finished_at, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'partial' ELSE 'success' END AS status FROM events"""


def runs(r):
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "signup", "partial").otherwise("success")
    return r.events.select("event_id", (F.col("user_id") % 20).alias("source_id"), F.col("ts").alias("finished_at"), status.alias("status"))


@query("j09_silence_windows", """
SELECT evaluated_at, COUNT(DISTINCT source_id) AS successful_sources FROM (
  SELECT DISTINCT date_trunc('hour', finished_at)::TIMESTAMP + CAST(s AS INT) * INTERVAL '1' HOUR AS evaluated_at, source_id FROM ox_runs, range(1, 37) g(s) WHERE status = 'success') GROUP BY evaluated_at""")
def _(r):
    return feed.silence_windows(runs(r))


@query("j09_silence_stream", """
WITH w AS (SELECT evaluated_at, COUNT(DISTINCT source_id) AS successful_sources FROM (
  SELECT date_trunc('hour', finished_at)::TIMESTAMP + CAST(s AS INT) * INTERVAL '1' HOUR AS evaluated_at, source_id FROM ox_runs, range(1, 37) g(s) WHERE status = 'success') GROUP BY evaluated_at)
SELECT * FROM w WHERE evaluated_at <= (SELECT MAX(finished_at) FROM ox_runs WHERE status = 'success') - INTERVAL '1' HOUR""")
def _(r):
    landing, out, state = (shared_dir(r.spark, p) for p in ("runs", "silence", "state"))
    rows = runs(r).select(F.col("finished_at").cast("timestamp_ltz").alias("finished_at"), F.col("source_id").cast("string").alias("source_id"), "status")
    rows.write.parquet(landing)
    feed.consume(feed.silence_stream(r.spark.readStream.schema(rows.schema).parquet(landing)), out, state)
    return r.spark.read.schema("evaluated_at timestamp_ltz, successful_sources bigint").parquet(out).select(
        F.col("evaluated_at").cast("timestamp_ntz").alias("evaluated_at"), "successful_sources")


@query("j10_problem_runs", """
SELECT event_id, source_id, finished_at, status FROM ox_runs WHERE status IN ('failed', 'partial') AND finished_at > TIMESTAMP '2024-01-15 12:00:00' - INTERVAL '2' HOUR""")
def _(r):
    landing, out, state = (shared_dir(r.spark, p) for p in ("runs", "problems", "state"))
    rows = runs(r)
    rows.write.parquet(landing)
    feed.consume(feed.problem_runs(r.spark.readStream.schema(rows.schema).parquet(landing), "2024-01-15 12:00:00"), out, state)
    return r.spark.read.schema(rows.schema).parquet(out)


# --- functions and adapters -----------------------------------------------------------------
@query("k01_case_folding", "SELECT doc_id, replace(lower(text), 'ß', 'ss') AS folded FROM documents WHERE contains(replace(lower(text), 'ß', 'ss'), 'ss')")
def _(r):
    return r.documents.filter(text.contains_folded(F.col("text"), "ß")).select("doc_id", text.fold(F.col("text")).alias("folded"))


@query("k02_adapter_union", """
SELECT 'search_api' AS adapter, COUNT(*) AS records FROM ox_preferred UNION ALL SELECT 'paged_listing', COUNT(*) FROM fx_opportunities UNION ALL SELECT 'embedded_listing', COUNT(*) FROM fx_opportunities""")
def _(r):
    inputs = {
        "search_api": search_documents(r),
        "paged_listing": listing_pages(r).select(F.from_json("body", "struct<" + landed.LISTING.replace(" int", ":int").replace(" array", ":array") + ">").alias("b")).select("b.*"),
        "embedded_listing": embedded_pages(r),
    }
    batches = [adapters.read_source(name, df, {"as_of": r.as_of}).records.select(F.lit(name).alias("adapter"), *rec.FIELDS) for name, df in inputs.items()]
    return agg.counts_by(reconcile.union_streams(*batches), "adapter")


# --- sinks ----------------------------------------------------------------------------------
@query("m01_jsonl_export", "SELECT id, title, deadline_on, content_state FROM ox_registry")
def _(r):
    path = shared_dir(r.spark, "export")
    export.write_jsonl(view(r).select("id", "title", "deadline_on", "content_state"), path)
    return r.spark.read.schema("id bigint, title string, deadline_on date, content_state string").json(path)


@query("m02_csv_export", r"""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '''=' || text ELSE text END AS cell FROM documents""")
def _(r):
    path = shared_dir(r.spark, "export")
    cell = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("="), F.col("text"))).otherwise(F.col("text"))
    export.write_csv(r.documents.select("doc_id", cell.alias("cell"), "lang"), path, ["doc_id", "cell"])
    return r.spark.read.schema("doc_id bigint, cell string").option("header", True).option("multiLine", True).option("escape", '"').csv(path)


@query("m03_manifest", f"""
SELECT '0007' AS schema_version, '{AS_OF}' AS exported_at_utc, (SELECT COUNT(*) FROM fx_opportunities) AS opportunities, (SELECT COUNT(*) FROM fx_sources) AS sources, false AS completeness_verified""")
def _(r):
    facts = export.manifest({"opportunities": r.fx_opportunities, "sources": r.fx_sources}, "0007", r.as_of)
    return facts.select("schema_version", "exported_at_utc", F.col("counts")["opportunities"].alias("opportunities"), F.col("counts")["sources"].alias("sources"), "completeness_verified")


@query("m04_document_tables", """
SELECT 'documents' AS table_name, COUNT(*) AS n FROM fx_documents UNION ALL SELECT 'opportunity-documents', COUNT(*) FROM fx_opportunity_documents UNION ALL SELECT 'links', COUNT(*) FROM fx_links""")
def _(r):
    path = shared_dir(r.spark, "documents")
    tables = {"documents": r.fx_documents, "opportunity-documents": r.fx_opportunity_documents, "links": r.fx_links}
    export.export_document_tables(tables, path)
    return agg.table_counts({n: r.spark.read.schema(t.schema).json(f"{path}/{n}.jsonl") for n, t in tables.items()})


def archived(r):
    return r.fx_texts.groupBy("sha256").agg(F.min("text").alias("text"), F.max("n_chars").alias("n_chars")).select(
        "sha256", "text", "n_chars", F.encode("text", "UTF-8").alias("original"), F.lit("text/plain").alias("media_type"))


@query("m05_content_files", "SELECT sha256, 'originals/' || sha256 || '.txt' AS original_file, 'texts/' || sha256 || '.txt' AS text_file, n_chars FROM fx_blobs")
def _(r):
    index = export.write_contents(archived(r), shared_dir(r.spark, "contents"))
    return index.select("sha256", "original_file", "text_file", "n_chars")


@query("m06_index_fragments", """
SELECT o.id AS opportunity_id, od.document_id, CASE WHEN od.document_id IS NULL THEN '<p class="note">Asiakirjojen keruuta ei ole vielä aloitettu.</p>' ELSE
  '<article><h2>' || d.url || '</h2><p>' || CASE d.state WHEN 'pending' THEN 'Odottaa keruuta' WHEN 'fetched' THEN 'Tallennettu' WHEN 'failed' THEN 'Lataus epäonnistui' ELSE 'Lähteen käyttörajoitus' END || ' · ' ||
  CASE d.extraction_status WHEN 'extracted' THEN 'Teksti poimittu' WHEN 'partial_text' THEN 'Teksti tarkistettava' ELSE 'Tekstiä ei vielä poimittu' END || '</p><p class="meta">Lähde: <a rel="noreferrer noopener" href="' || d.url || '">' || d.url || '</a></p>' ||
  COALESCE('<p class="actions"><a href="../texts/' || d.current_sha256 || '.txt">Lue koko teksti</a></p>', '') ||
  COALESCE('<p class="note">Puute: ' || CASE WHEN COALESCE(d.error, od.limitation) LIKE 'RATE_LIMIT|%' THEN 'Lähde rajoittaa pyyntöjä (' || split_part(d.error, '|', 2) || '). Keruu voi jatkua aikaisintaan ' || split_part(d.error, '|', 3) || ' UTC.'
    ELSE COALESCE(d.error, od.limitation) END || '</p>', '') || '</article>' END AS fragment
FROM fx_opportunities o LEFT JOIN fx_opportunity_documents od ON od.opportunity_id = o.id AND od.active LEFT JOIN ox_current_docs d ON d.id = od.document_id""")
def _(r):
    from noticegrid.plans.flow_queries import current_docs

    rows = lookups.notice_document_export(r.fx_opportunities, r.fx_opportunity_documents, current_docs(r), r.fx_blobs)
    return export.index_fragments(rows).select("opportunity_id", "document_id", "fragment")


@query("m07_membership_table", " UNION ALL ".join(f"SELECT id AS opportunity_id, {i} AS priority_id FROM fx_opportunities WHERE {c}" for i, c in GROUP_SQL.items()))
def _(r):
    path = shared_dir(r.spark, "memberships")
    export.write_jsonl(priorities.memberships(r.fx_opportunities, GROUPS).select("opportunity_id", "priority_id"), path)
    return r.spark.read.schema("opportunity_id bigint, priority_id int").json(path)


METRIC_TABLES = ("fx_sources", "fx_opportunities", "fx_documents", "fx_tags", "fx_changes", "fx_blobs")


def delivery_sections(r):
    """All sections of a delivery; each relation is scanned once for the counts that are its own."""
    coverage = registry.document_coverage(r.fx_opportunity_documents, r.fx_documents)
    notices = registry.with_coverage(base(r), coverage)
    documents = r.fx_documents.withColumn("page_count", F.expr("byte_count div 500"))
    faq_notices = r.fx_opportunity_documents.filter("active AND role = 'faq_keyword_match'").select("opportunity_id").distinct()
    pending = agg.pending_of_current(base(r), r.fx_opportunity_documents, r.fx_documents)
    raw = stored_items(r).agg(F.sum(F.json_array_length(F.get_json_object("raw_json", "$.documents"))).alias("all"))
    tables = agg.table_counts({t: getattr(r, t) for t in METRIC_TABLES}).select(
        F.lit("table_counts").alias("section"), F.col("table_name").alias("key"), "n")
    return [
        agg.notice_sections(notices), agg.document_sections(documents), agg.source_sections(agg.source_health(r.fx_sources, r.as_of)),
        agg.counters(pending, "source_content_gaps"), agg.counters(agg.flag_gaps(*flagged_contents(r)), "source_content_gaps"),
        agg.counters(faq_notices.agg(F.count(F.lit(1)).alias("all")), "opportunities_with_faq"), agg.counters(raw, "raw_documents"), tables,
    ]


SHARED["ox_metrics"] = f"""
SELECT 'by_source' AS section, source_id AS key, COUNT(*) AS n FROM fx_opportunities GROUP BY source_id UNION ALL SELECT 'by_status', effective_status, COUNT(*) FROM ox_status GROUP BY effective_status
UNION ALL SELECT 'by_record_kind', record_kind, COUNT(*) FROM fx_opportunities GROUP BY record_kind UNION ALL SELECT 'text_extraction', extraction_status, COUNT(*) FROM fx_documents GROUP BY extraction_status
UNION ALL SELECT 'funder_names', 'all', COUNT(DISTINCT lower(funder)) FROM fx_opportunities WHERE funder <> '' UNION ALL SELECT 'opportunities', 'all', COUNT(*) FROM fx_opportunities
UNION ALL SELECT 'call_coverage', content_state, COUNT(*) FROM ox_registry GROUP BY content_state UNION ALL SELECT 'documents', state, COUNT(*) FROM fx_documents GROUP BY state
UNION ALL SELECT 'documents_by_parser_state', parser || '/' || state, COUNT(*) FROM fx_documents GROUP BY parser, state
UNION ALL SELECT 'document_formats.originals', media_type, COUNT(*) FROM fx_documents WHERE state = 'fetched' GROUP BY media_type
UNION ALL SELECT 'document_formats.original_bytes', media_type, SUM(byte_count) FROM fx_documents WHERE state = 'fetched' GROUP BY media_type
UNION ALL SELECT 'document_formats.pages', media_type, SUM(byte_count // 500) FROM fx_documents WHERE state = 'fetched' GROUP BY media_type
UNION ALL SELECT 'source_content_gaps', 'attachment_urls_returning_html', COUNT(*) FILTER (WHERE error = 'DOCUMENT_DOWNLOAD_RETURNED_HTML') FROM fx_documents
UNION ALL SELECT 'source_content_gaps', 'details_redirecting_to_front_pages', COUNT(*) FILTER (WHERE error = 'DETAIL_REDIRECTED_TO_FRONT_PAGE') FROM fx_documents
UNION ALL SELECT 'source_content_gaps', 'rate_limit_deferred_documents', COUNT(*) FILTER (WHERE state = 'pending' AND error LIKE 'RATE_LIMIT|%') FROM fx_documents
UNION ALL SELECT 'source_content_gaps', 'current_or_unknown_pending_documents', COUNT(DISTINCT d.id) FROM fx_documents d JOIN fx_opportunity_documents od ON od.document_id = d.id
  JOIN ox_status o ON o.id = od.opportunity_id WHERE od.active AND od.limitation IS NULL AND d.state = 'pending' AND o.effective_status NOT IN ('closed', 'cancelled')
UNION ALL SELECT 'source_content_gaps', 'eu_entries_without_published_body', COUNT(*) FROM ox_flagged WHERE parser = 'eu_source' AND first_doc_id % 3 = 0
UNION ALL SELECT 'source_content_gaps', 'faq_entries_without_published_question_or_answer', COUNT(*) FROM ox_flagged WHERE parser = 'eu_faq_source' AND first_doc_id % 4 = 1
UNION ALL SELECT 'source_count', 'all', COUNT(*) FROM fx_sources UNION ALL SELECT 'structured_sources', 'all', COUNT(*) FILTER (WHERE adapter NOT IN ('page_watch', 'manual')) FROM fx_sources
UNION ALL SELECT 'source_issues', id, 1 FROM fx_sources WHERE enabled AND health <> 'success'
UNION ALL SELECT 'opportunities_with_faq', 'all', COUNT(DISTINCT opportunity_id) FROM fx_opportunity_documents WHERE active AND role = 'faq_keyword_match'
UNION ALL SELECT 'raw_documents', 'all', COUNT(*) FROM events
""" + "".join(f"UNION ALL SELECT 'table_counts', '{t}', COUNT(*) FROM {t}\n" for t in METRIC_TABLES)


@query("m08_delivery_metrics", "SELECT section, key, CAST(n AS BIGINT) AS n FROM ox_metrics")
def _(r):
    whole = delivery_sections(r)
    rows = whole[0]
    for more in whole[1:]:
        rows = rows.unionByName(more)
    return rows.select("section", "key", F.col("n").cast("bigint").alias("n"))


@query("m08_metrics_json", f"""
SELECT '{{"as_of_utc":"{AS_OF}",' || string_agg('"' || section || '":' || body, ',' ORDER BY section) || '}}' AS metrics_json FROM (
  SELECT section, CASE WHEN MIN(key) = 'all' THEN CAST(MAX(n) AS BIGINT)::VARCHAR ELSE '{{' || string_agg('"' || key || '":' || CAST(n AS BIGINT)::VARCHAR, ',' ORDER BY key) || '}}' END AS body FROM ox_metrics GROUP BY section)""")
def _(r):
    return export.delivery_metrics(delivery_sections(r), r.as_of)


@query("m09_transfer", """
SELECT v.table_name, v.equal FROM (VALUES ('sources', true), ('opportunities', true), ('tags', true), ('changes', true)) v(table_name, equal), (SELECT COUNT(*) AS n FROM orders) WHERE n > 0""")
def _(r):
    tables = {"sources": r.fx_sources, "opportunities": r.fx_opportunities, "tags": r.fx_tags, "changes": r.fx_changes}
    checks = export.transfer(tables, shared_dir(r.spark, "target"), "0007", "0007")
    return r.spark.createDataFrame(list(checks.items()), "table_name string, equal boolean")


@query("m10_coverage_report", f"""
SELECT s.id AS source_id, s.name, s.health, s.collection_level, COUNT(o.id) AS records, COUNT(o.id) FILTER (WHERE o.record_kind = 'call') AS calls
FROM ox_health s LEFT JOIN fx_opportunities o ON o.source_id = s.id GROUP BY ALL""")
def _(r):
    health = agg.source_health(r.fx_sources, r.as_of).select(F.col("id").alias("source_id"), "name", "health", "collection_level")
    counts = r.fx_opportunities.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("records"), registry.count_when(F.col("record_kind") == "call").alias("calls"))
    return health.join(counts, "source_id", "left").fillna(0, ["records", "calls"])
