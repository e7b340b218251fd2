"""Collection runs from landed responses to committed versions, and what the adapters reject."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticegrid.functions import fixed
from noticegrid.operators import collection
from noticegrid.plans.registry import SHARED, query
from noticegrid.plans.source_queries import CATALOGUE, PAGE_LINES, embedded_pages, iso, landed_lines, posts, search_documents
from noticegrid.plans.views import AS_OF
from noticegrid.session import shared_dir
from noticegrid.sources import landed
from noticegrid.sources import registry as adapters

EARLIER = "1998-06-30 06:00:00"
SECOND_COPY = 1_000_000  # pages that list some notices again


def faulty_pages(r):
    """A second listing: other titles for some, and rows that no run should take.

    Every 31st has no identifier, every 23rd a start without offset, every 29th ends on 31 February;
    every 37th is listed again on a later page.
    """
    k = F.col("id")
    title = F.when(k % 6 == 1, F.upper("title")).otherwise(F.col("title"))
    start = iso(F.col("opens_on").cast("timestamp_ntz") + F.expr("INTERVAL '21' HOUR"))
    rows = r.fx_opportunities.filter("id % 4 <> 0").withColumns({
        "title": title, "external_id": F.when(k % 31 != 0, F.col("external_id")),
        "start": F.when(k % 23 == 0, F.rtrim(start, F.lit("Z"))).otherwise(start),
        "end": F.when(k % 29 == 0, "1998-02-31").otherwise(iso(F.col("deadline_at")))})
    again = F.when(k % 37 == 0, F.array(F.lit(0), F.lit(SECOND_COPY))).otherwise(F.array(F.lit(0)))
    return listed_pages(rows.withColumn("_base", F.explode(again)))


def plain_pages(r):
    start = iso(F.col("opens_on").cast("timestamp_ntz") + F.expr("INTERVAL '21' HOUR"))
    return listed_pages(r.fx_opportunities.filter("id % 4 <> 3").withColumns({"start": start, "end": iso(F.col("deadline_at")), "_base": F.lit(0)}))


def listed_pages(rows):
    """Pages of about 100 notices as landed bodies; each advertises the whole number of rows."""
    text = lambda c: F.struct(F.col(c).alias("fi"))
    row = F.struct(
        F.col("external_id").alias("hakuasianAsianumero"), text("title").alias("nimi"), text("description").alias("kuvaus"),
        F.col("start").alias("hakuAlkaaDateTimeUtc"), F.col("end").alias("hakuPaattyyDateTimeUtc"),
        F.struct(text("funder").alias("nimi")).alias("vastuullinenJarjestajaOrganisaatio"))
    total = rows.agg(F.count(F.lit(1)).cast("int")).scalar()
    grouped = rows.groupBy((F.floor(F.col("id") / 100) + F.col("_base")).cast("int").alias("pageNo")).agg(F.collect_list(row).alias("hakuilmoitukset"))
    whole = F.struct("pageNo", total.alias("totalCount"), F.lit(1).alias("pageCount"), "hakuilmoitukset")
    return grouped.select(F.to_json(whole).alias("body"))


def listing_of(r, bodies):
    return landed.read_json(r.spark, landed_lines(r, bodies, lines=PAGE_LINES), landed.LISTING)


def collected(r):
    """A store after three runs: a clean listing, a faulty one, and a page without its payload."""
    store = collection.create(r.spark, shared_dir(r.spark, "registry"))
    config = {"adapter": "paged_listing", "as_of": r.as_of}
    collection.collect(store, "listing", listing_of(r, plain_pages(r)), config, run_id="run-1", as_of=EARLIER)
    faulty = listing_of(r, faulty_pages(r))
    for _ in range(2):  # the second call finds the run committed
        collection.collect(store, "listing", faulty, config, run_id="run-2", as_of=r.as_of)
    broken = r.region.filter("r_regionkey = 0").select(F.concat(F.lit("<html>"), "r_name", F.lit("</html>")).alias("html"))
    collection.collect(store, "embedded", broken, {"adapter": "embedded_listing"}, run_id="run-3", as_of=r.as_of)
    return store


SHARED["ox_listed"] = """
SELECT *, id % 31 <> 0 AND id % 23 <> 0 AND id % 29 <> 0 AS usable, CASE WHEN id % 6 = 1 THEN upper(title) ELSE title END AS new_title FROM fx_opportunities WHERE id % 4 <> 0"""
SHARED["ox_collected"] = f"""
SELECT o.external_id, CASE WHEN n.id IS NOT NULL THEN n.new_title ELSE o.title END AS title,
  CASE WHEN o.id % 4 = 3 THEN 'created' WHEN n.id IS NULL THEN 'kept' WHEN n.new_title <> o.title THEN 'updated' ELSE 'seen' END AS outcome
FROM fx_opportunities o LEFT JOIN ox_listed n ON n.id = o.id AND n.usable WHERE o.id % 4 <> 3 OR n.id IS NOT NULL"""


@query("j01_collected_snapshot", f"""
SELECT external_id, title, CAST(CASE outcome WHEN 'updated' THEN 2 ELSE 1 END AS INT) AS version,
  CASE outcome WHEN 'created' THEN TIMESTAMP '{AS_OF}' ELSE TIMESTAMP '{EARLIER}' END AS first_seen_at,
  CASE outcome WHEN 'kept' THEN TIMESTAMP '{EARLIER}' ELSE TIMESTAMP '{AS_OF}' END AS last_seen_at,
  CASE WHEN outcome IN ('created', 'updated') THEN TIMESTAMP '{AS_OF}' ELSE TIMESTAMP '{EARLIER}' END AS updated_at FROM ox_collected""")
def _(r):
    return collected(r).table("opportunities").select("external_id", "title", "version", "first_seen_at", "last_seen_at", "updated_at")


@query("j03_collected_changes", f"""
SELECT external_id, title, 'created' AS kind, TIMESTAMP '{EARLIER}' AS created_at FROM fx_opportunities WHERE id % 4 <> 3
UNION ALL SELECT external_id, title, outcome, TIMESTAMP '{AS_OF}' FROM ox_collected WHERE outcome IN ('created', 'updated')""")
def _(r):
    payload = F.from_json("payload_json", "external_id string, title string")
    return collected(r).table("changes").select(payload["external_id"].alias("external_id"), payload["title"].alias("title"), "kind", "created_at")


@query("j11_collected_runs", f"""
SELECT 'run-1' AS run_id, CASE WHEN COUNT(*) > 0 THEN 'success' ELSE 'failed' END AS status, COUNT(*) AS expected, COUNT(*) AS seen, COUNT(*) AS changed, 0 AS rejected, CAST(NULL AS VARCHAR) AS message,
  TIMESTAMP '{EARLIER}' AS last_success_at FROM fx_opportunities WHERE id % 4 <> 3
UNION ALL SELECT 'run-2', CASE WHEN seen < expected THEN 'partial' ELSE 'success' END, expected, seen, changed, expected - seen,
  CASE WHEN seen < expected THEN CAST(expected - seen AS VARCHAR) || ' records rejected' END, CASE WHEN seen < expected THEN TIMESTAMP '{EARLIER}' ELSE TIMESTAMP '{AS_OF}' END
FROM (SELECT COUNT(*) + COUNT(*) FILTER (WHERE id % 37 = 0) AS expected, COUNT(*) FILTER (WHERE usable) AS seen,
    (SELECT COUNT(*) FROM ox_collected c WHERE c.outcome IN ('created', 'updated')) AS changed FROM ox_listed)
UNION ALL SELECT 'run-3', 'failed', NULL, 0, 0, 0, 'failed', NULL""")
def _(r):
    store = collected(r)
    health = store.table("health").select("source_id", "last_success_at")
    runs = store.table("runs").join(health, "source_id")
    at = F.when(F.col("run_id") == "run-1", F.lit(EARLIER).cast("timestamp_ntz")).otherwise(F.col("last_success_at"))
    message = F.when(F.col("message").contains("preRenderData not found"), "failed").otherwise(F.col("message"))
    return runs.select("run_id", "status", "expected", "seen", "changed", "rejected", message.alias("message"), at.alias("last_success_at"))


def rejected_rows(batch):
    rows, _measured = collection.staged_batch(batch, "src")
    return rows.filter("reason IS NOT NULL")


@query("a01_rejects", f"""
SELECT CASE WHEN id % 31 <> 0 THEN external_id END AS external_id, CASE WHEN id % 31 = 0 THEN '{fixed.NO_IDENTIFIER}' WHEN copy = 2 THEN '{fixed.REPEATED_IDENTIFIER}'
  WHEN id % 23 = 0 THEN '{fixed.NO_OFFSET}' ELSE '{fixed.NO_SUCH_DAY}' END AS reason
FROM ox_listed, (SELECT unnest([1, 2]) AS copy) WHERE (copy = 1 AND NOT usable) OR (copy = 2 AND id % 37 = 0)""")
def _(r):
    batch = adapters.read_source("paged_listing", listing_of(r, faulty_pages(r)), {"as_of": r.as_of})
    return rejected_rows(batch).select(F.get_json_object("raw", "$.hakuasianAsianumero").alias("external_id"), "reason")


@query("a02_rejects", f"""
SELECT CAST(id AS VARCHAR) AS external_id, CASE WHEN id % 41 = 0 THEN '{fixed.NO_SUCH_DAY}' ELSE '{fixed.NO_OFFSET}' END AS reason
FROM fx_opportunities WHERE id % 41 = 0 OR id % 43 = 0""")
def _(r):
    start = F.when(F.col("id") % 41 == 0, "1998-02-30").otherwise(F.col("opens_on").cast("string"))
    end = F.when(F.col("id") % 43 == 0, "1998-08-01T12:00:00").otherwise(F.col("deadline_on").cast("string"))
    read = r.spark.read.text(landed_lines(r, embedded_pages(r, start, end), "html", PAGE_LINES)).withColumnRenamed("value", "html")
    return rejected_rows(adapters.read_source("embedded_listing", read, {})).select("external_id", "reason")


@query("a04_rejects", f"""
SELECT page_id AS id, CASE WHEN copy = 2 THEN '{fixed.REPEATED_IDENTIFIER}' WHEN page_id % 11 = 0 THEN 'Not a published funding request' ELSE 'Funding metadata missing; parser review required' END AS reason
FROM pages, (SELECT unnest([1, 2]) AS copy) WHERE (copy = 1 AND (page_id % 11 = 0 OR page_id % 7 = 0)) OR (copy = 2 AND page_id % 13 = 0)""")
def _(r):
    rows = posts(r).unionByName(posts(r).filter("id % 13 = 0"))
    batch = adapters.read_source("post_metadata", rows, {"post_type": "funding_request", "funder": "Sitra"})
    return rejected_rows(batch).select(F.get_json_object("raw", "$.id").cast("bigint").alias("id"), "reason")


@query("a05_rejects", f"""
SELECT page_id AS id, CASE WHEN copy = 2 THEN '{fixed.REPEATED_IDENTIFIER}' WHEN page_id % 11 = 0 THEN 'Duplicate or unsupported WordPress record' ELSE 'Conflicting WordPress call statuses' END AS reason
FROM pages, (SELECT unnest([1, 2]) AS copy) WHERE (copy = 1 AND (page_id % 11 = 0 OR page_id % 6 = 5)) OR (copy = 2 AND page_id % 13 = 0)""")
def _(r):
    rows = posts(r).unionByName(posts(r).filter("id % 13 = 0"))
    taxonomy = r.spark.createDataFrame([(500, "Open call"), (501, "Closed call")], "id int, name string")
    batch = adapters.read_source("post_calls", rows, {"name": "Mobility", "post_type": "funding_request", "taxonomy": taxonomy})
    return rejected_rows(batch).select(F.get_json_object("raw", "$.id").cast("bigint").alias("id"), "reason")


@query("a06_rejects", f"""
WITH c AS (SELECT lower(u.scheme) || '://' || u.host || rtrim(a.href, '/') AS target, a.page_id, a.label, ROW_NUMBER() OVER (PARTITION BY a.page_id, a.href ORDER BY a.position) AS rn
  FROM ox_anchors a JOIN ox_page_urls u ON u.page_id = a.page_id WHERE a.label <> '' AND NOT starts_with(lower(a.label), 'the'))
SELECT target AS address, '{fixed.REPEATED_CARD}' AS reason FROM c WHERE rn = 1 GROUP BY target HAVING COUNT(DISTINCT label) > 1
UNION ALL SELECT 'https://bare.example.org/' || page_id, 'Card without a link' FROM pages WHERE page_id % 5 = 0
UNION ALL SELECT 'https://bare.example.org/' || page_id, 'Card address cannot be used' FROM pages WHERE page_id % 5 = 0""")
def _(r):
    # Every fifth page is shown again with a card that has no link and one whose link leads nowhere public.
    bare = F.lit('<body><nav><ul><li><a href="/ok">Good card</a></li><li><a>Bare card</a></li><li><a href="mailto:x@example.org">Mail card</a></li></ul></nav></body>')
    extra = r.pages.filter("page_id % 5 = 0").select(
        (F.col("page_id") + 10_000_000).alias("page_id"), F.concat(F.lit("https://bare.example.org/"), "page_id").alias("url"), bare.alias("html"))
    batch = adapters.read_source("catalogue", r.pages.select("page_id", "url", "html").unionByName(extra), {**CATALOGUE, "skip_cards_without_link": True})
    return rejected_rows(batch).select(F.coalesce("external_id", F.get_json_object("raw", "$.listing_url")).alias("address"), "reason")


@query("a07_rejects", """
SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'Expected main content selector missing' ELSE 'Page content too short; possible error or bot challenge' END AS reason
FROM pages WHERE page_id % 3 < 2""")
def _(r):
    # A third of the pages has no main part, a third next to nothing in it.
    k = F.col("page_id")
    html = F.when(k % 3 == 0, "<html><body><p>Wait</p></body></html>").when(k % 3 == 1, "<html><body><main>Please wait</main></body></html>").otherwise(
        F.concat(F.lit("<html><body><main><h1>Call</h1>"), F.repeat(F.lit("<p>Ten words of text.</p>"), F.lit(10)), F.lit("</main></body></html>")))
    rows = r.pages.select(k, F.concat(F.lit("https://schemes.example.org/"), k).alias("url"), html.alias("html"))
    entries = rows.select("url", F.lit(None).cast("string").alias("title"), F.lit("call").alias("record_kind"))
    batch = adapters.read_source("configured_pages", rows, {"name": "Schemes", "entries": entries, "selector": "main"})
    return rejected_rows(batch).select(F.get_json_object("raw", "$.page_id").cast("bigint").alias("page_id"), "reason")


@query("k02_adapter_batches", """
SELECT 'search_api' AS adapter, (SELECT COUNT(*) FROM ox_preferred) AS records, (SELECT COUNT(*) FROM events WHERE event_id % 50 = 0) AS rejected
UNION ALL SELECT 'embedded_listing', COUNT(*), 0 FROM fx_opportunities UNION ALL SELECT 'expert_import', COUNT(*), 0 FROM fx_opportunities
UNION ALL SELECT 'post_metadata', COUNT(*) FILTER (WHERE page_id % 11 <> 0 AND page_id % 7 <> 0), COUNT(*) FILTER (WHERE page_id % 11 = 0 OR page_id % 7 = 0) FROM pages""")
def _(r):
    lines = r.fx_opportunities.select(F.to_json(F.struct("external_id", "canonical_url", "title", "funder")).alias("body"))
    inputs = {
        "search_api": search_documents(r), "embedded_listing": embedded_pages(r), "post_metadata": posts(r),
        "expert_import": landed.read_json(r.spark, landed_lines(r, lines), landed.RECORD_LINE),
    }
    counts = []
    for name, df in inputs.items():
        batch = adapters.read_source(name, df, {"as_of": r.as_of, "post_type": "funding_request", "funder": "Sitra"})
        rows = batch.rows.filter("listed").select(F.lit(name).alias("adapter"), F.col("reason").isNull().alias("usable"))
        counts.append(rows)
    whole = counts[0]
    for more in counts[1:]:
        whole = whole.unionByName(more)
    return whole.groupBy("adapter").agg(F.count_if("usable").alias("records"), F.count_if(~F.col("usable")).alias("rejected"))
