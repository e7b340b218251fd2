"""Scalar normalisation over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from noticegrid.functions import codes, dates, fixed, html, links, status, text, urls
from noticegrid.functions import record as rec
from noticegrid.plans.registry import SHARED, query

# Identity form of a page address, written with DuckDB's own string functions.
SHARED["ox_page_urls"] = r"""
SELECT page_id, url, html, regexp_extract(url, '^([a-zA-Z]+)://', 1) AS scheme, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS host,
  regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '\?([^#]*)', 1) AS query FROM pages"""
SHARED["ox_page_pairs"] = """
SELECT page_id, split_part(pair, '=', 1) AS k, substr(pair, instr(pair, '=') + 1) AS v, pair, pos
FROM (SELECT page_id, unnest(string_split(query, '&')) AS pair, generate_subscripts(string_split(query, '&'), 1) AS pos FROM ox_page_urls) WHERE pair <> ''"""
SHARED["ox_page_ids"] = """
SELECT u.page_id, u.url, u.html, lower(scheme) || '://' || host || CASE WHEN rtrim(path, '/') = '' THEN '/' ELSE rtrim(path, '/') END ||
  COALESCE('?' || q.joined, '') AS canonical,
  lower(scheme) || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || COALESCE('?' || q.ordered, '') AS document
FROM ox_page_urls u LEFT JOIN (
  SELECT page_id, string_agg(pair, '&' ORDER BY k, v) FILTER (WHERE v <> '') AS joined, string_agg(pair, '&' ORDER BY pos) AS ordered
  FROM ox_page_pairs WHERE NOT lower(k) LIKE 'utm!_%' ESCAPE '!' AND lower(k) NOT IN ('fbclid', 'gclid') GROUP BY page_id) q ON q.page_id = u.page_id"""

# Readable text of the test pages: blocks removed, tags as line breaks, trimmed lines, spaces squeezed.
_ENTITIES = (
    "replace(replace(replace(replace(replace({x}, '&copy;', '©'), '&middot;', '·'), '&quot;', '\"'), '&lt;', '<'), '&amp;', '&')")


def page_text(column: str, dropped: str) -> str:
    """DuckDB text for the readable lines of ``column``, one relation (page_id, txt)."""
    bare = column
    for tag in dropped.split(","):
        bare = f"regexp_replace({bare}, '(?is)<{tag}\\b.*?</{tag}>', '<i>', 'g')"
    bare = f"regexp_replace({bare}, '(?s)<!--.*?-->', '<i>', 'g')"
    split = f"string_split_regex({bare}, '<[^<>]*>')"
    piece = _ENTITIES.format(x="piece")
    return f"""SELECT page_id, regexp_replace(string_agg(trim({piece}, ' ' || chr(9) || chr(10) || chr(13)), chr(10) ORDER BY pos)
  FILTER (WHERE trim({piece}, ' ' || chr(9) || chr(10) || chr(13)) <> ''), '[ \\t]+', ' ', 'g') AS txt
FROM (SELECT page_id, unnest({split}) AS piece, generate_subscripts({split}, 1) AS pos FROM pages) GROUP BY page_id"""


@query("b01_canonical_json", """
SELECT id, '{"description":"' || description || '","funder":"' || funder || '","id":' || CAST(id AS VARCHAR) || ',"limit":' ||
  CASE WHEN deadline_on IS NULL THEN 'null' ELSE '"' || CAST(deadline_on AS VARCHAR) || '"' END || ',"title":"' || title || '"}' AS payload FROM fx_opportunities""")
def _(r):
    columns = {"title": F.col("title"), "id": F.col("id"), "description": F.col("description"), "funder": F.col("funder"),
               "limit": F.col("deadline_on").cast("string")}
    return r.fx_opportunities.select("id", text.canonical_json(columns).alias("payload"))


@query("b02_content_hash", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def _(r):
    return r.documents.select("doc_id", text.digest(F.col("text")).alias("sha256"))


@query("b03_clean_html", page_text("html", "script,style,noscript").replace("AS txt", "AS text"))
def _(r):
    return r.pages.select("page_id", html.clean_html(F.col("html")).alias("text"))


@query("b04_semantic_text", page_text("html", "script,style,noscript,nav,footer,form").replace("AS txt", "AS text"))
def _(r):
    return r.pages.select("page_id", html.semantic_text(F.col("html")).alias("text"))


@query("b05_language_fallback", """
SELECT doc_id, CASE WHEN lang IN ('fr', 'en', 'de') THEN text ELSE '' END AS text FROM documents""")
def _(r):
    d = F.col("lang")
    # fi from French rows, en from English ones, sv from German ones: each falls through to the next.
    value = F.struct(
        F.when(d == "fr", F.col("text")).otherwise("").alias("fi"),
        F.when(d == "en", F.col("text")).alias("en"), F.when(d == "de", F.col("text")).alias("sv"))
    return r.documents.withColumn("v", value).select("doc_id", text.translated(F.col("v")).alias("text"))


@query("b06_canonical_url", "SELECT page_id, canonical FROM ox_page_ids")
def _(r):
    return r.pages.select("page_id", urls.canonical_url(F.col("url")).alias("canonical"))


@query("b07_notice_id", """
WITH h AS (SELECT page_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(canonical)) AS s FROM ox_page_ids)
SELECT page_id, substr(s, 1, 8) || '-' || substr(s, 9, 4) || '-5' || substr(s, 14, 3) || '-' ||
  substr('89ab', 1 + CAST(instr('0123456789abcdef', substr(s, 17, 1)) - 1 AS INT) % 4, 1) || substr(s, 18, 3) || '-' || substr(s, 21, 12) AS id FROM h""")
def _(r):
    return r.pages.select("page_id", urls.notice_id(F.col("url")).alias("id"))


SHARED["ox_anchors"] = r"""
SELECT page_id, url, pos - 1 AS position, regexp_extract(piece, '^href="([^"]*)"', 1) AS href, trim(regexp_extract(piece, '>([^<]*)</a>', 1)) AS label
FROM (SELECT page_id, url, unnest(string_split(html, '<a ')) AS piece, generate_subscripts(string_split(html, '<a '), 1) - 1 AS pos FROM pages) WHERE pos > 0"""


@query("b08_document_url", """
SELECT a.page_id, a.position, lower(u.scheme) || '://' || u.host || a.href AS target_url FROM ox_anchors a JOIN ox_page_urls u ON u.page_id = a.page_id
UNION ALL SELECT page_id, -1, document FROM ox_page_ids""")
def _(r):
    raw = r.pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("position", "href"))
    own = r.pages.select("page_id", F.lit(-1).alias("position"), urls.document_url(F.col("url")).alias("target_url"))
    return raw.select(
        "page_id", "position", urls.document_url(F.col("href"), F.col("url")).alias("target_url")
    ).unionByName(own).withColumn("position", F.col("position").cast("bigint"))


@query("b09_parse_time", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 3 = 1 THEN date_trunc('second', ts)
  ELSE date_trunc('second', ts) - INTERVAL '150' MINUTE END AS parsed FROM events""")
def _(r):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    raw = F.when(F.col("event_id") % 3 == 0, F.left(stamp, F.lit(10))).when(
        F.col("event_id") % 3 == 1, F.concat(stamp, F.lit("Z"))).otherwise(F.concat(stamp, F.lit("+02:30")))
    return r.events.select("event_id", dates.parse_time(raw).alias("parsed"))


@query("b10_due_value", """
SELECT event_id, CAST(ts AS DATE) AS due_on, CASE WHEN event_id % 2 = 1 THEN date_trunc('second', ts) - INTERVAL '3' HOUR END AS due_at,
  CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S+03:00') END AS original, 'Europe/Helsinki' AS timezone FROM events""")
def _(r):
    raw = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+03:00'"))
    return r.events.select("event_id", dates.due(raw, "Europe/Helsinki").alias("d")).select("event_id", "d.*")


@query("b11_local_day", "SELECT id, CAST((created_at AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Helsinki' AS DATE) AS local_day FROM fx_changes")
def _(r):
    return r.fx_changes.select("id", dates.local_day(F.col("created_at")).alias("local_day"))


@query("b12_label_dates", """
SELECT o_orderkey AS id, pos - 1 AS position, CAST(o_orderdate AS DATE) + CASE WHEN o_orderkey % 4 = 3 AND pos = 2 THEN 10 ELSE 0 END AS due_on,
  CASE o_orderkey % 4 WHEN 0 THEN ((CAST(o_orderdate AS DATE) + INTERVAL '1005' MINUTE) AT TIME ZONE 'Europe/Helsinki') AT TIME ZONE 'UTC'
    WHEN 1 THEN CAST(o_orderdate AS DATE) + INTERVAL '900' MINUTE WHEN 2 THEN CAST(o_orderdate AS DATE) + INTERVAL '1320' MINUTE END AS due_at
FROM orders, (VALUES (1), (2)) v(pos) WHERE pos = 1 OR o_orderkey % 4 = 3""")
def _(r):
    key, day = F.col("o_orderkey") % 4, F.col("o_orderdate")
    label = (
        F.when(key == 0, F.date_format(day, "'Haku päättyy' d.M.yyyy 'klo 16.45'"))
        .when(key == 1, F.date_format(day, "'Call closes:' d MMMM yyyy', 17.00 CEST'"))
        .when(key == 2, F.date_format(day, "yyyy-MM-dd' 23:00: CET'"))
        .otherwise(F.concat_ws(" - ", F.date_format(day, "d.M.yyyy"), F.date_format(F.date_add(day.cast("date"), 10), "d.M.yyyy"))))
    found = r.orders.select(F.col("o_orderkey").alias("id"), F.posexplode(dates.dates_in_label(label, "Europe/Helsinki")).alias("position", "d"))
    return found.select("id", F.col("position").cast("int").alias("position"), "d.due_on", "d.due_at")


@query("b13_listing_status", """
SELECT id, CASE WHEN deadline_at < TIMESTAMP '1998-07-01 00:00:00' THEN 'closed' WHEN opens_on > DATE '1998-07-01' THEN 'forthcoming'
  WHEN id % 19 = 0 THEN 'unknown' WHEN source_status = 'rolling' THEN 'rolling' ELSE 'open' END AS status FROM fx_opportunities""")
def _(r):
    starts = F.when(F.col("id") % 19 != 0, F.col("opens_on").cast("string"))
    return r.fx_opportunities.select("id", codes.listing_status(
        starts, F.col("opens_on"), F.col("deadline_at"), F.col("source_status") == "rolling", r.as_of).alias("status"))


@query("b14_status_map", """
SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'closed' ELSE 'unknown' END AS code_status,
  CASE o_orderkey % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'closed' WHEN 2 THEN 'rolling' ELSE 'unknown' END AS word_status FROM orders""")
def _(r):
    word = F.element_at(F.array(*map(F.lit, (" Avoinna", "PÄÄTTYNYT", "Jatkuva ", "?"))), (F.col("o_orderkey") % 4).cast("int") + 1)
    return r.orders.select(
        F.col("o_orderkey").alias("id"), codes.lookup(F.col("o_orderstatus"), {"O": "open", "F": "closed"}, "unknown").alias("code_status"),
        codes.status_word(word).alias("word_status"))


@query("b15_lenient_decimal", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE CAST(CAST(o_totalprice AS DECIMAL(20,2)) AS DOUBLE) END AS amount,
  CASE WHEN o_orderkey % 3 <> 2 THEN 'EUR' END AS currency FROM orders""")
def _(r):
    price = F.col("o_totalprice").cast("decimal(20,2)").cast("string")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" "), F.replace(price, F.lit("."), F.lit(",")))).when(
        F.col("o_orderkey") % 3 == 1, F.concat(F.left(price, F.lit(1)), F.lit(" "), F.substr(price, F.lit(2)))).otherwise("n/a")
    value = codes.amount(raw)
    return r.orders.select(F.col("o_orderkey").alias("id"), value.cast("double").alias("amount"), F.when(value.isNotNull(), "EUR").alias("currency"))


@query("b16_region_scope", """
SELECT id, CASE WHEN id % 5 = 0 THEN 'finland' WHEN id % 4 = 1 THEN 'pirkanmaa' WHEN id % 4 = 3 THEN 'unknown' ELSE 'other_region' END AS scope FROM fx_opportunities""")
def _(r):
    areas = F.when(F.col("id") % 4 == 3, F.array().cast("array<string>")).when(
        F.col("id") % 4 == 1, F.array(F.lit("Uusimaa"), F.lit("Pirkanmaa"))).otherwise(F.array(F.lit("Lappi")))
    return r.fx_opportunities.select("id", codes.region_scope(F.col("id") % 5 == 0, areas).alias("scope"))


@query("b17_first_metadata", """
SELECT event_id, COALESCE(CASE WHEN event_id % 4 = 1 THEN event_type WHEN event_id % 4 = 3 THEN CAST(user_id AS VARCHAR) END, 'none') AS first_value FROM events""")
def _(r):
    values = F.when(F.col("event_id") % 4 == 1, F.array("event_type", F.lit("x"))).when(
        F.col("event_id") % 4 == 3, F.array(F.col("user_id").cast("string"))).when(F.col("event_id") % 4 == 0, F.array().cast("array<string>"))
    return r.events.select("event_id", codes.first_value(F.create_map(F.lit("k"), values), "k", "none").alias("first_value"))


@query("b18_typed_identity", """
SELECT id, CASE WHEN id % 7 = 0 AND id % 31 <> 0 THEN 'cascade:' || id WHEN id % 50 = 0 THEN '' ELSE external_id END AS external_id,
  CASE WHEN id % 50 = 0 THEN 'EU cascade funding' ELSE split_part(external_id, '-', 1) END AS programme,
  CASE WHEN id % 31 = 0 THEN 'Not a supported funding topic type' WHEN id % 7 <> 0 AND id % 50 = 0 THEN 'Missing or unsupported funding topic identifier' END AS problem
FROM fx_opportunities""")
def _(r):
    kind = F.when(F.col("id") % 31 == 0, "2").when(F.col("id") % 7 == 0, "8").otherwise("1")
    identifier = F.when(F.col("id") % 50 == 0, "").otherwise(F.col("external_id"))
    return r.fx_opportunities.select("id", codes.typed_identity(kind, identifier, F.col("id").cast("string")).alias("t")).select("id", "t.*")


@query("b20_dated_kinds", """
SELECT id, CASE WHEN record_kind = 'call' THEN CASE WHEN id % 3 = 0 THEN 'closed' ELSE 'open' END ELSE CASE WHEN id % 3 = 0 THEN 'closed' ELSE 'unknown' END END AS source_status,
  CASE WHEN record_kind = 'call' THEN opens_on END AS opens_on, CASE WHEN record_kind = 'call' THEN opens_on + 10 END AS due_on,
  CASE record_kind WHEN 'call' THEN CASE WHEN id % 3 = 0 THEN 'eligibility_excerpt_requires_review' ELSE 'eligibility_excerpt_requires_review,opening_status_not_published_in_listing' END
    WHEN 'funding_scheme' THEN 'eligibility_excerpt_requires_review,scheme_not_a_dated_call' ELSE 'eligibility_excerpt_requires_review,advance_information_not_a_call' END AS flags
FROM fx_opportunities""")
def _(r):
    from noticegrid.sources.pages import rule_record

    label = F.concat_ws(" - ", F.date_format("opens_on", "d.M.yyyy"), F.date_format(F.date_add("opens_on", 10), "d.M.yyyy"))
    word = F.when(F.col("id") % 3 == 0, "Päättynyt").otherwise("")
    rows = rule_record(
        r.fx_opportunities, {"name": "Funder", "date_is_period": True}, title=F.col("title"), url=F.col("canonical_url"),
        body=F.col("description"), date_label=label, status_label=word, level="listing", keep=("id",), kind=F.col("record_kind"))
    return rows.select("id", "source_status", "opens_on", F.try_element_at("deadlines", F.lit(1))["due_on"].alias("due_on"),
                       F.array_join("quality_flags", ",").alias("flags"))


@query("b21_eligibility_excerpt", """
SELECT doc_id, COALESCE(left(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE regexp_matches(line,
  '(?i)voivat hakea|voi hakea|hakukelpoi|hakijaksi|who can apply|eligible applicant|eligibility|public sector|julkiset|julkisen sektorin|yhteisöt|organisations can apply')), 18000), '') AS excerpt
FROM (SELECT doc_id, unnest(string_split(replace(text, ' the ', ' who can apply '), chr(10))) AS line,
  generate_subscripts(string_split(replace(text, ' the ', ' who can apply '), chr(10)), 1) AS pos FROM documents) GROUP BY doc_id""")
def _(r):
    body = F.replace(F.col("text"), F.lit(" the "), F.lit(" who can apply "))
    return r.documents.select("doc_id", text.eligibility_excerpt(body).alias("excerpt"))


def _theme_sql():
    parts = []
    for theme, words in fixed.THEMES.items():
        cond = " OR ".join(f"contains(lower(t), '{w}')" for w in words)
        parts.append(f"SELECT doc_id, '{theme}' AS theme FROM x WHERE {cond}")
    return " UNION ALL ".join(parts)


# The invented prose has no theme words, so frequent fragments stand for some of them.
@query("b22_rule_themes", f"""
WITH x AS (SELECT doc_id, replace(replace(replace(text, 'tion', 'innovation'), 'ther', 'water'), 'sch', 'energia') AS t FROM documents) {_theme_sql()}""")
def _(r):
    body = F.col("text")
    for fragment, word in (("tion", "innovation"), ("ther", "water"), ("sch", "energia")):
        body = F.replace(body, F.lit(fragment), F.lit(word))
    return r.documents.select("doc_id", F.explode(text.rule_themes(body)).alias("theme"))


@query("b30_safe_cell", r"""
SELECT doc_id, CASE WHEN regexp_matches(cell, '^\s*[=+\-@]') THEN '''' || cell ELSE cell END AS cell FROM (
  SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '=' || text WHEN 1 THEN '  @' || text WHEN 2 THEN chr(9) || '-' || text ELSE text END AS cell FROM documents)""")
def _(r):
    head, k = F.col("text"), F.col("doc_id") % 4
    cell = F.when(k == 0, F.concat(F.lit("="), head)).when(k == 1, F.concat(F.lit("  @"), head)).when(
        k == 2, F.concat(F.lit("\t-"), head)).otherwise(F.col("text"))
    return r.documents.select("doc_id", codes.safe_cell(cell).alias("cell"))


_MEDIA = ("application/pdf", "text/html", "TEXT/PLAIN", "image/webp", "application/vnd.ms-excel")


@query("b31_file_extension", """
SELECT id, CASE id % 5 WHEN 0 THEN '.pdf' WHEN 1 THEN '.html' WHEN 2 THEN '.txt' WHEN 3 THEN '.bin' ELSE '.xls' END AS extension FROM fx_documents""")
def _(r):
    media = F.element_at(F.array(*map(F.lit, _MEDIA)), (F.col("id") % 5).cast("int") + 1)
    return r.fx_documents.select("id", codes.extension(media).alias("extension"))


@query("b32_extraction_notes", """
SELECT id, CASE id % 4 WHEN 0 THEN 'Tarkista alkuperäisestä sivut ' || id || '.' WHEN 1 THEN 'Kuvista tunnistettavien sivujen keruuraja on 40 sivua.|Julkaisijan hakutietueesta puuttuu varsinainen sisältöteksti.'
  WHEN 2 THEN '' ELSE 'Alkuperäinen tiedosto on tallennettu, mutta sen kokotekstiä ei voitu poimia.' END AS notes FROM fx_documents""")
def _(r):
    k = F.col("id") % 4
    flags = F.when(k == 0, F.array(F.concat(F.lit("pages_need_visual_or_ocr_review:"), F.col("id")), F.lit("other"))).when(
        k == 1, F.array(F.lit("ocr_page_limit:40"), F.lit(fixed.TOPIC_BODY_MISSING))).when(
        k == 2, F.array(F.lit("unknown_flag"))).otherwise(F.array(F.lit("encrypted_pdf")))
    return r.fx_documents.select("id", F.array_join(codes.extraction_notes(flags), "|").alias("notes"))


@query("b33_response_issue", """
SELECT page_id, CASE WHEN page_id % 5 = 4 THEN NULL WHEN page_id % 5 = 0 THEN 'DOCUMENT_DOWNLOAD_RETURNED_HTML'
  WHEN page_id % 5 IN (1, 2) THEN 'DETAIL_REDIRECTED_TO_FRONT_PAGE' END AS issue FROM pages""")
def _(r):
    k = F.col("page_id") % 5
    plain = F.regexp_replace("url", r"[?#].*$", "")
    url = F.when(k == 0, F.concat(plain, F.lit("/rules.PDF?v=1"))).otherwise(F.col("url"))
    final = F.when(k == 1, "https://www.example.org/fi/").when(k == 2, "https://www.example.org").otherwise(F.col("url"))
    media = F.when(k == 4, "application/pdf").otherwise("text/html")
    return r.pages.select("page_id", codes.response_issue(url, media, final).alias("issue"))


@query("b34_media_type", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'application/octet-stream' WHEN 2 THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' ELSE 'text/plain' END AS media_type FROM documents""")
def _(r):
    k = F.col("doc_id") % 4
    head = F.when(k == 0, F.lit("%PDF-1.7 ")).when(k == 1, F.lit("PK\x03\x04")).when(k == 2, F.lit("PK\x03\x04 xl/workbook.xml")).otherwise("")
    declared = F.when(k == 2, "application/vnd.ms-excel").when(k == 3, "text/plain").otherwise("application/octet-stream")
    return r.documents.select("doc_id", codes.media_type(F.encode(F.concat(head, "text"), "UTF-8"), declared).alias("media_type"))


_RELEVANT = fixed.RELEVANT.replace("(?iu)", "(?i)")
_NAVIGATION = fixed.NAVIGATION.replace("(?iu)", "(?i)")
_INFORMATION = fixed.INFORMATION.replace("(?iu)", "(?i)")


def _decorate(label, position):
    """Give every third and fifth anchor a label that the policy knows."""
    return F.when(position % 5 == 0, F.concat(label, F.lit(" Conditions and guidelines"))).when(
        position % 7 == 0, F.concat(label, F.lit(" cookies annex"))).otherwise(label)


@query("b35_link_policy", f"""
WITH l AS (SELECT a.page_id, a.position, lower(u.scheme) || '://' || u.host || a.href || CASE WHEN a.position % 3 = 0 THEN '.pdf' ELSE '' END AS target_url,
  CASE WHEN a.position % 5 = 0 THEN a.label || ' Conditions and guidelines' WHEN a.position % 7 = 0 THEN a.label || ' cookies annex' ELSE a.label END AS title
  FROM ox_anchors a JOIN ox_page_urls u ON u.page_id = a.page_id)
SELECT page_id, position, CASE WHEN regexp_matches(target_url, '(?i)\\.(pdf|docx?|zip)($|[?#])') THEN 'attachment' ELSE 'reference' END AS role,
  (regexp_matches(target_url, '(?i)\\.(pdf|docx?|zip)($|[?#])') OR regexp_matches(title || ' ' || target_url, '{_RELEVANT}') OR regexp_matches(title || ' ' || target_url, '{_INFORMATION}'))
    AND NOT regexp_matches(title || ' ' || target_url, '{_NAVIGATION}') AS follow FROM l""")
def _(r):
    raw = r.pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)">[^<]*</a>'), 0)).alias("position", "a"))
    href = F.regexp_extract("a", 'href="([^"]*)"', 1)
    target = F.concat(urls.document_url(href, F.col("url")), F.when(F.col("position") % 3 == 0, ".pdf").otherwise(""))
    label = _decorate(F.trim(F.regexp_extract("a", ">([^<]*)<", 1)), F.col("position"))
    rows = raw.withColumn("p", codes.link_policy(target, label, F.lit(False)))
    return rows.select("page_id", F.col("position").cast("bigint").alias("position"), "p.role", "p.follow")


SHARED["ox_body_anchors"] = r"""
SELECT page_id, url, pos - 2 AS position, regexp_extract(piece, '^href="([^"]*)"', 1) AS href, trim(regexp_extract(piece, '>([^<]*)</a>', 1)) AS label
FROM (SELECT page_id, url, unnest(string_split(part, '<a ')) AS piece, generate_subscripts(string_split(part, '<a '), 1) AS pos
  FROM (SELECT page_id, url, regexp_replace(regexp_extract(html, '(?s)<article.*</article>'), '(?s)<nav.*?</nav>', '', 'g') AS part FROM pages)) WHERE pos > 1"""


@query("b36_html_links", r"""
WITH nav AS (SELECT page_id, url, replace(replace(html, '<nav>', '<div>'), '</nav>', '</div>') AS html FROM pages)
SELECT a.page_id, lower(u.scheme) || '://' || u.host || a.href AS target_url, COUNT(*) AS links
FROM ox_anchors a JOIN ox_page_urls u ON u.page_id = a.page_id GROUP BY ALL""")
def _(r):
    # The test pages keep their links in the navigation block, which documents leave out; it is renamed here.
    body = F.replace(F.replace(F.replace(F.replace("html", F.lit("<nav>"), F.lit("<div>")), F.lit("</nav>"), F.lit("</div>")),
                               F.lit("<article"), F.lit("<section")), F.lit("</article>"), F.lit("</section>"))
    parts = r.pages.select("page_id", "url", html.document_part(body).alias("p"))
    rows = links.policy_links(parts.select("page_id", "url", "p.links"), "links", "url", "page_id")
    return rows.groupBy("page_id", "target_url").agg(F.count(F.lit(1)).alias("links"))


@query("b36_malformed_links", """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'malformed_source_url:http://[bad/form.pdf' WHEN 2 THEN 'malformed_source_url:http://[bad/,malformed_source_url:http://]x/' ELSE '' END AS flags,
  CASE page_id % 4 WHEN 0 THEN 'partial_text' ELSE 'extracted' END AS status, CASE page_id % 4 WHEN 1 THEN 'https://ok.example.org:99999/a' WHEN 3 THEN 'http://[2001:db8::1]/a.pdf' ELSE '' END AS targets FROM pages""")
def _(r):
    k = F.col("page_id") % 4
    body = F.when(k == 0, '<a href="http://[bad/form.pdf">Form</a>').when(k == 1, '<a href="https://ok.example.org:99999/a">Port</a>').when(
        k == 2, '<a href="http://[bad/">Us</a><img src="http://[bad/logo.png" alt="Logo"><a href="http://]x/">Them</a>').otherwise('<a href="http://[2001:db8::1]/a.pdf">Six</a>')
    page = F.concat(F.lit("<html><body><main><p>"), "page_id", F.lit("</p>"), body, F.lit("</main></body></html>"))
    parts = r.pages.select("page_id", "url", html.document_part(page).alias("p")).select(
        "page_id", "url", "p.links", F.lit("extracted").alias("status"), F.array().cast("array<string>").alias("flags"))
    marked = links.marked_malformed(parts).select("page_id", F.array_join("flags", ",").alias("flags"), "status")
    found = links.policy_links(parts, "links", "url", "page_id").groupBy("page_id").agg(F.min("target_url").alias("targets"))
    return marked.join(found, "page_id", "left").select("page_id", "flags", "status", F.coalesce("targets", F.lit("")).alias("targets"))


@query("b37_json_lines", """
SELECT event_id, 'k: ' || json_extract_string(props, '$.k') || chr(10) || 'tags[0]: ' || event_type || chr(10) || 'more.deep: true' AS text FROM events""")
def _(r):
    doc = F.concat(F.expr("left(props, length(props) - 1)"), F.lit(',"tags":["'), F.col("event_type"), F.lit('"],"more":"{\\"deep\\": true}"}'))
    return r.events.select("event_id", html.json_lines(doc)["text"].alias("text"))


@query("b38_referenced_codes", """
SELECT event_id, n_nationkey AS code, n_name AS label FROM events JOIN nation ON json_extract_string(props, '$.k') = CAST(n_nationkey AS VARCHAR)""")
def _(r):
    refs = r.events.select("event_id", F.explode(html.json_references(F.col("props"))).alias("ref"))
    table = r.nation.select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("label"), F.col("n_nationkey").cast("string").alias("ref"))
    return refs.join(table, "ref").select("event_id", "code", "label")


@query("b39_published_text", """
SELECT page_id, page_id % 3 = 2 AS published FROM pages""")
def _(r):
    value = F.when(F.col("page_id") % 3 == 2, F.col("html")).when(F.col("page_id") % 3 == 1, "<p>&nbsp; </p><br>").otherwise("<div>\n</div>")
    meta = F.create_map(F.lit("description"), F.array(F.lit(""), value))
    return r.pages.select("page_id", text.any_published(meta, fixed.CONTENT_KEYS).alias("published"))


@query("b40_topic_completeness", """
SELECT p.page_id, CASE WHEN p.page_id % 3 = 2 THEN 'extracted' ELSE 'partial_text' END AS status,
  CASE WHEN p.page_id % 3 = 2 THEN '' ELSE 'full_eu_conditions_not_present_in_source_entry' END AS flags,
  CASE WHEN p.page_id % 3 = 2 THEN '' ELSE p.document || ' source_detail_fallback true' END AS links FROM ox_page_ids p""")
def _(r):
    body = F.when(F.col("page_id") % 3 == 2, F.array("html")).otherwise(F.array(F.lit("<p></p>")))
    docs = F.array(F.struct(F.col("url").alias("url"), F.create_map(F.lit("description"), body, F.lit("url"), F.array("url")).alias("metadata")))
    none = F.array().cast("array<struct<url:string,title:string,role:string,follow:boolean,parser:string>>")
    rows = r.pages.select(
        "page_id", docs.alias("documents"), F.lit("extracted").alias("status"), F.array().cast("array<string>").alias("flags"),
        none.alias("links"), F.lit("https://index.example.org/entry").alias("url"))
    shown = F.transform("links", lambda li: F.concat_ws(" ", li["url"], li["role"], li["follow"].cast("string")))
    return links.topic_completeness(rows).select("page_id", "status", F.array_join("flags", ",").alias("flags"), F.array_join(shown, ",").alias("links"))


@query("b40_faq_completeness", """
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'extracted' ELSE 'partial_text' END AS status,
  CASE WHEN page_id % 2 = 0 THEN '' ELSE 'full_faq_question_or_answer_not_published' END AS flags,
  CASE WHEN page_id % 2 = 0 THEN '' ELSE 'https://api.tech.ec.europa.eu/search-api/prod/rest/document/' || page_id || '?apiKey=SEDIA_FAQ faq_detail_fallback' END AS links FROM pages""")
def _(r):
    answer = F.when(F.col("page_id") % 2 == 0, F.array("html")).otherwise(F.array(F.lit("&nbsp;")))
    meta = F.create_map(
        F.lit("question"), F.array(F.lit("Who?")), F.lit("answer"), answer, F.lit("nid"), F.array(F.col("page_id").cast("string")))
    none = F.array().cast("array<struct<url:string,title:string,role:string,follow:boolean,parser:string>>")
    rows = r.pages.select(
        "page_id", "url", meta.alias("metadata"), F.lit("extracted").alias("status"), F.array().cast("array<string>").alias("flags"), none.alias("links"))
    shown = F.transform("links", lambda li: F.concat_ws(" ", li["url"], li["role"]))
    return links.faq_completeness(rows).select("page_id", "status", F.array_join("flags", ",").alias("flags"), F.array_join(shown, ",").alias("links"))


@query("b41_extraction_quality", """
SELECT doc_id, CASE WHEN lang = 'fr' AND length(text) < 120 THEN 'unreadable' WHEN doc_id % 9 = 1 THEN 'partial_text' ELSE 'extracted' END AS status,
  concat_ws(',', CASE WHEN lang = 'fr' AND length(text) < 120 THEN 'javascript_shell_or_access_challenge' END,
    CASE WHEN doc_id % 9 = 1 AND lang <> 'fr' THEN 'encoding_needs_review' END, CASE WHEN doc_id % 9 = 1 THEN 'decoding_replacement_characters' END) AS flags
FROM (SELECT doc_id, lang, trim(CASE WHEN doc_id % 9 = 1 THEN text || chr(65533) ELSE text END) AS text FROM documents)""")
def _(r):
    body = F.when(F.col("doc_id") % 9 == 1, F.concat("text", F.lit("�"))).otherwise(F.col("text"))
    rows = r.documents.withColumn("q", text.extraction_quality(body, F.lit(""), F.col("lang") == "fr"))
    return rows.select("doc_id", "q.status", F.array_join("q.flags", ",").alias("flags"))


@query("b42_next_daily_check", "SELECT id, date_trunc('day', created_at) + INTERVAL '1' DAY AS next_check FROM fx_changes")
def _(r):
    return r.fx_changes.select("id", status.next_daily_check(F.col("created_at")).alias("next_check"))


@query("b43_origin_deferrals", """
SELECT split_part(error, '|', 2) AS origin, MAX(CAST(split_part(error, '|', 3) AS TIMESTAMP)) AS until, COUNT(*) AS documents
FROM fx_documents WHERE error LIKE 'RATE_LIMIT|%' AND (next_check_at IS NULL OR next_check_at > TIMESTAMP '1998-01-01') GROUP BY 1""")
def _(r):
    rows = r.fx_documents.filter("next_check_at IS NULL OR next_check_at > TIMESTAMP_NTZ '1998-01-01 00:00:00'").select(
        codes.origin_deferral(F.col("error")).alias("d")).filter("d IS NOT NULL")
    return rows.groupBy(F.col("d.origin").alias("origin")).agg(F.max("d.until").alias("until"), F.count(F.lit(1)).alias("documents"))


@query("b44_text_parts", """
SELECT c.id AS document_id, c.current_sha256 AS sha256, CAST(p AS INT) AS part_number, substr(t.text, (p - 1) * 1600 + 1, 1600) AS text
FROM fx_contents c JOIN fx_texts t ON t.doc_id = c.id, range(1, 100000) g(p)
WHERE p <= CAST(ceil(length(t.text) / 1600.0) AS INT) AND EXISTS (SELECT 1 FROM fx_opportunity_documents od WHERE od.document_id = c.id AND od.active AND od.limitation IS NULL)""")
def _(r):
    from noticegrid.operators.predicates import in_scope

    wanted = r.fx_opportunity_documents.filter(in_scope()).select("document_id")
    current = r.fx_contents.join(wanted, F.col("id") == F.col("document_id"), "left_semi").select(
        F.col("id").alias("document_id"), F.col("current_sha256").alias("sha256"))
    # One text per hash before it is cut, so copies are split once per document only at the join.
    texts = r.fx_texts.groupBy("sha256").agg(F.min("text").alias("body"))
    return current.join(texts, "sha256").select(
        "document_id", "sha256", F.explode(text.chunks(F.col("body"), 1600)).alias("p")).select("document_id", "sha256", "p.*")


@query("b22_enriched_record", """
SELECT id, deadline_on, deadline_at, deadline_expires_at, concat_ws(',', CASE WHEN deadline_on IS NULL THEN 'deadline_unknown' END, 'eligibility_not_extracted',
  CASE WHEN deadline_model IN ('two-stage', 'multiple-cut-off') THEN 'stage_access_must_be_checked' END) AS flags FROM ox_expiry""")
def _(r):
    due = F.struct(F.col("deadline_on").alias("due_on"), F.col("deadline_at").alias("due_at"), F.lit("x").alias("original"),
                   F.lit("Europe/Helsinki").alias("timezone"))
    rows = rec.record(
        r.fx_opportunities, keep=("id",), external_id=F.col("external_id"), canonical_url=F.col("canonical_url"), title=F.col("title"),
        description=F.col("description"), deadline_model=F.col("deadline_model"),
        deadlines=F.when(F.col("deadline_on").isNotNull(), F.array(due)).otherwise(F.array()))
    return rec.enrich(rows).select(
        "id", "deadline_on", "deadline_at", "deadline_expires_at", F.array_join("quality_flags", ",").alias("flags"))
