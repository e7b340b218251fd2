"""JSON listings: the paged one, and the one embedded in an HTML script."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticegrid.functions import codes, dates, fixed, html, text
from noticegrid.functions.record import record
from noticegrid.sources.landed import EMBEDDED, fail_unless

ZONE = "Europe/Helsinki"
NOTICE_URL = "https://www.haeavustuksia.fi/fi/haku/"
EMBEDDED_URL = "https://eura2021.fi/hakuilmoitukset/hakuilmoitus/"
MARKER = r"(?is)<script[^>]*>\s*(%7B%22preRenderData%22[^<]*)</script>"


def paged_rows(pages: DataFrame) -> DataFrame:
    """One row per listed notice, with its page and the total its page advertised."""
    return pages.select(
        F.col("pageNo").alias("page"), F.col("totalCount").alias("expected"),
        F.posexplode("hakuilmoitukset").alias("position", "row"))


def checked_rows(pages: DataFrame) -> DataFrame:
    """``paged_rows`` with ``raw`` and ``reason``, and one row that is not ``listed`` for a page without notices.

    A row without an identifier, with a time that has no offset or with a day that no calendar has
    is rejected. ``last_page`` is the number of pages that the row's page advertised.
    """
    rows = pages.select(
        F.col("pageNo").alias("page"), F.col("totalCount").alias("expected"), F.col("pageCount").alias("last_page"),
        F.posexplode_outer("hakuilmoitukset").alias("position", "row"))
    row = F.col("row")
    reason = F.when(F.coalesce(F.length(row["hakuasianAsianumero"]), F.lit(0)) == 0, fixed.NO_IDENTIFIER).otherwise(
        F.coalesce(*(dates.unusable(row[c]) for c in ("hakuAlkaaDateTimeUtc", "hakuPaattyyDateTimeUtc"))))
    return rows.withColumns({"listed": row.isNotNull(), "raw": F.to_json("row"), "reason": reason})


def paged_records(rows: DataFrame, as_of: str, strip_html: bool = True) -> DataFrame:
    row = F.col("row")
    start, end = row["hakuAlkaaDateTimeUtc"], row["hakuPaattyyDateTimeUtc"]
    rolling = F.coalesce(row["hakuTyyppi"] == "Jatkuva", F.lit(False))
    # Staged as columns: what is used several times is parsed once.
    rows = rows.withColumns({"_starts": dates.parse_time(start), "_ends": dates.parse_time(end)})
    rows = rows.withColumn("_opens", dates.published_day(start, ZONE, F.col("_starts")))
    opens, ends_at = F.col("_opens"), F.col("_ends")
    due = F.struct(
        dates.published_day(end, ZONE, ends_at).alias("due_on"), ends_at.alias("due_at"), end.alias("original"),
        F.lit(ZONE).alias("timezone"))
    clean = html.clean_html if strip_html else (lambda c: F.trim(c))
    return record(
        rows, keep=tuple(c for c in ("page", "position", "expected", "last_page", "row", "listed", "raw", "reason") if c in rows.columns),
        external_id=row["hakuasianAsianumero"],
        canonical_url=F.concat(F.lit(NOTICE_URL), F.replace(F.url_encode(row["hakuasianAsianumero"]), F.lit("+"), F.lit("%20"))),
        title=clean(text.translated(row["nimi"])), description=clean(text.translated(row["kuvaus"])),
        funder=clean(text.translated(row["vastuullinenJarjestajaOrganisaatio"]["nimi"])),
        programme=F.lit("Valtionavustukset"), opens_on=opens,
        source_status=codes.listing_status(start, opens, ends_at, rolling, as_of),
        deadline_model=F.when(rolling, "rolling").otherwise("single-stage"),
        deadlines=F.when(F.length(end) > 0, F.array(due)).otherwise(F.array()),
        quality_flags=F.array(F.lit("geographic_eligibility_not_extracted")),
    )


def embedded_data(pages: DataFrame) -> DataFrame:
    """Parsed payload of each page; a page without the marker or without notices stops the job."""
    raw = F.regexp_extract("html", MARKER, 1)
    # A plus sign is itself in percent-encoded JSON, not a space.
    decoded = F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    data = fail_unless(F.length(raw) > 0, F.from_json(decoded, EMBEDDED)["preRenderData"],
                       "Public preRenderData not found; adapter needs review")
    parsed = pages.select(*[c for c in pages.columns if c != "html"], data.alias("data"))
    notices = fail_unless(F.size("data.hankehaku") > 0, F.col("data.hankehaku"), "List is unexpectedly empty or malformed")
    return parsed.withColumn("notices", notices)


def embedded_rows(pages: DataFrame) -> DataFrame:
    """One row per embedded notice, with the region and authority names of its own page looked up.

    No page is without notices here. The outer form says so to Spark, which else filters the pages on
    it first and for that parses every payload again. What a notice keeps of its page is taken out
    before, as a row would carry the whole payload on.
    """
    kept = [c for c in pages.columns if c != "html"]
    paged = embedded_data(pages).select(*kept, F.col("data.koodisto").alias("codes"), F.size("notices").alias("expected"), "notices")
    return paged.select(*kept, "codes", "expected", F.posexplode_outer("notices").alias("position", "row"))


def checked_embedded(rows: DataFrame) -> DataFrame:
    """``embedded_rows`` with ``raw`` and, where start or end cannot be read, the ``reason`` to reject the row."""
    row = F.col("row")
    reason = F.coalesce(*(dates.unusable(row["hakuaika"][c]) for c in ("alku", "loppu")))
    return rows.withColumns({"listed": F.lit(True), "raw": F.to_json("row"), "reason": reason})


def embedded_records(rows: DataFrame, strip_html: bool = True) -> DataFrame:
    row, tables = F.col("row"), F.col("codes")
    # Staged as columns: the names are looked up once, and rows go to Python without the code lists.
    keep = tuple(c for c in rows.columns if c != "codes")
    authority = F.coalesce(row["viranomainen"], F.lit(""))
    rows = rows.select(
        *keep, F.coalesce(F.try_element_at(tables["viranomainen"], authority)["fi"], authority).alias("_funder"),
        F.transform(
            F.coalesce(row["maakunnat"], F.array().cast("array<string>")),
            lambda c: F.coalesce(F.try_element_at(tables["maakunta"], c)["fi"], c)).alias("_areas"))
    areas = F.col("_areas")
    end, rolling = row["hakuaika"]["loppu"], F.coalesce(row["jatkuvaHaku"], F.lit(False))
    amount = codes.amount(row["kokonaistuki"])
    body = F.coalesce(row["kuvaus"], F.lit(""))
    return record(
        rows, keep=keep,
        external_id=row["id"], canonical_url=F.concat(F.lit(EMBEDDED_URL), row["id"]), title=row["otsikko"],
        description=html.clean_html(body) if strip_html else F.trim(body), funder=F.col("_funder"),
        programme=F.coalesce(row["rahasto"], F.lit("EURA 2021")),
        source_status=F.when(rolling, "rolling").otherwise(codes.lookup(row["tila"], codes.fixed.PORTAL_STATUS, "unknown")),
        opens_on=row["hakuaika"]["alku"].try_cast("date"),
        deadlines=F.when(F.length(end) > 0, F.array(dates.due(end, ZONE))).otherwise(F.array()),
        deadline_model=F.when(rolling, "rolling").otherwise("single-stage"),
        geographic_scope=codes.region_scope(F.coalesce(row["alue"] == "VALTAKUNNALLINEN", F.lit(False)), areas),
        total_budget=amount, currency=F.when(amount.isNotNull(), "EUR"),
        detail_level=F.when(row["kuvaus"].isNotNull(), "full").otherwise("listing"),
        tags=F.transform(areas, lambda a: F.struct(
            F.lit("region").alias("kind"), a.alias("value"), F.lit("source").alias("basis"))),
        quality_flags=F.when(F.length(end) > 0, F.array(F.lit("date_only_deadline"))).otherwise(F.array()),
    )
