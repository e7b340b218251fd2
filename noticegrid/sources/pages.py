"""HTML sources: WordPress posts, card catalogues, configured pages and watched pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticegrid.functions import codes, dates, fixed, html, text, urls
from noticegrid.functions.record import record
from noticegrid.operators.predicates import listed
from noticegrid.sources.landed import fail_unless

ZONE = "Europe/Helsinki"
MAIN_LENGTH = 100


def rule_record(df: DataFrame, config: dict, *, title, url, body, date_label, status_label, level, keep=(), opens=None,
                rolling=None, kind=None, external_id=None) -> DataFrame:
    """Record of a page or card: dates only for calls, status only as published.

    Nothing is inferred: a scheme has no dates, a future deadline alone does not open a round.
    """
    kind = F.lit(config.get("record_kind", "call")) if kind is None else kind
    labels = {
        "_kind": kind, "_found": F.when(kind == "call", dates.dates_in_label(date_label, config.get("timezone", ZONE))),
        "_state": codes.status_word(F.coalesce(status_label, F.lit(""))),
        "_labelled": F.length(F.trim(F.coalesce(status_label, F.lit("")))) > 0,
    }
    # Staged as columns so that each label is parsed once.
    df = df.withColumns(labels)
    kind, labelled = F.col("_kind"), F.col("_labelled")
    call = kind == "call"
    none = F.array().cast("array<struct<due_on:date,due_at:timestamp_ntz,original:string,timezone:string>>")
    found = F.coalesce("_found", none)
    period = (F.size(found) == 2) & F.lit(bool(config.get("date_is_period")))
    start = F.when(period, F.element_at(found, 1)["due_on"])
    start = start if opens is None else F.coalesce(F.when(call, opens), start)
    ends = F.when(F.size(found) > 0, F.slice(found, -1, 1)).otherwise(none)
    state = F.when(start.isNotNull() & (F.size(ends) > 0) & ~labelled, "open").otherwise(F.col("_state"))
    model = F.when(F.size(ends) > 0, "single-stage").otherwise("unknown")
    if config.get("deadline_model"):
        model = F.lit(config["deadline_model"])
    if rolling is not None:
        rolling = F.coalesce(rolling & call, F.lit(False))
        state, model = F.when(rolling, "rolling").otherwise(state), F.when(rolling, "rolling").otherwise(model)
        ends = F.when(rolling, none).otherwise(ends)
    flags = F.array_compact(F.concat(
        F.array(F.lit("eligibility_excerpt_requires_review")), F.array(*map(F.lit, config.get("quality_flags", []))).cast("array<string>"),
        F.array(
            F.when(kind == "funding_scheme", "scheme_not_a_dated_call"),
            F.when(kind == "advance_information", "advance_information_not_a_call"),
            F.when((F.size(found) > 0) & ~labelled, "opening_status_not_published_in_listing"))))
    eligibility = text.eligibility_excerpt(body)
    if config.get("eligibility_note"):
        eligibility = F.concat(eligibility, F.lit(
            "\n[Lähderekisterin huomio; ei kelpoisuuspäätös] " + config["eligibility_note"]))
    return record(
        df, keep=keep, external_id=urls.canonical_url(url) if external_id is None else external_id,
        canonical_url=url, title=title, description=body, funder=F.lit(config.get("funder", config["name"])),
        programme=F.lit(config.get("programme", "")), record_kind=kind,
        instrument=F.lit(config.get("instrument", "grant")), language=F.lit(config.get("language", "fi")),
        geographic_scope=F.lit(config.get("geographic_scope", "unknown")), source_status=state, opens_on=start,
        deadlines=ends, deadline_model=model, detail_level=F.lit(level) if isinstance(level, str) else level,
        eligibility_text=eligibility, quality_flags=flags)


IMPOSSIBLE_DATE = fixed.NO_SUCH_DAY


def _carried(rows: DataFrame, *names: str) -> tuple[str, ...]:
    """The provenance columns that ``rows`` has."""
    return tuple(n for n in names if n in rows.columns)


# --- WordPress ------------------------------------------------------------------------------
META = {k: f".single-meta--{k} .single-meta__data" for k in ("program", "start-datetime", "end-datetime", "status")}


def post_records(posts: DataFrame, config: dict) -> DataFrame:
    """Posts of one type with their metadata in marked blocks; ``reason`` is set on rejects."""
    body = F.col("content.rendered")
    rows = posts.withColumn("_meta", html.fields(body, META)).withColumn("_text", html.semantic_text(body))
    rows = rows.withColumn("_title", html.clean_html(F.col("title.rendered")))
    values = F.filter(F.map_values("_meta"), lambda v: F.length(v) > 0)
    reason = F.when(
        (F.col("type") != config["post_type"]) | (F.col("status") != "publish"), "Not a published funding request"
    ).when(F.size(values) == 0, "Funding metadata missing; parser review required")

    def meta(key):
        return F.coalesce(F.try_element_at("_meta", F.lit(key)), F.lit(""))

    rows = rows.withColumn("_ends", dates.dates_in_label(meta("end-datetime"), ZONE))
    rows = rows.withColumn("reason", F.coalesce(reason, F.when(dates.impossible(F.col("_ends")), IMPOSSIBLE_DATE)))
    starts = dates.dates_in_label(meta("start-datetime"), ZONE)
    return record(
        rows, keep=_carried(rows, "id", "reason", "raw"), external_id=F.col("id").cast("string"), canonical_url=F.col("link"),
        title=F.col("_title"), description=F.col("_text"), funder=F.lit(config["funder"]), programme=meta("program"),
        source_status=codes.status_word(meta("status")), opens_on=F.try_element_at(starts, F.lit(1))["due_on"],
        deadlines=F.col("_ends"), deadline_model=F.when(F.size("_ends") > 0, "single-stage").otherwise("unknown"),
        geographic_scope=F.lit(config.get("geographic_scope", "finland")), detail_level=F.lit("full"),
        eligibility_text=text.eligibility_excerpt(F.col("_text")),
        quality_flags=F.array(F.lit("eligibility_excerpt_requires_review")))


def post_statuses(posts: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Status of each post from its taxonomy ids; conflicting ones set ``reason``.

    The taxonomy is one page of at most 100 terms. Posts with one term never shuffle beyond the
    min/max pair that detects a conflict.
    """
    words = taxonomy.select(
        F.col("id").cast("int").alias("code"), codes.status_word(F.col("name")).alias("word"))
    exploded = posts.select("id", F.explode_outer("status_ids").alias("code"))
    joined = exploded.join(words, "code", "left").withColumn(
        "word", F.when(F.col("code").isNotNull(), F.coalesce("word", F.lit("unknown"))))
    found = joined.groupBy("id").agg(F.min("word").alias("_lo"), F.max("word").alias("_hi"))
    return posts.join(found, "id").select(
        *posts.columns, F.coalesce("_lo", F.lit("unknown")).alias("status_word"),
        F.when(F.col("_lo") != F.col("_hi"), "Conflicting WordPress call statuses").alias("reason"))


def post_calls(posts: DataFrame, taxonomy: DataFrame, config: dict) -> DataFrame:
    """Calls of a WordPress post type: closing labels from the body, status from the taxonomy."""
    rows = post_statuses(posts, taxonomy)
    kind_problem = F.when((F.col("type") != config["post_type"]) | (F.col("status") != "publish"),
                          "Duplicate or unsupported WordPress record")
    body = F.col("content.rendered")
    rows = rows.withColumn("_body", html.labelled_text(body, "p,li,tr"))
    labels = F.filter("_body.labels", lambda t: t.rlike("(?i)" + fixed.DEADLINE_LABEL))
    rows = rows.withColumn("_labels", F.array_join(labels, "\n"))
    bad_date = dates.impossible(dates.dates_in_label(F.col("_labels"), config.get("timezone", ZONE)))
    rows = rows.withColumns({
        "reason": F.coalesce(kind_problem, F.col("reason"), F.when(bad_date, IMPOSSIBLE_DATE)),
        "_text": F.col("_body.text"), "_title": html.unescaped(html.clean_html(F.col("title.rendered"))),
    })
    return rule_record(
        rows, config, title=F.col("_title"), url=F.col("link"), body=F.col("_text"), date_label=F.col("_labels"),
        status_label=F.col("status_word"), level="full", keep=_carried(rows, "id", "reason", "raw"), external_id=F.col("id").cast("string"))


# --- catalogues -----------------------------------------------------------------------------
def catalogue_cards(pages: DataFrame, config: dict) -> DataFrame:
    """Kept cards: absolute address, title, texts. ``page_id`` and ``position`` give listing order."""
    found = pages.select("page_id", F.col("url").alias("listing_url"), html.cards(F.col("html"), config).alias("_cards"))
    # Addresses are resolved inside the array, so that the filters below do not resolve them again.
    fields = ("position", "title", "text", "date_label", "status_label", "open_label")
    resolved = F.transform("_cards", lambda c: F.struct(
        *(c[f].alias(f) for f in fields), (F.length(c["href"]) > 0).alias("linked"),
        urls.canonical_url(urls.resolve(c["href"], F.col("listing_url"))).alias("target")))
    checked = fail_unless(F.size("_cards") > 0, resolved, "Funder cards missing; parser review required")
    rows = found.select("page_id", "listing_url", F.explode(checked).alias("c")).select("page_id", "listing_url", "c.*")
    if not config.get("skip_cards_without_link"):
        rows = rows.withColumn("linked", fail_unless(F.col("linked"), F.col("linked"), "Funder card link missing"))
    keep = listed(
        F.col("target"), F.col("title"), include_url=config.get("include_url"),
        include_title=config.get("include_title"), exclude_title=config.get("exclude_title"))
    return rows.filter(F.col("linked") & (F.length("title") > 0) & F.col("target").isNotNull() & keep).drop("linked")


def card_rejects(pages: DataFrame, config: dict) -> DataFrame:
    """Cards that ``catalogue_cards`` leaves out although they are listed, each with its reason."""
    found = pages.select("page_id", F.col("url").alias("listing_url"), F.posexplode(html.cards(F.col("html"), config)).alias("_n", "c")).select(
        "page_id", "listing_url", "c.position", "c.href", "c.title")
    target = urls.canonical_url(urls.resolve(F.col("href"), F.col("listing_url")))
    reason = F.when(F.length("href") == 0, "Card without a link").when(target.isNull(), "Card address cannot be used").when(
        F.length("title") == 0, "Card without a title")
    return found.withColumn("reason", reason).filter("reason IS NOT NULL")


def distinct_cards(cards: DataFrame) -> DataFrame:
    """First card per address; ``conflict`` marks addresses listed with different content.

    Within a page only the first card of an address counts. Both steps combine map-side.
    """
    order = F.struct("page_id", "position")
    rest = [c for c in cards.columns if c not in ("target",)]
    per_page = cards.groupBy("page_id", "target").agg(F.min_by(F.struct(*rest), order).alias("_c")).select(
        "target", "_c.*")
    return per_page.withColumn("_hash", F.sha2("text", 256)).groupBy("target").agg(
        F.min_by(F.struct(*rest), order).alias("_c"), F.count(F.lit(1)).alias("listings"),
        (F.min("_hash") != F.max("_hash")).alias("conflict"),
    ).select("target", "_c.*", "listings", "conflict")


def catalogue_records(cards: DataFrame, config: dict, details: DataFrame | None = None) -> DataFrame:
    """Records of distinct cards; with ``details`` (target, body) the full text replaces the listing."""
    rows, body, level = cards, F.col("text"), "listing"
    if details is not None:
        rows = cards.join(details.select("target", F.col("body").alias("_body")), "target", "left")
        body = F.coalesce("_body", "text")
        level = F.when(F.col("_body").isNotNull(), "full").otherwise("listing")
    starts = dates.dates_in_label(F.col("open_label"), config.get("timezone", ZONE))
    opens = F.try_element_at(starts, F.lit(1))["due_on"] if config.get("open_date_selector") else None
    records = rule_record(
        rows, config, title=F.col("title"), url=F.col("target"), body=body, date_label=F.col("date_label"),
        status_label=F.col("status_label"), level=level, keep=_carried(rows, "conflict", "listings", "raw"), opens=opens)
    if details is not None:
        missing = F.col("detail_level") == "listing"
        records = records.withColumn("quality_flags", F.when(missing, F.array_append(
            "quality_flags", F.lit("detail_fetch_failed_listing_retained"))).otherwise(F.col("quality_flags")))
    return records


def main_text(pages: DataFrame, config: dict) -> Column:
    return html.semantic_text(F.col("html"), config.get("selector", "main, article, #content"))


def _named_pages(pages: DataFrame, entries: DataFrame) -> DataFrame:
    wanted = entries.groupBy(urls.canonical_url(F.col("url")).alias("_key")).agg(
        F.min("title").alias("_named"), F.min("record_kind").alias("_kind"), F.count(F.lit(1)).alias("_n"))
    wanted = wanted.withColumn("_kind", fail_unless(F.col("_n") == 1, F.col("_kind"), "Duplicate configured scheme URL")).drop("_n")
    return pages.withColumn("_key", urls.canonical_url(F.col("url"))).join(wanted, "_key")


def configured_page_rejects(pages: DataFrame, entries: DataFrame, config: dict) -> DataFrame:
    """Configured pages without a usable main part, each with its reason."""
    rows = _named_pages(pages, entries)
    body = main_text(rows, config)
    rows = rows.withColumn("_text", body)
    reason = F.when(F.col("_text").isNull(), "Expected main content selector missing").when(
        F.length("_text") < MAIN_LENGTH, "Page content too short; possible error or bot challenge")
    return rows.withColumn("reason", reason).filter("reason IS NOT NULL").select("page_id", "url", "reason")


def configured_pages(pages: DataFrame, entries: DataFrame, config: dict) -> DataFrame:
    """Records of the pages that the configuration names, matched on the canonical address.

    ``entries`` holds address, optional title and record kind; the page side is reduced by the join
    before any HTML is parsed.
    """
    rows = _named_pages(pages, entries)
    selectors = {"h1": "h1"}
    for name in ("date_selector", "status_selector", "open_date_selector", "rolling_selector"):
        if config.get(name):
            selectors[name] = config[name]
    scope = config.get("selector", "main, article, #content")
    rows = rows.withColumn("_text", main_text(rows, config)).withColumn("_f", html.fields(F.col("html"), selectors, scope))
    rows = rows.filter(F.length("_text") >= MAIN_LENGTH)

    def found(key):
        return F.coalesce(F.try_element_at("_f", F.lit(key)), F.lit(""))

    starts = dates.dates_in_label(found("open_date_selector"), config.get("timezone", ZONE))
    return rule_record(
        rows, config, title=F.coalesce("_named", F.nullif(found("h1"), F.lit(""))), url=F.col("_key"), body=F.col("_text"),
        date_label=found("date_selector"), status_label=found("status_selector"), level="full", keep=_carried(rows, "page_id", "raw"),
        kind=F.coalesce("_kind", F.lit(config.get("record_kind", "funding_scheme"))),
        opens=F.try_element_at(starts, F.lit(1))["due_on"],
        rolling=found("rolling_selector").rlike(r"(?iu)^jatkuva haku\b"))


# --- page watch -----------------------------------------------------------------------------
def watched_pages(pages: DataFrame, selector: str = "main, article") -> DataFrame:
    """Main text and its hash per page; short or missing content sets ``reason``."""
    rows = pages.withColumn("text", html.watched_text(F.col("html"), selector))
    reason = F.when(F.col("text").isNull(), "Expected main content selector missing").when(
        F.length("text") < MAIN_LENGTH, "Page content too short; possible error or bot challenge")
    return rows.select("page_id", "url", "text", F.sha2("text", 256).alias("text_hash"), reason.alias("reason"))
