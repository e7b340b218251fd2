"""Search-API documents: typed identities, several raw variants per topic."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticegrid.functions import codes, dates, fixed, html
from noticegrid.functions.record import record

PORTAL = "https://ec.europa.eu/info/funding-tenders/opportunities/portal/screen/opportunities/"
ZONE = "UTC (source offset)"


def split_identities(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) documents; the rejected ones carry a reason."""
    meta = F.col("metadata")
    typed = documents.withColumn("_t", codes.typed_identity(
        codes.first_value(meta, "type"), codes.first_value(meta, "identifier"), codes.first_value(meta, "callccm2Id")))
    stages = F.coalesce(F.try_element_at(meta, F.lit("deadlineDate")), F.array().cast("array<string>"))
    bad = F.array_compact(F.transform(F.array_append(stages, F.left(codes.first_value(meta, "startDate"), F.lit(10))), dates.unusable))
    reason = F.coalesce(F.col("_t.problem"), F.try_element_at(bad, F.lit(1)))
    typed = typed.withColumn("reason", reason)
    accepted = typed.filter("reason IS NULL").withColumns(
        {"topic": F.col("_t.external_id"), "programme": F.col("_t.programme")}).drop("_t", "reason")
    return accepted, typed.filter("reason IS NOT NULL").drop("_t")


def preferred_variants(documents: DataFrame) -> DataFrame:
    """One document per topic, with how many there were and whether their deadlines disagree.

    A single aggregation with map-side combine: a topic with very many mirrors never meets in one
    task, and the raw texts of losing variants are dropped before the shuffle.
    """
    meta = F.col("metadata")
    queue = F.coalesce(F.nullif(codes.first_value(meta, "esDA_QueueDate"), F.lit("")), codes.first_value(meta, "es_SortDate"))
    rank = F.struct(
        (codes.first_value(meta, "DATASOURCE") == fixed.PRIMARY_DATASOURCE).alias("primary"), queue.alias("queue"),
        F.coalesce(F.col("reference"), F.lit("")).alias("reference"))
    stages = F.array_join(F.array_sort(F.array_distinct(
        F.coalesce(F.try_element_at(meta, F.lit("deadlineDate")), F.array().cast("array<string>")))), "|")
    rest = [c for c in documents.columns if c != "topic"]
    return documents.withColumn("_stages", stages).groupBy("topic").agg(
        F.max_by(F.struct(*rest), rank).alias("_d"), F.count(F.lit(1)).alias("variants"),
        (F.min("_stages") != F.max("_stages")).alias("conflict"),
    ).select("topic", "_d.*", "variants", "conflict")


def search_records(preferred: DataFrame, strip_html: bool = True) -> DataFrame:
    meta = F.col("metadata")

    def value(key, default=""):
        return codes.first_value(meta, key, default)

    kind, call_id = value("type"), value("callccm2Id")
    body = F.coalesce(F.nullif(F.col("content"), F.lit("")), F.col("summary"), F.lit(""))
    content = F.coalesce(F.col("content"), F.lit(""))
    title = F.when(kind == "8", F.coalesce(
        F.nullif(value("caName"), F.lit("")), F.nullif(content, F.lit("")), value("title"))).otherwise(
        F.coalesce(F.nullif(value("title"), F.lit("")), content))
    slug = F.replace(F.url_encode(F.lower(value("identifier"))), F.lit("+"), F.lit("%20"))
    url = F.when(kind == "8", F.concat(F.lit(PORTAL + "competitive-calls-cs/"), call_id)).otherwise(
        F.concat(F.lit(PORTAL + "topic-details/"), slug))
    days = F.array_sort(F.array_distinct(F.coalesce(F.try_element_at(meta, F.lit("deadlineDate")), F.array().cast("array<string>"))))
    flags = F.array_compact(F.array(
        F.lit("consortium_and_country_rules_not_extracted"),
        F.when(F.col("variants") > 1, "multiple_source_documents_for_topic"),
        F.when(F.col("conflict"), "conflicting_source_deadlines")))
    start = F.left(value("startDate"), F.lit(10)).try_cast("date")
    return record(
        preferred, keep=("topic", "variants", "conflict", "reference"),
        external_id=F.col("topic"), canonical_url=url, title=title,
        description=html.clean_html(body) if strip_html else F.trim(body),
        funder=F.lit("European Commission / EU"), programme=F.col("programme"), language=F.lit("en"),
        source_status=codes.lookup(value("status"), fixed.SEARCH_STATUS, "unknown"),
        deadlines=F.transform(days, lambda d: dates.due(d, ZONE)), opens_on=start,
        deadline_model=value("deadlineModel", "unknown"), geographic_scope=F.lit("eu"), quality_flags=flags)


RAW = "documents array<struct<reference:string,url:string,content:string,summary:string,metadata:map<string,array<string>>>>"


def reread(items: DataFrame) -> DataFrame:
    """Documents of stored raw evidence, ready for the same preference and record steps."""
    parsed = F.from_json("raw_json", f"struct<{RAW.replace(' ', ':', 1)}>")
    return items.select(F.explode(parsed["documents"]).alias("d")).select("d.*")
