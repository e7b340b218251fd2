"""Lookup, export and integrity joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticegrid.operators.registry import with_contents


def code_labels(rows: DataFrame, codes: DataFrame, code: str, label: str, out: str) -> DataFrame:
    """Label of a code, or the code itself where the list has none."""
    table = codes.select(F.col(code).alias("_code"), F.col(label).alias("_label"))
    return rows.join(table, rows[out] == F.col("_code"), "left").withColumn(
        out, F.coalesce("_label", F.col(out).cast("string"))).drop("_code", "_label")


def notice_document_export(notices: DataFrame, bridge: DataFrame, documents: DataFrame, blobs: DataFrame) -> DataFrame:
    """Notices with their active documents and contents; notices without documents stay."""
    active = bridge.filter("active").select("opportunity_id", "document_id", "depth", "role", "limitation")
    docs = with_contents(documents.withColumnRenamed("id", "document_id"), blobs.withColumnRenamed("sha256", "current_sha256"))
    # Notices come last: those without documents have no document to look up.
    return notices.select(F.col("id").alias("opportunity_id"), "title").join(active.join(docs, "document_id", "left"), "opportunity_id", "left")


def tags_on_notices(notices: DataFrame, tags: DataFrame) -> DataFrame:
    """Theme and region lists on each notice. Tag values are distinct per notice before they are listed."""
    distinct = tags.filter(F.col("kind").isin("theme", "region")).select("opportunity_id", "kind", "value").distinct()
    def listed(kind):
        return F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("value")))), ", ")

    lists = distinct.groupBy("opportunity_id").agg(listed("theme").alias("themes"), listed("region").alias("regions"))
    joined = notices.join(lists, notices.id == lists.opportunity_id, "left").drop("opportunity_id")
    return joined.fillna("", ["themes", "regions"])


def evidence(items: DataFrame, notice) -> DataFrame:
    """Source items of one notice with their raw evidence parsed."""
    return items.filter(F.col("opportunity_id") == notice).withColumn("raw", F.parse_json("payload_json"))


def document_version(documents: DataFrame, versions: DataFrame, blobs: DataFrame, links: DataFrame, document, sha256=None) -> DataFrame:
    """Text of one document version with that version's links; it must be in the document's history.

    ``sha256`` defaults to the current version. All inputs are cut to one document first.
    """
    doc = documents.filter(F.col("id") == document)
    wanted = F.coalesce(F.lit(sha256), F.col("current_sha256")) if sha256 else F.col("current_sha256")
    history = versions.filter(F.col("document_id") == document)
    chosen = doc.withColumn("sha256", wanted).join(history.select("sha256"), "sha256", "left_semi")
    counted = history.groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("versions"))
    edges = links.filter(F.col("document_id") == document).groupBy(
        F.col("document_id").alias("id"), F.col("source_sha256").alias("sha256")
    ).agg(F.count(F.lit(1)).alias("links"), F.count(F.when(F.col("follow"), 1)).alias("followed"))
    return chosen.join(blobs, "sha256").join(counted, "id").join(edges, ["id", "sha256"], "left").fillna(0, ["links", "followed"])


def version_history(documents: DataFrame, versions: DataFrame, document) -> DataFrame:
    """All versions of one document with their sightings, and which of them is current."""
    current = documents.filter(F.col("id") == document).select(F.col("id").alias("document_id"), "current_sha256")
    return versions.filter(F.col("document_id") == document).join(current, "document_id").withColumn(
        "is_current", F.col("sha256").eqNullSafe(F.col("current_sha256"))).drop("current_sha256")


def version_links(documents: DataFrame, versions: DataFrame, links: DataFrame, document, sha256=None) -> DataFrame:
    """Link rows of one version of one document, the current one unless ``sha256`` names another of its history."""
    chosen = version_history(documents, versions, document).filter(F.col("sha256") == sha256 if sha256 else F.col("is_current"))
    own = links.filter(F.col("document_id") == document)
    return own.join(chosen.select("document_id", F.col("sha256").alias("source_sha256")), ["document_id", "source_sha256"], "left_semi")


def current_links(links: DataFrame, documents: DataFrame) -> DataFrame:
    """Followed links of the documents' current versions only."""
    current = documents.select(F.col("id").alias("document_id"), F.col("current_sha256").alias("source_sha256"))
    return links.filter("follow").join(current, ["document_id", "source_sha256"])


def unknown_targets(links: DataFrame, documents: DataFrame, target: str = "target_url") -> DataFrame:
    """Followed link targets without a document; one row per address."""
    wanted = links.filter("follow").select(target).distinct()
    return wanted.join(documents.select(F.col("url").alias(target)), target, "left_anti").withColumn(
        "document_id", F.sha2(target, 256))


def affected_notices(changed: DataFrame, documents: DataFrame, bridge: DataFrame, shared: bool = True) -> DataFrame:
    """Notices with an active link to a changed document or, if ``shared``, to one with the same content."""
    touched = changed.select("document_id")
    if shared:
        hashes = documents.join(touched, documents.id == F.col("document_id"), "left_semi").select("current_sha256")
        twins = documents.join(hashes.filter("current_sha256 IS NOT NULL").distinct(), "current_sha256", "left_semi")
        touched = touched.union(twins.select("id"))
    return bridge.filter("active").join(touched.distinct(), "document_id", "left_semi").select("opportunity_id").distinct()
