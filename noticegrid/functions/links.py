"""From raw links to policy rows, and the completeness marks of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticegrid.functions import fixed, text, urls
from noticegrid.functions.codes import link_policy


def link_label(link: Column) -> Column:
    """The link's label, with its paragraph where only the paragraph speaks of conditions."""
    bare = F.concat_ws(" ", link["label"], link["href"])
    use = link["context"].isNotNull() & link["context"].rlike(fixed.RELEVANT) & ~bare.rlike(fixed.RELEVANT)
    return F.when(use, F.concat(link["label"], F.lit(" · "), link["context"])).otherwise(link["label"])


def policy_links(parts: DataFrame, links: str = "links", base: str = "url", *keys: str) -> DataFrame:
    """One row per usable link: target, label, role and follow.

    Pictures count only when they show information such as a calendar, and are then required.
    Links to the document itself and malformed addresses are left out; ``marked_malformed`` tells of the latter.
    """
    own = urls.document_url(F.col(base))
    # Addresses are resolved inside the array: a filter on a column made after the explode would be
    # pushed below it and resolve every address again.
    resolved = F.transform(links, lambda li: F.struct(
        li["position"].alias("position"), li["image"].alias("mandatory"),
        F.left(link_label(li), F.lit(1000)).alias("title"),
        (~li["image"] | F.concat_ws(" ", li["label"], li["href"]).rlike(fixed.INFORMATION)).alias("wanted"),
        urls.document_url(li["href"], F.col(base)).alias("target_url")))
    rows = parts.select(*keys, own.alias("_own"), F.explode(resolved).alias("l")).select(*keys, "_own", "l.*")
    rows = rows.filter(F.col("wanted") & F.col("target_url").isNotNull() & ~F.col("target_url").eqNullSafe(F.col("_own")))
    policy = link_policy(F.col("target_url"), F.col("title"), F.col("mandatory"))
    return rows.withColumn("_p", policy).select(
        *keys, "position", "target_url", "title", F.col("_p.role").alias("role"), F.col("_p.follow").alias("follow"))


def one_per_target(links: DataFrame, *keys: str) -> DataFrame:
    """One link per destination: the last followed one, else the first. Combines map-side."""
    follow, position = F.col("follow"), F.col("position")
    rank = F.struct(follow, F.when(follow, position).otherwise(-position))
    rest = [c for c in links.columns if c not in (*keys, "target_url")]
    return links.groupBy(*keys, "target_url").agg(F.max_by(F.struct(*rest), rank).alias("_l")).select(
        *keys, "target_url", "_l.*")


def marked_malformed(parts: DataFrame, links: str = "links", base: str = "url", flag_length: int = 300) -> DataFrame:
    """``status`` and ``flags`` of documents after their links: an http address that cannot be used is a flag.

    The text is partial where that address is a file's, its label speaks of conditions, or it is a
    picture that shows information; other pictures do not count. A flag holds at most
    ``flag_length`` characters of the address.
    """
    wanted = lambda li: ~li["image"] | F.concat_ws(" ", li["label"], li["href"]).rlike(fixed.INFORMATION)
    unusable = lambda li: F.trim(li["href"]).rlike("^https?://") & urls.document_url(li["href"], F.col(base)).isNull()
    bad = F.filter(links, lambda li: wanted(li) & unusable(li))
    weighty = lambda li: li["image"] | li["href"].rlike(fixed.DOCUMENT_URL) | link_label(li).rlike(fixed.RELEVANT)
    flags = F.transform(bad, lambda li: F.concat(F.lit(fixed.MALFORMED_URL), F.left(li["href"], F.lit(flag_length))))
    return parts.withColumn("_bad", bad).withColumns({
        "flags": F.concat("flags", F.when(F.size("_bad") > 0, flags).otherwise(F.array().cast("array<string>"))),
        "status": F.when(F.exists("_bad", weighty), "partial_text").otherwise(F.col("status")),
    }).drop("_bad")


def _incomplete(part: Column, flag: str) -> dict[str, Column]:
    return {
        "status": F.when(part["status"] == "extracted", "partial_text").otherwise(part["status"]),
        "flags": F.array_union(part["flags"], F.array(F.lit(flag))),
    }


def _fallback(links: Column, targets: Column, label: str, role: str, parser: str | None) -> Column:
    """Follow the targets: promote a known link, add an unknown one."""
    known = F.transform(links, lambda li: li["url"])

    def promote(li):
        hit = F.array_contains(targets, li["url"])
        return F.struct(
            li["url"].alias("url"), li["title"].alias("title"),
            F.when(hit, role).otherwise(li["role"]).alias("role"), (li["follow"] | hit).alias("follow"),
            (F.when(hit, parser).otherwise(li["parser"]) if parser else li["parser"]).alias("parser"))

    new = F.transform(F.array_except(targets, known), lambda u: F.struct(
        u.alias("url"), F.lit(label).alias("title"), F.lit(role).alias("role"), F.lit(True).alias("follow"),
        F.lit(parser or "web").alias("parser")))
    return F.concat(F.transform(links, promote), new)


def topic_completeness(df: DataFrame) -> DataFrame:
    """Mark topic documents whose source entry carries no body, and follow the detail addresses.

    Expects ``documents`` (array of struct with url and metadata), ``status``, ``flags``, ``links``
    and ``url``.
    """
    has_body = F.exists("documents", lambda d: text.any_published(d["metadata"], fixed.CONTENT_KEYS))
    hrefs = F.flatten(F.transform("documents", lambda d: F.concat(
        F.array(d["url"]), F.coalesce(F.try_element_at(d["metadata"], F.lit("url")), F.array().cast("array<string>")))))
    targets = F.array_distinct(F.filter(
        F.transform(hrefs, lambda h: urls.document_url(h, F.col("url"))),
        lambda t: t.isNotNull() & ~t.eqNullSafe(urls.document_url(F.col("url")))))
    marks = _incomplete({"status": F.col("status"), "flags": F.col("flags")}, fixed.TOPIC_BODY_MISSING)
    links = _fallback(F.col("links"), targets, "EU-haun lähteessä ilmoitettu lisätietovastaus", "source_detail_fallback", None)
    return _where_missing(df, ~has_body, marks, links)


def faq_completeness(df: DataFrame) -> DataFrame:
    """Mark FAQ documents without a published question or answer; ``metadata`` is their map."""
    complete = text.any_published(F.col("metadata"), ("question",)) & text.any_published(F.col("metadata"), ("answer",))
    nid = F.try_element_at(F.try_element_at("metadata", F.lit("nid")), F.lit(1))
    before, after = fixed.FAQ_DETAIL_URL.split("{}")
    target = F.concat(F.lit(before), nid, F.lit(after))
    usable = F.coalesce(nid.rlike(r"^\d+$") & ~target.eqNullSafe(urls.document_url(F.col("url"))), F.lit(False))
    targets = F.when(usable, F.array(target)).otherwise(F.array().cast("array<string>"))
    marks = _incomplete({"status": F.col("status"), "flags": F.col("flags")}, fixed.FAQ_BODY_MISSING)
    links = _fallback(
        F.col("links"), targets, "FAQ-kysymyksen julkinen lisätietovastaus", "faq_detail_fallback", "eu_faq_detail")
    return _where_missing(df, ~complete, marks, links)


def _where_missing(df: DataFrame, missing: Column, marks: dict[str, Column], links: Column) -> DataFrame:
    return df.withColumns({
        "status": F.when(missing, marks["status"]).otherwise(F.col("status")),
        "flags": F.when(missing, marks["flags"]).otherwise(F.col("flags")),
        "links": F.when(missing, links).otherwise(F.col("links")),
    })
