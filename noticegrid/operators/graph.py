"""Bounded reachability of documents per notice, as level-synchronous joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noticegrid.functions import fixed, urls
from noticegrid.functions.codes import lookup
from noticegrid.session import bucketed, materialise

DEPTH_LIMIT, DOCUMENT_LIMIT = "depth_limit", "document_limit"


def root_documents(notices: DataFrame, section_source: str = "haeavustuksia", parsers: dict[str, str] | None = None) -> DataFrame:
    """Root documents: six section addresses for one source, the notice's own page otherwise."""
    parsers = parsers or {"eura2021": "eura", "eu-funding": "eu_source"}
    encoded = F.replace(F.url_encode("external_id"), F.lit("+"), F.lit("%20"))
    prefix = F.concat(F.lit(fixed.ROOT_PREFIX), encoded, F.lit("/hakuilmoitus/"))

    def root(url: Column, parser: Column, title: str) -> Column:
        return F.struct(url.alias("url"), parser.alias("parser"), F.lit(title).alias("title"))

    sections = F.array(*(root(F.concat(prefix, F.lit(s)), F.lit("hae_json"), s) for s in fixed.ROOT_SECTIONS))
    page = F.array(root(F.col("canonical_url"), lookup(F.col("source_id"), parsers, "web"), "Hakuilmoitus"))
    roots = F.when(F.col("source_id") == section_source, sections).otherwise(page)
    return notices.select(F.col("id").alias("opportunity_id"), F.explode(roots).alias("r")).select(
        "opportunity_id", urls.document_id(F.col("r.url")).alias("document_id"), "r.*")


def reach(roots: DataFrame, links: DataFrame, max_depth: int = 4, max_documents: int | None = 250) -> DataFrame:
    """Documents reached from each notice's roots over followed links, breadth first.

    ``roots``: (opportunity_id, document_id). ``links``: (document_id, target_id, role), already cut
    to followed links of current versions. Rows come out with depth, parent, role, limitation and
    ``position``, the order of reach: (depth, parent's position, target).

    A document one level below ``max_depth`` is recorded as ``depth_limit`` and not expanded. Beyond
    ``max_documents`` one further document per notice is recorded as ``document_limit``; None is no
    limit. Each level is one join with the links and one shuffle by notice, and is written out, so
    that neither lineage nor lost executors repeat earlier levels. With a limit, that shuffle takes
    the notice's earlier rows along, at most ``max_documents`` + 1 of them. The work per notice is bounded: it keeps at most
    ``max_documents`` + 1 rows, and of a document's links only the leading ones can matter.
    """
    if max_documents is None:
        return _reach_all(roots, links, max_depth)
    links = materialise(_leading_links(links, 2 * (max_documents + 1)))
    placed = materialise(_placed_roots(roots, links, max_documents))
    full = placed.filter(F.col("position") > max_documents).select("opportunity_id").distinct()
    start = placed.join(full, "opportunity_id", "left_anti")
    parts = _partitions(placed, max_documents)
    levels, frontier = [placed, _markers_of_full(placed.join(full, "opportunity_id", "left_semi"), links)], start
    seen = [start]
    for depth in range(1, max_depth + 2):
        level = materialise(_next_level(frontier, links, _union(seen), depth, max_depth, max_documents, parts))
        if not level.head(1):
            break
        levels.append(level)
        seen.append(level)
        frontier = level.filter("limitation IS NULL")
    return _union(levels)


CO_PARTITION = "spark.sql.requireAllClusterKeysForCoPartition"


def _reach_all(roots: DataFrame, links: DataFrame, max_depth: int) -> DataFrame:
    """``reach`` without a limit on documents: a level shuffles only its own new rows.

    Every level is a table in buckets by notice. The new rows come into the same buckets by the one
    shuffle of a level; dedupe, anti joins with the levels before, and positions then stay within
    them. Positions count a notice's documents level by level; a level's offset is the largest so far.
    """
    spark = roots.sparkSession
    before = spark.conf.get(CO_PARTITION)
    # Joins on (notice, document) may then use tables that are in buckets by notice alone.
    spark.conf.set(CO_PARTITION, "false")
    try:
        return _union(_levels(roots, links, max_depth))
    finally:
        spark.conf.set(CO_PARTITION, before)


def _levels(roots: DataFrame, links: DataFrame, max_depth: int) -> list[DataFrame]:
    keys = ["opportunity_id", "document_id"]
    buckets = int(roots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_parent = links.select(F.col("document_id").alias("parent_id"), "target_id", "role").repartition(buckets, "parent_id")
    links = bucketed(by_parent.groupBy("parent_id", "target_id").agg(F.min("role").alias("role")), "parent_id", buckets, "parent_id")
    packed, place, role = _packing(links)
    none = F.lit(None)
    order = Window.partitionBy("opportunity_id")
    level = roots.select(*keys).repartition(buckets, "opportunity_id").distinct().select(
        *keys, F.lit(0).alias("depth"), none.cast(links.schema["parent_id"].dataType).alias("parent_id"),
        F.lit("call_content").alias("role"), none.cast("string").alias("limitation"),
        F.row_number().over(order.orderBy("document_id")).alias("position"))
    levels = [bucketed(level, "opportunity_id", buckets, *keys)]
    for depth in range(1, max_depth + 2):
        front = levels[-1].select("opportunity_id", F.col("document_id").alias("parent_id"), F.col("position").alias("place"))
        steps = front.join(links, "parent_id").select("opportunity_id", F.col("target_id").alias("document_id"), packed.alias("way"))
        # Of several parents of a document the earliest wins; its id comes back from its place.
        new = steps.repartition(buckets, "opportunity_id").groupBy(*keys).agg(F.min("way").alias("way"))
        for known in levels:
            new = new.join(known.select(*keys), keys, "left_anti")
        ends = levels[-1].groupBy("opportunity_id").agg(F.max("position").alias("_end"))
        parents = levels[-1].select("opportunity_id", F.col("position").alias("place"), F.col("document_id").alias("parent_id"))
        ranked = new.join(ends, "opportunity_id").withColumn("n", F.row_number().over(order.orderBy(place, "document_id"))).withColumn("place", place)
        ranked = ranked.join(parents, ["opportunity_id", "place"])
        limitation = F.lit(DEPTH_LIMIT) if depth > max_depth else none.cast("string")
        level = bucketed(ranked.select(
            *keys, F.lit(depth).alias("depth"), "parent_id", role.alias("role"),
            limitation.alias("limitation"), (F.col("_end") + F.col("n")).cast("int").alias("position")), "opportunity_id", buckets, *keys)
        if not level.head(1):
            break
        levels.append(level)
    return levels


ROLE_BITS = 10


def _packing(links: DataFrame) -> tuple[Column, Column, Column]:
    """(``way`` of a step, the parent's place in it, the link's role in it).

    A way is one number where there are few roles, so that a step is shuffled as three numbers;
    otherwise it holds the role itself. Either form is ordered by place; a place has one parent.
    """
    most = 2**ROLE_BITS - 1
    names = sorted(r.role for r in links.filter("role IS NOT NULL").select("role").distinct().limit(most + 1).collect())
    if len(names) > most:
        return F.struct("place", "role"), F.col("way.place"), F.col("way.role")
    known = F.array(*map(F.lit, names)).cast("array<string>")
    code = F.coalesce(F.array_position(known, F.col("role")), F.lit(0))
    way = F.shiftleft(F.col("place").cast("bigint"), ROLE_BITS) + code
    number = F.col("way").bitwiseAND(F.lit(most)).cast("int")
    return way, F.shiftright("way", ROLE_BITS).cast("int"), F.when(number > 0, F.get(known, number - 1))


def _leading_links(links: DataFrame, count: int) -> DataFrame:
    """First ``count`` distinct targets per document, in target order.

    New documents are taken in that order after skipping those already seen. A notice that can still
    take one has seen at most half of ``count``, so the rest of a longer list is never reached.
    """
    distinct = links.groupBy("document_id", "target_id").agg(F.min("role").alias("role"))
    order = Window.partitionBy("document_id").orderBy("target_id")
    return distinct.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= count).drop("_n")


ROWS_A_TASK = 1_000_000


def _partitions(placed: DataFrame, max_documents: int, rows: int = ROWS_A_TASK) -> int:
    """Partitions by notice in which a task holds about ``rows`` kept rows, however many notices there are."""
    most = placed.select("opportunity_id").distinct().count() * (max_documents + 1)
    return max(int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-most // rows))


def _placed_roots(roots: DataFrame, links: DataFrame, max_documents: int) -> DataFrame:
    """Roots in document order. Only positions up to the cap matter, so later roots share one place."""
    keys = ["opportunity_id", "document_id"]
    distinct = roots.select(*keys).distinct()
    order = Window.partitionBy("opportunity_id").orderBy("document_id")
    leading = distinct.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= max_documents + 1)
    return distinct.join(leading, keys, "left").select(
        *keys, F.lit(0).alias("depth"), F.lit(None).cast(links.schema["document_id"].dataType).alias("parent_id"),
        F.lit("call_content").alias("role"), F.lit(None).cast("string").alias("limitation"),
        F.coalesce("position", F.lit(max_documents + 2)).alias("position"))


def _steps(frontier: DataFrame, links: DataFrame) -> DataFrame:
    step = frontier.select("opportunity_id", F.col("document_id").alias("parent_id"), F.col("position").alias("place"))
    return step.join(links.withColumnRenamed("document_id", "parent_id"), "parent_id").select(
        "opportunity_id", F.col("target_id").alias("document_id"), "parent_id", "place", "role")


def _markers_of_full(full: DataFrame, links: DataFrame) -> DataFrame:
    """The one marker of notices whose roots alone exceed the cap; found by aggregation, not by rank."""
    keys = ["opportunity_id", "document_id"]
    fresh = _steps(full, links).join(full.select(*keys), keys, "left_anti")
    first = fresh.groupBy("opportunity_id").agg(F.min(F.struct("place", "document_id", "parent_id", "role")).alias("m"))
    return first.select(
        "opportunity_id", "m.document_id", F.lit(1).alias("depth"), "m.parent_id", "m.role",
        F.lit(DOCUMENT_LIMIT).alias("limitation"), (F.col("m.place") + 1).alias("position"))


def _union(levels: list[DataFrame]) -> DataFrame:
    result = levels[0]
    for level in levels[1:]:
        result = result.unionByName(level)
    return result


def _next_level(frontier, links, seen, depth, max_depth, max_documents, parts) -> DataFrame:
    new = _steps(frontier, links).withColumn("fresh", F.lit(1)).withColumn("marked", F.lit(False))
    old = seen.select(
        "opportunity_id", "document_id", "parent_id", F.col("position").alias("place"), "role", F.lit(0).alias("fresh"),
        F.coalesce(F.col("limitation") == DOCUMENT_LIMIT, F.lit(False)).alias("marked"))
    # Partitioned by notice once: the dedupe and both windows below need no further shuffle.
    rows = new.unionByName(old).repartition(parts, "opportunity_id")
    # A seen document stays seen; of several parents the earliest wins, then the smallest role.
    best = rows.groupBy("opportunity_id", "document_id").agg(
        F.min(F.struct("fresh", "place", "parent_id", "role")).alias("b"), F.max("marked").alias("marked"))
    notice = Window.partitionBy("opportunity_id")
    order = notice.orderBy("b.fresh", "b.place", "document_id")
    known = F.col("b.fresh") == 0
    placed = best.select(
        "*", F.row_number().over(order).alias("n"),
        F.max("marked").over(notice).alias("over")).filter(~known)
    # Positions of a notice under its cap are dense, so the running number is the position.
    position = F.col("n")
    limitation = F.when(position > max_documents, DOCUMENT_LIMIT)
    if depth > max_depth:
        limitation = F.coalesce(limitation, F.lit(DEPTH_LIMIT))
    keep = (position <= max_documents) | (~F.col("over") & (position == max_documents + 1))
    return placed.filter(keep).select(
        "opportunity_id", "document_id", F.lit(depth).alias("depth"), F.col("b.parent_id").alias("parent_id"),
        F.col("b.role").alias("role"), limitation.alias("limitation"), position.alias("position"))


def refresh_bridge(old: DataFrame, reached: DataFrame, as_of: str) -> DataFrame:
    """New bridge state: reached documents active, others kept as inactive history.

    First sightings survive; roots stay roots.
    """
    keys = ["opportunity_id", "document_id"]
    new = reached.select(
        *keys, F.col("depth").alias("_depth"), F.col("parent_id").alias("_parent"), F.col("role").alias("_role"),
        F.col("limitation").alias("_limitation"), F.lit(True).alias("_reached"))
    joined = old.join(new, keys, "full_outer")
    hit = F.coalesce("_reached", F.lit(False))

    def pick(column, fresh):
        return F.when(hit, F.col(fresh)).otherwise(F.col(column)).alias(column)

    return joined.select(
        *keys, pick("depth", "_depth"), pick("parent_id", "_parent"), pick("role", "_role"), pick("limitation", "_limitation"),
        (F.coalesce("is_root", F.lit(False)) | (hit & (F.col("_depth") == 0))).alias("is_root"), hit.alias("active"),
        F.coalesce("first_seen_at", F.lit(as_of).cast("timestamp_ntz")).alias("first_seen_at"))


def refresh_notices(affected: DataFrame, old: DataFrame, links: DataFrame, as_of: str, max_depth=4, max_documents=250) -> DataFrame:
    """Refresh only the affected notices; the other rows of the bridge pass through."""
    ids = affected.select("opportunity_id").distinct()
    touched = old.join(ids, "opportunity_id", "left_semi")
    rest = old.join(ids, "opportunity_id", "left_anti")
    reached = reach(touched.filter("is_root"), links, max_depth, max_documents)
    fresh = refresh_bridge(touched, reached, as_of)
    return fresh.unionByName(rest.select(*fresh.columns))
