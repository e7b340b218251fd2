"""Centroid clustering of integer vectors in built-in expressions alone."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticegrid.llm.leading import leading
from noticegrid.session import materialise

REACH = 1 << 26  # larger components would let a squared distance leave the range of a long
SCHEMA = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


def whole_numbers(column: str, scale: int, reach: int = REACH) -> Column:
    """floor(scale * x) of every component, held within ``reach``; null for a vector with a component that is null or not finite."""
    x = F.col(column).cast("array<double>")
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False)))
    floors = F.transform(x, lambda v: F.floor(F.greatest(F.lit(float(-reach)), F.least(F.lit(float(reach)), v * F.lit(float(scale))))))
    return F.when(finite, floors)


def nearest(vector: str, centroids: list[list[int]]) -> Column:
    """``(distance, cluster)`` of the nearest centroid; of equal distances the smaller number.

    Each centroid is an array literal, folded from one string. The whole is one text, as a Python
    column for every part takes longer to plan than the job to run.
    """
    options = []
    for i, centre in enumerate(centroids):
        literal = f"cast(split('{','.join(map(str, centre))}', ',') as array<bigint>)"
        squares = f"zip_with({vector}, {literal}, (a, b) -> (a - b) * (a - b))"
        options.append(f"struct(aggregate({squares}, 0L, (total, s) -> total + s) as distance, {i} as cluster)")
    return F.expr(f"array_min(array({', '.join(options)}))")


def updated(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Floors of the means of each centroid's vectors; one without vectors stays.

    The sums are one column a component and combine before the shuffle, so the driver gets one row a
    centroid, whatever the number of vectors.
    """
    size = len(centroids[0])
    sums = [F.expr(f"sum(cast(v[{i}] as decimal(20,0))) as s{i}") for i in range(size)]
    found = vectors.select("v", nearest("v", centroids)["cluster"].alias("cluster")).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *sums)
    means = {r.cluster: [int(r[f"s{i}"]) // r.n for i in range(size)] for r in found.collect()}
    return [means.get(i, c) for i, c in enumerate(centroids)]


def first_centroids(vectors: DataFrame, count: int, seed: int) -> list[list[int]]:
    """The vectors of smallest SHA-256 of ``seed:vec_id``; of one id, the smaller vector first."""
    hashed = vectors.withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256))
    key = F.conv(F.substring("hash", 1, 15), 16, 10).cast("bigint")
    return [r.v for r in leading(hashed, key, count, ["hash", "v"]).select("v").collect()]


def clusters(vectors: DataFrame, *, count: int = 16, rounds: int = 3, dimension: int = 64, scale: int = 64, seed: int = 1) -> DataFrame:
    """One row a kept vector of ``vec_id, embedding``: see ``SCHEMA``.

    Kept are vectors of ``dimension`` components, none null or non-finite; components become
    floor(scale * x), held within 2**26 either way, so distances are exact. ``count`` vectors chosen
    by hash are the first centroids (all of them where there are fewer); after ``rounds`` updates
    every vector is assigned once more. Rows that repeat an id, and rows without one, are vectors of
    their own; the null id is hashed as an empty one. An empty table, or one without a usable vector,
    gives no row. An inertia beyond a long is null.
    """
    kept = materialise(
        vectors.filter(F.size("embedding") == dimension)
        .select(F.col("vec_id").cast("bigint").alias("vec_id"), whole_numbers("embedding", scale).alias("v")).filter("v is not null")
    )
    centroids = first_centroids(kept, count, seed)
    if not centroids:
        return kept.sparkSession.createDataFrame([], SCHEMA)
    for _ in range(rounds):
        centroids = updated(kept, centroids)
    near = nearest("v", centroids)
    assigned = materialise(kept.select("vec_id", near.alias("near")).select("vec_id", "near.cluster", "near.distance"))
    sums = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s"))
    of_cluster = {r.cluster: int(r.s) for r in sums.collect()}  # one row a centroid
    long = lambda n: F.lit(n if n < 1 << 63 else None).cast("bigint")
    inertia = F.array(*[long(of_cluster.get(i, 0)) for i in range(len(centroids))])
    digests = F.array(*[F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids])
    return assigned.select(
        "vec_id", "cluster", "distance", F.get(inertia, F.col("cluster")).alias("cluster_inertia"),
        long(sum(of_cluster.values())).alias("inertia"), F.get(digests, F.col("cluster")).alias("centroid_sha256"),
    )
