"""The rows with the smallest keys, found without one task that every partition sends its best rows to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPARE = 16  # rows looked at for each row wanted


def leading(rows: DataFrame, key: Column, count: int, order: list, spare: int = SPARE) -> DataFrame:
    """The ``count`` rows of smallest ``order``, whose first part is the bigint ``key`` without nulls.

    A quantile of the keys cuts the rows down to about a thousandth, until few are left to sort. Its
    rank is off by a ten-thousandth of the rows at most, so the wanted ones always stay. Equal keys
    are never parted. ``rows`` are read several times: give a written table.
    """
    held, size = rows.withColumn("_key", key), rows.count()
    while size > spare * count:
        share = max(2 * count / size, 1e-3)
        edge = held.agg(F.percentile_approx("_key", share, 10_000).alias("edge")).first().edge
        fewer = held.filter(F.col("_key") <= F.lit(edge))
        now = fewer.count()
        if not count <= now < size:
            break
        held, size = fewer, now
    return held.drop("_key").orderBy(*order).limit(count)


def looked_up(rows: DataFrame, table: DataFrame, key: str, salts: int = 16) -> DataFrame:
    """``rows`` left-joined with ``table`` (one row a key, a written table) on ``key``.

    Rows of one key are spread over ``salts`` tasks where Spark finds the table too large to send
    around; the table is repeated as often.
    """
    own = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(salts)).cast("int")
    repeated = table.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", own).join(repeated, [key, "_salt"], "left").drop("_salt")
