"""A bounded sample of labelled rows for fitting classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticegrid.llm.batches import id_and_text
from noticegrid.llm.leading import leading
from noticegrid.session import materialise

SAMPLE_ROWS = 20_000


def remainder(modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % modulus


def sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id, text, label`` (double) of at most about ``rows`` labelled documents.

    They are the ``rows`` least by a hash of the id among labelled ids for which ``learn`` holds, so
    the sample does not depend on order or partitions. Null labels do not count; of several labels
    of an id the mean decides. The ids are ``rows`` at most, so they may be broadcast; an id that
    repeats in ``docs`` gives several rows.
    """
    known = materialise(
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("double").alias("label"))
        .filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & learn)
        .groupBy("doc_id").agg((F.avg("label") >= 0.5).cast("double").alias("label"))
    )
    chosen = leading(known, F.xxhash64("doc_id"), rows, [F.xxhash64("doc_id"), F.col("doc_id")])
    return id_and_text(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label")
