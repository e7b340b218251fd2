"""Helpers that run numpy code over Arrow batches inside Spark tasks.

Every operator of this package reads only the columns it names, so further columns, also ones that
clash with its own names, never matter. A null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Characters of text that a task turns into Python objects at once; a longer text is a slice of its own.
SLICE_CHARS = 4_000_000


def id_and_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, without null texts."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def slices(batches: Iterable[pa.RecordBatch], chars: int = SLICE_CHARS, rows: int = 1_000) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) in lists of at most ``rows`` texts and about ``chars`` characters."""
    for batch in batches:
        ids, start = batch.column(0).to_pylist(), 0
        for texts in text_slices((x.as_py() for x in batch.column(1)), chars, rows):
            yield ids[start:start + len(texts)], texts
            start += len(texts)


def arrow_slices(batches: Iterable[pa.RecordBatch], chars: int = SLICE_CHARS) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, texts) as Arrow arrays of about ``chars`` bytes; a longer text is a slice of its own."""
    for batch in batches:
        size = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            done = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, done + chars, side="right")))
            yield batch.column(0).slice(start, end - start), batch.column(1).slice(start, end - start)
            start = end


def text_slices(texts: Iterable[str], chars: int = SLICE_CHARS, rows: int = 1_000) -> Iterator[list[str]]:
    """The texts of one batch in lists of at most ``rows`` texts and about ``chars`` characters."""
    out, size = [], 0
    for text in texts:
        if out and (size + len(text) > chars or len(out) >= rows):
            yield out
            out, size = [], 0
        out.append(text)
        size += len(text)
    if out:
        yield out


def per_slice(docs: DataFrame, make: Callable[[], Callable[[list, list[str]], dict]], schema: str) -> DataFrame:
    """One pass over whole texts: ``make()`` gives, once a task, the function of (ids, texts) to columns."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        work = make()
        for ids, texts in slices(batches):
            columns = work(ids, texts)
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)

    return id_and_text(docs).mapInArrow(run, schema)
