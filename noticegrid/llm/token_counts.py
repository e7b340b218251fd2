"""Token counts by rank-synchronous merging (see ``bpe``)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from noticegrid.llm import batches, bpe

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


def token_counts(docs: DataFrame, *, limit: int = 2048, vocabulary: str | None = None, cache: int = 600_000) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every row, from its whole text.

    A null or empty text has 0 bytes and 0 tokens. Special strings inside a text count as one token
    each, as the library has it by default; no begin or end token is added. Repeated rows and ids
    each give a row; an empty table gives none. ``cache`` bounds the chunks a worker remembers.
    """
    path = vocabulary or bpe.default_path()
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def run(parts):
        vocab = bpe.vocabulary(path)
        known = bpe.ChunkCache(vocab, cache)
        for doc_ids, texts in batches.arrow_slices(parts):
            chunks, place, starts = bpe.split(texts)
            sums = np.concatenate([[0], np.cumsum(known.encode(chunks)[2][place])])
            counts = sums[starts[1:]] - sums[starts[:-1]]
            columns = [doc_ids, pc.binary_length(texts).cast(pa.int64()), pa.array(counts), pa.array(counts > limit)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return batches.id_and_text(docs).mapInArrow(run, SCHEMA)
