"""Toxicity by a factorization machine over hashed terms, with learned pairwise interactions."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticegrid.llm import batches, factors, labelled
from noticegrid.session import materialise

BUCKETS = 1 << 20
TERMS = 512  # hashed terms that enter the model
LEAST_ROWS = 5  # training documents a term needs
TERMS_HELD = 300_000
# ASCII letters and digits stay, other ASCII becomes a blank; bytes of other characters stay.
TABLE = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))


def terms(text: str) -> set[bytes]:
    """Distinct words of a text in lower case, and the stems of longer ones.

    A stem is a leading part of 4, 5 or 6 bytes, marked so that it is not a word of its own; it
    carries what the inflected forms of a word share.
    """
    words = set(text.lower().encode("utf-8", "surrogatepass").translate(TABLE).split())
    return words.union(*({b"^" + w[:n] for w in words if len(w) > n} for n in (4, 5, 6)))


def bucket(term: bytes) -> int:
    return zlib.crc32(term) % BUCKETS


class Buckets(dict):
    """Bucket of a term; forgotten when too many are held."""

    def __missing__(self, term: bytes) -> int:
        if len(self) >= TERMS_HELD:
            self.clear()
        number = self[term] = bucket(term)
        return number


class Columns(dict):
    """Model feature of a term, or -1; forgotten when too many are held."""

    def __init__(self, chosen: np.ndarray):
        super().__init__()
        self._number = {int(b): i for i, b in enumerate(chosen)}

    def __missing__(self, term: bytes) -> int:
        if len(self) >= TERMS_HELD:
            self.clear()
        number = self[term] = self._number.get(bucket(term), -1)
        return number


def ragged(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in lists], np.int64)
    return (np.concatenate(lists) if lists else np.zeros(0)).astype(np.int64), sizes


def choose(found: DataFrame, count: int, least: int) -> np.ndarray:
    """The ``count`` buckets whose presence tells most of the label (chi-squared), in ascending order.

    ``found`` has ``label, b`` for each document; all sums are made by Spark, ``count`` rows come back.
    """
    total = found.agg(F.count(F.lit(1)).alias("n"), F.avg("label").alias("share")).first()
    if not total.n:
        return np.zeros(0, np.int64)
    seen = found.select("label", F.explode("b").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("seen"), F.sum("label").alias("hits"))
    spread = F.col("seen") * (1 - F.col("seen") / total.n) * (total.share * (1 - total.share))
    chi = F.pow(F.col("hits") - F.col("seen") * total.share, F.lit(2.0)) / spread
    best = seen.filter((F.col("seen") >= least) & (spread > 0)).orderBy(chi.desc(), "b").limit(count)
    return np.sort(np.array([r.b for r in best.select("b").collect()], np.int64))


def train(docs: DataFrame, labels: DataFrame, label: str, learn, rows: int = labelled.SAMPLE_ROWS, count: int = TERMS):
    """(chosen buckets, machine) from at most ``rows`` labelled documents."""
    some = labelled.sample(docs, labels, label, learn, rows)

    def make():
        known = Buckets()
        return lambda ids, texts: {"doc_id": ids, "b": [sorted({known[t] for t in terms(x)}) for x in texts]}

    truth = some.select("doc_id", "label").distinct()
    found = materialise(batches.per_slice(some, make, "doc_id bigint, b array<int>").join(truth, "doc_id"))
    chosen = choose(found, count, LEAST_ROWS)
    own = F.array_intersect("b", F.array(*(F.lit(int(b)) for b in chosen)) if len(chosen) else F.array().cast("array<int>"))
    table = found.select("doc_id", own.alias("b"), "label").orderBy("doc_id").toArrow()
    lists = table.column("b").combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy()) if len(table) else np.zeros(0, np.int64)
    index = np.searchsorted(chosen, lists.flatten().to_numpy()) if len(table) else np.zeros(0, np.int64)
    return chosen, factors.fit(index, sizes.astype(np.int64), table.column("label").to_numpy(), len(chosen))


def toxicity(
    docs: DataFrame, labels: DataFrame, *, label: str = "toxic", modulus: int = 5, held: int = 0, limit: float = 0.5,
    rows: int = labelled.SAMPLE_ROWS,
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, from its whole text.

    Labels are learnt from ids whose crc32 modulo ``modulus`` is not ``held``. A null or empty text
    has no term and is scored by the bias alone; rows that repeat an id or a text are scored each by
    itself; an empty table gives no row. A label table without usable rows gives 0.5 throughout.
    """
    part = labelled.remainder(modulus)
    chosen, machine = train(docs, labels, label, part != held, rows)

    def make():
        columns = Columns(chosen)

        def work(ids, texts):
            lists = [np.array(sorted({columns[t] for t in terms(x)} - {-1}), np.int64) for x in texts]
            return {"doc_id": ids, "score": machine.scores(*ragged(lists))}

        return work

    scored = batches.per_slice(docs, make, "doc_id bigint, score double")
    return scored.select(
        "doc_id", (part == held).alias("held_out"), "score", F.when(F.col("score") >= limit, 1).otherwise(0).alias("predicted")
    )
