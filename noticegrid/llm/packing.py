"""Packing by lexical retrieval: each window grows from a seed with its best unused BM25 neighbours."""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticegrid.llm import batches, bpe
from noticegrid.session import materialise

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
)
NAMES = [part.split()[0] for part in SCHEMA.split(", ")]


K1, B = 1.2, 0.75


class Corpus(NamedTuple):
    """What BM25 knows of the whole table: documents of each term, number of documents, mean length."""

    df: np.ndarray
    count: int
    mean: float

    def weights(self, term: np.ndarray, tf: np.ndarray, length, k1: float = K1, b: float = B) -> np.ndarray:
        """BM25 weight of terms that occur ``tf`` times in documents of ``length`` tokens."""
        df = self.df[term]
        return np.log1p((self.count - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / self.mean))

    def shared(self) -> np.ndarray:
        """Inverse document frequency of each term; 0 for a term that no second document holds."""
        return np.where(self.df > 1, np.log1p((self.count - self.df + 0.5) / (self.df + 0.5)), 0.0)

    def routes(self, ids: np.ndarray, shared: np.ndarray) -> tuple[int, int]:
        """The two terms of most weight in a document that others hold as well; -1 where there is none."""
        term, tf = counted(ids)
        weight = shared[term] * (tf / (tf + K1 * (1 - B + B * len(ids) / self.mean)))
        out = []
        for _ in range(2):
            best = int(weight.argmax())
            out.append(int(term[best]) if weight[best] > 0 else -1)
            weight[best] = 0
        return out[0], out[1]


def counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and how often each occurs; ``np.unique`` takes twice as long on short arrays."""
    ids = np.sort(ids, kind="stable")  # by digits, for two bytes an id
    fresh = np.empty(len(ids) + 1, bool)
    fresh[0] = fresh[-1] = True
    np.not_equal(ids[1:], ids[:-1], out=fresh[1:-1])
    at = fresh.nonzero()[0]
    return ids[at[:-1]], at[1:] - at[:-1]


class ShardIndex:
    """A BM25 inverted index of one shard; terms are token ids, weighed by ``corpus`` or the shard alone.

    Terms in more than ``common`` of the shard's documents get no posting list: their weight is next
    to nothing and their lists would hold most of the shard.
    """

    def __init__(self, ids: list[np.ndarray], k1: float = K1, b: float = B, common: float = 0.5, corpus: Corpus | None = None):
        sizes = np.array([len(x) for x in ids], np.int64)
        count = len(ids)
        key = np.repeat(np.arange(count, dtype=np.int64), sizes) << 32 | np.concatenate(ids)
        key, tf = np.unique(key, return_counts=True)
        doc, term = key >> 32, key & 0xFFFFFFFF
        df = np.bincount(term)
        rare = df[term] <= max(1.0, common * count)
        rare &= df[term] > 1  # a term of one document finds no neighbour
        doc, term, tf = doc[rare], term[rare], tf[rare]
        self._terms_of = np.searchsorted(doc, np.arange(count + 1))
        self._term = term
        order = np.argsort(term, kind="stable")
        self._doc = doc[order]
        known = corpus or Corpus(df, count, max(1.0, sizes.mean()))
        self._weight = known.weights(term, tf, sizes[doc], k1, b)[order]
        self._list = np.searchsorted(term[order], np.arange(len(df) + 1))
        self._count = count

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document of the shard against the seed's terms."""
        terms = self._term[self._terms_of[seed]:self._terms_of[seed + 1]]
        start = self._list[terms]
        size = self._list[terms + 1] - start
        at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return np.bincount(self._doc[at], self._weight[at], self._count)


def windows(ids: list[np.ndarray], size: int, corpus: Corpus | None = None):
    """Lists of (document, start, length) that fill ``size`` tokens each; the last may be shorter.

    A document that does not fit is cut and its rest seeds the next window. Without such a rest the
    next unused document in order is the seed. Equal scores go to the earlier document.
    """
    index = ShardIndex(ids, corpus=corpus)
    free = np.ones(len(ids), bool)
    next_seed, rest = 0, None  # rest: (document, start)
    while True:
        if rest is None:
            while next_seed < len(ids) and not free[next_seed]:
                next_seed += 1
            if next_seed == len(ids):
                return
            rest = (next_seed, 0)
            free[next_seed] = False
        seed, window, space, scores = rest[0], [], size, None
        while space:
            if rest is None:
                if scores is None:
                    scores = index.scores(seed)
                    scores[~free] = -1.0
                best = int(scores.argmax())
                if scores[best] < 0:
                    break
                rest, scores[best], free[best] = (best, 0), -1.0, False
            doc, start = rest
            length = min(space, len(ids[doc]) - start)
            window.append((doc, start, length))
            space -= length
            rest = (doc, start + length) if start + length < len(ids[doc]) else None
        yield window


def power_cuts(window: list, size: int):
    """A full window as it is; a shorter one cut into sequences whose lengths are powers of two."""
    total = sum(length for _, _, length in window)
    if total == size:
        yield window
        return
    pieces = list(window)[::-1]
    while total:
        space = 1 << (total.bit_length() - 1)
        total -= space
        part = []
        while space:
            doc, start, length = pieces.pop()
            take = min(space, length)
            part.append((doc, start, take))
            space -= take
            if take < length:
                pieces.append((doc, start + take, length - take))
        yield part


class Tally:
    """What a task knows of the corpus: in how many of its documents a term stands, their number and tokens."""

    SCHEMA = "term bigint, n bigint"

    def __init__(self, top: int):
        self._df, self._count, self._total = np.zeros(top + 1, np.int64), 0, 0

    def add(self, ids: np.ndarray) -> None:
        self._df[counted(ids)[0]] += 1
        self._count, self._total = self._count + 1, self._total + len(ids)

    def columns(self) -> list[pa.Array]:
        """Terms and their numbers; under -1 the number of documents and under -2 that of their tokens."""
        term = np.flatnonzero(self._df)
        return [pa.array(np.concatenate([term, [-1, -2]])), pa.array(np.concatenate([self._df[term], [self._count, self._total]]))]


def tokenised(docs: DataFrame, path: str, end_id: int, group_chars: int, top: int) -> DataFrame:
    """``doc_id, ids, term, n``: the token ids of every row with the end id, as bytes of ``unit(path, end_id)``.

    Rows with a ``term`` are the ``Tally`` of a task.
    """
    kind = unit(path, end_id)
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("term", pa.int64()), ("n", pa.int64())])

    def run(parts):
        tally = Tally(top)
        for doc_ids, place, starts, symbols in bpe.encoded(batches.arrow_slices(parts), bpe.vocabulary(path), group_chars):
            rows = joined(place, starts, *symbols, kind, end_id)
            for ids in rows:
                tally.add(ids)
            nothing = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array([x.tobytes() for x in rows], pa.binary()), nothing, nothing], schema=schema)
        columns = tally.columns()
        nothing = [pa.nulls(len(columns[0]), f.type) for f in (schema.field("doc_id"), schema.field("ids"))]
        yield pa.RecordBatch.from_arrays([*nothing, *columns], schema=schema)

    return batches.id_and_text(docs).mapInArrow(run, f"doc_id bigint, ids binary, {Tally.SCHEMA}")


def joined(place: np.ndarray, starts: np.ndarray, ids: np.ndarray, first: np.ndarray, size: np.ndarray, kind: str, end_id: int) -> list[np.ndarray]:
    """The ids of each text with the end id: the chunks' ids gathered at every place at once."""
    each = size[place]
    flat = bpe.gathered(ids, first[place], each).astype(kind)
    bounds = np.concatenate([[0], np.cumsum(each)])[starts]
    end = np.array([end_id], kind)
    return [np.concatenate([flat[a:b], end]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def unit(path: str, end_id: int) -> str:
    """Two bytes an id where the vocabulary allows it."""
    return "<u2" if max(bpe.vocabulary(path).top, end_id) < 1 << 16 else "<u4"


def corpus_of(tokens: DataFrame, kind: str, top: int) -> Corpus:
    """Sums over the tasks; the driver gets one number a term, at most the vocabulary's size.

    ``tokens`` with a ``term`` bring their counts along (see ``tokenised``); others are counted here.
    """
    schema = pa.schema([("term", pa.int64()), ("n", pa.int64())])

    def run(parts):
        tally = Tally(top)
        for batch in parts:
            for raw in batch.column(0):
                tally.add(np.frombuffer(raw.as_buffer(), kind))
        yield pa.RecordBatch.from_arrays(tally.columns(), schema=schema)

    known = "term" in tokens.columns
    counts = tokens.filter("term IS NOT NULL") if known else tokens.select("ids").mapInArrow(run, Tally.SCHEMA)
    rows = counts.groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    found = dict(zip(rows.column("term").to_pylist(), rows.column("n").to_pylist()))
    count, total = found.pop(-1, 0), found.pop(-2, 0)
    df = np.zeros(top + 1, np.int64)
    df[list(found)] = list(found.values())
    return Corpus(df, count, max(1.0, total / max(1, count)))


def routed(tokens: DataFrame, kind: str, corpus: Corpus) -> DataFrame:
    """Rows in the order of their two heaviest terms, dealt in even ranges.

    The hash of the id is the last part of the key, so a route that many documents share takes as
    many ranges as its rows need.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("_first", pa.int64()), ("_second", pa.int64())])

    def run(parts):
        shared = corpus.shared()
        for batch in parts:
            routes = [corpus.routes(np.frombuffer(raw.as_buffer(), kind), shared) for raw in batch.column(1)]
            columns = [pa.array([r[k] for r in routes], pa.int64()) for k in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], schema=schema)

    keys = ["_first", "_second", F.xxhash64("doc_id", "ids")]
    rows = tokens.mapInArrow(run, "doc_id bigint, ids binary, _first bigint, _second bigint")
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "ids")


def pack(
    docs: DataFrame, *, size: int = 4096, end_id: int = 2, shard_docs: int = 1_000, shard_tokens: int = 2_000_000,
    vocabulary: str | None = None, group_chars: int = 64_000_000,
) -> DataFrame:
    """One row per piece of a document in a sequence (see ``SCHEMA``).

    Document frequencies and the mean length are those of the whole table. Documents are routed by
    the two terms of most weight they share with others, so those on one subject meet wherever they
    stand in the input. Shards are consecutive rows of that order, at most ``shard_docs`` documents
    and about ``shard_tokens`` tokens; neighbours are searched within a shard. Every document is
    indexed and every one is used once. All windows are full but a shard's last one, which is cut
    into powers of two, so nothing is padded. A null or empty text is its end id alone. Repeated
    rows and ids are packed each by itself; an empty table gives no row. A task encodes the distinct
    chunks of about ``group_chars`` bytes of text together.
    """
    path = vocabulary or bpe.default_path()
    arrow = pa.schema([(n, pa.int64()) for n in NAMES])
    kind, top = unit(path, end_id), max(bpe.vocabulary(path).top, end_id)
    tokens = materialise(tokenised(docs, path, end_id, group_chars, top))
    corpus = corpus_of(tokens, kind, top)
    tokens = tokens.filter("term IS NULL").select("doc_id", "ids")

    def run(parts):
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple[int, np.ndarray]] = []
        total = 0

        def shard():
            nonlocal sequence
            ids = [x for _, x in held]
            rows = []
            for window in windows(ids, size, corpus):
                for part in power_cuts(window, size):
                    offset = 0
                    for doc, start, length in part:
                        crc = zlib.crc32(ids[doc][start:start + length].astype("<u4"))
                        rows.append((held[doc][0], start, length, crc, len(ids[doc]), sequence, offset))
                        offset += length
                    sequence += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], schema=arrow)

        for batch in parts:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(raw.as_py(), kind).astype(np.int64)
                if held and (len(held) >= shard_docs or total + len(ids) > shard_tokens):
                    yield shard()
                    held, total = [], 0
                held.append((doc_id, ids))
                total += len(ids)
        if held:
            yield shard()

    return routed(tokens, kind, corpus).mapInArrow(run, SCHEMA)
