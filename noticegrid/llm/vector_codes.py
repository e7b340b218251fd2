"""Vector codes: every part of a vector is named by the nearest entry of its codebook.

Codebooks are learnt by Lloyd's rounds that follow the entries that move. A part keeps the index of
its entry and the exact squared distance to it. Where that entry stayed where it was, the distances
to all other unmoved entries are what they were, and none of them beat it; so only moved entries are
compared with the stored distance. A part whose entry moved is scanned against the whole codebook.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticegrid.llm.centroids import whole_numbers
from noticegrid.llm.leading import leading, looked_up
from noticegrid.session import materialise

REACH = 1 << 27  # components beyond it would let a squared distance leave the range of a long
STATE = "vec_id bigint, label string, v array<int>, codes array<int>, distances array<bigint>"
SUMS = "part int, entry int, n bigint, sums array<bigint>"
ARROW = pa.schema([
    ("vec_id", pa.int64()), ("label", pa.string()), ("v", pa.list_(pa.int32())), ("codes", pa.list_(pa.int32())),
    ("distances", pa.list_(pa.int64())), ("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64())),
])


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances, a row of ``x`` by an entry."""
    most = max(np.abs(x).max(initial=0), np.abs(entries).max(initial=0))
    if x.shape[1] * (2.0 * most) ** 2 < 2**53:  # every sum is a whole number that a double holds
        a, b = x.astype(np.float64), entries.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2.0 * (a @ b.T)).astype(np.int64)
    return np.stack([((x - e) ** 2).sum(1) for e in entries], axis=1)


def reassigned(x: np.ndarray, code: np.ndarray, distance: np.ndarray, old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and distances of parts ``x`` after the codebook went from ``old`` to ``new``; equal distances go to the lower index."""
    code, distance = code.copy(), distance.copy()
    moved = (old != new).any(axis=1)
    again = moved[code]
    if again.any():
        code[again], distance[again] = scanned(x[again], new)
    still, at = np.flatnonzero(~again), np.flatnonzero(moved)
    if len(still) and len(at):
        best, near = scanned(x[still], new[at])
        best = at[best]
        better = (near < distance[still]) | ((near == distance[still]) & (best < code[still]))
        code[still[better]], distance[still[better]] = best[better], near[better]
    return code, distance


def scanned(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = distances(x, entries)
    code = found.argmin(axis=1)
    return code, found[np.arange(len(x)), code]


def lists(rows: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(rows).reshape(-1), kind))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def step(state: DataFrame, old: np.ndarray | None, new: np.ndarray) -> DataFrame:
    """One assignment: the rows with their new codes, and each task's sums of the parts of every entry.

    Rows of sums have a ``part``; rows of vectors have none. The first step has no ``old`` codebooks.
    """
    parts, entries, width = new.shape

    def run(batches):
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = matrix(batch.column(2), parts * width)
            codes, near = np.empty((len(v), parts), np.int64), np.empty((len(v), parts), np.int64)
            if old is not None:
                codes, near = matrix(batch.column(3), parts), matrix(batch.column(4), parts)
            for p in range(parts):
                x = v[:, p * width:(p + 1) * width]
                codes[:, p], near[:, p] = scanned(x, new[p]) if old is None else reassigned(x, codes[:, p], near[:, p], old[p], new[p])
                count[p] += np.bincount(codes[:, p], minlength=entries)
                np.add.at(total[p], codes[:, p], x)
            columns = [batch.column(0), batch.column(1), batch.column(2).cast(pa.list_(pa.int32())), lists(codes, pa.int32()), lists(near, pa.int64())]
            columns += [pa.nulls(len(v), f.type) for f in list(ARROW)[5:]]
            yield pa.RecordBatch.from_arrays(columns, schema=ARROW)
        part, entry = np.nonzero(count)
        if len(part):
            columns = [pa.nulls(len(part), f.type) for f in list(ARROW)[:5]]
            columns += [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), lists(total[part, entry], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=ARROW)

    return state.mapInArrow(run, f"{STATE}, {SUMS}")


def moved_entries(stepped: DataFrame, books: np.ndarray) -> np.ndarray:
    """Floors of the means of each entry's parts; an unused entry stays. One row an entry comes to the driver."""
    width = books.shape[2]
    sums = [F.expr(f"sum(cast(sums[{i}] as decimal(20,0))) as s{i}") for i in range(width)]
    out = books.copy()
    for r in stepped.filter("part is not null").groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():
        out[r.part, r.entry] = [int(r[f"s{i}"]) // r.n for i in range(width)]
    return out


def learnt(rows: DataFrame, books: np.ndarray, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """Rows with their final codes, and the final codebooks. Every step is a written table."""
    state, old = rows, None
    for _ in range(rounds):
        stepped = materialise(step(state, old, books))
        state = stepped.filter("part is null").select("vec_id", "label", "v", "codes", "distances")
        old, books = books, moved_entries(stepped, books)
    return materialise(step(state, old, books).filter("part is null").select("vec_id", "label", "codes", "distances")), books


def compressed(vectors: DataFrame, *, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every kept row of ``vec_id, embedding, label``.

    Dropped are vectors that are null, hold a null or non-finite component, or differ in length from
    the kept vector with the smallest id; a length that ``parts`` does not divide gives no row at
    all. Components become floor(scale * x), held within 2**27 either way, so distances are exact. Codebooks
    start as the parts of the vectors with the smallest ids (all of them where there are fewer than
    ``entries``; a null id is the largest, and of one id the smaller vector comes first). Rows that
    repeat an id are coded each by itself. ``label_error`` sums the errors of equal labels, nulls
    together. An empty table gives no row.
    """
    if not 1 <= entries <= 256:
        raise ValueError("two hex digits name 256 entries at most")
    numbers = whole_numbers("embedding", scale, REACH).cast("array<int>")
    all_rows = materialise(
        vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), numbers.alias("v")).filter("size(v) > 0")
    )
    key = F.coalesce("vec_id", F.lit(2**63 - 1))
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    first = leading(all_rows, key, 1, order).select(F.size("v").alias("n")).first()
    empty = all_rows.sparkSession.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    if first is None or first.n % parts:
        return empty
    rows = all_rows.filter(F.size("v") == first.n)
    start = np.array([r.v for r in leading(rows, key, entries, order).select("v").collect()], np.int64)
    books = start.reshape(len(start), parts, -1).transpose(1, 0, 2).copy()
    blank = rows.withColumns({"codes": F.lit(None).cast("array<int>"), "distances": F.lit(None).cast("array<bigint>")})
    coded, books = learnt(blank, books, rounds)
    error = F.aggregate("distances", F.lit(0).cast("bigint"), lambda total, d: total + d)
    coded = coded.select(
        "vec_id", F.coalesce(F.concat(F.lit("="), "label"), F.lit("")).alias("label"), error.alias("error"),
        F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "").alias("code"),
    )
    of_label = materialise(coded.groupBy("label").agg(F.sum("error").alias("label_error")))
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return looked_up(coded, of_label, "label").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
