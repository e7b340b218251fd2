"""Exact deduplication by a sharded minimal perfect hash over distinct digests.

A history is a table of distinct digests with their winners. It is cut into shards of about
``shard_keys`` digests; each shard becomes one row with a minimal perfect hash whose slots hold the
full digest and the winner's locator. Looking a digest up costs two hashes and one comparison of all
32 bytes, so a digest outside the history never passes for a member.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticegrid.session import by_shuffle, materialise

SHARD_KEYS = 50_000
TASK_ROWS = 20_000
WHITE = " \t\n\x0b\x0c\r"
PILOT_LOAD = 4  # keys to a bucket of the perfect hash
SHARD_SCHEMA = "shard bigint, keys bigint, index binary"


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, text_sha256, n_chars`` of every row; the digest is of the text without white space."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("_t"),
    ).select("doc_id", F.sha2(F.translate("_t", WHITE, ""), 256).alias("text_sha256"), F.char_length("_t").cast("bigint").alias("n_chars"))


def groups(prints: DataFrame) -> DataFrame:
    """One row per distinct digest: the row that stays and the number of rows.

    Of equal texts the one with the most code points stays, then the smallest id; a null id counts
    as larger than any other. Combines before its shuffle, so a group of any size is a few rows.
    """
    best = F.max(F.struct("n_chars", (-F.col("doc_id")).alias("minus"))).alias("best")
    return prints.groupBy("text_sha256").agg(best, F.count(F.lit(1)).alias("group_size")).select(
        "text_sha256", (-F.col("best.minus")).alias("keep_id"), F.col("best.n_chars").alias("keep_chars"), "group_size"
    )


# ---- the perfect hash of one shard ----


def _words(digests: np.ndarray) -> np.ndarray:
    """Rows of 32 bytes as rows of four 64-bit words."""
    return np.ascontiguousarray(digests).view("<u8").reshape(-1, 4)


def _mix(x: np.ndarray, seed) -> np.ndarray:
    x = x ^ (np.asarray(seed, np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _slot(words: np.ndarray, pilots: np.ndarray, n: int) -> np.ndarray:
    bucket = (words[:, 1] % np.uint64(len(pilots))).astype(np.int64)
    return (_mix(words[:, 2], pilots[bucket]) % np.uint64(n)).astype(np.int64)


def perfect_hash(digests: np.ndarray) -> np.ndarray:
    """A pilot per bucket, such that distinct digests (rows of 32 bytes) get distinct slots in [0, n).

    Buckets are placed from the largest to the smallest; each takes the first pilot that sends all
    its keys to free slots.
    """
    words, n = _words(digests), len(digests)
    count = max(1, (n + PILOT_LOAD - 1) // PILOT_LOAD)
    bucket = (words[:, 1] % np.uint64(count)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    sizes = np.bincount(bucket, minlength=count)
    starts = np.cumsum(sizes) - sizes
    pilots, taken = np.zeros(count, np.uint64), np.zeros(n, bool)
    for b in np.argsort(-sizes, kind="stable"):
        if not sizes[b]:
            break
        keys = words[order[starts[b]:starts[b] + sizes[b]], 2]
        first, step = 0, 64
        while True:
            tries = np.arange(first, first + step, dtype=np.uint64)
            slots = (_mix(keys[None, :], tries[:, None]) % np.uint64(n)).astype(np.int64)
            good = ~taken[slots].any(axis=1)
            if sizes[b] > 1:
                ordered = np.sort(slots, axis=1)
                good &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            if good.any():
                at = int(good.argmax())
                pilots[b] = tries[at]
                taken[slots[at]] = True
                break
            first, step = first + step, min(step * 4, max(4096, 4 * n))
    return pilots


def pack_shard(digests: np.ndarray, keep_id: np.ndarray, keep_null: np.ndarray, size: np.ndarray) -> bytes:
    """A shard's pilots and slots as bytes."""
    pilots = perfect_hash(digests)
    slot = _slot(_words(digests), pilots, len(digests))
    held = {"pilots": pilots.astype("<u4") if pilots.max() < 1 << 32 else pilots}
    for name, values in (("digest", digests), ("keep_id", keep_id), ("keep_null", keep_null), ("size", size)):
        placed = np.empty_like(values)
        placed[slot] = values
        held[name] = placed
    out = io.BytesIO()
    np.savez(out, **held)
    return out.getvalue()


def look_up(index: bytes, digests: np.ndarray):
    """(member, keep_id, keep_null, size) of each digest; the last three mean nothing for nonmembers."""
    held = np.load(io.BytesIO(index))
    placed = held["digest"]
    slot = _slot(_words(digests), held["pilots"].astype(np.uint64), len(placed))
    return (placed[slot] == digests).all(axis=1), held["keep_id"][slot], held["keep_null"][slot], held["size"][slot]


def _bytes32(column: pd.Series) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(column)), np.uint8).reshape(-1, 32)


# ---- the distributed index and its use ----


def shard_of(shards: int):
    """A digest's shard, from its first 32 bits."""
    return F.expr(f"shiftright(cast(conv(substr(text_sha256, 1, 8), 16, 10) as bigint) * {shards}L, 32)")


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """``shard, keys, index`` from ``groups`` rows; digests are distinct, so shards are even."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        # Ids arrive as text: a nullable whole number would turn into a float here.
        digests, null = _bytes32(rows["text_sha256"]), rows["keep_id"].isna().to_numpy()
        keep = rows["keep_id"].fillna("0").to_numpy(str).astype(np.int64)
        index = pack_shard(digests, keep, null, rows["group_size"].to_numpy(np.int64))
        return pd.DataFrame({"shard": rows["shard"].iloc[:1].to_numpy(), "keys": [len(rows)], "index": [index]})

    return (
        history.select(shard_of(shards).alias("shard"), "text_sha256", F.col("keep_id").cast("string").alias("keep_id"), "group_size")
        .groupBy("shard").applyInPandas(pack, SHARD_SCHEMA)
    )


def probe(prints: DataFrame, index: DataFrame, shards: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """``prints`` with ``member, found_id, found_size`` from the index, one row each.

    Rows of a shard meet its index in one group; a shard with more than ``task_rows`` rows, such as
    one that holds a very common text, is dealt over as many copies of its index as it needs. All
    copies together are at most one a shard and one per ``task_rows`` rows.
    """
    rows = prints.select("*", shard_of(shards).alias("shard"))
    copies = rows.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / task_rows).cast("int").alias("copies"))
    left = rows.join(copies, "shard").withColumn(
        "copy", F.pmod(F.xxhash64("doc_id"), F.col("copies")).cast("int")
    ).select("shard", "copy", F.col("doc_id").cast("string").alias("doc_id"), "text_sha256", "n_chars")
    right = index.join(copies, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "index")

    def find(docs: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = docs[["doc_id", "text_sha256", "n_chars"]].copy()
        out["member"], out["found_id"], out["found_size"] = False, None, 0
        if len(held) and len(docs):
            member, keep, null, size = look_up(held["index"].iloc[0], _bytes32(docs["text_sha256"]))
            out["member"] = member
            out["found_id"] = np.where(member & ~null, keep.astype(str).astype(object), None)
            out["found_size"] = np.where(member, size, 0)
        return out

    schema = "doc_id string, text_sha256 string, n_chars bigint, member boolean, found_id string, found_size bigint"
    found = left.groupBy("shard", "copy").cogroup(right.groupBy("shard", "copy")).applyInPandas(find, schema)
    return found.withColumns({c: F.col(c).cast("bigint") for c in ("doc_id", "found_id")})


def exact_dedup(docs: DataFrame, history: DataFrame | None = None, *, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row, from its whole text.

    ``history`` has ``text_sha256, keep_id, group_size`` with distinct digests, as ``groups`` makes
    them: a row found there is a repeat of that winner. Rows not found are grouped among themselves.
    Without a history, the digests that this table holds more than once are taken as it, so that
    every group of copies is answered by the index and what is left is alone.

    Of equal texts the row with the most code points, then the smallest id, stays. A null text
    counts as empty, and all blank texts are equal. Rows that repeat both id and text are marked
    alike. A row with a null id stays only where its group has no other id of equal length. An
    empty table gives no row.
    """
    prints = materialise(fingerprints(docs))
    own = history is None
    if own:
        history = groups(prints).filter("group_size > 1")
    history = materialise(history.select("text_sha256", "keep_id", "group_size"))
    shards = max(1, -(-history.count() // shard_keys))
    found = materialise(probe(prints, build_index(history, shards), shards))
    members = found.filter("member").select(
        "doc_id", F.col("found_id").alias("keep_id"), F.col("found_size").alias("group_size"), "text_sha256",
        (F.col("doc_id").eqNullSafe(F.col("found_id")) if own else F.lit(False)).alias("kept"),
    )
    rest = found.filter(~F.col("member")).select("doc_id", "text_sha256", "n_chars")
    others = rest.join(by_shuffle(groups(rest)), "text_sha256").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    order = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    return members.select(*order).unionByName(others.select(*order))


def first_copies(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: exactly one for each group of equal texts."""
    dropped = exact_dedup(docs, **options).filter(~F.col("kept")).select(
        F.col("doc_id").alias("_out_id"), F.col("text_sha256").alias("_out_digest")
    ).distinct()
    digest = F.sha2(F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), WHITE, ""), 256)
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("bigint").alias("_id"), digest.alias("_digest"))
    out = (F.col("_digest") == F.col("_out_digest")) & F.col("_id").eqNullSafe(F.col("_out_id"))
    return rows.join(dropped, out, "left_anti").dropDuplicates(["_id", "_digest"]).select("_row.*")
