"""MinHash near duplicates by an inverted join over signature coordinates.

Documents with equal shingle sets are one class. Each class posts itself under every
(coordinate, value) pair of its signature. Two classes as similar as the limit agree in at least
``least_matches`` of the coordinates but for one pair in a million, so

* skip: a class with fewer pairs that anyone else has cannot reach that number and leaves;
* prefix: of a class with m shared pairs the m - least_matches + 1 rarest are enough to meet every
  partner, which leaves the pairs of common passages out;
* count: where two classes meet, the agreements of their signatures are counted, once for each two.

First every class is compared with the pivot of its buckets, the class whose pairs are shared most;
the confirmed links make components. Then each bucket that holds several components is compared in
blocks of bounded size, never a component with itself. Classes that reach the count there meet once
more with their full sets, and each block gives a spanning forest of the links that the sets confirm,
so no bucket ever yields more rows than it has classes.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from noticegrid.llm import batches, shingles
from noticegrid.llm.components import components
from noticegrid.session import by_shuffle, materialise

COORDINATES = 32
BLOCK = 600  # classes of one side of a block pair
COLUMNS = 4096  # shingles that a block counts in common at once
ID_CELLS = 1 << 20  # at most so many rows in the broadcast that spares texts a shuffle
HITS = "aggregate(zip_with(sig_a, sig_b, (x, y) -> if(x = y, 1, 0)), 0, (s, x) -> s + x)"


def least_matches(coordinates: int, similarity: float, miss: float = 1e-6) -> int:
    """The largest number of agreeing coordinates that a pair of this similarity misses with probability ``miss`` at most."""
    below = 0.0
    for k in range(coordinates + 1):
        below += comb(coordinates, k) * similarity**k * (1 - similarity) ** (coordinates - k)
        if below > miss:
            return max(1, k)
    return coordinates


def prints(docs: DataFrame, size: int, count: int = COORDINATES) -> DataFrame:
    """``doc_id, n_shingles, digest, sig`` of every row; the last two are null without words."""

    def make():
        known, functions = shingles.WordHashes(), shingles.coordinates(count)

        def work(ids, texts):
            sets = [shingles.shingle_set(t, size, known) for t in texts]
            return {
                "doc_id": ids, "n_shingles": [len(s) for s in sets],
                "digest": [shingles.digest(s) if len(s) else None for s in sets],
                "sig": [shingles.signature(s, functions).view(np.int32) if len(s) else None for s in sets],
            }

        return work

    return batches.per_slice(docs, make, "doc_id bigint, n_shingles bigint, digest binary, sig array<int>")


def postings(classes: DataFrame, matches: int) -> DataFrame:
    """``cid, token, central``: the prefix of each class that can reach ``matches`` agreements.

    ``central`` is the number of classes met under all of a class's pairs, so the original of a
    group of edited copies has the largest.
    """
    tokens = classes.select("cid", F.posexplode("sig").alias("k", "v")).select(
        "cid", F.expr("shiftleft(cast(k as bigint), 32) | (cast(v as bigint) & 4294967295L)").alias("token")
    )
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    own = Window.partitionBy("cid")  # at most one row a coordinate
    ranked = tokens.join(by_shuffle(shared), "token").withColumns({
        "m": F.count(F.lit(1)).over(own), "central": F.sum("df").over(own), "rank": F.row_number().over(own.orderBy("df", "token")),
    })
    return ranked.filter(F.col("rank") <= F.col("m") - matches + 1).select("cid", "token", "central")


def near_sizes(a: str, b: str, num: int, den: int):
    """Sizes that the similarity allows."""
    return F.least(F.col(a), F.col(b)) * den >= F.greatest(F.col(a), F.col(b)) * num


def pivot_pairs(posted: DataFrame, classes: DataFrame, matches: int, num: int, den: int) -> DataFrame:
    """``a, b``: for each class the pivots worth confirming, two at most."""
    rank = F.struct("central", (-F.col("cid")).alias("minus"))
    pivots = posted.groupBy("token").agg(F.max(rank).alias("pivot"))
    met = posted.join(by_shuffle(pivots), "token").select(
        F.col("cid").alias("a"), (-F.col("pivot.minus")).alias("b"), F.col("pivot.central").alias("central")
    ).filter("a <> b").distinct()
    one = classes.select(F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("sig").alias("sig_a"))
    two = classes.select(F.col("cid").alias("b"), F.col("n").alias("n_b"), F.col("sig").alias("sig_b"))
    counted = met.join(by_shuffle(one), "a").join(by_shuffle(two), "b").filter(near_sizes("n_a", "n_b", num, den)).withColumn("hits", F.expr(HITS)).filter(F.col("hits") >= matches)
    likely = F.col("hits") * den >= num * F.size("sig_a")
    chosen = counted.groupBy("a").agg(
        F.max(F.when(likely, F.struct("central", "b"))).alias("first"), F.max(F.struct("hits", "b")).alias("best")
    )
    return chosen.select("a", F.explode(F.array("first.b", "best.b")).alias("b")).filter("b is not null").distinct()


def dealt(posted: DataFrame, labels: DataFrame, block: int) -> DataFrame:
    """``token, i, j, own, cid, comp``: every class of a bucket once for each pair of blocks it is part of.

    A component of more than ``block`` classes has blocks of its own, which do not meet each other;
    the others share blocks by a hash of the component. Buckets of one component meet nobody.
    """
    labelled = posted.join(labels, posted["cid"] == labels["id"], "left").select("token", "cid", F.coalesce("component", "cid").alias("comp"))
    counts = labelled.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("m"))
    large = F.col("m") > block
    whole = counts.groupBy("token").agg(
        F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.coalesce(F.sum(F.when(~large, F.col("m"))), F.lit(0)).alias("small"),
        F.collect_list(F.when(large, F.struct("comp", F.ceil(F.col("m") / block).cast("int").alias("n")))).alias("large"),
    ).filter("lo <> hi")
    one = lambda comp, n: F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(comp.alias("c"), k.alias("k")))
    shared = F.ceil(F.col("small") / block).cast("int")
    blocks = F.concat(
        F.when(shared > 0, one(F.lit(-1).cast("bigint"), shared)).otherwise(F.array().cast("array<struct<c:bigint,k:int>>")),
        F.flatten(F.transform("large", lambda x: one(x["comp"], x["n"]))),
    )
    mixed = whole.select("token", shared.alias("shared"), "large", blocks.alias("blocks"))
    rows = labelled.join(by_shuffle(mixed), "token")
    own_large = F.try_element_at(F.filter("large", lambda x: x["comp"] == F.col("comp")), F.lit(1))
    mine = F.when(own_large.isNull(), F.struct(F.lit(-1).cast("bigint").alias("c"), F.pmod(F.xxhash64("comp"), F.col("shared")).cast("int").alias("k"))).otherwise(
        F.struct(F.col("comp").alias("c"), F.pmod(F.xxhash64("cid"), own_large["n"]).cast("int").alias("k")))
    placed = rows.withColumn("mine", mine).withColumn("own", (F.array_position("blocks", F.col("mine")) - 1).cast("int"))
    meets = F.col("other")["c"].eqNullSafe(F.lit(-1)) | (F.col("other")["c"] != F.col("mine.c"))
    spread = placed.select("token", "cid", "comp", "mine", "own", F.posexplode("blocks").alias("at", "other")).filter(meets)
    return spread.select("token", F.least("own", "at").alias("i"), F.greatest("own", "at").alias("j"), "own", "cid", "comp")


def candidates(posted: DataFrame, classes: DataFrame, labels: DataFrame, matches: int, num: int, den: int, block: int = BLOCK) -> DataFrame:
    """``token, i, j, own, cid, comp`` of the classes that reach the count with another component of their block pair."""
    prefix = posted.groupBy("cid").agg(F.bit_or(F.expr("shiftleft(1L, cast(shiftright(token, 32) as int))")).alias("prefix"))
    facts = classes.select("cid", "n", "sig").join(by_shuffle(prefix), "cid")
    rows = dealt(posted, labels, block).join(by_shuffle(facts), "cid").select("token", "i", "j", "own", "cid", "comp", "n", "prefix", "sig")
    schema = "token bigint, i int, j int, own int, cid bigint, comp bigint"

    def run(parts):
        for table in whole_groups(parts):
            found = reaching(table, matches, num, den)
            if found.any():
                yield from table.select(list(range(6))).filter(pa.array(found)).to_batches()

    return rows.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(run, schema)


def whole_groups(parts, rows: int = 20_000):
    """Tables of sorted (item, i, j) groups, never a part of one; a group has two blocks at most."""
    held, size = [], 0
    for batch in parts:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        table = pa.Table.from_batches(held)
        starts = np.flatnonzero(group_starts(table))
        cut = int(starts[-1])
        if cut:
            yield table.slice(0, cut)
        held, size = table.slice(cut).combine_chunks().to_batches(), table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def group_starts(table: pa.Table) -> np.ndarray:
    keys = [table.column(c).to_numpy() for c in ("token", "i", "j")]
    fresh = np.ones(table.num_rows, bool)
    fresh[1:] = False
    for key in keys:
        fresh[1:] |= key[1:] != key[:-1]
    return fresh


def reaching(table: pa.Table, matches: int, num: int, den: int) -> np.ndarray:
    """Which rows of a table of whole groups reach ``matches`` agreements with a row of another component.

    Row r meets row r + d of its group, one d after the other. Two classes that share several
    buckets count in the one of their lowest common coordinate.
    """
    group = np.cumsum(group_starts(table))
    cid, comp, n, own, prefix = (table.column(c).to_numpy() for c in ("cid", "comp", "n", "own", "prefix"))
    coordinate = table.column("token").to_numpy() >> 32
    across = table.column("i").to_numpy() != table.column("j").to_numpy()
    sig = table.column("sig").combine_chunks().flatten().to_numpy().reshape(len(cid), -1)
    bits = (prefix[:, None] >> np.arange(sig.shape[1])) & 1 == 1
    out = np.zeros(len(cid), bool)
    rows, d = np.arange(len(cid)), 0
    while True:
        d += 1
        rows = rows[rows + d < len(cid)]
        rows = rows[group[rows] == group[rows + d]]
        if not len(rows):
            return out
        for a in np.array_split(rows, len(rows) // 20_000 + 1):
            b = a + d
            good = (comp[a] != comp[b]) & (~across[a] | (own[a] != own[b]))
            good &= np.minimum(n[a], n[b]) * den >= np.maximum(n[a], n[b]) * num
            a, b = a[good], b[good]
            equal = sig[a] == sig[b]
            good = equal.sum(axis=1) >= matches
            good &= (equal & bits[a] & bits[b]).argmax(axis=1) == coordinate[a]
            out[a[good]] = out[b[good]] = True


def forests(rows: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """``a, b``: for each (token, i, j) of ``candidates`` a spanning forest of the links that the full sets confirm."""
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(parts):
        for table in whole_groups(parts, 500):
            bounds = [*np.flatnonzero(group_starts(table)).tolist(), table.num_rows]
            cid, comp = table.column("cid").to_numpy(), table.column("comp").to_numpy()
            items = table.column("items").combine_chunks()
            values, offsets = items.values.to_numpy(), items.offsets.to_numpy()
            links = []
            for start, end in zip(bounds[:-1], bounds[1:]):
                found = [values[offsets[r]:offsets[r + 1]] for r in range(start, end)]
                links += [(cid[start + a], cid[start + b]) for a, b in forest(found, comp[start:end].tolist(), num, den)]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links)], schema=arrow)

    whole = rows.join(sets.select("cid", "items"), "cid")
    return whole.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(run, "a bigint, b bigint")


def forest(sets: list[np.ndarray], comp: list[int], num: int, den: int) -> list[tuple[int, int]]:
    """Links between different components, as few as join all that are linked."""
    root = {c: c for c in comp}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    size = np.array([len(s) for s in sets], np.int64)
    common = in_common(sets)
    similar = np.triu(common * (num + den) >= num * (size[:, None] + size), 1)
    out = []
    for a, b in zip(*(x.tolist() for x in similar.nonzero())):
        one, two = find(comp[a]), find(comp[b])
        if one != two:
            root[max(one, two)] = min(one, two)
            out.append((a, b))
    return out


def in_common(sets: list[np.ndarray]) -> np.ndarray:
    """How many items each two sets have in common, exactly; items are counted some thousand at a time."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held[column] > 1  # an item of one set is in common with none
    row, column = row[shared], column[shared]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(sets), len(sets)), np.int64)
    at = 0
    while at < len(column):
        end = int(np.searchsorted(column, column[at] + COLUMNS))
        part = np.zeros((len(sets), COLUMNS), np.float32)  # counts below 2**24 are exact
        part[row[at:end], column[at:end] - column[at]] = 1
        total += (part @ part.T).astype(np.int64)
        at = end
    return total


def cell(column: str):
    return F.pmod(F.xxhash64(column), F.lit(ID_CELLS))


def in_cells(rows: DataFrame, ids: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """The rows whose key may be (``left_anti``: cannot be) among ``ids``, told by the ids' hash cells.

    There are ``ID_CELLS`` cells at most, so they are broadcast, and texts that no id asks for need no
    shuffle. With very many ids all cells are taken and every row stays for the exact join.
    """
    cells = ids.select(cell(column).alias("_cell")).distinct()
    return rows.withColumn("_at", cell(column)).join(F.broadcast(cells), F.col("_at") == F.col("_cell"), how).drop("_at")


def full_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``cid, n, items`` of the classes in ``wanted`` (``cid, min_id, digest``), from one text of each."""
    key = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(-(2**63)))
    texts = docs.select(key("doc_id").alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = wanted.select(key("min_id").alias("key"), "cid", "digest")
    rows = in_cells(texts, ids, "key").join(ids, "key").select("cid", "text", "digest")
    schema = "cid bigint, n bigint, items array<bigint>"
    arrow = pa.schema([("cid", pa.int64()), ("n", pa.int64()), ("items", pa.list_(pa.int64()))])

    def run(parts):
        known = shingles.WordHashes()
        for batch in parts:
            ids, digests, row = batch.column(0).to_pylist(), batch.column(2).to_pylist(), 0
            for texts in batches.text_slices(x.as_py() for x in batch.column(1)):
                kept = []
                for text in texts:
                    found = shingles.shingle_set(text, size, known)
                    if shingles.digest(found) == digests[row]:  # ids may repeat
                        kept.append((ids[row], len(found), found.view(np.int64)))
                    row += 1
                if kept:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), arrow.types)], schema=arrow)

    return rows.mapInArrow(run, schema)


def confirmed(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    one = sets.select(F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("items").alias("items_a"))
    two = sets.select(F.col("cid").alias("b"), F.col("n").alias("n_b"), F.col("items").alias("items_b"))
    both = pairs.join(one, "a").join(two, "b").withColumn("common", F.size(F.array_intersect("items_a", "items_b")).cast("bigint"))
    return both.filter(F.col("common") * den >= (F.col("n_a") + F.col("n_b") - F.col("common")) * num).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, coords: int = COORDINATES) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row, from its whole text.

    Rows are linked where 100 * common >= ``percent`` * union of their sets of ``shingle``-word
    shingles; ``component_id`` is the least id reachable and ``kept`` marks the row that has it. A
    null, empty or blank text has no shingle and is its own component. Rows that repeat an id stay
    rows of their own, linked by their own texts; a null id is never a component's id unless all ids
    of the component are null, and then such rows are not ``kept``. An empty table gives no row.
    """
    num, den = percent, 100
    matches = least_matches(coords, percent / 100)
    found = materialise(prints(docs, shingle, coords))
    classes = materialise(
        found.filter("digest is not null").groupBy("digest")
        .agg(F.min("doc_id").alias("min_id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
        .withColumn("cid", F.monotonically_increasing_id())
    )
    posted = materialise(postings(classes, matches))
    able = materialise(classes.join(posted.select("cid").distinct(), "cid", "left_semi"))
    sets = materialise(full_sets(docs, able, shingle))
    links = materialise(confirmed(pivot_pairs(posted, able, matches, num, den), sets, num, den))
    rest = materialise(candidates(posted, able, components(links), matches, num, den))
    more = materialise(forests(rest, sets, num, den))
    labels = components(links.union(more))
    reach = labels.join(classes, labels["id"] == classes["cid"]).groupBy("component").agg(F.min("min_id").alias("component_id"))
    linked = labels.join(reach, "component").select(F.col("id").alias("cid"), "component_id")
    of_class = classes.join(linked.withColumn("in_one", F.lit(True)), "cid", "left").select(
        "digest", F.when(F.col("in_one"), F.col("component_id")).otherwise(F.col("min_id")).alias("class_id")
    )
    rows = found.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    )


def group_representatives(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: the least id of each component.

    A row with a null id stays. Where several rows share an id, they stay if one of them does.
    """
    rows = materialise(near_duplicates(docs, **options).select("doc_id", "kept"))
    gone = materialise(rows.groupBy("doc_id").agg(F.max("kept").alias("kept")).filter(~F.col("kept")).select(F.col("doc_id").alias("_id")))
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").cast("bigint").alias("_id"))
    sure = in_cells(keyed, gone, "_id", "left_anti")
    checked = in_cells(keyed, gone, "_id").join(gone, "_id", "left_anti")
    return sure.select("_row.*").unionByName(checked.select("_row.*"))
