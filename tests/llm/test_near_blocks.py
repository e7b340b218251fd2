"""Blocks of the near-duplicate join: who meets whom, and what a block gives."""

from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from noticegrid.llm import near_dup


@pytest.fixture(scope="module")
def labels_of(spark):
    return lambda pairs: spark.createDataFrame(pairs, "id bigint, component bigint")


def test_two_components_in_a_bucket_of_twenty_thousand_classes(spark, labels_of):
    posted = spark.range(20_000).selectExpr("7L as token", "id as cid", "1L as central")
    labels = labels_of([(0, 0)]).unionByName(spark.range(1, 19_999).selectExpr("id", "0L as component"))
    rows = near_dup.dealt(posted, labels, near_dup.BLOCK)
    # Every class of the large component once, the other class once for each of its 34 blocks and once for its own.
    assert rows.count() == 19_999 + 34 + 1
    assert near_dup.dealt(posted.filter("cid < 19999"), labels, near_dup.BLOCK).count() == 0


@pytest.mark.parametrize("block", [1, 3, 50])
def test_all_pairs_of_different_components_meet_once(spark, labels_of, block):
    rng = np.random.default_rng(block)
    posted = {(int(t), int(c)) for t, c in zip(rng.integers(0, 4, 120), rng.integers(0, 60, 120))}
    comp = {c: min(c, int(rng.integers(0, 8)) if c % 3 else c) for c in range(60)}
    comp = {c: comp[c] for c in range(60)}
    rows = near_dup.dealt(
        spark.createDataFrame([(t, c, 1) for t, c in posted], "token bigint, cid bigint, central bigint"),
        labels_of([(c, k) for c, k in comp.items() if k != c]), block).collect()
    assert len({tuple(r) for r in rows}) == len(rows)
    groups, met = defaultdict(list), defaultdict(int)
    for r in rows:
        groups[r.token, r.i, r.j].append(r)
    for (token, i, j), members in groups.items():
        for a, b in combinations(members, 2):
            if a.comp != b.comp and (i == j or a.own != b.own):
                met[token, min(a.cid, b.cid), max(a.cid, b.cid)] += 1
    want = {(t, a, b) for t, a in posted for u, b in posted if t == u and a < b and comp[a] != comp[b]}
    assert set(met) == want and set(met.values()) <= {1}


def test_reaching_rows_against_all_pairs():
    rng = np.random.default_rng(1)
    count = 150
    sig = rng.integers(0, 3, (count, 32)).astype(np.int32)
    comp, own, n = rng.integers(0, 20, count), rng.integers(0, 2, count), rng.integers(90, 110, count)
    token = np.sort(rng.integers(0, 5, count))
    prefix = np.full(count, (1 << 32) - 1)
    table = pa.table({
        "token": token << 32, "i": np.zeros(count, np.int32), "j": np.ones(count, np.int32), "own": own.astype(np.int32), "cid": np.arange(count),
        "comp": comp, "n": n, "prefix": prefix, "sig": pa.array(list(sig))})
    want = np.zeros(count, bool)
    for a, b in combinations(range(count), 2):
        equal = np.flatnonzero(sig[a] == sig[b])
        if token[a] == token[b] and own[a] != own[b] and comp[a] != comp[b] and 100 * min(n[a], n[b]) >= 90 * max(n[a], n[b]):
            if len(equal) >= 13 and equal[0] == token[a]:  # counted under the lowest common coordinate
                want[[a, b]] = True
    assert want.any() and (near_dup.reaching(table, 13, 90, 100) == want).all()


def test_a_block_gives_a_forest_of_its_links():
    rng = np.random.default_rng(2)
    for trial in range(20):
        base = rng.integers(0, 2**62, 6000 if trial % 5 == 0 else 40)
        sets = [np.unique(np.where(rng.random(len(base)) < rng.choice([0.02, 0.1, 0.3]), rng.integers(0, 2**62, len(base)), base)) for _ in range(25)]
        comp = rng.integers(0, 18, 25).tolist()
        common = near_dup.in_common(sets)
        links = []
        for a, b in combinations(range(25), 2):
            both = len(np.intersect1d(sets[a], sets[b]))
            assert common[a, b] == both
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
        got = near_dup.forest(sets, comp, 80, 100)
        assert set(got) <= set(links) and joined(comp, got) == joined(comp, links)
        assert len(got) < len(set(comp))


def joined(comp, links):
    group = {c: {c} for c in comp}
    for a, b in links:
        whole = group[comp[a]] | group[comp[b]]
        for c in whole:
            group[c] = whole
    return {c: min(g) for c, g in group.items()}


def test_a_large_group_whose_members_miss_their_pivot_is_joined(spark):
    """Copies in a chain of small edits: the ends are far apart, each is near to the next."""
    words = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(300):
        words[i % 120] = f"v{i}"
        texts.append((i, " ".join(words)))
    frame = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = near_dup.near_duplicates(frame, shingle=3, percent=85).collect()
    assert {r.component_id for r in got} == {0} and [r.doc_id for r in got if r.kept] == [0]


def test_no_signatures_pass_through_the_driver(spark):
    """Spark counts a signature as one number, so its exploded rows were broadcast at 32 times that size."""
    from pyspark.sql import functions as F

    from noticegrid.session import materialise

    classes = materialise(spark.range(300).select(
        F.col("id").alias("cid"), F.col("id").alias("min_id"), F.lit(5).cast("bigint").alias("n"),
        F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: (F.pmod(F.xxhash64(k, F.col("id") % 100), F.lit(2**31))).cast("int")).alias("sig")))
    posted = near_dup.postings(classes, 16)
    staged = materialise(posted)
    assert staged.groupBy("cid").count().filter("count = 17").count() == 300
    pairs = near_dup.pivot_pairs(staged, classes, 16, 85, 100)
    for df in (posted, pairs):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert {(r.a % 100, r.b % 100) for r in pairs.collect()} == {(i, i) for i in range(100)}


def test_no_digests_pass_through_the_driver(spark):
    """A digest is 64 characters, of which Spark counts 20."""
    from noticegrid.llm import exact_dedup

    docs = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c"), (4, None)], "doc_id bigint, text string")
    found = exact_dedup.exact_dedup(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in found.collect()} == {(1, 1, 2, True), (2, 1, 2, False), (3, 3, 1, True), (4, 4, 1, True)}
