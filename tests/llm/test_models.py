"""Boosted trees and the factorization machine; held-out accuracy of both classifiers."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from noticegrid.llm import factors, labelled, mixing, quality_trees, queries, toxicity, trees


def walk(model, t, row):
    node = 0
    while model.left[t, node] != node:
        node = model.left[t, node] + (row[model.feature[t, node]] > model.limit[t, node])
    return model.value[t, node]


def test_trees_learn_and_flat_traversal_equals_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 6))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = trees.fit(x[:2000], y[:2000], trees=30)
    scores = model.scores(x)
    assert ((scores > 0.5) == y)[2000:].mean() > 0.95
    for i in range(0, 3000, 300):
        margin = model.base + sum(walk(model, t, x[i]) for t in range(30))
        assert np.isclose(scores[i], 1 / (1 + np.exp(-margin)))
    assert np.allclose(trees.fit(np.zeros((0, 3)), np.zeros(0)).scores(np.ones((2, 3))), 0.5)


def test_machine_learns_a_pair_that_weights_alone_miss():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for _ in range(3000):
        a, b = rng.integers(0, 2, 2)
        rows.append(np.array([k for k, on in ((0, a), (1, b)) if on] + [2 + int(rng.integers(0, 5))]))
        y.append(float(a and b))  # insult with group mention; each alone is harmless
    y, sizes = np.array(y), np.array([len(r) for r in rows])
    model = factors.fit(np.concatenate(rows), sizes, y, 7, epochs=30)
    score = model.scores(np.array([0, 1, 0, 1]), np.array([2, 1, 1]))
    assert score[0] > 0.9 and score[1] < 0.2 and score[2] < 0.2
    assert model.factors[0] @ model.factors[1] > 0.5


def test_machine_equals_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    model = factors.Machine(0.1, rng.normal(size=9), rng.normal(size=(9, 4)))
    row = np.array([1, 4, 7])
    pairs = sum(model.factors[a] @ model.factors[b] for i, a in enumerate(row) for b in row[i + 1:])
    assert np.allclose(model.margins(row, np.array([3, 0])), [0.1 + model.weights[row].sum() + pairs, 0.1])


@pytest.mark.parametrize("name,label,least", [("op4_toxicity", "toxic", 0.93), ("op7_quality_trees", "quality", 0.97)])
def test_held_out_accuracy(spark, name, label, least):
    path = "/root/testdata/sf0.1"
    scored = queries.QUERIES[name](spark, path).filter("held_out")
    rows = scored.join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").select("predicted", label).collect()
    assert len(rows) > 300 and np.mean([r[0] == r[1] for r in rows]) >= least


@pytest.mark.parametrize("score,label,modulus,kept_out,limit", [(toxicity.toxicity, "toxic", 5, 0, 0.5), (quality_trees.quality, "quality", 4, 2, 0.7)])
def test_scored_rows_and_labels_kept_out(spark, documents, data, score, label, modulus, kept_out, limit):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    rows = score(documents, labels).collect()
    assert len(rows) == documents.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == kept_out)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= limit)
    # Other labels of held-out ids change no score; other labels of the rest do.
    out = F.crc32(F.col("doc_id").cast("string")) % modulus == kept_out
    before = {r.doc_id: r.score for r in rows}
    turned = lambda where: labels.withColumn(label, F.when(where, 1 - F.col(label)).otherwise(F.col(label)))
    assert {r.doc_id: r.score for r in score(documents, turned(out)).collect()} == before
    assert {r.doc_id: r.score for r in score(documents, turned(~out)).collect()} != before


def test_samples_are_the_least_hashes(spark):
    docs = spark.range(40_000).selectExpr("id as doc_id", "cast(id as string) as text").repartition(9)
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality")
    got = {r.doc_id for r in labelled.sample(docs, labels, "quality", F.lit(True), rows=50).collect()}
    want = {r.doc_id for r in docs.orderBy(F.xxhash64("doc_id"), "doc_id").limit(50).collect()}
    assert got == want


def test_mixing_meets_entropy_and_budget(spark):
    rows = [(i, " ".join(["w"] * (i % 7 + 1)), f"s{0 if i % 10 else 1 + i % 3}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    even = mixing.mix(docs, entropy=0.9, max_repeats=100.0)
    tokens = np.array([r[1] for r in even.groupBy("source").sum("n_tokens").collect()], float)
    share = tokens / tokens.sum()
    assert -(share * np.log(share)).sum() / np.log(len(share)) >= 0.88
    total = mixing.mix(docs, budget=3000).agg({"n_tokens": "sum"}).first()[0]
    assert 2900 <= total <= 3000
    copies = mixing.mix(docs).groupBy("doc_id").count()
    assert copies.count() == 2000 and {r[1] for r in copies.collect()} <= {1, 2}
    again = mixing.mixed_rows(docs)
    want = {(r.doc_id, r[1]) for r in copies.collect()}
    assert {(r.doc_id, r[1]) for r in again.groupBy("doc_id").count().collect()} == want
