"""Every operator and pipeline stage on nulls, empty and long texts, ties, repeats, clashing columns, no rows."""

import pytest

import corpus_pipeline
from noticegrid.llm import (
    exact_dedup, license_scan, mixing, near_dup, packing, quality_trees, repetition, secret_scan, token_counts, toxicity,
)

ROW_BY_ROW = {
    "token_counts": lambda d, _: token_counts.token_counts(d),
    "secrets": lambda d, _: secret_scan.secrets(d),
    "exact": lambda d, _: exact_dedup.exact_dedup(d),
    "toxicity": lambda d, l: toxicity.toxicity(d, l),
    "licenses": lambda d, _: license_scan.licenses(d),
    "quality": lambda d, l: quality_trees.quality(d, l),
    "near": lambda d, _: near_dup.near_duplicates(d),
    "repetition": lambda d, _: repetition.repetition(d),
}


@pytest.mark.parametrize("name", list(ROW_BY_ROW))
def test_one_row_a_document(name, odd, odd_rows, empty, labels):
    got = ROW_BY_ROW[name](odd, labels).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in odd_rows)
    assert ROW_BY_ROW[name](empty, labels).count() == 0


@pytest.mark.parametrize("name", ["toxicity", "quality"])
def test_no_labels_score_one_half(name, odd, labels):
    scores = {r.score for r in ROW_BY_ROW[name](odd, labels.limit(0)).collect()}
    assert scores == {0.5}


def test_stages_keep_columns_and_take_odd_rows(spark, odd, empty):
    for table in (odd, empty):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == table.columns, name
            docs = spark.createDataFrame(out.collect(), out.schema)
        assert (docs.count() > 0) == (table is odd)


def test_stages_alone_take_odd_rows(spark, odd, odd_rows):
    kept = {name: stage(spark, odd, "").count() for name, stage in corpus_pipeline.STAGES}
    # Exactly one of each group of equal texts: null, empty and blank are one group; ids 1, 5, 5 and 2**62 another.
    assert kept["exact_duplicates"] == len(odd_rows) - 3 - 3
    assert kept["source_mixing"] >= len(odd_rows)


def test_defined_results(odd, odd_rows):
    counts = {r.doc_id: r for r in token_counts.token_counts(odd).collect()}
    assert (counts[2].n_bytes, counts[2].n_tokens, counts[3].n_tokens, counts[4].n_tokens) == (0, 0, 0, 0)
    exact = exact_dedup.exact_dedup(odd).filter("doc_id = 1").first()
    assert (exact.keep_id, exact.group_size, exact.kept) == (2**62, 4, False)  # the longest original text stays
    near = {r.doc_id: r for r in near_dup.near_duplicates(odd).collect() if r.doc_id is not None}
    assert near[2].n_shingles == near[3].n_shingles == near[4].n_shingles == 0
    assert (near[5].component_id, near[2**62].component_id, near[7].component_id) == (1, 1, 6)
    pieces = [r for r in packing.pack(odd).collect() if r.doc_id == 2]
    assert [(p.start, p.length, p.doc_tokens) for p in pieces] == [(0, 1, 1)]
    rules = {r.doc_id: r for r in repetition.repetition(odd).collect() if r.doc_id is not None}
    assert rules[2].base_failed and not rules[2].kept and rules[1].kept and rules[9].n_dup_lines == 4
    found = {r.doc_id: r for r in secret_scan.secrets(odd).collect() if r.doc_id is not None}
    assert (found[2].spans, found[10].n_assign) == ("", 1)
    names = license_scan.licenses(odd).filter("doc_id = 2").first()
    assert (names.n_words, names.first_word, names.labels, names.score) == (0, None, "", 0.0)
    mixed = mixing.mix(odd).filter("n_tokens = 0").collect()
    assert mixed and all(r.n_tokens == 0 for r in mixed)
