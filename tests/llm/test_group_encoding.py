"""Slices whose distinct chunks are encoded together."""

import numpy as np
import pyarrow as pa
import pytest

from noticegrid.llm import batches, bpe


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def hard_texts():
    rng = np.random.default_rng(6)
    pool = [chr(c) for c in [*range(1, 0x300), *range(0x370, 0x600), 0x1C89, 0x2028, 0x3000, 0xAC00, 0x10400, 0x1F600, 0x105C0]]
    pool += ["<|endoftext|>", "<|startoftext|>", "'s", "'LL", " ", " ", " ", "\n", "aaaa", "́", "word", "Word,"]
    plain = [c for c in pool if c.isascii()]
    made = ["".join(rng.choice(pool if i % 2 else plain, rng.integers(0, 40))) for i in range(1500)]
    return ["", " ", "\n\t", "a<|endoftext|>b", "aaaa" * 300, *made]


@pytest.mark.parametrize("chars", [1, 5_000, 10**9])
def test_grouped_slices_give_the_library_s_ids(library, chars):
    texts = hard_texts()
    rows = pa.RecordBatch.from_arrays([pa.array([*range(len(texts) - 1), None], pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    seen = []
    for ids, place, starts, (flat, first, size) in bpe.encoded(batches.arrow_slices([rows], 1_000), bpe.vocabulary(bpe.default_path()), chars):
        for a, b in zip(starts[:-1], starts[1:]):
            text = texts[len(seen)]
            got = bpe.gathered(flat, first[place[a:b]], size[place[a:b]]).tolist()
            assert got == library.encode(text, add_special_tokens=False).ids, ascii(text)
            seen.append(text)
        assert len(ids) == len(starts) - 1
    assert seen == texts


@pytest.mark.parametrize("piece", [2, 7, 200_000])
def test_distinct_chunks_in_pieces(piece):
    vocab = bpe.vocabulary(bpe.default_path())
    chunks = ["", "Word", "word", "wordword", "it's", "été", "a<|endoftext|>b", "<|endoftext|>", "中文", "word-word", "x1y22"]
    flat, first, size = bpe.encode_once(vocab, pa.array(chunks), piece)
    for want, at, n in zip(vocab.encode(chunks), first, size):
        assert flat[at:at + n].tolist() == want.tolist()
    assert [len(x) for x in bpe.encode_once(vocab, pa.array([], pa.string()), piece)] == [0, 0, 0]
    assert bpe.encode_once(vocab, pa.array([""]), piece)[2].tolist() == [0]


def test_a_group_merges_each_pre_token_once(monkeypatch):
    """The words of one slice come again in all others, as in text; the limit of held ones made workers merge them anew."""
    vocab, merged = bpe.vocabulary(bpe.default_path()), []
    real = vocab.merge
    monkeypatch.setattr(vocab, "merge", lambda words: merged.extend(words) or real(words))
    texts = pa.array([" ".join(f"{chr(97 + i % 26)}word{chr(97 + i // 26 % 26)}, X" for i in range(676))] * 40)
    rows = pa.RecordBatch.from_arrays([pa.array(range(40)), texts], names=["doc_id", "text"])
    slices = list(bpe.encoded(batches.arrow_slices([rows], 10_000), vocab, 10**9))
    assert len(slices) > 10 and len(merged) == len(set(merged)) == 676 + 3  # words, comma, x, line break
