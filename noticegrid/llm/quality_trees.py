"""Document quality by gradient-boosted trees over statistics of the whole text."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticegrid.llm import batches, labelled, trees

NAMES = (
    "log_chars", "log_words", "word_length", "word_length_sd", "upper", "digits", "spaces", "punctuation", "symbols",
    "bars", "exclamations", "other_ascii", "beyond_ascii", "byte_entropy", "distinct_words", "distinct_pairs", "top_word",
    "short_words", "long_words", "log_lines", "line_length", "distinct_lines", "sentence_ends", "breaks_in_words",
)


def _bytes_in(characters: bytes) -> np.ndarray:
    mask = np.zeros(256)
    mask[list(characters)] = 1
    return mask


BYTE_GROUPS = np.stack([
    _bytes_in(bytes(range(65, 91))), _bytes_in(b"0123456789"), _bytes_in(b" \t\n\x0b\x0c\r"), _bytes_in(b".,;:'\"-()?"),
    _bytes_in(b"#*$%&<>=@^~\\_{}[]"), _bytes_in(b"|"), _bytes_in(b"!"), _bytes_in(bytes([*range(9), *range(14, 32), 127])),
    _bytes_in(bytes(range(128, 256))), _bytes_in(b".?!"),
], axis=1)


def statistics(text: str) -> list[float]:
    """The features ``NAMES`` of a text; an empty one has zeros."""
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return [0.0] * len(NAMES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    groups = counts @ BYTE_GROUPS / len(raw)
    seen = counts[counts > 0] / len(raw)
    words = raw.split()
    n = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    pairs = np.unique(ids[:-1] * n + ids[1:]).size if len(words) > 1 else 1
    lines = raw.split(b"\n")
    upper, digits, spaces, punctuation, symbols, bars, marks, other, beyond, ends = groups
    letters_end = sum(w[-1:] in b"#*$%&|<>!" for w in words) / n
    return [
        np.log1p(len(text)), np.log1p(len(words)), sizes.mean(), sizes.std(), upper, digits, spaces, punctuation, symbols, bars, marks,
        other, beyond, float(-(seen * np.log(seen)).sum()), len(numbers) / n, pairs / max(1, len(words) - 1),
        np.bincount(ids).max() / n if len(words) else 0.0, float((sizes <= 3).mean()), float((sizes >= 12).mean()),
        np.log1p(len(lines)), len(raw) / len(lines), len(set(lines)) / len(lines), ends, letters_end,
    ]


def features(docs: DataFrame) -> DataFrame:
    """``doc_id, x`` (array of the features) for every row."""

    def make():
        return lambda ids, texts: {"doc_id": ids, "x": [statistics(t) for t in texts]}

    return batches.per_slice(docs, make, "doc_id bigint, x array<double>")


def train(docs: DataFrame, labels: DataFrame, label: str, learn, rows: int = labelled.SAMPLE_ROWS) -> trees.Boosted:
    """Trees fitted on at most ``rows`` labelled documents; without any, all scores are one half."""
    some = labelled.sample(docs, labels, label, learn, rows)
    truth = some.select("doc_id", "label").distinct()
    table = features(some).join(truth, "doc_id").orderBy("doc_id").select("x", "label").toArrow()
    x = np.array(table.column("x").to_pylist(), float).reshape(-1, len(NAMES))
    return trees.fit(x, table.column("label").to_numpy())


def quality(
    docs: DataFrame, labels: DataFrame, *, label: str = "quality", modulus: int = 4, held: int = 2, limit: float = 0.7,
    rows: int = labelled.SAMPLE_ROWS,
) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row, from its whole text.

    Labels are learnt from ids whose crc32 modulo ``modulus`` is not ``held``. A null text is scored
    as an empty one; rows that repeat an id or a text are scored each by itself; an empty table gives
    no row. A label table without usable rows gives 0.5 throughout.
    """
    part = labelled.remainder(modulus)
    model = train(docs, labels, label, part != held, rows)

    def make():
        def work(ids, texts):
            score = model.scores(np.array([statistics(t) for t in texts]).reshape(-1, len(NAMES)))
            return {"doc_id": ids, "score": score}

        return work

    scored = batches.per_slice(docs, make, "doc_id bigint, score double")
    return scored.select(
        "doc_id", (part == held).alias("held_out"), "score", F.when(F.col("score") >= limit, 1).otherwise(0).alias("predicted")
    )
