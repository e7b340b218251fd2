"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths in numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticegrid.llm import batches

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
# n-gram length -> largest share of a text's word characters inside n-grams met twice or more.
COVERAGE = {3: 0.60, 5: 0.30, 7: 0.28, 10: 0.25}
DUP_LINE_CHARS = 0.30
SCHEMA = (
    "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, kept boolean, " + ", ".join(f"chars_dup_{n} bigint" for n in COVERAGE) + ", chars_dup_lines bigint"
)


class Numbers(dict):
    """Gives every new word the next number."""

    def __missing__(self, word):
        number = self[word] = len(self)
        return number


def spread_bits(x: np.ndarray) -> np.ndarray:
    """A fixed mixing of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def covered(ids: np.ndarray, doc: np.ndarray, lengths) -> dict[int, np.ndarray]:
    """For each n-gram length, the mask of words inside n-grams that their document has twice or more.

    ``ids`` are the word numbers of consecutive documents, ``doc`` the document of each word. Each
    length's hash rolls out of the next shorter one; equal hashes are compared word by word.
    """
    total, out = len(ids), {}
    value = spread_bits(ids.astype(np.uint64) + np.uint64(1))
    rolling = value.copy()
    for n in range(1, max(lengths) + 1):
        if n > 1:
            if total < n:
                break
            rolling = rolling[: total - n + 1] * np.uint64(0x9E3779B97F4A7C15) + value[n - 1:]
        if n not in lengths:
            continue
        at = np.flatnonzero(doc[: total - n + 1] == doc[n - 1:])
        key = spread_bits(rolling[at] ^ spread_bits(doc[at].astype(np.uint64) + np.uint64(0x632BE59B)))
        order = np.argsort(key, kind="stable")
        where = at[order]
        twin = np.flatnonzero(key[order][1:] == key[order][:-1])
        for j in range(n):
            twin = twin[ids[where[twin] + j] == ids[where[twin + 1] + j]]
        twin = twin[doc[where[twin]] == doc[where[twin + 1]]]
        starts = np.zeros(total + 1, bool)
        starts[where[twin]] = True
        starts[where[twin + 1]] = True
        starts = np.flatnonzero(starts)
        edge = np.bincount(starts, minlength=total + 1) - np.bincount(starts + n, minlength=total + 1)
        out[n] = np.cumsum(edge[:total]) > 0
    return {n: out.get(n, np.zeros(total, bool)) for n in lengths}


def repeated_lines(text: str) -> tuple[int, int]:
    """Number and word characters of lines that hold a word and equal an earlier line."""
    lines = text.split("\n")
    if len(lines) < 2 or len(set(lines)) == len(lines):
        return 0, 0
    seen, count, chars = set(), 0, 0
    for line in lines:
        if line in seen:
            if filled := len(line) - sum(map(line.count, BLANKS)):
                count, chars = count + 1, chars + filled
        else:
            seen.add(line)
    return count, chars


def measure(texts: list[str], limits: dict[int, float], dup_line_chars: float) -> dict:
    """The columns of ``SCHEMA`` but the id."""
    numbers, words, sizes = Numbers(), [], []
    for text in texts:
        found = text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space alone
        sizes.append(len(found))
        words.append(np.fromiter(map(numbers.__getitem__, found), np.int64, len(found)))
    n_words = np.array(sizes, np.int64)
    flat = np.concatenate(words)
    doc = np.repeat(np.arange(len(texts)), n_words)
    chars_of = np.fromiter((len(w.decode("utf-8", "surrogatepass")) for w in numbers), np.int64, len(numbers))
    chars = chars_of[flat]
    per_doc = lambda weights: np.bincount(doc, weights, len(texts)).astype(np.int64)
    masks = covered(flat, doc, tuple(limits))
    word_chars = per_doc(chars)
    repeat = per_doc(masks[5])
    dup = {n: per_doc(np.where(m, chars, 0)) for n, m in masks.items()}
    lines = np.array([repeated_lines(t) for t in texts], np.int64).reshape(-1, 2)
    failed = (n_words < 10) | (100 * repeat > 20 * n_words)
    bad = failed | (lines[:, 1] > dup_line_chars * word_chars)
    for n, most in limits.items():
        bad |= dup[n] > most * word_chars
    return {
        "n_words": n_words, "word_chars": word_chars,
        "n_symbols": [sum(map(t.count, SYMBOLS)) for t in texts], "n_dup_lines": lines[:, 0],
        "n_repeat_words": repeat, "base_failed": failed, "kept": ~bad,
        **{f"chars_dup_{n}": dup[n] for n in limits}, "chars_dup_lines": lines[:, 1],
    }


def _limits(coverage: dict[int, float] | None) -> dict[int, float]:
    limits = dict(coverage or COVERAGE)
    if set(limits) != set(COVERAGE):
        raise ValueError(f"coverage needs a limit for each of {sorted(COVERAGE)}")
    return limits


def repetition(
    docs: DataFrame, *, coverage: dict[int, float] | None = None, dup_line_chars: float = DUP_LINE_CHARS,
) -> DataFrame:
    """Counts and verdict of every row, from its whole text (see ``SCHEMA``).

    ``chars_dup_N`` are characters of words inside N-word windows that the text has twice or more,
    first ones included. ``kept`` is false if the base rule fails or if a share of ``coverage`` or
    the share of characters in repeated lines is exceeded. A null, empty or blank text has no words,
    so it fails the base rule. Repeated rows each give a row; an empty table gives none.
    """
    limits = _limits(coverage)

    def make():
        return lambda ids, texts: {"doc_id": ids, **measure(texts, limits, dup_line_chars)}

    return batches.per_slice(docs, make, SCHEMA)


def passing_rows(
    docs: DataFrame, *, coverage: dict[int, float] | None = None, dup_line_chars: float = DUP_LINE_CHARS,
) -> DataFrame:
    """The rows of ``docs`` that ``repetition`` keeps, with all their columns; only texts reach Python."""
    limits = _limits(coverage)

    @F.pandas_udf("boolean")
    def passes(text: pd.Series) -> pd.Series:
        kept = [measure(texts, limits, dup_line_chars)["kept"] for texts in batches.text_slices(text)]
        return pd.Series(np.concatenate(kept) if kept else np.zeros(0, bool))

    return docs.filter(passes(F.coalesce(F.col("text").cast("string"), F.lit(""))))
