"""Byte-pair encoding of many pre-tokens at once, by rank-synchronous merging of numpy arrays."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NONE = np.int32(2**31 - 1)
# White space as the vocabulary's own pattern knows it; str.split() also splits at \x1c-\x1f.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
ODD_SPLITS = "\x1c\x1d\x1e\x1f"
# The same class beyond ASCII, and as a whole, as Arrow's expressions write it.
WIDE_SPACES = r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ARROW_SPACES = rf"(?:[\t-\r ]|{WIDE_SPACES})+"


def _category_class(letter: str, below: int) -> str:
    """A character class of the code points below ``below`` whose general category starts with ``letter``."""
    return "".join(re.escape(chr(c)) for c in range(below) if unicodedata.category(chr(c))[0] == letter)


class Vocabulary:
    """A word-end BPE vocabulary: chunks between white space to symbol ids.

    Chunks of the Latin blocks are cut here; of any others the library's own normaliser and
    pre-tokeniser are asked, as Unicode versions differ. The merging is always done here.
    """

    LATIN = 0x250

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        vocab, merges = stored["model"]["vocab"], stored["model"]["merges"]
        suffix = stored["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        self.top = max(*vocab.values(), *self.special.values(), 0)  # the largest id
        self._special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.uint64)
        right = np.array([vocab[b] for _, b in pairs], np.uint64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        key = left << np.uint64(32) | right
        order = np.argsort(key, kind="stable")
        self._key, self._rank, self._made = key[order], order.astype(np.int32), made
        from tokenizers.pre_tokenizers import ByteLevel

        letters: dict[int, str] = {}  # byte -> the character that stands for it
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        # One character for every first and every following byte that UTF-8 has.
        for c in (*range(0x800), *(0x1000 * k for k in range(1, 16) if k != 13), 0x800, 0xD000, *(0x40000 * k for k in range(1, 5)), 0x10000):
            for byte, mark in zip(chr(c).encode(), level.pre_tokenize_str(chr(c))[0][0]):
                letters[byte] = mark
        self._letters = {mark: byte for byte, mark in letters.items()}
        inner, last = np.zeros(256, np.int32), np.zeros(256, np.int32)
        for byte, mark in letters.items():
            inner[byte], last[byte] = vocab[mark], vocab[mark + suffix]
        self._inner, self._last = inner, last
        alpha, digit = _category_class("L", self.LATIN), _category_class("N", self.LATIN)
        self._cut = re.compile(f"[{alpha}]+|[{digit}]|\n|'(?:s|t|re|ve|m|ll|d)|[^\n{alpha}{digit}]+")
        self._other = re.compile(f"[^\\x00-\\u{self.LATIN - 1:04x}]")
        self._split = re.compile(f"[^{SPACES}]+")

    def chunks(self, text: str) -> list[str]:
        """The pieces of a text between white space; no pre-token reaches over one."""
        if any(c in text for c in ODD_SPLITS):
            return self._split.findall(text)
        return text.split()

    @staticmethod
    def lowered(text: str) -> str:
        return text.lower() if text.isascii() else unicodedata.normalize("NFC", text).lower()

    def beyond_latin(self, lower: str) -> bool:
        return self._other.search(lower) is not None

    def cut(self, lower: str) -> list[str]:
        """Pre-tokens of lowered text without white space but line breaks, which are pre-tokens of their own."""
        return self._cut.findall(lower)

    def words(self, chunk: str) -> list[bytes]:
        """Pre-tokens of a chunk without special strings, in UTF-8."""
        lower = self.lowered(chunk)
        if self._other.search(lower):
            normal = self._library.normalizer.normalize_str(chunk)
            shown = self._library.pre_tokenizer.pre_tokenize_str(normal)
            return [bytes(map(self._letters.__getitem__, marks)) for marks, _ in shown]
        return [w.encode() for w in self.cut(lower)]

    def encode(self, chunks: list[str]) -> list[np.ndarray]:
        """Symbol ids of each chunk; chunks are merged together, all pre-tokens at once."""
        words: list[bytes] = []
        owners: list[int] = []
        parts: dict[int, list] = {}  # of chunks that hold a special string: word numbers and ids, in order
        for i, chunk in enumerate(chunks):
            if "<" in chunk and self._special.search(chunk):
                parts[i] = order = []
                for piece in self._special.split(chunk):
                    if piece in self.special:
                        order.append(("id", self.special[piece]))
                    elif piece:
                        for w in self.words(piece):
                            order.append(("word", len(words)))
                            owners.append(-1)
                            words.append(w)
                continue
            for w in self.words(chunk):
                owners.append(i)
                words.append(w)
        ids, lengths = self.merge(words)
        ends = np.cumsum(lengths)
        starts = ends - lengths
        out: list = [None] * len(chunks)
        empty = np.zeros(0, np.int32)
        owner = np.array(owners, np.int64)
        plain = np.flatnonzero(owner >= 0)
        if plain.size:
            first = plain[np.flatnonzero(np.diff(owner[plain], prepend=-1))]
            last = plain[np.flatnonzero(np.diff(owner[plain], append=-1))]
            for i, a, b in zip(owner[first].tolist(), starts[first].tolist(), ends[last].tolist()):
                out[i] = ids[a:b]
        for i, order in parts.items():
            out[i] = np.concatenate([[x] if kind == "id" else ids[starts[x]:ends[x]] for kind, x in order]).astype(np.int32)
        return [empty if x is None else x for x in out]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All surviving symbols of all words and their number a word.

        Words are ragged rows of one symbol array. In every round each row merges all places of its
        lowest-ranked pair, left to right; rows without a ranked pair are done and leave the array.
        """
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        if not len(raw):
            return np.zeros(0, np.int32), lengths
        symbols = self._inner[raw]
        ends = np.cumsum(lengths)
        filled = lengths > 0
        symbols[ends[filled] - 1] = self._last[raw[ends[filled] - 1]]
        counts = np.zeros(len(words), np.int64)
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows, size = np.flatnonzero(filled), lengths[filled]
        rank = self._ranks(symbols, size)
        while len(rows):
            start = np.cumsum(size) - size
            least = np.minimum.reduceat(rank, start)
            open_ = least < NONE
            if not open_.all():
                keep = np.repeat(open_, size)
                done.append((rows[~open_], size[~open_], symbols[~keep]))
                rows, size, least = rows[open_], size[open_], least[open_]
                symbols, rank = symbols[keep], rank[keep]
                if not len(rows):
                    break
            hit = np.flatnonzero(rank == np.repeat(least, size))
            # Of touching places (a symbol paired with itself) every second one merges.
            fresh = np.diff(hit, prepend=-2) != 1
            place = np.arange(len(hit))
            hit = hit[(place - np.maximum.accumulate(np.where(fresh, place, 0))) % 2 == 0]
            symbols[hit] = self._made[rank[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            row_of = np.repeat(np.arange(len(rows)), size)
            size = size - np.bincount(row_of[hit], minlength=len(rows))
            changed = np.zeros(len(symbols), bool)
            changed[hit] = True
            symbols, rank, changed = symbols[keep], rank[keep], changed[keep]
            changed[:-1] |= changed[1:]
            self._ranks(symbols, size, rank, changed)
        order = np.concatenate([r for r, _, _ in done])
        sizes = np.concatenate([s for _, s, _ in done])
        flat = np.concatenate([x for _, _, x in done])
        counts[order] = sizes
        out = np.empty(len(flat), np.int32)
        target = (np.cumsum(counts) - counts)[order]
        out[np.repeat(target - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(flat))] = flat
        return out, counts

    def _ranks(self, symbols, size, rank=None, changed=None):
        """Rank of the pair that starts at each symbol; the last symbol of a row has none."""
        if rank is None:
            rank = np.full(len(symbols), NONE, np.int32)
            changed = np.ones(len(symbols), bool)
        ends = np.cumsum(size) - 1
        last = np.zeros(len(symbols), bool)
        last[ends] = True
        rank[changed & last] = NONE
        at = np.flatnonzero(changed & ~last)
        key = symbols[at].astype(np.uint64) << np.uint64(32) | symbols[at + 1].astype(np.uint64)
        slot = np.minimum(np.searchsorted(self._key, key), len(self._key) - 1)
        rank[at] = np.where(self._key[slot] == key, self._rank[slot], NONE)
        return rank


def chunked(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(chunks at every place, first place of each text and the end) of a batch.

    Texts are cut and compared in Arrow's buffers. An empty chunk, as before leading white space, has
    no symbols.
    """
    wide = pc.any(pc.match_substring_regex(texts, pattern=WIDE_SPACES)).as_py()
    lists = pc.split_pattern_regex(texts, pattern=ARROW_SPACES) if wide else pc.ascii_split_whitespace(texts)
    offsets = lists.offsets.to_numpy()
    return lists.flatten().dictionary_encode(), offsets - offsets[0]


def strings(names: pa.Array) -> list[str]:
    """Chunks as Python strings: one string cut by Python is several times quicker than as many taken one by one."""
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names), "\n")[0].as_py()
    return whole.split("\n") if len(names) else []


def split(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct chunks, their number at every place, first place of each text and the end) of a batch."""
    found, starts = chunked(texts)
    return strings(found.dictionary), found.indices.to_numpy(), starts


def unified(parts: list[pa.DictionaryArray]) -> tuple[pa.Array, list[np.ndarray]]:
    """Distinct strings of all parts, and their numbers at the places of each part."""
    whole = pa.chunked_array(parts).unify_dictionaries()
    return whole.chunk(0).dictionary, [part.indices.to_numpy() for part in whole.chunks]


def gathered(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs ``flat[first:first + size]`` one after the other."""
    ends = np.cumsum(size)
    return flat[np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


class Held:
    """Symbols of keys met before, all in one array; when more than ``limit`` keys are held, the half
    used last stays. What one call asks for is held whatever the limit."""

    def __init__(self, limit: int, make):
        self._limit, self._make, self._now, self._filled = max(2, limit), make, 0, 0
        self._row: dict[str, int] = {}
        self.ids, self.first, self.size, self._used = (np.zeros(1, t) for t in (np.int32, np.int64, np.int64, np.int64))

    def rows(self, keys: list[str]) -> np.ndarray:
        """Row of each key in ``first`` and ``size``; valid until the next call. ``make`` gives (symbols, sizes) of new keys."""
        self._now += 1
        if len(self._row) > self._limit:
            self._forget()
        # One look-up a key: in a large dictionary each is a walk through memory.
        rows = np.fromiter(map(self._row.get, keys, repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            start = len(self._row)
            wanted = [keys[i] for i in missing.tolist()]
            new = dict.fromkeys(wanted)
            flat, size = self._make(list(new))
            new = dict(zip(new, range(start, start + len(new))))
            self._row.update(new)
            rows[missing] = np.fromiter(map(new.__getitem__, wanted), np.int64, len(wanted))
            self.ids = _room(self.ids, self._filled, flat)
            self.first = _room(self.first, start, self._filled + np.cumsum(size) - size)
            self.size = _room(self.size, start, size)
            self._used = _room(self._used, start, np.zeros(len(new), np.int64))
            self._filled += len(flat)
        self._used[rows] = self._now
        return rows

    def _forget(self) -> None:
        keep = np.sort(np.argsort(-self._used[: len(self._row)], kind="stable")[: self._limit // 2])
        at = np.full(len(self._row), -1, np.int64)
        at[keep] = np.arange(len(keep))
        self._row = {w: n for w, n in zip(self._row, at.tolist()) if n >= 0}
        self.ids = gathered(self.ids, self.first[keep], self.size[keep])
        self.size, self._used = self.size[keep], self._used[keep]
        self.first, self._filled = np.cumsum(self.size) - self.size, len(self.ids)


class ChunkCache:
    """Symbols of chunks and of pre-tokens met before in this worker process, at most ``limit`` of each.

    A new chunk is cut into pre-tokens, all new ones in one pass, and only new pre-tokens are merged.
    """

    def __init__(self, vocabulary: Vocabulary, limit: int):
        self._vocabulary = vocabulary
        self._chunks = Held(limit, self._cut)
        self._words = Held(limit, lambda words: vocabulary.merge([w.encode() for w in words]))

    def encode(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbols, first, size): one array of symbols, and where those of each chunk lie."""
        rows, held = self._chunks.rows(chunks), self._chunks
        return held.ids, held.first[rows], held.size[rows]

    def _cut(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words, odd = cut_chunks(self._vocabulary, chunks)
        rows, held = self._words.rows(words), self._words
        between = np.fromiter(map("\n".__eq__, words), bool, len(words))
        return laid(held.ids, held.first[rows], held.size[rows], between, odd)


class Odd(NamedTuple):
    """Chunks that are encoded by themselves: their numbers, symbols one after the other, and sizes."""

    chunks: list[int]
    ids: np.ndarray
    size: np.ndarray


def cut_chunks(vocabulary: Vocabulary, chunks: list[str]) -> tuple[list[str], Odd]:
    """Pre-tokens of all chunks with a line break between chunks; special strings and letters beyond Latin apart."""
    lower, odd = vocabulary.lowered("\n".join(chunks)), []
    if "<" in lower or vocabulary.beyond_latin(lower):
        odd = [i for i, c in enumerate(chunks) if "<" in c or vocabulary.beyond_latin(vocabulary.lowered(c))]
        plain = list(chunks)
        for i in odd:
            plain[i] = ""
        lower = vocabulary.lowered("\n".join(plain))
    found = vocabulary.encode([chunks[i] for i in odd]) if odd else []
    flat = np.concatenate([np.zeros(0, np.int32), *found])
    return vocabulary.cut(lower), Odd(odd, flat, np.fromiter(map(len, found), np.int64, len(found)))


def laid(ids: np.ndarray, first: np.ndarray, size: np.ndarray, between: np.ndarray, odd: Odd) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, sizes) of chunks whose pre-tokens lie at ``first`` and ``size``; ``between`` marks the line breaks."""
    each = np.where(between, 0, size)
    flat = gathered(ids, first, each)
    ends, breaks = np.concatenate([[0], np.cumsum(each)]), np.flatnonzero(between)
    total = np.diff(np.concatenate([[0], ends[breaks], ends[-1:]]))
    if not odd.chunks:
        return flat, total
    start = np.cumsum(total) - total
    total[odd.chunks] = odd.size
    start[odd.chunks] = len(flat) + np.cumsum(odd.size) - odd.size
    return gathered(np.concatenate([flat, odd.ids]), start, total), total


def encode_once(vocabulary: Vocabulary, chunks: pa.Array, piece: int = 200_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, first, size) of distinct chunks; each distinct pre-token among them is merged once.

    At most ``piece`` chunks are Python strings at a time.
    """
    cuts, odds = [], []
    for at in range(0, len(chunks), piece):
        words, odd = cut_chunks(vocabulary, strings(chunks.slice(at, piece)))
        cuts.append(pa.array(words, pa.string()).dictionary_encode())
        odds.append(odd)
    if not cuts:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    names, places = unified(cuts)
    line = pc.index(names, "\n").as_py()
    merged = [vocabulary.merge([w.encode() for w in names.slice(at, piece // 2).to_pylist()]) for at in range(0, len(names), piece // 2)]
    ids = np.concatenate([np.zeros(0, np.int32), *(x for x, _ in merged)])
    size = np.concatenate([np.zeros(0, np.int64), *(n for _, n in merged)])
    first = np.cumsum(size) - size
    done = [laid(ids, first[rows], size[rows], rows == line, odd) for rows, odd in zip(places, odds)]
    sizes = np.concatenate([n for _, n in done])
    return np.concatenate([x for x, _ in done]), np.cumsum(sizes) - sizes, sizes


def encoded(slices: Iterable[tuple[pa.Array, pa.Array]], vocabulary: Vocabulary, chars: int) -> Iterator[tuple]:
    """(row ids, chunk numbers at every place, first places, symbols of the chunks as in ``encode_once``) of each slice.

    Slices of about ``chars`` bytes of text are taken together, so that a chunk they share is encoded once;
    of their texts only the chunks' numbers and the distinct chunks are held.
    """
    held, total = [], 0

    def group():
        names, places = unified([found for _, found, _ in held])
        symbols = encode_once(vocabulary, names)
        for (row_ids, _, starts), place in zip(held, places):
            yield row_ids, place, starts, symbols

    for row_ids, texts in slices:
        held.append((row_ids, *chunked(texts)))
        total += pc.sum(pc.binary_length(texts)).as_py() or 0
        if total >= chars:
            yield from group()
            held, total = [], 0
    if held:
        yield from group()


def _room(held: np.ndarray, filled: int, more: np.ndarray) -> np.ndarray:
    """``held`` with ``more`` from place ``filled`` on; it grows by doubling."""
    if filled + len(more) > len(held):
        grown = np.zeros(2 * (filled + len(more)), held.dtype)
        grown[:filled] = held[:filled]
        held = grown
    held[filled:filled + len(more)] = more
    return held


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary at ``path``, read once a worker process."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


