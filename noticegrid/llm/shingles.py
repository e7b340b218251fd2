"""Word shingles of whole texts as 64-bit hashes, and signatures of them."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

WORDS_HELD = 300_000


class WordHashes(dict):
    """64-bit hash of a word; forgotten when too many are held."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_HELD:
            self.clear()
        number = self[word] = xxhash.xxh3_64_intdigest(word)
        return number


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, size: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the text's ``size``-word shingles.

    Words are runs outside ASCII white space with A-Z lowered. A text of fewer words has its whole
    sequence as one shingle; one without words has none.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII alone is lowered and split
    if not words:
        return np.zeros(0, np.uint64)
    value = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    width = min(size, len(words))
    rolled = value[: len(value) - width + 1].copy()
    for j in range(1, width):
        rolled = mix(rolled * np.uint64(0x9E3779B97F4A7C15) + value[j:len(value) - width + 1 + j])
    return np.unique(rolled + np.uint64(width))


def digest(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a whole set."""
    return hashlib.blake2b(shingles.astype("<u8").tobytes(), digest_size=16).digest()


def coordinates(count: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and offsets of ``count`` hash functions."""
    state = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    return state[:count] | np.uint64(1), state[count:]


def signature(shingles: np.ndarray, functions: tuple[np.ndarray, np.ndarray], block: int = 8192) -> np.ndarray:
    """For each function the least 32-bit value over a non-empty set."""
    times, plus = functions
    least = np.full(len(times), 2**32 - 1, np.uint64)
    for at in range(0, len(shingles), block):
        part = shingles[at:at + block, None] * times[None, :] + plus[None, :]
        np.minimum(least, ((part ^ (part >> np.uint64(29))) >> np.uint64(32)).min(axis=0), out=least)
    return least.astype(np.uint32)
