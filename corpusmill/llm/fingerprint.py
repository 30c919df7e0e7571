"""Min-hash block fingerprints of texts, computed for whole Arrow batches with numpy.

A fingerprint is ``blocks`` words of 64 bits. Each word holds 8 bytes, each the low byte of the smallest hash in one
bin of a one-permutation min-hash over the text's character trigrams, so two texts of Jaccard value J have an equal
byte with probability about J and an equal word with J**8. With 40 words, texts at J = 0.75 / 0.80 / 0.85 share a word
with probability 0.985 / 0.9994 / 0.99998.
"""

from __future__ import annotations

import numpy as np

from ..functions.normal_text import gram_codes, normal

BLOCKS = 40
BINS = 64
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = 0x9E3779B97F4A7C15


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def text_node(texts: list[str]) -> np.ndarray:
    """64-bit identity of each normalized text as a signed integer, never negative."""
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) >> 1 for t in texts], np.int64)


def normal_or_none(text: str | None, least_chars: int) -> str | None:
    if text is None:
        return None
    out = normal(text)
    return out if len(out) >= least_chars else None


def blocks(texts: list[str], count: int = BLOCKS) -> np.ndarray:
    """(texts, count) words. Every text must have a trigram."""
    n, rounds = len(texts), -(-count * 8 // BINS)
    codes, whose = gram_codes(texts)
    base = mix(codes)
    out = np.empty((n, rounds * BINS), np.uint8)
    slot = (whose * BINS).astype(np.int64)
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    for r in range(rounds):
        h = mix(base + np.uint64((_STEP * (r + 1)) & 0xFFFFFFFFFFFFFFFF))
        least = np.full(n * BINS, empty)
        np.minimum.at(least, slot + (h >> np.uint64(58)).astype(np.int64), h)
        least = least.reshape(n, BINS)
        for _ in range(BINS):
            gap = least == empty
            if not gap.any():
                break
            least = np.where(gap, np.roll(least, -1, axis=1), least)
        out[:, r * BINS : (r + 1) * BINS] = (least & np.uint64(0xFF)).astype(np.uint8)
    return np.ascontiguousarray(out[:, : count * 8]).view(np.uint64)


def keys(words: np.ndarray) -> np.ndarray:
    """Key of each word in its own rotated table: the word mixed with the table's number."""
    return mix(words ^ mix(np.arange(1, words.shape[1] + 1, dtype=np.uint64) * np.uint64(_STEP)))


def sketch(words: np.ndarray, longs: int = 2) -> np.ndarray:
    """The lowest bit of evenly spread bytes: 64 * longs bits, of which texts at J differ in about (1 - J) / 2."""
    low = words.view(np.uint8)
    picked = low[:, np.linspace(0, low.shape[1] - 1, 64 * longs).astype(int)] & 1
    return np.ascontiguousarray(np.packbits(picked, axis=1)).view(np.int64).reshape(len(words), longs)


def most_differing(bits: int, threshold: float, sigmas: float = 4.5) -> int:
    """Bits that two texts at the threshold differ in, with that many standard deviations of room."""
    p = (1 - threshold) / 2
    return int(bits * p + sigmas * (bits * p * (1 - p)) ** 0.5)
