"""Text normalization and the character n-gram measure, as plain Python for Arrow workers (Column forms: normalize.py)."""

from __future__ import annotations

import math

import numpy as np

#: Fixed value: characters cut from both ends of a normalized text.
EDGE_CHARS = " \t\r\n.,;:!?\"'`«»()[]{}"


def normal(text: str) -> str:
    """Collapse white space, fold ё to е, lower the case, cut edge punctuation."""
    return " ".join(text.split()).replace("ё", "е").replace("Ё", "Е").lower().strip(EDGE_CHARS)


def gram_codes(texts: list[str], n: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(code, text index) of each run of three code points in each text; 21 bits a code point, so codes are exact.

    Texts of one or two characters have one code, which no run of three has; empty ones have none.
    """
    if n != 3:
        raise ValueError("codes are packed for n = 3")
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(texts)), lengths)
    if len(points) < 3:
        codes, whose = np.empty(0, np.uint64), np.empty(0, np.int64)
    else:
        codes = (points[:-2] << np.uint64(42)) | (points[1:-1] << np.uint64(21)) | points[2:]
        inside = owner[:-2] == owner[2:]
        codes, whose = codes[inside], owner[:-2][inside]
    short = np.flatnonzero((lengths > 0) & (lengths < 3))
    if len(short):
        packed = [sum(ord(c) << (21 * i) for i, c in enumerate(texts[i])) | 1 << 63 for i in short]
        codes, whose = np.concatenate([codes, np.array(packed, np.uint64)]), np.concatenate([whose, short])
        order = np.argsort(whose, kind="stable")
        codes, whose = codes[order], whose[order]
    return codes, whose


def gram_set(text: str) -> np.ndarray:
    """Sorted distinct codes of one text (already stripped and collapsed)."""
    return np.unique(gram_codes([text])[0])


def least_overlap(size_a: int, size_b: int, threshold: float) -> int:
    """Smallest intersection of two sets of these sizes whose Jaccard value reaches the threshold."""
    return math.ceil(threshold * (size_a + size_b) / (1 + threshold) - 1e-9)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of distinct codes; two empty sets are equal."""
    if not len(a) or not len(b):
        return float(not len(a) and not len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def grams(text: str, n: int) -> set[str]:
    """Distinct n-character slices of a text whose white space is collapsed; one of n characters or fewer is its own only slice."""
    text = " ".join(text.split())
    if len(text) <= n:
        return {text} if text else set()
    return {text[i : i + n] for i in range(len(text) - n + 1)}


def similarity(a: set, b: set) -> float:
    """Jaccard value of two sets; two empty ones are equal."""
    if not a or not b:
        return float(not a and not b)
    both = len(a & b)
    return both / (len(a) + len(b) - both)
