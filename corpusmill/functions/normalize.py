"""Column forms of normalization, prefix keys and the character n-gram measure (plain Python: normal_text.py)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .normal_text import EDGE_CHARS
from .text import NOT_WS, WS, WS_CHARS

#: The characters of WS for Java: one look-up up to U+00FF and one comparison for letters above, instead of one for each range.
_WS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WS_CHARS if c < "\u0100") + "[\\x{1680}-\\x{3000}&&[" + "".join(f"\\x{{{ord(c):x}}}" for c in WS_CHARS if c > "\u0100") + "]]]"


def normalize(text: Column, lowercase: bool = True, collapse: bool = True, trim_punctuation: bool = True, replace_yo: bool = True) -> Column:
    """Strip, collapse white space, fold ё, lower the case, cut edge punctuation; in this order, each step optional but the first."""
    text = F.btrim(text, F.lit(WS_CHARS))
    if collapse:
        text = F.regexp_replace(text, f"{_WS}+", " ")
    if replace_yo:
        text = F.replace(F.replace(text, F.lit("ё"), F.lit("е")), F.lit("Ё"), F.lit("Е"))
    if lowercase:
        text = F.lower(text)
    if trim_punctuation:
        text = F.btrim(text, F.lit(EDGE_CHARS))
    return text


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({NOT_WS}+)"), F.lit(1))


def prefix_key(normal: Column, count: int) -> Column:
    """The first ``count`` words of a normalized text; a negative count drops words from the end, 0 gives ''."""
    if count > 0:
        # the rest of the text is not cut into words
        first = F.regexp_extract(normal, f"{NOT_WS}+(?:{WS}+{NOT_WS}+){{0,{count - 1}}}", 0)
        return F.regexp_replace(first, f"{_WS}+", " ")
    if count == 0:
        return F.when(normal.isNotNull(), "")
    found = words(normal)
    keep = F.greatest(F.size(found) + count, F.lit(0))
    return F.array_join(F.slice(found, F.lit(1), keep), " ")


def char_ngrams(text: Column, n: int) -> Column:
    """Distinct n-character slices; a text of n characters or fewer is its own only slice, an empty one has none."""
    if n < 1:
        raise ValueError("n must be at least 1")
    text = F.btrim(F.regexp_replace(text, f"{WS}+", " "))
    # each match looks n code points ahead and consumes one
    slices = F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)))
    return F.when(text == "", F.array().cast("array<string>")).when(F.char_length(text) <= n, F.array(text)).otherwise(slices)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; two empty ones are equal."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))
