"""Column forms of the text functions. Every expression is built-in, so it stays inside whole-stage code generation.

White space is the set of 29 code points that Python's ``str`` methods and ``re`` take as such; Java's and DuckDB's own
classes are narrower, so the set is always spelled out.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space, its complement, and the line ends of str.splitlines().
_WS_BODY = r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS, NOT_WS = f"[{_WS_BODY}]", f"[^{_WS_BODY}]"
WS_CHARS = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
LINE_END = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x85\x{2028}\x{2029}]"
WORD_LEFT, WORD_RIGHT = r"(?:^|[^\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|$)"


def strip(text: Column, chars: str = WS_CHARS) -> Column:
    return F.btrim(text, F.lit(chars))


def collapse_spaces(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.btrim(F.regexp_replace(text, f"{WS}+", " "))


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"{NOT_WS}+"))


def count_cyrillic(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[ЁёА-Яа-я]"))


def count_latin(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[A-Za-z]"))


def contains_digit(text: Column) -> Column:
    return text.rlike(r"\p{Nd}")


def occurrences(text: Column, part: str) -> Column:
    """Non-overlapping occurrences of a literal; an empty literal counts length + 1 like str.count."""
    if not part:
        return F.char_length(text) + 1
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).cast("int")


def strip_fragments(text: Column, fragments: list[str], case_sensitive: bool = True) -> Column:
    """Replace the fragments, the longest first, by a space; then collapse."""
    for part in sorted((f for f in fragments if f), key=len, reverse=True):
        if case_sensitive:
            text = F.replace(text, F.lit(part), F.lit(" "))
        else:
            text = F.regexp_replace(text, "(?iu)" + literal_pattern(part), " ")
    return collapse_spaces(text)


def literal_pattern(part: str) -> str:
    return re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", part)


def split_lines(text: Column) -> Column:
    return F.split(text, LINE_END)


def format_list(items: Column) -> Column:
    """``- item`` lines; an empty or null list reads ``- none``."""
    return F.when(F.coalesce(F.size(items), F.lit(0)) < 1, "- none").otherwise(F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n"))


def format_mapping(entries: Column) -> Column:
    """``- key: v1, v2`` lines of an array<struct<key, values>> in its order; ``none`` for empty values, ``- none`` for no entries."""
    line = lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), F.when(F.size(e["values"]) < 1, "none").otherwise(F.array_join(e["values"], ", ")))
    return F.when(F.coalesce(F.size(entries), F.lit(0)) < 1, "- none").otherwise(F.array_join(F.transform(entries, line), "\n"))


#: Constructs whose meaning isn't carried over to Java's engine; such patterns run in Python.
_FOREIGN = re.compile(r"\(\?P|\(\?\(|\\Z|\\A|\\N|\(\?[aLmsx]|\\[1-9]|&&|\[\[|\\h|\\R|\\Q|\\E|\\p|\\P|\\G|\\X|\\k|\\z|[*+?}]\+")
_CLASSES = {"s": _WS_BODY, "d": r"\p{Nd}", "w": r"\p{L}\p{N}_"}
_EDGE = r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))"
_NO_EDGE = r"(?:(?<=[\p{L}\p{N}_])(?=[\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?![\p{L}\p{N}_]))"


def java_pattern(pattern: str, ignore_case: bool = False) -> str | None:
    """The pattern for Java's engine with Python's Unicode classes, or None where it has to run in Python."""
    re.compile(pattern)
    if _FOREIGN.search(pattern):
        return None
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            n = pattern[i + 1]
            if n.lower() in _CLASSES and not (inside and n.isupper()):
                out.append(_CLASSES[n] if inside else f"[{'^' if n.isupper() else ''}{_CLASSES[n.lower()]}]")
            elif n.lower() in _CLASSES:
                return None
            elif n == "b" and not inside:
                out.append(_EDGE)
            elif n == "B" and not inside:
                out.append(_NO_EDGE)
            elif n == "u":
                out.append(f"\\x{{{pattern[i + 2 : i + 6]}}}")
                i += 4
            else:
                out.append(c + n)
            i += 2
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "]" and inside and pattern[i - 1] not in "[^":
            inside = False
        elif c == "$" and not inside:
            c = r"(?=\n?\z)"
        out.append(c)
        i += 1
    return ("(?iu)" if ignore_case else "") + "".join(out)
