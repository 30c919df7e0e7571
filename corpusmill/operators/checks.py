"""The acceptance checks: each is a Column with the reason of its failure, null where the text passes.

``chain`` gives the first failure in the declared order; all checks are plain expressions, so one scan evaluates the
whole chain and ``coalesce`` stops at the first reason. A null text fails no check and is reported as ``null_text``.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X


@dataclass(frozen=True)
class Check:
    """A check of a rule: its type and parameters. Unknown parameters are kept and ignored."""

    type: str
    params: dict[str, Any] = field(default_factory=dict)

    @staticmethod
    def of(entry: dict[str, Any]) -> Check:
        rest = dict(entry)
        return Check(str(rest.pop("type")), rest)


def _between(measure: Callable[[Column], Column], what: str):
    def build(p: dict[str, Any], t: Column) -> Column:
        least, most = int(p["min"]), int(p["max"])
        n = measure(t)
        return F.when(n < least, f"too_few_{what}").when(n > most, f"too_many_{what}")

    return build


def _holds(p: dict[str, Any], t: Column) -> list[Column]:
    values = [str(v) for v in p["values"]]
    if bool(p.get("case_sensitive", True)):
        return [F.contains(t, F.lit(v)) for v in values]
    return [F.contains(F.lower(t), F.lit(v.lower())) for v in values]


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def matches(t: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Whether the pattern is found anywhere; in the JVM, or in an Arrow UDF for constructs that Java reads differently."""
    java = X.java_pattern(pattern, ignore_case)
    if java is not None:
        return t.rlike(java)
    flags = re.IGNORECASE if ignore_case else 0

    @F.udf(T.BooleanType(), useArrow=True)
    def search(value):
        return None if value is None else re.search(pattern, value, flags) is not None

    return search(t)


def _russian(p: dict[str, Any], t: Column) -> Column:
    rest = X.strip_fragments(t, [str(v) for v in p.get("allow_latin_inside", [])])
    least, most = int(p.get("min_cyrillic_chars", 1)), int(p.get("max_latin_chars", 0))
    return F.when(X.count_cyrillic(rest) < least, "not_enough_cyrillic").when(X.count_latin(rest) > most, "too_much_latin")


#: Words of an echoed instruction; the last is a beginning.
ECHO_WORDS = ["json", "markdown", "output", "format", "return", "prompt", "instruction", "rule", "example", "generate", "сгенерируй", "верни", "формат"]
ECHO_BEGINNINGS = ["инструкц"]
ECHO = f"(?iu){X.WORD_LEFT}(?:{'|'.join(ECHO_WORDS)}){X.WORD_RIGHT}|{X.WORD_LEFT}(?:{'|'.join(ECHO_BEGINNINGS)})"


def _echo(p: dict[str, Any], t: Column) -> Column:
    found = _any([t.rlike(ECHO), *(matches(t, str(e), True) for e in p.get("extra_patterns", []))])
    return F.when(t.startswith("-") | t.startswith("*"), "list_item_echo").when(F.contains(t, F.lit("\n")), "multiline_echo").when(found, "instruction_echo")


_BUILD: dict[str, Callable[[dict[str, Any], Column], Column]] = {
    "word_count_between": _between(X.count_words, "words"),
    "char_count_between": _between(F.char_length, "chars"),
    "require_contains_any": lambda p, t: F.when(~_any(_holds(p, t)), "missing_required_fragment"),
    "require_contains_all": lambda p, t: F.when(~_all(_holds(p, t)), "missing_required_fragment"),
    "reject_contains_any": lambda p, t: F.when(_any(_holds(p, t)), "forbidden_fragment"),
    "require_regex_any": lambda p, t: F.when(~_any([matches(t, str(x)) for x in p["patterns"]]), "regex_required_pattern_missing"),
    "reject_regex_any": lambda p, t: F.when(_any([matches(t, str(x)) for x in p["patterns"]]), "forbidden_regex"),
    "russian_text": _russian,
    "no_digits": lambda p, t: F.when(X.contains_digit(t), "digits_present"),
    "require_digits": lambda p, t: F.when(~X.contains_digit(t), "digits_missing"),
    "no_latin": lambda p, t: F.when(X.count_latin(X.strip_fragments(t, [str(v) for v in p.get("allow_inside", [])])) > 0, "latin_present"),
    "not_instruction_echo": _echo,
}


def supported_types() -> list[str]:
    return sorted(_BUILD)


def reason(check: Check, text: Column) -> Column:
    """``type:reason`` of the failure, or null. An unknown type is a ValueError, a missing parameter a KeyError."""
    if check.type not in _BUILD:
        raise ValueError(f"unknown check type: {check.type}")
    why = _BUILD[check.type](check.params, text)
    return F.when(why.isNotNull(), F.concat(F.lit(check.type + ":"), why))


def chain(checks: list[Check], text: Column) -> Column:
    """The first failure in order; null if all pass or there are none."""
    null = F.when(text.isNull(), "null_text")
    return F.coalesce(null, *(reason(c, text) for c in checks)) if checks else null


# What each check says of itself in a prompt.
_DESCRIPTIONS: dict[str, str] = {
    "word_count_between": "word count must be between {min} and {max}",
    "char_count_between": "character count must be between {min} and {max}",
    "require_contains_any": "must contain at least one of: {values}",
    "require_contains_all": "must contain all of: {values}",
    "reject_contains_any": "must not contain any of: {values}",
    "require_regex_any": "must match at least one regex: {patterns}",
    "reject_regex_any": "must not match any regex: {patterns}",
    "russian_text": "must be Russian-context text with at least {min_cyrillic_chars} Cyrillic chars and at most {max_latin_chars} Latin chars",
    "no_digits": "must not contain decimal digits",
    "require_digits": "must contain at least one decimal digit",
    "no_latin": "must not contain Latin characters",
    "not_instruction_echo": "must not echo prompts, formatting instructions, markdown, or metadata",
}


def describe(checks: list[Check]) -> list[str]:
    out = []
    for c in checks:
        if c.type not in _DESCRIPTIONS:
            raise ValueError(f"unknown check type: {c.type}")
        values = {"min_cyrillic_chars": 1, "max_latin_chars": 0} | {k: ", ".join(map(str, v)) if isinstance(v, list) else v for k, v in c.params.items()}
        line = _DESCRIPTIONS[c.type].format_map(values)
        if c.type == "no_latin" and c.params.get("allow_inside"):
            line += " outside: " + ", ".join(map(str, c.params["allow_inside"]))
        out.append(line)
    return out
