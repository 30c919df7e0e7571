"""Digits as Russian words, as Columns. Words are looked up in constant arrays; no table is joined."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Number words, and the words of repeated digits.
UNITS = ["ноль", "один", "два", "три", "четыре", "пять", "шесть", "семь", "восемь", "девять"]
TEENS = ["десять", "одиннадцать", "двенадцать", "тринадцать", "четырнадцать", "пятнадцать", "шестнадцать", "семнадцать", "восемнадцать", "девятнадцать"]
TENS = ["", "", "двадцать", "тридцать", "сорок", "пятьдесят", "шестьдесят", "семьдесят", "восемьдесят", "девяносто"]
HUNDREDS = ["", "сто", "двести", "триста", "четыреста", "пятьсот", "шестьсот", "семьсот", "восемьсот", "девятьсот"]
REPEATED = ["нуля", "единицы", "двойки", "тройки", "четверки", "пятерки", "шестерки", "семерки", "восьмерки", "девятки"]
TIMES = {2: "две", 3: "три"}


def words_of(value: int) -> str:
    """0 to 999 in words."""
    if not 0 <= value <= 999:
        raise ValueError(f"not within 0..999: {value}")
    tail = value % 100
    parts = [HUNDREDS[value // 100], TEENS[tail - 10] if 10 <= tail < 20 else TENS[tail // 10], "" if 10 <= tail < 20 or not tail % 10 else UNITS[tail % 10]]
    return " ".join(p for p in parts if p) or UNITS[0]


def readings(digits: str) -> list[str]:
    """The ways to read a block of one to three digits, none of which drops a leading zero."""
    rest = digits.lstrip("0")
    zeros = len(digits) - len(rest)
    if not zeros:
        return [words_of(int(digits))]
    value, single = ([words_of(int(rest))] if rest else []), [UNITS[0]] * zeros
    out = [" ".join(single + value)]
    if zeros in TIMES:
        out.append(" ".join([TIMES[zeros], REPEATED[0], *value]))
    if rest:
        out.append(" ".join(single + [UNITS[int(d)] for d in rest]))
    return out


def _table(values: list, kind: str) -> Column:
    """A constant array; Spark folds it once, so a row costs one access."""
    return F.from_json(F.lit(json.dumps(values, ensure_ascii=False)), f"array<{kind}>")


def _at(values: list, index: Column, kind: str = "string") -> Column:
    return F.get(_table(values, kind), index.cast("int"))


def number_to_words(value: Column) -> Column:
    """0 to 999; null otherwise."""
    return F.when((value >= 0) & (value <= 999), _at([words_of(i) for i in range(1000)], value))


def digit_words(digits: Column) -> Column:
    """Digit by digit; null where anything else is in the text."""
    each = F.transform(F.split(digits, ""), lambda d: _at(UNITS, d))
    return F.when(digits.rlike("^[0-9]+$"), F.array_join(each, " ")).when(digits == "", "")


def repeat_words(digits: Column) -> Column:
    """'три нуля' for two or three equal digits, else null."""
    equal = digits.rlike(r"^([0-9])\1{1,2}$")
    return F.when(equal, F.concat_ws(" ", F.when(F.char_length(digits) == 2, TIMES[2]).otherwise(TIMES[3]), _at(REPEATED, F.substring(digits, 1, 1))))


def drawn(*keys: Column) -> Column:
    """A number from 0 to 2**32 - 1 by the keys, the same in every run and every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(k.cast("string") for k in keys))), 1, 8), 16, 10).cast("long")


def pick(options: Column, *keys: Column) -> Column:
    """One element, drawn by the keys."""
    return F.get(options, F.pmod(drawn(*keys), F.size(options).cast("long")).cast("int"))


def fixed_width_words(digits: Column, *keys: Column) -> Column:
    """A block of one to three digits; leading zeros are kept. Null where anything else is in the text."""
    blocks = [str(i).zfill(w) for w in (1, 2, 3) for i in range(10**w)]
    first = F.when(F.char_length(digits) == 1, 0).when(F.char_length(digits) == 2, 10).otherwise(110)
    own = _at([readings(b) for b in blocks], digits.cast("int") + first, "array<string>")
    return F.when(digits.rlike("^[0-9]{1,3}$"), pick(own, digits, *keys))


def compact_words(digits: Column, *keys: Column) -> Column:
    return F.replace(fixed_width_words(digits, *keys), F.lit(" "), F.lit(""))


def replace_all(text: Column, pairs: dict[str, str]) -> Column:
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs.items(), text)
