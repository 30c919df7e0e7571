"""Replies to candidates: json_array, answer_tags, lines.

``items`` gives an array<string>, or null where the reply can't be parsed; ``explode_candidates`` numbers the
surviving items from 1. Null replies are parse errors for every parser.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

TYPES = ("json_array", "answer_tags", "lines")
#: Fixed value: characters cut from the start of a line.
BULLET_CHARS = "-*0123456789. )\t"


def json_strings(raw: str | None) -> list[str] | None:
    """Stripped non-empty strings of a JSON array; from the widest bracketed slice where the whole isn't JSON; else None."""
    if raw is None:
        return None
    try:
        value = json.loads(raw)
    except ValueError:
        begin, end = raw.find("["), raw.rfind("]")
        if begin < 0 or end <= begin:
            return None
        try:
            value = json.loads(raw[begin : end + 1])
        except (ValueError, RecursionError):
            return None
    except RecursionError:
        return None
    if not isinstance(value, list):
        return None
    return [s for s in (x.strip() for x in value if isinstance(x, str)) if s]


def _json_items(raw: Column) -> Column:
    # strict JSON with a fallback has no built-in equivalent: from_json accepts trailing text and coerces numbers
    return F.udf(json_strings, T.ArrayType(T.StringType()), useArrow=True)(raw)


def _tag_items(raw: Column) -> Column:
    found = F.regexp_extract_all(raw, F.lit(rf"(?isu)<answer>{X.WS}*(.*?){X.WS}*</answer>"), F.lit(1))
    return F.filter(F.transform(found, lambda x: F.btrim(X.collapse_spaces(x), F.lit("\"'"))), lambda x: x != "")


def _line_items(raw: Column) -> Column:
    clean = lambda x: X.strip(F.ltrim(X.strip(x), F.lit(BULLET_CHARS)))
    return F.filter(F.transform(X.split_lines(raw), clean), lambda x: x != "")


def items(parser: str, raw: Column) -> Column:
    if parser not in TYPES:
        raise ValueError(f"unknown parser: {parser}")
    return {"json_array": _json_items, "answer_tags": _tag_items, "lines": _line_items}[parser](raw)


def items_by(parser: Column, raw: Column) -> Column:
    """Each row by the parser it names; a row without a known parser is a parse error."""
    return F.when(parser == "lines", _line_items(raw)).when(parser == "answer_tags", _tag_items(raw)).when(parser == "json_array", _json_items(raw))


def explode_candidates(replies: DataFrame, items_col: str = "items") -> DataFrame:
    """All other columns, candidate_index (1-based) and text; replies without items have no row."""
    rest = [c for c in replies.columns if c != items_col]
    # an inner explode would bring in a filter on the items below it, which evaluates the parser once more for each reply
    found = replies.select(*rest, F.posexplode_outer(items_col).alias("candidate_index", "text")).where("candidate_index IS NOT NULL")
    return found.withColumn("candidate_index", F.coalesce("candidate_index", F.lit(0)) + 1)
