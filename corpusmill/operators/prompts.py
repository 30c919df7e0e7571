"""Request planning, diversity samples and prompt texts as DataFrames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import format_mapping
from .checks import Check, describe

#: The names a user template may hold.
TEMPLATE_NAMES = ("rule_id", "batch_size", "goal", "positive_examples", "negative_examples", "checks", "diversity", "output_contract")
_SLOT = "\x00diversity\x00"


def plan_size(remaining: int, batch_size: int, prompts_per_cycle: int, concurrency: int, requests_left: int) -> int:
    """Requests of the next cycle."""
    return max(0, min(prompts_per_cycle, concurrency, max(1, math.ceil(remaining / max(1, batch_size))), requests_left))


def planned(remaining: Column, batch_size: Column, prompts_per_cycle: int, concurrency: int, requests_left: Column) -> Column:
    """The same as a Column, for many rules at once."""
    batches = F.greatest(F.lit(1), F.ceil(remaining / F.greatest(F.lit(1), batch_size)))
    return F.greatest(F.lit(0), F.least(F.lit(prompts_per_cycle), F.lit(concurrency), batches, requests_left)).cast("int")


def plan_requests(spark: SparkSession, rule_id: str, start: int, count: int) -> DataFrame:
    """(rule_id, request_index) of ``count`` requests after ``start``."""
    return spark.range(start + 1, start + count + 1).select(F.lit(rule_id).alias("rule_id"), F.col("id").cast("int").alias("request_index"))


def seeded_order(seed: int, *keys: Column) -> Column:
    """A value to sort by that is the same in every run and every engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(k.cast("string") for k in keys)))


def sample_diversity(requests: DataFrame, dimensions: list[tuple[str, list[str], int]], seed: int = 42) -> DataFrame:
    """(rule_id, request_index, diversity array<struct<key, values>>): of each dimension k values without replacement.

    ``dimensions`` is a profile: (dimension, values, k) in declared order; those with k <= 0 or no values are left out.
    Values are sorted within the row by a seeded hash, so nothing is shuffled.
    """
    entries = []
    for name, values, k in dimensions:
        k = min(int(k), len(values))
        if k > 0:
            order = lambda i, v, n=name: F.struct(seeded_order(seed, F.col("rule_id"), F.col("request_index"), F.lit(n), F.lit(i), F.lit(v)).alias("o"), F.lit(i).alias("i"), F.lit(v).alias("v"))
            ranked = F.slice(F.array_sort(F.array(*(order(i, v) for i, v in enumerate(values)))), 1, k)
            entries.append(F.struct(F.lit(name).alias("key"), F.transform(ranked, lambda x: x["v"]).alias("values")))
    diversity = F.array(*entries) if entries else F.array().cast("array<struct<key:string,values:array<string>>>")
    return requests.select("rule_id", "request_index", diversity.alias("diversity"))


def render_user_prompt(template: str, rule_id: str, goal: str, batch_size: int, positive: list[str], negative: list[str], checks: list[Check], output_contract: str, diversity: Column) -> Column:
    """str.format with the template names; an unknown name is a KeyError. The part of the rule is rendered once, the diversity per row."""
    as_list = lambda items: "\n".join(f"- {x}" for x in items) or "- none"
    names = {
        "rule_id": rule_id, "batch_size": batch_size, "goal": goal, "positive_examples": as_list(positive), "negative_examples": as_list(negative),
        "checks": as_list(describe(checks)), "diversity": _SLOT, "output_contract": output_contract.strip(),
    }
    parts = template.format(**names).strip().split(_SLOT)
    out: list[Column] = []
    for i, part in enumerate(parts):
        if i:
            out.append(format_mapping(diversity))
        out.append(F.lit(part))
    return F.concat(*out)
