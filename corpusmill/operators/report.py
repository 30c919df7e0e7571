"""The report: counters, totals, samples and statuses as aggregates over verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts_by_reason(verdicts: DataFrame, reason: str = "reason", rule: str = "rule_id") -> DataFrame:
    """(rule, reason, n) of rejected rows (null reason: accepted, left out)."""
    return verdicts.where(F.col(reason).isNotNull()).groupBy(rule, reason).agg(F.count("*").alias("n"))


def reasons_map(counts: DataFrame, reason: str = "reason", rule: str = "rule_id") -> DataFrame:
    """(rule, rejected map): the counters as one map per rule; there are as many entries as reasons."""
    return counts.groupBy(rule).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(reason, "n")))).alias("rejected"))


def accepted_and_remaining(verdicts: DataFrame, rules: DataFrame, accepted: Column, rule: str = "rule_id") -> DataFrame:
    """(rule, target, accepted, remaining) of every rule, also of those without rows."""
    got = verdicts.groupBy(rule).agg(F.sum(accepted.cast("long")).alias("accepted"))
    out = F.broadcast(rules.select(rule, "target")).join(got, rule, "left").withColumn("accepted", F.coalesce("accepted", F.lit(0)).cast("long"))
    return out.select(rule, "target", "accepted", F.greatest(F.col("target") - F.col("accepted"), F.lit(0)).cast("long").alias("remaining"))


def totals(per_rule: DataFrame) -> DataFrame:
    """One row: target, accepted and remaining over all rules."""
    return per_rule.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("target", "accepted", "remaining")))


def first_samples(rows: DataFrame, limit: int, order: str | list[str] = "seq", rule: str = "rule_id") -> DataFrame:
    """The first ``limit`` rows of each rule in order, with their rank ``n``; limited per task before the shuffle."""
    order = [order] if isinstance(order, str) else order
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(rule).orderBy(*order))).where(F.col("n") <= limit)


def parsed_candidates(replies: DataFrame, items: str = "items", rule: str = "rule_id") -> DataFrame:
    """(rule, api_requests, parsed_candidates, parse_errors)."""
    size = F.when(F.col(items).isNotNull(), F.size(items)).otherwise(0)
    return replies.groupBy(rule).agg(F.count("*").alias("api_requests"), F.sum(size).alias("parsed_candidates"), F.sum(F.col(items).isNull().cast("long")).alias("parse_errors"))


def error_counts(replies: DataFrame, items: str = "items", rule: str = "rule_id") -> DataFrame:
    """(rule, error, n): api_error for replies without a text, parse_error for those whose text gives no items."""
    kind = F.when(F.col("raw_text").isNull(), "api_error").when(F.col(items).isNull(), "parse_error")
    return replies.select(rule, kind.alias("error")).where("error IS NOT NULL").groupBy(rule, "error").agg(F.count("*").alias("n"))


def rule_status(accepted: Column, target: Column, requests: Column, max_requests: int, empty_cycles: Column, max_empty: int) -> Column:
    return F.when(accepted >= target, "done").when(requests >= max_requests, "request_limit_reached").when(empty_cycles >= max_empty, "empty_cycle_limit_reached").when(requests > 0, "running").otherwise("pending")


def run_status(statuses: list[str], failed: bool = False) -> str:
    if failed:
        return "failed"
    return "done" if all(s == "done" for s in statuses) else "finished_with_incomplete_rules"
