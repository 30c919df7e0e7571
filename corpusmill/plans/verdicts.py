"""From replies to verdicts and accepted records: one lazy plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import callbacks as U
from ..operators import dedup as D
from ..operators import parsers as P
from ..operators.checks import Check, chain
from .scratch import cut

#: Candidates of one reply at most; the order of rows is request_index, then candidate_index.
PER_REPLY = 1 << 20


def with_seq(candidates: DataFrame) -> DataFrame:
    return candidates.withColumn("seq", F.col("request_index").cast("long") * PER_REPLY + F.col("candidate_index"))


def judged(candidates: DataFrame, checks: list[Check], post: list[Callable], policy: D.DedupPolicy, target: int, prior: DataFrame | None = None, already: int = 0) -> DataFrame:
    """Candidates of one rule (rule_id, request_index, candidate_index, text, callback_anchor) plus seq, stage, reason and error.

    Stages in order: check, post_validation, dedup, ok, unprocessed. Rows that fail early never reach deduplication.
    """
    rows = with_seq(candidates).withColumn("check_reason", chain(checks, F.col("text")))
    passed = F.col("check_reason").isNull()
    if post:
        rows = rows.withColumn("post", F.when(passed, U.post_validation(post, F.col("text"), F.col("callback_anchor"))))
        why, error = F.when(passed, F.col("post.reason")), F.when(passed, F.col("post.error"))
    else:
        why, error = F.lit(None).cast("string"), F.lit(None).cast("string")
    # written once, so that checks and user callbacks run once for each candidate
    rows = cut(rows.withColumn("early", F.coalesce("check_reason", why)).withColumn("error", error).drop("post"), "judged")
    late = D.dedup(rows.where("early IS NULL"), policy, prior=prior).drop("bucket")
    late = _capped(late, target - already)
    stage = F.when(F.col("verdict").isin(D.OK, D.UNPROCESSED), F.col("verdict")).otherwise("dedup")
    late = late.withColumn("stage", stage).withColumn("reason", F.when(stage == "dedup", F.concat(F.lit("dedup:"), "verdict"))).drop("verdict")
    first = rows.where("early IS NOT NULL").withColumn("stage", F.when(F.col("check_reason").isNotNull(), "check").otherwise("post_validation")).withColumn("reason", F.col("early"))
    out = late.unionByName(first).drop("check_reason", "early")
    # rows behind the one that filled the rule were never looked at
    last = out.where("stage = 'ok'").agg(F.max("seq").alias("last"), F.count("*").alias("n"))
    full = F.broadcast(last.where(F.col("n") >= max(0, target - already)).select("last"))
    behind = out.join(full, out["seq"] > F.coalesce(full["last"], F.lit(-1)), "left")
    return behind.withColumn("stage", F.when(F.col("last").isNotNull(), "unprocessed").otherwise(F.col("stage"))).withColumn("reason", F.when(F.col("last").isNull(), F.col("reason"))).drop("last")


def _capped(rows: DataFrame, room: int) -> DataFrame:
    """At most ``room`` accepted rows, by seq: a top-k that is limited per task."""
    if room <= 0:
        return rows.withColumn("verdict", F.lit(D.UNPROCESSED))
    kept = rows.where(F.col("verdict") == D.OK).select("seq").orderBy("seq").limit(room)
    last = F.broadcast(kept.agg(F.max("seq").alias("last"), F.count("*").alias("k")).where(F.col("k") >= room).select("last"))
    out = rows.join(last, rows["seq"] > last["last"], "left")
    return out.withColumn("verdict", F.when(F.col("last").isNotNull(), D.UNPROCESSED).otherwise(F.col("verdict"))).drop("last")


def parsed(replies: DataFrame, parser: str) -> DataFrame:
    """Replies with their items; null items are parse errors."""
    return replies.withColumn("items", P.items(parser, F.col("raw_text")))


def accepted_records(rows: DataFrame, run_name: str, model: str, parser: str, pre: list[U.CallbackSpec], post: list[U.CallbackSpec], accepted_at: float) -> DataFrame:
    """The record of each accepted row: rule_id, text, meta."""
    specs = lambda all_: F.array(*(F.struct(F.lit(s.path).alias("path"), F.lit(s.function).alias("function")) for s in all_)) if all_ else F.array().cast("array<struct<path:string,function:string>>")
    meta = F.struct(
        F.lit(run_name).alias("run_name"), F.lit("openai_compatible_api").alias("source"), F.lit(model).alias("model"), F.lit(accepted_at).cast("double").alias("accepted_at_unix"),
        F.col("request_index").cast("int").alias("request_index"), F.col("candidate_index").cast("int").alias("candidate_index"), F.lit(parser).alias("parser"),
        F.map_from_entries("diversity").alias("diversity"), "callback_anchor", F.struct(specs(pre).alias("pre_extension"), specs(post).alias("post_validation")).alias("callbacks"),
    )
    return rows.select("rule_id", "text", meta.alias("meta"))
