"""Ordered deduplication: exact repeats, prefix quota, n-gram near-duplicates of the last accepted texts, and caps.

The state is what was accepted, so verdicts depend on the order ``seq`` (a bigint, unique within a bucket). The forms
below give the sequential verdicts without walking the rows one by one:

* exact and prefix: the first row of each text is a grouped minimum; a text is allowed if it is among the first
  ``max_count`` texts of its prefix, a rank filter that Spark limits per task before its shuffle;
* near-duplicates: an exact edge list (similarity.py) tells which texts are similar to none. Their verdicts follow from
  counts; the rows of all others are contested and pass in order, compared with the accepted rows of their component;
* cap: the position of the last row that a rule may accept.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normal_text import grams, similarity
from ..functions.normalize import normalize, prefix_key
from ..plans.components import components
from ..plans.scratch import cut
from .similarity import similar_edges

EXACT, PREFIX, NEAR, OK, UNPROCESSED = "duplicate_exact", "prefix_overuse", "ngram_near_duplicate", "ok", "unprocessed"


@dataclass(frozen=True)
class DedupPolicy:
    name: str = "smart_text"
    scope: str = "rule"
    exact: bool = True
    normalization: dict[str, bool] = field(default_factory=dict)
    prefix_enabled: bool = True
    prefix_words: int = 4
    prefix_max: int = 8
    ngram_enabled: bool = True
    ngram: int = 3
    threshold: float = 0.88
    max_compare: int = 1000

    @staticmethod
    def of(name: str, entry: dict[str, Any] | None) -> DedupPolicy:
        entry = entry or {}
        form, quota, near = entry.get("normalization") or {}, entry.get("prefix_limit") or {}, entry.get("ngram_similarity") or {}
        keys = {"lowercase": "lowercase", "collapse_spaces": "collapse", "trim_punctuation": "trim_punctuation", "replace_yo": "replace_yo"}
        return DedupPolicy(
            name, str(entry.get("scope", "rule")), bool(entry.get("exact", True)), {keys[k]: bool(v) for k, v in form.items() if k in keys},
            bool(quota.get("enabled", True)), int(quota.get("words", 4)), int(quota.get("max_count", 8)),
            bool(near.get("enabled", True)), int(near.get("ngram", 3)), float(near.get("threshold", 0.88)), int(near.get("max_compare", 1000)),
        )

    def bucket(self, rule: Column) -> Column:
        return F.lit(self.name) if self.scope == "global" else F.concat(rule, F.lit(":" + self.name))

    def norm(self, text: Column) -> Column:
        return normalize(text, **self.normalization)


def prepare(df: DataFrame, policy: DedupPolicy, text: str = "text", rule: str = "rule_id") -> DataFrame:
    """Adds bucket, norm and prefix. A null text counts as an empty one."""
    norm = policy.norm(F.coalesce(F.col(text), F.lit("")))
    return df.withColumn("bucket", policy.bucket(F.coalesce(F.col(rule), F.lit("")))).withColumn("norm", norm).withColumn("prefix", prefix_key(F.col("norm"), policy.prefix_words))


def _exact_and_prefix(rows: DataFrame, policy: DedupPolicy, old: DataFrame | None) -> DataFrame:
    """Verdicts without n-grams; ``old`` has (bucket, norm, prefix) of the rows that were accepted before."""

    def ranked(df: DataFrame, prefix: str, order: str) -> DataFrame:
        """The rows whose prefix has room for them: those accepted before, then by rank."""
        out = df.withColumn("r", F.row_number().over(Window.partitionBy("bucket", prefix).orderBy(order))).where(F.col("r") <= policy.prefix_max)
        if old is None:
            return out
        used = old.groupBy("bucket", F.col("prefix").alias(prefix)).agg(F.count("*").alias("used"))
        return out.join(used, ["bucket", prefix], "left").where(F.col("r") + F.coalesce("used", F.lit(0)) <= policy.prefix_max)

    if not policy.exact:
        if not policy.prefix_enabled:
            return rows.withColumn("verdict", F.lit(OK))
        kept = ranked(rows.select("bucket", "seq", "prefix"), "prefix", "seq").select("bucket", "seq", F.lit(OK).alias("ok"))
        return rows.join(kept, ["bucket", "seq"], "left").withColumn("verdict", F.coalesce("ok", F.lit(PREFIX))).drop("ok")
    first = rows.groupBy("bucket", "norm").agg(F.min("seq").alias("first_seq"), F.first("prefix").alias("p"))
    held = old.select("bucket", "norm").distinct() if old is not None else None
    if held is not None:
        first = first.join(held, ["bucket", "norm"], "left_anti")
    allowed = (ranked(first, "p", "first_seq") if policy.prefix_enabled else first).select("bucket", "norm", "first_seq")
    if held is not None:
        allowed = allowed.unionByName(held.withColumn("first_seq", F.lit(-(1 << 63)).cast("long")))
    verdict = F.when(F.col("first_seq").isNull(), PREFIX).when(F.col("first_seq") == F.col("seq"), OK).otherwise(EXACT)
    return rows.join(allowed, ["bucket", "norm"], "left").withColumn("verdict", verdict).drop("first_seq")


def running_count(rows: DataFrame, flag: Column, name: str) -> DataFrame:
    """Per bucket, the rows with the flag before each row in order of seq; by ranges of seq, so no bucket meets in one task.

    The range of each row is written down once, and both the counts per range and the rows come from that table: a second
    evaluation would sample other bounds. ``seq`` is unique in its bucket. A row without its range is an error.
    """
    placed = rows.withColumn("_f", flag.cast("long")).repartitionByRange("bucket", "seq").withColumn("_p", F.spark_partition_id())
    placed = cut(placed, "ranges")
    per = placed.groupBy("bucket", "_p").agg(F.sum("_f").alias("_n"))
    before = per.select("bucket", "_p", F.coalesce(F.sum("_n").over(Window.partitionBy("bucket").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    inside = F.coalesce(F.sum("_f").over(Window.partitionBy("bucket", "_p").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = placed.withColumn("_i", inside).join(before.withColumnRenamed("bucket", "_k").withColumnRenamed("_p", "_q"), (F.col("bucket").eqNullSafe(F.col("_k"))) & (F.col("_p") == F.col("_q")), "left")
    total = F.when(F.col("_b").isNull(), F.raise_error(F.lit("a row's range was not counted")).cast("long")).otherwise(F.col("_i") + F.col("_b"))
    return known.withColumn(name, total).drop("_f", "_p", "_i", "_b", "_k", "_q")


def _ordered_pass(policy: DedupPolicy):
    window = max(1, policy.max_compare)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, quota, recent, mine = None, set(), {}, {}, 0
        for batch in batches:
            out = []
            for bucket, seq, tid, last, prefix, used, certain, label, norm, prior in zip(*(batch.column(i).to_pylist() for i in range(10))):
                if bucket != at:
                    at, held, quota, recent, mine = bucket, set(), {}, {}, 0
                accepted = certain + mine
                near = recent.get(label) if label is not None else None
                own = grams(norm, policy.ngram) if label is not None else None
                while near and accepted - near[0][0] > window:
                    near.popleft()
                if prior:
                    verdict = OK
                elif policy.exact and tid in held:
                    verdict = EXACT
                elif policy.prefix_enabled and quota.get(prefix, 0) + used >= policy.prefix_max:
                    verdict = PREFIX
                elif near and any(similarity(own, other) >= policy.threshold for _, other in near):
                    verdict = NEAR
                else:
                    verdict = OK
                    quota[prefix] = quota.get(prefix, 0) + 1
                if verdict == OK:
                    held.add(tid)
                    mine += 1
                    if label is not None:
                        recent.setdefault(label, deque()).append((accepted, own))
                if seq == last:
                    held.discard(tid)
                out.append((bucket, seq, verdict))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.string())], names=["bucket", "seq", "v"])

    return run


def _with_ngrams(rows: DataFrame, policy: DedupPolicy) -> DataFrame:
    """Verdicts under a policy with n-grams; rows with ``_prior`` count as accepted whatever they are.

    A text without a similar one is judged without walking: its first row is accepted and the others repeat it, or its
    prefix is full at its first row because as many such texts came before it. All other rows are contested. Of prior
    rows, only the last ``max_compare`` of a bucket can be similar to what is yet to be accepted.
    """
    keys = ["bucket", "norm"]
    whole = rows if "_prior" in rows.columns else rows.withColumn("_prior", F.lit(False))
    rows = cut(whole.select("bucket", "seq", "norm", "prefix", "_prior"), "rows")
    texts = rows.groupBy(*keys).agg(F.min("seq").alias("tid"), F.max("seq").alias("last"), F.first("prefix").alias("prefix"), F.count("*").alias("copies"), F.max("_prior").alias("old"))
    texts = cut(texts, "texts")
    latest = rows.where("_prior").select(*keys, "seq").withColumn("r", F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("seq")))).where(F.col("r") <= max(1, policy.max_compare))
    live = texts.join(latest.select(*keys).distinct().withColumn("live", F.lit(True)), keys, "left").where("live OR NOT old").select("bucket", "tid", "norm", "old")
    edges = cut(similar_edges(live, policy.ngram, policy.threshold, F.col("old")).select("bucket", "a", "b"), "edges")
    node = lambda c: F.xxhash64("bucket", c)  # noqa: E731 - a collision only joins two components, whose members are compared anyway
    label = components(edges.select(node("a").alias("a"), node("b").alias("b"))).select("node", F.col("label").alias("_label"))
    state = texts.withColumn("node", node("tid")).join(label, "node", "left").drop("node")
    if not policy.exact:
        # every copy is compared with the others
        state = state.withColumn("_label", F.coalesce("_label", F.when(F.col("copies") > 1, node("tid"))))
    lone = state.where("_label IS NULL AND NOT old").select("bucket", "prefix", "tid")
    state = cut(state, "state")
    if policy.prefix_enabled:
        used = rows.where("_prior").groupBy("bucket", "prefix").agg(F.count("*").alias("used"))
        news = F.when(~F.col("old"), F.lit(1) if policy.exact else F.col("copies")).otherwise(F.lit(0) if policy.exact else F.col("copies"))
        full = state.groupBy("bucket", "prefix").agg(F.sum(news).alias("news")).join(used, ["bucket", "prefix"], "left").select("bucket", "prefix", "news", F.coalesce("used", F.lit(0)).alias("used"))
        ahead = lone.withColumn("r", F.row_number().over(Window.partitionBy("bucket", "prefix").orderBy("tid"))).where(F.col("r") <= policy.prefix_max).select("bucket", "tid", "r")
        state = state.join(full, ["bucket", "prefix"], "left").join(ahead, ["bucket", "tid"], "left")
        roomy = F.col("news") + F.col("used") <= policy.prefix_max
        behind = ~roomy & (F.col("r").isNull() | (F.col("r") + F.col("used") > policy.prefix_max))
    else:
        state = state.withColumn("used", F.lit(0).cast("long"))
        roomy, behind = F.lit(True), F.lit(False)
    sure = F.when(F.col("_label").isNotNull(), None).when(F.col("old"), EXACT if policy.exact else None).when(roomy, OK).when(behind, PREFIX)
    state = state.select(*keys, "tid", "last", "used", "_label", sure.alias("sure"))
    own = rows.join(state, keys)
    accepted = F.col("_prior") | (F.col("sure") == OK) & (F.col("seq") == F.col("tid"))
    own = own.withColumn("contested", F.col("sure").isNull() & (~F.col("_prior") | F.col("_label").isNotNull()))
    known = running_count(own, accepted & ~F.col("contested"), "certain")
    contested = known.where("contested").select("bucket", "seq", "tid", "last", "prefix", F.coalesce("used", F.lit(0)).alias("used"), "certain", "_label", F.when(F.col("_label").isNotNull(), F.col("norm")).alias("norm"), "_prior")
    passed = contested.repartition("bucket").sortWithinPartitions("bucket", "seq").mapInArrow(_ordered_pass(policy), "bucket string, seq long, v string")
    plain = known.where("NOT contested").select("bucket", "seq", F.when(F.col("_prior") | (F.col("sure") == PREFIX) | (F.col("seq") == F.col("tid")), F.when(F.col("_prior"), OK).otherwise(F.col("sure"))).otherwise(EXACT).alias("v"))
    verdicts = passed.unionByName(plain)
    out = whole.where("NOT _prior").join(verdicts, ["bucket", "seq"], "left")
    return out.withColumn("verdict", F.coalesce("v", F.raise_error(F.lit("a row got no verdict")))).drop("v")


def dedup(df: DataFrame, policy: DedupPolicy, text: str = "text", rule: str = "rule_id", prior: DataFrame | None = None) -> DataFrame:
    """``df`` (with seq) plus verdict: ok, duplicate_exact, prefix_overuse or ngram_near_duplicate.

    ``seq`` is a bigint, unique within a bucket. Null texts count as empty ones, which are texts like others; a null
    rule as an empty one. ``prior`` has (rule, seq, text) of rows accepted earlier, which are state whatever the policy
    says of them; they come before all rows of ``df`` and get no verdict. Other columns are kept, an empty table gives no rows.
    """
    rows = prepare(df, policy, text, rule)
    old = None
    if prior is not None:
        old = prepare(prior.select(F.col(rule), F.col(text), F.col("seq")), policy, text, rule)
    if policy.ngram_enabled:
        if old is not None:
            # prior rows come first, in their own order
            rows = rows.withColumn("_prior", F.lit(False)).unionByName(old.withColumn("_prior", F.lit(True)).withColumn("seq", F.col("seq") - F.lit(1 << 62)), allowMissingColumns=True)
        out = _with_ngrams(rows, policy)
    else:
        out = _exact_and_prefix(rows, policy, old)
    return out.drop("norm", "prefix", "_prior")


def cap(df: DataFrame, counts: DataFrame, rule: str = "rule_id", verdict: str = "verdict", already: DataFrame | None = None) -> DataFrame:
    """Rows after the one that fills a rule's count become ``unprocessed``.

    ``counts`` has (rule, target) and ``already`` (rule, accepted) of earlier runs; both have a row for each rule. The
    rank is filtered by the greatest target, so Spark keeps only that many rows of a rule per task.
    """
    room = counts.select(rule, "target")
    if already is not None:
        room = room.join(already.select(rule, "accepted"), rule, "left").select(rule, (F.col("target") - F.coalesce("accepted", F.lit(0))).alias("target"))
    room = F.broadcast(room)
    accepted = df.where(F.col(verdict) == OK).select(rule, "seq").join(room, rule)
    most = int(counts.agg(F.max("target")).first()[0] or 0)
    ranked = accepted.withColumn("r", F.row_number().over(Window.partitionBy(rule).orderBy("seq"))).where(F.col("r") <= most)
    last = ranked.where("r = target").groupBy(rule).agg(F.max("seq").alias("last"))
    full = room.where("target <= 0").select(rule, F.lit(-(1 << 63)).cast("long").alias("last"))
    out = df.join(F.broadcast(last.union(full)), rule, "left")
    return out.withColumn(verdict, F.when(F.col("last").isNotNull() & (F.col("seq") > F.col("last")), UNPROCESSED).otherwise(F.col(verdict))).drop("last")


def dedup_rules_in_order(df: DataFrame, policy: DedupPolicy, counts: list[tuple[str, int]], text: str = "text", rule: str = "rule_id") -> DataFrame:
    """For one bucket over several capped rules: rules are processed in the given order, each before the accepted rows of the earlier ones."""
    spark = df.sparkSession
    prior, parts = None, []
    for position, (name, target) in enumerate(counts):
        own = dedup(df.where(F.col(rule) == name), policy, text, rule, prior)
        own = cap(own, spark.createDataFrame([(name, target)], f"{rule} string, target int"), rule)
        parts.append(own)
        kept = own.where(F.col("verdict") == OK).select(rule, text, (F.col("seq") + F.lit(position << 40)).alias("seq"))
        prior = kept if prior is None else prior.unionByName(kept)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
