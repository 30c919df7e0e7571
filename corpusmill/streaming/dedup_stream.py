"""Deduplication as a stream: accepted texts are the keyed state of each bucket, so only new rows are ever read.

Rows of a bucket are processed in order of seq within a micro-batch; micro-batches must arrive in that order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..functions.normal_text import gram_set, jaccard
from ..operators.dedup import EXACT, NEAR, OK, PREFIX, DedupPolicy, prepare

OUTPUT = "bucket string, rule_id string, seq long, text string, verdict string"


class _Bucket(StatefulProcessor):
    """State: accepted texts (set), accepted texts per prefix, and a ring of the last max_compare accepted texts."""

    def __init__(self, policy: DedupPolicy):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        text = StructType([StructField("t", StringType())])
        number = StructType([StructField("n", LongType())])
        self.seen = handle.getMapState("seen", text, number)
        self.quota = handle.getMapState("quota", text, number)
        self.ring = handle.getMapState("ring", StructType([StructField("i", IntegerType())]), text)
        self.total = handle.getValueState("total", number)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        p = self.policy
        size = max(1, p.max_compare)
        total = self.total.get()[0] if self.total.exists() else 0
        recent = {i[0]: gram_set(t[0]) for i, t in self.ring.iterator()} if p.ngram_enabled and total else {}
        batch = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out = []
        for rule, seq, text, norm, prefix in zip(batch["rule_id"], batch["seq"], batch["text"], batch["norm"], batch["prefix"]):
            grams = gram_set(norm) if p.ngram_enabled else None
            used = self.quota.getValue((prefix,))[0] if p.prefix_enabled and self.quota.containsKey((prefix,)) else 0
            if p.exact and self.seen.containsKey((norm,)):
                verdict = EXACT
            elif p.prefix_enabled and used >= p.prefix_max:
                verdict = PREFIX
            elif p.ngram_enabled and any(jaccard(grams, other) >= p.threshold for other in recent.values()):
                verdict = NEAR
            else:
                verdict = OK
                self.seen.updateValue((norm,), (int(seq),))
                if p.prefix_enabled:
                    self.quota.updateValue((prefix,), (used + 1,))
                if p.ngram_enabled:
                    self.ring.updateValue((total % size,), (norm,))
                    recent[total % size] = grams
                total += 1
            out.append((key[0], rule, seq, text, verdict))
        self.total.update((total,))
        yield pd.DataFrame(out, columns=["bucket", "rule_id", "seq", "text", "verdict"])

    def close(self) -> None:
        pass


def dedup_stream(stream: DataFrame, policy: DedupPolicy) -> DataFrame:
    """(bucket, rule_id, seq, text, verdict) of a stream of (rule_id, seq, text). Needs the RocksDB state store, which is set here.

    n-grams have three characters, as the workers pack them so.
    """
    if policy.ngram_enabled and policy.ngram != 3:
        raise ValueError("the stream compares sets of three-character slices")
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = prepare(stream.select("rule_id", "seq", "text"), policy)
    return rows.groupBy("bucket").transformWithStateInPandas(_Bucket(policy), OUTPUT, "Append", "None")
