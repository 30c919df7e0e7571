"""Connected components of an edge table by alternating large-star and small-star steps.

Only minima are aggregated per node, so a node with very many neighbours is pre-combined on the map side and
no neighbour list is ever gathered in one task. Every task first shrinks its own edges to a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, new_path, write_table


#: Nodes that a task holds before it hands on what it has joined so far.
HELD = 1_000_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of one task -> (node, root) stars with the same connectivity, for chunks of up to about HELD nodes."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while x != top:
            parent[x], x = top, parent.get(x, x)
        return top

    def stars() -> Iterator[pa.RecordBatch]:
        nodes = [n for n in parent if parent[n] != n]
        tops = [root(n) for n in nodes]
        for at in range(0, len(nodes), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + 50_000], pa.int64()), pa.array(tops[at : at + 50_000], pa.int64())], names=["a", "b"])
        parent.clear()

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if a is None or b is None:
                continue
            ra, rb = root(a), root(b)
            if ra != rb:
                low, high = (ra, rb) if ra < rb else (rb, ra)
                parent[high] = low
                parent.setdefault(low, low)
        if len(parent) > HELD:
            yield from stars()
    yield from stars()


def _shrink(edges: DataFrame) -> DataFrame:
    return edges.mapInArrow(_forest, "a long, b long")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label) for each node that has an edge; label is the smallest node of its component.

    ``edges`` has two bigint columns in any order; loops, repeats and nulls are ignored. An empty table gives an
    empty result. The number of rounds follows the logarithm of the longest path; running out of rounds is an error.
    """
    spark = edges.sparkSession
    a, b = edges.columns[:2]
    path = new_path(spark, "edges")
    now = write_table(_shrink(edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))), path)
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    mark = None
    for _ in range(max_rounds):
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        small_in = large.distinct()
        down = small_in.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        after = new_path(spark, "edges")
        nxt = write_table(small, after)
        drop(spark, path)
        now, path = nxt, after
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (seen["n"], seen["s"]) == mark:
            label = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
            return label.union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
        mark = (seen["n"], seen["s"])
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
