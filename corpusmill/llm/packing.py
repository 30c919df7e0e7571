"""Filling fixed-capacity containers by bin completion.

Every container is built around the largest item that is left. A first pass takes for each container the completion of
least waste (a branch-and-bound search that cuts a branch when even taking everything it may still take can't beat the
best filling so far); best-fit decreasing gives a second incumbent. If neither meets the lower bound, the search over
containers follows: for each container the undominated fillings are enumerated, those of least waste first, and a branch
is cut when the waste so far leaves no room to beat the incumbent. A filling is dominated if some of its items could be
exchanged for one larger item that is left and still fits, or if any item left would fit beside it.

Items are dealt to blocks of about ``BLOCK_ITEMS`` by a hash and each block is packed by itself, so the work follows
the input; a block leaves at most about one container partly filled. Only items larger than a container are split:
into full containers and one remainder, which is packed like any item.
"""

from __future__ import annotations

import sys
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ITEMS = 20_000
#: Search nodes for one container in the first pass, and for all containers of a block in the second; without a limit (None) a block is packed exactly.
NODES = 3000
_SCHEMA = "spec_name string, container_id long, id long, part_no int, start_token int, n_tokens int"


def complete(room: int, sizes: list[int], counts: list[int], nodes: int | None = NODES) -> list[int]:
    """Indices (with repeats) of the filling of ``room`` with the least waste; sizes ascending and distinct."""
    best: list[int] = []
    best_sum = 0
    path: list[int] = []
    budget = [float("inf") if nodes is None else nodes]

    def search(top: int, left: int, total: int) -> bool:
        nonlocal best, best_sum
        if total > best_sum:
            best, best_sum = path.copy(), total
            if best_sum == room:
                return True
        i = min(top, bisect_right(sizes, left) - 1)
        while i >= 0:
            if budget[0] <= 0:
                return True
            if counts[i]:
                # what this branch can reach at most: everything of sizes up to i
                if total + min(left, reach[i]) <= best_sum:
                    return False
                budget[0] -= 1
                counts[i] -= 1
                path.append(i)
                done = search(i, left - sizes[i], total + sizes[i])
                path.pop()
                counts[i] += 1
                if done:
                    return True
            i -= 1
        return False

    reach, run = [], 0
    for s, c in zip(sizes, counts):
        run += s * c
        reach.append(run)
    search(len(sizes) - 1, room, 0)
    return best


def best_fit(sizes: np.ndarray, capacity: int) -> list[int]:
    """Best-fit decreasing: the container of each item, items given in descending order."""
    rooms: list[tuple[int, int]] = []
    out: list[int] = []
    used = 0
    for s in sizes.tolist():
        i = bisect_right(rooms, (s, -1))
        if i < len(rooms):
            room, c = rooms.pop(i)
        else:
            room, c, used = capacity, used, used + 1
        out.append(c)
        insort(rooms, (room - s, c))
    return out


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Containers that any packing needs: by the total size, and with items over a half apart and those they exclude."""
    best = -(-sum(sizes) // capacity)
    big = sorted((s for s in sizes if s > capacity // 2), reverse=True)
    for least in {capacity - s for s in big} | {1}:
        if least > capacity // 2 or least < 1:
            continue
        alone = sum(s > capacity - least for s in big)
        half = [s for s in big if s <= capacity - least]
        small = sum(s for s in sizes if least <= s <= capacity // 2)
        room = sum(capacity - s for s in half)
        best = max(best, alone + len(half) + max(0, -(-(small - room) // capacity)))
    return best


def dominated(chosen: list[int], left: list[int], slack: int) -> bool:
    """Whether one or two of the chosen sizes could be exchanged for one larger size of those left (ascending), within the slack."""
    if left and left[0] <= slack:
        return True
    parts = set(chosen) | {a + b for i, a in enumerate(chosen) for b in chosen[i + 1 :]}
    for s in parts:
        i = bisect_right(left, s)
        if i < len(left) and left[i] <= s + slack:
            return True
        # two items for one of their size: the one is the harder to place
        if s not in chosen and i and left[i - 1] == s:
            return True
    return False


def fillings(room: int, sizes: list[int], counts: list[int], most_waste: int, budget: list[float]) -> list[list[int]]:
    """Undominated fillings (indices of sizes, ascending sizes) whose waste is at most ``most_waste``, the least first."""
    found: list[tuple[int, list[int]]] = []
    path: list[int] = []
    reach, run = [], 0
    for s, c in zip(sizes, counts):
        run += s * c
        reach.append(run)

    def search(top: int, left: int) -> None:
        budget[0] -= 1
        if budget[0] <= 0:
            return
        if left <= most_waste:
            chosen = [sizes[i] for i in path]
            rest = [s for s, c in zip(sizes, counts) if c]
            if not dominated(chosen, rest, left):
                found.append((left, path.copy()))
        for i in range(min(top, bisect_right(sizes, left) - 1), -1, -1):
            if left - reach[i] > most_waste:
                return
            if counts[i]:
                counts[i] -= 1
                path.append(i)
                search(i, left - sizes[i])
                path.pop()
                counts[i] += 1

    search(len(sizes) - 1, room)
    return [f for _, f in sorted(found, key=lambda x: x[0])]


def bin_completion(sizes: list[int], counts: list[int], capacity: int, incumbent: int, nodes: int | None) -> list[list[int]] | None:
    """Containers (lists of indices of sizes) fewer than ``incumbent``, or None where there are none or the nodes end."""
    total = sum(s * c for s, c in zip(sizes, counts))
    least = lower_bound([s for s, c in zip(sizes, counts) for _ in range(c)], capacity)
    budget = [float("inf") if nodes is None else float(nodes)]
    best: list[list[int]] | None = None
    limit = incumbent
    done: list[list[int]] = []

    def place(left: int, waste: int) -> bool:
        nonlocal best, limit
        if not left:
            best, limit = [c.copy() for c in done], len(done)
            return limit <= least
        # one container less than the incumbent has this much room to waste
        spare = (limit - 1) * capacity - total - waste
        if spare < 0 or budget[0] <= 0:
            return False
        top = max(i for i, c in enumerate(counts) if c)
        counts[top] -= 1
        for more in fillings(capacity - sizes[top], sizes, counts, spare, budget):
            chosen = [top, *more]
            used = sum(sizes[i] for i in chosen)
            if (limit - 1) * capacity - total - waste < capacity - used:
                continue
            for i in more:
                counts[i] -= 1
            done.append(chosen)
            end = place(left - used, waste + capacity - used)
            done.pop()
            for i in more:
                counts[i] += 1
            if end or budget[0] <= 0:
                counts[top] += 1
                return end
        counts[top] += 1
        return False

    place(total, 0)
    return best


def pack(sizes: np.ndarray, capacity: int, nodes: int | None = NODES) -> np.ndarray:
    """Container number of each item of 0 <= size <= capacity; items of size 0 go to the first container."""
    order = np.argsort(-sizes, kind="stable")
    ordered = sizes[order]
    positive = int((ordered > 0).sum())
    ordered = ordered[:positive]
    distinct, first, count = np.unique(-ordered, return_index=True, return_counts=True)
    whole_sizes = (-distinct)[::-1].tolist()  # ascending
    whole_counts = count[::-1].tolist()

    def numbered(containers: list[list[int]]) -> np.ndarray:
        out, start = np.zeros(len(sizes), np.int64), first[::-1].tolist()
        for c, chosen in enumerate(containers):
            for i in chosen:
                out[order[start[i]]] = c
                start[i] += 1
        return out

    distinct, counts = whole_sizes.copy(), whole_counts.copy()
    greedy: list[list[int]] = []
    top = len(distinct) - 1
    while True:
        while top >= 0 and not counts[top]:
            top -= 1
        if top < 0:
            break
        del distinct[top + 1 :], counts[top + 1 :]
        counts[top] -= 1
        chosen = [top, *complete(capacity - distinct[top], distinct, counts, nodes)]
        for i in chosen[1:]:
            counts[i] -= 1
        greedy.append(chosen)
    out, used = numbered(greedy), len(greedy)
    least = lower_bound(ordered.tolist(), capacity)
    if used > least:
        other = np.array(best_fit(ordered, capacity), np.int64)
        if len(other) and other.max() + 1 < used:
            out, used = np.zeros(len(sizes), np.int64), int(other.max()) + 1
            out[order[:positive]] = other
    if used > least:
        better = bin_completion(whole_sizes, whole_counts.copy(), capacity, used, nodes)
        if better is not None:
            out = numbered(better)
    return out


def _block(spec: str, b: int, item: np.ndarray, n: np.ndarray, cap: int, nodes: int | None) -> pa.RecordBatch:
    rows = np.argsort(item, kind="stable")
    item, n = item[rows], n[rows]
    full = n // cap
    full[(full > 0) & (n % cap == 0)] -= 1
    rest = n - full * cap
    place = pack(rest, cap, nodes)
    ids, part, begin, length, where = [item], [full], [full * cap], [rest], [place]
    if full.sum():
        whole = np.repeat(np.arange(len(item)), full)
        number = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        ids.append(item[whole])
        part.append(number)
        begin.append(number * cap)
        length.append(np.full(len(whole), cap))
        where.append(place.max() + 1 + np.arange(len(whole)))
    c = np.concatenate(where) + (np.int64(b) << 32)
    return pa.RecordBatch.from_arrays(
        [pa.array([spec] * len(c)), pa.array(c), pa.array(np.concatenate(ids)), *(pa.array(np.concatenate(x).astype(np.int32)) for x in (part, begin, length))],
        names=["spec_name", "container_id", "id", "part_no", "start_token", "n_tokens"],
    )


def _packer(nodes: int | None):
    """Blocks arrive one after the other; only one is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(100_000)  # a search is as deep as a container has items
        at: tuple[str, int] | None = None
        items: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        cap = 0
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            block, item, n, capacity = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5))
            edges = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (names[1:] != names[:-1])]) if len(block) else []
            for lo, hi in zip(edges, [*edges[1:], len(block)]):
                if (names[lo], block[lo]) != at:
                    if at is not None:
                        yield _block(at[0], at[1], np.concatenate(items), np.concatenate(sizes), cap, nodes)
                    at, items, sizes, cap = (names[lo], block[lo]), [], [], int(capacity[lo])
                items.append(item[lo:hi])
                sizes.append(n[lo:hi])
        if at is not None:
            yield _block(at[0], at[1], np.concatenate(items), np.concatenate(sizes), cap, nodes)

    return run


def fill_containers(sizes: DataFrame, specs: list[tuple[str, int]], nodes: int | None = NODES, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(id, n_tokens) and [(spec_name, capacity)] -> (spec_name, container_id, id, part_no, start_token, n_tokens).

    Every item is in a container of every spec, those of size 0 (or null) too; its parts cover it once and in order.
    Equal sizes are told apart by the order of ids. No specs or no items: no rows. A capacity under 1 is a ValueError.
    ``nodes`` bounds the searches (None: exact within a block); whatever it is, every item is placed.
    """
    if any(c < 1 for _, c in specs):
        raise ValueError("a capacity must be at least 1")
    spark = sizes.sparkSession
    if not specs:
        return spark.createDataFrame([], _SCHEMA)
    spec = F.explode(F.array(*(F.struct(F.lit(n).alias("spec_name"), F.lit(c).alias("capacity")) for n, c in specs)))
    items = sizes.select("id", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
    total = items.agg(F.count("*").alias("n")).first()["n"]
    blocks = max(1, -(-total // block_items))
    rows = items.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))).withColumn("spec", spec).select("spec.spec_name", "block", "id", "n_tokens", F.col("spec.capacity").cast("long").alias("capacity"))
    lanes = max(1, min(blocks * len(specs), 16 * spark.sparkContext.defaultParallelism))
    return rows.repartition(lanes, "spec_name", "block").sortWithinPartitions("spec_name", "block").mapInArrow(_packer(nodes), _SCHEMA)


def container_waste(filled: DataFrame, specs: list[tuple[str, int]]) -> DataFrame:
    """(spec_name, containers, least_containers, unused_tokens, unused_share): how near each spec comes to the bound by total size."""
    capacity = F.create_map(*(x for n, c in specs for x in (F.lit(n), F.lit(c)))) if specs else F.lit(None).cast("map<string,int>")
    each = filled.groupBy("spec_name", "container_id").agg(F.sum("n_tokens").alias("used"))
    per = each.groupBy("spec_name").agg(F.count("*").alias("containers"), F.sum("used").alias("used")).withColumn("capacity", capacity[F.col("spec_name")])
    unused = F.col("containers") * F.col("capacity") - F.col("used")
    return per.select("spec_name", "containers", F.ceil(F.col("used") / F.col("capacity")).alias("least_containers"), unused.alias("unused_tokens"), F.round(unused / (F.col("containers") * F.col("capacity")), 6).alias("unused_share"))
