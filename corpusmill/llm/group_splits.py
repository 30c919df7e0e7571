"""Train, validation and test splits that keep related records together.

Records are related if they share a key (here a phone number or a case number); groups are the connected components of
the key table, which is the distinct pairs of keys and so is pre-aggregated before any shuffle of rows.

Allocation by min-cost flow: groups of the same size and label profile form one bundle; only the bundle counts reach
the driver (at most sqrt(2 * rows) sizes times the number of profiles). Rows flow from bundles to (profile, split)
nodes and on to splits; flow beyond a node's quota costs its deviation, so the optimum has the least total deviation.
Flows are rounded to whole groups, the largest first, and bundle members are dealt to the splits in order of a hash.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.components import components
from ..plans.scratch import cut

#: Case numbers follow the ten-digit phone numbers in the space of nodes.
CASE_BASE = 10**11
#: Groups of one bundle that are ranked in one task, about.
RANKED = 20_000


def phone_number(text: Column) -> Column:
    """Ten-digit national number as a bigint; any notation, with or without a leading +7, 7 or 8. Else null."""
    digits = F.regexp_replace(text, r"\P{Nd}", "")
    return F.when(digits.rlike("^[78]?[0-9]{10}$"), F.substring(digits, -10, 10).cast("long"))


def case_number(text: Column) -> Column:
    """The first number inside a case id as a bigint; null where there is none (or one of over 18 digits)."""
    number = F.regexp_extract(text, r"([0-9]+)", 1)
    return F.when(number.rlike("^0*[0-9]{1,18}$"), number.cast("long"))


def keyed(df: DataFrame, id_col: str, phone_col: str, case_col: str, *more: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), phone_number(F.col(phone_col)).alias("phone"), (case_number(F.col(case_col)) + CASE_BASE).alias("case"), *more)


def key_groups(rows: DataFrame) -> DataFrame:
    """(node, label) of every key of ``rows`` (phone, case); label is the smallest key: a phone number where there is one."""
    pairs = cut(rows.groupBy("phone", "case").agg(F.count("*").alias("n")), "keys")
    linked = cut(components(pairs.where("phone IS NOT NULL AND case IS NOT NULL").select("phone", "case")), "labels")
    single = pairs.select(F.explode(F.array("phone", "case")).alias("node")).where("node IS NOT NULL").distinct().join(linked, "node", "left_anti")
    return linked.union(single.select("node", F.col("node").alias("label")))


class _Flow:
    """Min-cost flow by successive shortest paths (queue-based, arcs in lists)."""

    def __init__(self, nodes: int):
        self.arcs: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.arcs[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def push(self, source: int, sink: int) -> None:
        while True:
            far, came, waiting, queued = {source: 0}, {}, deque([source]), {source}
            while waiting:
                a = waiting.popleft()
                queued.discard(a)
                for e in self.arcs[a]:
                    if self.room[e] and (d := far[a] + self.cost[e]) < far.get(b := self.to[e], 1 << 60):
                        far[b], came[b] = d, e
                        if b not in queued:
                            queued.add(b)
                            waiting.append(b)
            if sink not in far:
                return
            path, at = [], sink
            while at != source:
                path.append(came[at])
                at = self.to[came[at] ^ 1]
            most = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= most
                self.room[e ^ 1] += most


def allocate(bundles: list[tuple[int, str, int]], shares: dict[str, float]) -> dict[tuple[int, str], dict[str, int]]:
    """[(group size, profile, groups)] and shares -> for each bundle how many whole groups each split gets."""
    splits = sorted(shares, key=lambda s: (-shares[s], s))
    scale = sum(shares.values()) or 1.0
    rows = sum(size * n for size, _, n in bundles)
    profiles = sorted({p for _, p, _ in bundles})
    by_profile = {p: sum(s * n for s, q, n in bundles if q == p) for p in profiles}

    def quotas(total: int) -> dict[str, int]:
        exact = {s: total * shares[s] / scale for s in splits}
        whole = {s: int(exact[s]) for s in splits}
        for s in sorted(splits, key=lambda s: whole[s] - exact[s])[: total - sum(whole.values())]:
            whole[s] += 1
        return whole

    ordered = sorted(bundles, key=lambda b: (-b[0], b[1]))
    flow = _Flow(2 + len(ordered) + (len(profiles) + 1) * len(splits))
    source, sink, first = 0, 1, 2 + len(ordered)
    place = {(p, s): first + i * len(splits) + j for i, p in enumerate([*profiles, None]) for j, s in enumerate(splits)}
    arcs = {}
    for i, (size, p, n) in enumerate(ordered):
        flow.arc(source, 2 + i, size * n, 0)
        for s in splits:
            arcs[i, s] = flow.arc(2 + i, place[p, s], size * n, 0)
    for p in profiles:
        for s, q in quotas(by_profile[p]).items():
            flow.arc(place[p, s], place[None, s], q, 0)
            flow.arc(place[p, s], place[None, s], by_profile[p], 1)
    for s, q in quotas(rows).items():
        flow.arc(place[None, s], sink, q, 0)
        flow.arc(place[None, s], sink, rows, 100)
    flow.push(source, sink)

    given: dict[tuple[int, str], dict[str, int]] = {}
    left = {s: float(q) for s, q in quotas(rows).items()}
    left_p = {(p, s): float(q) for p in profiles for s, q in quotas(by_profile[p]).items()}
    for i, (size, p, n) in enumerate(ordered):
        counts = {s: min(n, flow.room[arcs[i, s] ^ 1] // size) for s in splits}
        for s in splits:  # rounding of larger groups may have used up a quota
            counts[s] = max(0, min(counts[s], int((left[s] + size / 2) // size)))
        for _ in range(n - sum(counts.values())):
            best = max(splits, key=lambda s: (left[s] - counts[s] * size, left_p[p, s] - counts[s] * size, shares[s], s))
            counts[best] += 1
        for s in splits:
            left[s] -= counts[s] * size
            left_p[p, s] -= counts[s] * size
        given[size, p] = counts
    return given


def group_splits(df: DataFrame, quota: DataFrame, id_col: str = "variant_id", phone_col: str = "phone_digits", case_col: str = "case_id", label_col: str = "kind") -> DataFrame:
    """(id, group_key, split_name, phones, cases) of every record; all records of a group are in one split.

    phones and cases are the group's distinct numbers and case numbers. A record with neither key is its own group
    (group_key null). The label profile of a group is its commonest value of ``label_col`` (trimmed, lower case, null as
    ''), ties to the smaller. ``quota`` has (split_name, share) and is a handful of rows; without rows there is no split
    and ValueError is raised. Repeated records count by themselves; an empty table gives an empty result.
    """
    shares = {r["split_name"]: float(r["share"]) for r in quota.select("split_name", "share").collect() if r["split_name"] is not None and (r["share"] or 0) > 0}
    if not shares:
        raise ValueError("no split has a positive share")
    rows = keyed(df, id_col, phone_col, case_col, F.coalesce(F.lower(F.trim(label_col)), F.lit("")).alias("kind")).withColumn("node", F.coalesce("phone", "case"))
    nodes = cut(key_groups(rows), "nodes")
    key = F.coalesce(F.col("label"), -F.col("id") - 1)
    counts = rows.groupBy("node", "kind", F.when(F.col("node").isNull(), F.col("id")).alias("id")).agg(F.count("*").alias("n"))
    per_kind = counts.join(nodes, "node", "left").groupBy(key.alias("g"), "kind").agg(F.sum("n").alias("n"))
    is_case = F.col("node") >= CASE_BASE
    keys = nodes.groupBy(F.col("label").alias("g")).agg(F.sum(F.when(is_case, 0).otherwise(1)).alias("phones"), F.sum(F.when(is_case, 1).otherwise(0)).alias("cases"))
    sizes = per_kind.groupBy("g").agg(F.sum("n").alias("size"), F.max_by("kind", F.struct("n", -F.xxhash64("kind"))).alias("profile"))
    groups = cut(sizes.join(keys, "g", "left").na.fill(0, ["phones", "cases"]).withColumn("h", F.xxhash64("g")), "groups")
    bundles = [(r["size"], r["profile"], r["n"]) for r in groups.groupBy("size", "profile").agg(F.count("*").alias("n")).collect()]
    dealt = allocate(bundles, shares)
    spans = []
    for (size, profile), counts_ in dealt.items():
        at = 0
        for s, n in counts_.items():
            if n:
                spans.append((size, profile, at, at + n, s))
                at += n
    spark = df.sparkSession
    span = spark.createDataFrame(spans or [(0, "", 0, 0, "")], "size long, profile string, lo long, hi long, split_name string")
    bucket = F.pmod(F.col("h"), F.lit(1 + max((n for _, _, n in bundles), default=0) // RANKED))
    per_bucket = groups.groupBy("size", "profile", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    before = per_bucket.withColumn("offset", F.sum("n").over(Window.partitionBy("size", "profile").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).na.fill(0, ["offset"]).drop("n")
    ranked = groups.withColumn("bucket", bucket).withColumn("r", F.row_number().over(Window.partitionBy("size", "profile", "bucket").orderBy("h", "g")) - 1)
    ranked = ranked.join(before, ["size", "profile", "bucket"]).withColumn("r", F.col("r") + F.col("offset"))
    split = ranked.join(span, ["size", "profile"]).where("r >= lo AND r < hi").select("g", "split_name", "phones", "cases")
    return rows.select("id", "node").join(nodes, "node", "left").select("id", F.col("label").alias("group_key"), key.alias("g")).join(split, "g").select("id", "group_key", "split_name", "phones", "cases")


def mixed_groups(allocated: DataFrame) -> DataFrame:
    """(id, group_phone) of the allocated records (group_splits) whose group has more than one number or more than one case number.

    group_phone is the group's smallest number as 11 digits with a leading 8; null where a group has case numbers only,
    of which one alone is never mixed.
    """
    phone = F.when(F.col("group_key") < CASE_BASE, F.format_string("8%010d", "group_key"))
    return allocated.where("phones > 1 OR cases > 1").select("id", phone.alias("group_phone"))


def split_deviation(allocated: DataFrame, quota: DataFrame) -> DataFrame:
    """(split_name, records, wanted, deviation): how far each split is from its share of the records."""
    total, shares = allocated.count(), quota.where("share > 0").agg(F.coalesce(F.sum("share"), F.lit(1.0))).first()[0]
    per = allocated.groupBy("split_name").agg(F.count("*").alias("records"))
    out = F.broadcast(quota.where("share > 0").select("split_name", "share")).join(per, "split_name", "left")
    out = out.select("split_name", F.coalesce("records", F.lit(0)).alias("records"), F.round(F.lit(total) * F.col("share") / F.lit(shares), 3).alias("wanted"))
    return out.withColumn("deviation", F.round(F.col("records") - F.col("wanted"), 3))
