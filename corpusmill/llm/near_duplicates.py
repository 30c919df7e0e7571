"""Near-duplicate groups of a text table of any size, by a token-group matrix.

Measure: Jaccard value of the sets of character trigrams of normalized texts (functions.normal_text). Two texts belong
together at ``threshold`` or more, and a class is everything connected so.

1. Every distinct text gets a block fingerprint (fingerprint.py). Its block keys are the sparse token side of the
   matrix: texts that share a key are brought together, so the whole collection is never compared pairwise.
2. Texts are partitioned into groups around the smallest text that each meets. For a group the union of its members'
   trigrams is stored, and for each query text that met any member, |query & union| bounds its overlap with every
   member. Only groups whose bound reaches the overlap that the threshold needs are opened.
3. Opened groups are verified exactly; links go to connected components.

Skew: exact copies collapse before keys are made (within an Arrow batch) or counted (by a map-side combined minimum);
the texts of a key that is crowded within a batch go to tasks by text, and only one of them to the key's task, which
then counts the key as crowded; the number of key tasks follows the rows. Buckets of up to ``WIDE`` texts give the pairs whose sketches are close; larger or crowded ones give a star around
their smallest text, and only the texts that the star doesn't connect are compared with the rest of their bucket; large
groups are split in blocks.

Losses: a link at J is missed only if the two texts share none of 40 keys (1.5 % at 0.75, 0.06 % at 0.8, 0.002 % at
0.85, and a missed link splits a class only if no other link joins its ends).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.normal_text import gram_codes, least_overlap
from ..plans.components import components
from ..plans.scratch import cut, new_path
from .fingerprint import BLOCKS, blocks, keys, most_differing, normal_or_none, sketch, text_node

#: A bucket of up to SMALL texts, or of up to WIDE with few close pairs, gives its close pairs; others take the exact way round.
SMALL, WIDE = 32, 2048
GROUP_BLOCK = 1024
#: Texts of one batch of workers (BATCH texts) that a key may have before they bypass the key's task.
CROWD, BATCH = 64, 4000
#: Bytes of key records that one task may hold.
SHARD_BYTES = 32 << 20
#: Ids of texts to verify that may be broadcast (8 bytes each); beyond it they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
_KEY = np.dtype([("low", "<u4"), ("high", "u1"), ("hot", "u1"), ("node", "<i8"), ("s0", "<u8"), ("s1", "<u8")])
_MEMBER = np.dtype([("bucket", "<i8"), ("node", "<i8"), ("s0", "<u8"), ("s1", "<u8")])
_ID = np.dtype([("id", "<i8"), ("node", "<i8")])
PAIR, BIG, ID = 0, 1, 2


def _split(records: np.ndarray, shard: np.ndarray, kind: int) -> Iterator[tuple[int, int, bytes]]:
    order = np.argsort(shard, kind="stable")
    shard, records = shard[order], records[order]
    starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else []
    for a, b in zip(starts, [*starts[1:], len(shard)]):
        yield int(shard[a]), kind, records[a:b].tobytes()


def _records(shards: int, least_chars: int, crowd: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                pairs = [(i, n) for i, n in zip(part.column(0).to_pylist(), (normal_or_none(t, least_chars) for t in part.column(1).to_pylist())) if n is not None and i is not None]
                if not pairs:
                    continue
                ids, texts = np.array([p[0] for p in pairs], np.int64), [p[1] for p in pairs]
                nodes = text_node(texts)
                _, first = np.unique(nodes, return_index=True)
                words = blocks([texts[i] for i in first])
                own = nodes[first]
                k = keys(words)
                record = np.zeros(k.size, _KEY)
                flat = k.ravel()
                record["low"], record["high"] = flat & np.uint64(0xFFFFFFFF), (flat >> np.uint64(32)) & np.uint64(0xFF)
                shard = ((flat >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)
                s = sketch(words)
                record["node"] = np.repeat(own, k.shape[1])
                record["s0"], record["s1"] = (np.repeat(s[:, i].view(np.uint64), k.shape[1]) for i in (0, 1))
                _, one, which, count = np.unique(flat, return_index=True, return_inverse=True, return_counts=True)
                hot = count[which] > crowd
                member = np.empty(int(hot.sum()), _MEMBER)
                member["bucket"] = (flat[hot] & np.uint64((1 << 40) - 1)).astype(np.int64) | (shard[hot] << 40)
                for c in ("node", "s0", "s1"):
                    member[c] = record[c][hot]
                marks = one[count > crowd]
                record["hot"][marks] = 1
                keep = ~hot
                keep[marks] = True
                ident = np.empty(len(ids), _ID)
                ident["id"], ident["node"] = ids, nodes
                out = [
                    *_split(record[keep], shard[keep], PAIR),
                    *_split(member, np.abs(member["node"]) % shards, BIG),
                    *_split(ident, np.abs(ids) % shards, ID),
                ]
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int8()), pa.array([o[2] for o in out], pa.binary())], names=["shard", "kind", "payload"])

    return run


def bucket_pairs(key: np.ndarray, node: np.ndarray, bits: list[np.ndarray], most: int, small: int = SMALL, wide: int = WIDE, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All buckets of one shard -> (a, b) pairs of the small ones, members (bucket, node, s0, s1) of the large ones and of those with a hot record.

    Pairs whose sketches differ in more than ``most`` bits end here, so chance meetings are never shuffled.
    """
    hot_keys = np.unique(key[hot > 0]) if hot is not None else np.empty(0, np.int64)
    order = np.lexsort((node, key))
    key, node, bits = key[order], node[order], [x[order] for x in bits]
    fresh = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])] if len(key) else np.empty(0, bool)
    key, node, bits = key[fresh], node[fresh], [x[fresh] for x in bits]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[starts, len(key)])
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    crowded = (sizes > max(small, wide)) | np.isin(key[starts], hot_keys)
    for size in np.unique(sizes[(sizes > 1) & (sizes <= small)]):
        rows = starts[(sizes == size) & ~crowded][:, None] + np.arange(size)
        i, j = np.triu_indices(size, 1)
        i, j = rows[:, i].ravel(), rows[:, j].ravel()
        near = sum(np.bitwise_count(x[i] ^ x[j]).astype(np.int16) for x in bits) <= most
        left.append(node[i[near]])
        right.append(node[j[near]])
    for at in np.flatnonzero((sizes > small) & ~crowded):
        a, b = starts[at], starts[at] + sizes[at]
        apart = sum(np.bitwise_count(x[a:b, None] ^ x[None, a:b]).astype(np.int16) for x in bits)
        i, j = np.nonzero(np.triu(apart <= most, 1))
        if len(i) > small * sizes[at]:
            crowded[at] = True
        else:
            left.append(node[a + i])
            right.append(node[a + j])
    both = np.unique(np.stack([np.concatenate(left), np.concatenate(right)], 1), axis=0)
    large = np.repeat(crowded, sizes)
    member = np.empty(int(large.sum()), _MEMBER)
    member["bucket"], member["node"], member["s0"], member["s1"] = key[large], node[large], bits[0][large], bits[1][large]
    return both[:, 0], both[:, 1], member


_FLAT = "a long, b long, kind byte, s0 long, s1 long"


def _buckets(batches: Iterator[pa.RecordBatch], most: int, small: int, wide: int) -> Iterator[pa.RecordBatch]:
    """One shard: ids and members of crowded keys pass through, key records are held and compared."""
    held: list[tuple[int, bytes]] = []

    def out(kind: int, a: np.ndarray, b: np.ndarray, s0: np.ndarray | None = None, s1: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(a), 100_000):
            cols = [pa.array(np.ascontiguousarray(x[at : at + 100_000])) for x in (a, b)]
            n = len(cols[0])
            bits = [pa.nulls(n, pa.int64()) if x is None else pa.array(np.ascontiguousarray(x[at : at + 100_000]).view(np.int64)) for x in (s0, s1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(n, kind, np.int8)), *bits], names=["a", "b", "kind", "s0", "s1"])

    for batch in batches:
        for shard, kind, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if kind == PAIR:
                held.append((shard, payload))
            elif kind == ID:
                ids = np.frombuffer(payload, _ID)
                yield from out(ID, ids["id"], ids["node"])
            else:
                m = np.frombuffer(payload, _MEMBER)
                yield from out(BIG, m["bucket"], m["node"], m["s0"], m["s1"])
    record = np.frombuffer(b"".join(p for _, p in held), _KEY)
    shard = np.repeat(np.array([s for s, _ in held], np.int64), [len(p) // _KEY.itemsize for _, p in held])
    key = record["low"].astype(np.int64) | (record["high"].astype(np.int64) << 32) | (shard << 40)
    held.clear()
    a, b, m = bucket_pairs(key, record["node"].astype(np.int64), [record["s0"].astype(np.uint64), record["s1"].astype(np.uint64)], most, small, wide, record["hot"])
    del record, key
    yield from out(PAIR, a, b)
    yield from out(BIG, m["bucket"], m["node"], m["s0"], m["s1"])


def _open_groups(threshold: float):
    """Rows sorted by (g, block, role): members of a block of a group (role 0), then the texts that query it."""

    def verify(members: list[tuple[int, str]], queries: list[tuple[int, str]]) -> list[tuple[int, int]]:
        if not members or not queries:
            return []
        def sets(rows: list[tuple[int, str]]) -> list[np.ndarray]:
            codes, whose = gram_codes([t for _, t in rows])
            cuts = np.searchsorted(whose, np.arange(len(rows) + 1))
            return [np.unique(codes[a:b]) for a, b in zip(cuts, cuts[1:])]

        own, asked = sets(members), sets(queries)
        union = np.unique(np.concatenate(own))
        smallest = min(map(len, own))
        at = np.zeros((len(own), len(union)), bool)
        for i, tokens in enumerate(own):
            at[i, np.searchsorted(union, tokens)] = True
        sizes = np.array([len(x) for x in own])
        found: list[tuple[int, int]] = []
        for (q, _), tokens in zip(queries, asked):
            place = np.minimum(np.searchsorted(union, tokens), len(union) - 1)
            place = place[union[place] == tokens]
            if len(place) < least_overlap(len(tokens), smallest, threshold):
                continue
            both = at[:, place].sum(1)
            near = both / (len(tokens) + sizes - both) >= threshold
            found.extend((q, members[i][0]) for i in np.flatnonzero(near) if members[i][0] != q)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links: list[tuple[int, int]] = []
        at, members, queries = None, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"])
                links.clear()

        for batch in batches:
            for g, block, role, node, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (g, block) != at:
                    links.extend(verify(members, queries))
                    at, members, queries = (g, block), [], []
                if role == 0:
                    members.append((node, text))
                else:
                    queries.append((node, text))
                    if len(queries) >= 4096:
                        links.extend(verify(members, queries))
                        queries = []
            if len(links) > 50_000:
                yield from flush()
        links.extend(verify(members, queries))
        yield from flush()

    return run


def _normalize(least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [normal_or_none(t, least_chars) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["node", "text"])

    return run


def verified_links(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs (a, b) and the normalized text of each node -> the pairs' groups, opened where the bound allows; links (a, b)."""
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lead = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("g"))
    lead = cut(lead.select(F.col("a").alias("node"), "g"), "lead")
    asked = both.join(lead.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "g").distinct()
    size = lead.groupBy("g").agg(F.ceil(F.count("*") / GROUP_BLOCK).cast("int").alias("blocks"))
    member = lead.join(size, "g").select("g", F.pmod(F.xxhash64("node"), "blocks").cast("int").alias("block"), F.lit(0).alias("role"), "node")
    query = asked.join(size, "g").select("g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("role"), "node")
    rows = member.union(query).join(texts, "node").select("g", "block", "role", "node", "text")
    rows = rows.repartition("g", "block").sortWithinPartitions("g", "block", "role")
    return rows.mapInArrow(_open_groups(threshold), "a long, b long")


def near_duplicate_classes(df: DataFrame, id_col: str, text_col: str, threshold: float = 0.75, least_chars: int = 40, small: int = SMALL, wide: int = WIDE, crowd: int = CROWD) -> DataFrame:
    """(id, first_id) of every record whose class has two or more records; first_id is the class's smallest id.

    ``id_col`` is a bigint, unique. Null texts and texts of fewer than ``least_chars`` characters after normalization
    have no class, nor have rows without an id. Exact repeats belong together. An empty table gives an empty result.
    Other columns are ignored.
    """
    spark = df.sparkSession
    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    most = most_differing(128, threshold)
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), source.count() * BLOCKS * _KEY.itemsize // SHARD_BYTES)
    flat = source.mapInArrow(_records(shards, least_chars, crowd), "shard int, kind byte, payload binary").repartitionById(shards, "shard").mapInArrow(partial(_buckets, most=most, small=small, wide=wide), _FLAT)
    path = new_path(spark, "near")
    flat.write.partitionBy("kind").parquet(path)
    raw = spark.read.schema("a long, b long, s0 long, s1 long, kind int").parquet(path)
    ids = raw.where(F.col("kind") == ID).select(F.col("a").alias("id"), F.col("b").alias("node"))
    first = ids.groupBy("node").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    big = raw.where(F.col("kind") == BIG).groupBy(F.col("a").alias("bucket"), F.col("b").alias("node")).agg(F.first("s0").alias("s0"), F.first("s1").alias("s1"))
    apart_bits = lambda x, y: F.bit_count(F.col(f"{x}.s0").bitwiseXOR(F.col(f"{y}.s0"))) + F.bit_count(F.col(f"{x}.s1").bitwiseXOR(F.col(f"{y}.s1")))
    tops = big.groupBy("bucket").agg(F.min(F.struct("node", "s0", "s1")).alias("top"))
    stars = big.alias("x").join(tops, "bucket").where((F.col("node") != F.col("top.node")) & (apart_bits("x", "top") <= most)).select(F.col("top.node").alias("a"), F.col("node").alias("b"))
    pairs = raw.where(F.col("kind") == PAIR).select("a", "b").union(stars).distinct()

    def link(p: DataFrame) -> DataFrame:
        p = cut(p, "candidates")
        nodes = p.select(F.col("a").alias("node")).union(p.select(F.col("b").alias("node"))).distinct()
        wanted = cut(first.join(nodes, "node").select("node", F.col("first").alias("id")), "wanted")
        by_id = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted
        texts = source.join(by_id, "id").select("node", "text").mapInArrow(_normalize(least_chars), "node long, text string")
        return cut(verified_links(p, texts, threshold), "links")

    links = link(pairs)
    labels = cut(components(links), "labels")
    if not big.isEmpty():
        tag = big.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        top = tag.groupBy("bucket").agg(F.min_by("label", "node").alias("main"))
        apart = tag.join(top, "bucket").where("label <> main")
        x = apart.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15)))).alias("x")
        y = tag.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(16)).cast("int")).alias("y")
        near = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.salt") == F.col("y.salt")) & (F.col("x.label") != F.col("y.label")) & (apart_bits("x", "y") <= most)
        more = x.join(y, near).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
        links = links.union(link(more))
        labels = cut(components(links), "labels")
    known = first.join(labels, "node", "left").where("n > 1 OR label IS NOT NULL").select("node", "first", F.coalesce("label", "node").alias("label"))
    known = cut(known, "known")
    head = known.groupBy("label").agg(F.min("first").alias("first_id"))
    return ids.join(known.join(head, "label").select("node", "first_id"), "node").select("id", "first_id")
