"""Exact similarity join: all pairs of texts of one bucket whose character n-gram sets reach a Jaccard value.

Sets of a and b members that reach t differ in at most ``(a + b) * (1 - t) / (1 + t)`` members. So if all n-grams are dealt
to one part more than that, by a hash, two such sets are equal within at least one part. Texts of a bucket are grouped by set
size so that a text and all larger ones it can be similar to are in one of two groups; each text has a key for each part,
the sum of its n-grams' hashes there, and texts with an equal key meet.

Texts that met are told apart by a row of bits: every n-gram flips one bit. Two rows differ in at most as many bits as the
sets differ in members. So a pair whose bits differ in more is none, whatever was hashed where, and only the others are
verified on their texts. A longer text has more bits, so that chance pairs differ in more than the bound; rows are folded
to the shorter one's length, and further where the bound is low.

A group is one task's; of groups of more than ``WHOLE`` texts each part is shared out by key. Where keys tell little (low
values, or a template that most texts of a group differ from in few places) all texts of the group are compared, above
``LARGE`` in blocks of like set sizes whose pairs are shared out: a text's row of bits is then shuffled once for each block
it meets, at most ``PIECES`` or one for each ``WIDEST`` texts. A filter by the rarest n-grams was tried before: texts of one
template and alphabet share them so often that nearly all pairs of a bucket met.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.normal_text import gram_codes, grams, similarity
from ..plans.scratch import cut

#: Texts of a group that are compared as one block; blocks of a larger group, and texts of a block at most.
LARGE, PIECES, WIDEST = 4096, 12, 32_768
#: Texts of a group whose keys are looked up by one task; verified pairs up to which texts are picked by a broadcast of ids.
WHOLE, FEW = 262_144, 200_000
#: Texts with an equal key that are taken pair by pair.
_RUN = 32
_BATCH = 2000
_ROWS, _COLUMNS = 16, 4096


def _codes(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of each text as numbers, text by text, and how many each has: packed code points for n = 3, else hashes."""
    texts = [" ".join(t.split()) for t in texts]
    if n != 3:
        import xxhash

        sets = [np.array([xxhash.xxh3_64_intdigest(g.encode("utf-8", "surrogatepass")) for g in grams(t, n)], np.uint64) for t in texts]
        return np.concatenate([np.empty(0, np.uint64), *sets]), np.array([len(s) for s in sets], np.int64)
    codes, whose = gram_codes(texts)
    points = np.unique(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32))
    each = np.bincount(whose, minlength=len(texts))
    wide, rows = max(1, int(len(points)).bit_length()), max(1, len(texts).bit_length())
    if 3 * wide + rows > 64 or (each == 0).all() or (codes >> np.uint64(63)).any():
        ends = np.cumsum([0, *each.tolist()])
        sets = [np.unique(codes[a:b]) for a, b in zip(ends, ends[1:])]
        return np.concatenate([np.empty(0, np.uint64), *sets]), np.array([len(s) for s in sets], np.int64)
    # the batch's code points are few, so that text and n-gram fit one number and one sort does for all texts
    rank = np.zeros(int(points[-1]) + 1, np.uint64)
    rank[points] = np.arange(len(points), dtype=np.uint64)
    low, own = np.uint64((1 << 21) - 1), np.uint64((1 << wide) - 1)
    packed = whose.astype(np.uint64) << np.uint64(3 * wide)
    for at in range(3):
        packed |= rank[(codes >> np.uint64(21 * at)) & low] << np.uint64(wide * at)
    packed.sort()
    packed = packed[np.concatenate([[True], packed[1:] != packed[:-1]])]
    points = points.astype(np.uint64)
    codes = np.zeros(len(packed), np.uint64)
    for at in range(3):
        codes |= points[((packed >> np.uint64(wide * at)) & own).astype(np.int64)] << np.uint64(21 * at)
    return codes, np.bincount((packed >> np.uint64(3 * wide)).astype(np.int64), minlength=len(texts))


def _sets(texts: list[str], n: int) -> list[np.ndarray]:
    codes, each = _codes(texts, n)
    ends = np.cumsum([0, *each.tolist()])
    return [codes[a:b] for a, b in zip(ends, ends[1:])]


def _roomy(width: int) -> float:
    """Differing members up to which rows of so many bits tell chance pairs apart: those differ in half of the bits, but for three deviations."""
    return width / 2 - 1.5 * width**0.5


def _width(size: int, threshold: float) -> int:
    """Bits for a set of that size; a larger similar one has at most ``size * (1 - t) / t`` other members."""
    width = 256
    while _roomy(width) < size * (1 - threshold) / threshold:
        width *= 2
    return width


def _mixed(codes: np.ndarray) -> np.ndarray:
    each = codes * np.uint64(0x9E3779B97F4A7C15)
    each ^= each >> np.uint64(29)
    each *= np.uint64(0xBF58476D1CE4E5B9)
    return each


def _rows_of_bits(sets: list[np.ndarray], widths: list[int]) -> list[bytes]:
    return _bits(_mixed(np.concatenate(sets)), np.array([len(s) for s in sets]), widths)


def _bits(mixed: np.ndarray, sizes: np.ndarray, widths: list[int]) -> list[bytes]:
    bit = (mixed >> np.uint64(32)).astype(np.int64) & (np.repeat(widths, sizes) - 1)
    starts = np.cumsum([0, *widths])
    odd = np.bincount(np.repeat(starts[:-1], sizes) + bit, minlength=starts[-1]) & 1
    packed = np.packbits(odd.astype(np.uint8)).tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(starts, starts[1:])]


@lru_cache(maxsize=16)
def _bounds(threshold: float, most: int) -> np.ndarray:
    """Least set size of each group of sizes, up to the group after that of ``most``: a set and its similar ones are in one group, or in neighbouring ones."""
    least = [1]
    while least[-1] <= most:
        least.append(int(least[-1] / threshold + 1e-9) + 1)
    return np.array([*least, int(least[-1] / threshold + 1e-9) + 1])


def _parts(largest: int, threshold: float) -> int:
    """Parts of which two similar sets up to that size have an equal one; 0 where parts would hold too few n-grams to tell sets apart."""
    parts = int(2 * largest * (1 - threshold) / (1 + threshold) + 1e-6) + 1
    return parts if parts == 1 or parts * 2 <= largest else 0


def _keys(mixed: np.ndarray, sizes: np.ndarray, parts: np.ndarray) -> list[bytes | None]:
    """A number of 32 bits for each part of each set."""
    each = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    each ^= each >> np.uint64(31)
    has = np.repeat(parts > 0, sizes)
    starts = np.concatenate([[0], np.cumsum(parts)])
    own = each[has]
    at = np.repeat(starts[:-1], sizes)[has] + ((own >> np.uint64(32)) % np.repeat(parts, sizes)[has].astype(np.uint64)).astype(np.int64)
    keys = np.zeros(starts[-1], np.uint32)
    np.add.at(keys, at, own.astype(np.uint32))
    held = keys.tobytes()
    return [held[4 * a : 4 * b] if b > a else None for a, b in zip(starts.tolist(), starts[1:].tolist())]


def _signed(n: int, threshold: float):
    """A row for each text: its group and the next one, with its keys there; the next one only where it has sets similar to it."""

    def first(keys: list[bytes | None]) -> pa.Array:
        return pa.array([int.from_bytes(k[:4], "little") if k else 0 for k in keys], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH):
                part = batch.slice(at, _BATCH)
                codes, sizes = _codes(part.column(2).to_pylist(), n)
                there = np.flatnonzero(sizes)
                if not len(there):
                    continue
                sizes, mixed = sizes[there], _mixed(codes)
                bits = _bits(mixed, sizes, [_width(s, threshold) for s in sizes.tolist()])
                least = _bounds(threshold, 1 << int(sizes.max()).bit_length())
                parts = np.array([_parts(int(a) - 1, threshold) for a in least[1:]])
                group = np.searchsorted(least, sizes, "right") - 1
                beyond = sizes >= least[group + 1] * (threshold - 1e-9)
                own, after = _keys(mixed, sizes, parts[group]), _keys(mixed, sizes, np.where(beyond, parts[np.minimum(group + 1, len(parts) - 1)], 0))
                bucket, tid, old = (part.column(i).take(pa.array(there)) for i in (0, 1, 3))
                columns = [bucket, tid, old, pa.array(sizes, pa.int32()), pa.array(bits, pa.binary()), pa.array(group, pa.int32()), pa.array(own, pa.binary()), first(own), pa.array(beyond), pa.array(after, pa.binary()), first(after)]
                yield pa.RecordBatch.from_arrays(columns, names=_COLUMNS_OF_SIGNED)

    return run


_COLUMNS_OF_SIGNED = ["bucket", "tid", "old", "size", "bits", "grp", "keys", "first", "beyond", "keys_after", "first_after"]


class _Block:
    """Texts in ascending order of set size, with their rows of bits at every length up to their own.

    ``old``: bits of what a pair must not have in common.
    """

    def __init__(self, tid: np.ndarray, old: np.ndarray, size: np.ndarray, bits: np.ndarray):
        self.order = order = np.argsort(size, kind="stable")
        self.tid, self.old, self.size = tid[order], old[order], size[order]
        rows = bits[order]
        # widths follow the sizes, so the texts of a width or more are the last ones
        self.width = np.fromiter((len(r) * 8 for r in rows), np.int64, len(rows))
        self.folded: dict[int, tuple[int, np.ndarray]] = {}
        width, held = int(self.width[-1]), None
        while width >= 64:
            first = int(np.searchsorted(self.width, width))
            own = np.frombuffer(b"".join(rows[first : int(np.searchsorted(self.width, width, "right"))]), np.uint64).reshape(-1, width // 64).T
            if held is not None:
                half = held[: width // 64] ^ held[width // 64 :]
                own = np.concatenate([own, half], axis=1) if own.size else half
            held = np.ascontiguousarray(own)
            self.folded[width] = (first, held)
            width //= 2

    def words(self, width: int, a: int, b: int) -> np.ndarray:
        first, held = self.folded[width]
        return held[:, a - first : b - first]


def _near(x: _Block, y: _Block, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (in x, in y) of the pairs whose bits allow the threshold; of one block with itself, each pair once."""
    share, found = (1 - threshold) / (1 + threshold), []
    for a in range(0, len(x.size), _ROWS):
        b = min(a + _ROWS, len(x.size))
        start = a if x is y else int(np.searchsorted(y.size, x.size[a] * (threshold - 1e-9)))
        end = int(np.searchsorted(y.size, x.size[b - 1] / (threshold - 1e-9), "right"))
        for c in range(start, end, _COLUMNS):
            d = min(c + _COLUMNS, end)
            most, longest = (int(x.size[b - 1]) + int(y.size[d - 1])) * share + 1e-6, int(min(x.width[a], y.width[c]))
            width = 64
            while width < longest and _roomy(width) < most:
                width *= 2
            apart = None
            for p, q in zip(x.words(width, a, b), y.words(width, c, d)):
                here = np.bitwise_count(p[:, None] ^ q[None, :])
                here = here if width < 256 else here.astype(np.uint16)
                apart = here if apart is None else np.add(apart, here, out=apart)
            at = np.flatnonzero(apart <= most)
            if not len(at):
                continue
            i, j = at // (d - c) + a, at % (d - c) + c
            if x is y:
                i, j = i[i < j], j[i < j]
            keep = ((x.old[i] & y.old[j]) == 0) & (np.minimum(x.size[i], y.size[j]) >= np.maximum(x.size[i], y.size[j]) * (threshold - 1e-9))
            i, j = i[keep], j[keep]
            if len(i):
                (f, p), (g, q) = x.folded[longest], y.folded[longest]
                differ = sum(np.bitwise_count(m[i - f] ^ n[j - g]).astype(np.int32) for m, n in zip(p, q))
                keep = differ <= (x.size[i].astype(np.int64) + y.size[j]) * share + 1e-6
                found.append((i[keep], j[keep]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _alike(x: _Block, keys: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a block that have an equal key and whose bits allow the threshold, each once. ``keys`` has a row for each part."""
    share, n, found = (1 - threshold) / (1 + threshold), len(x.size), []
    most = 2 * int(x.size[-1]) * share + 1e-6
    longest = width = int(x.width[0])
    while width > 64 and _roomy(width // 2) >= most:
        width //= 2
    near, whole = x.words(width, 0, n), x.words(longest, 0, n)

    def take(i: np.ndarray, j: np.ndarray, part: int) -> None:
        """Keeps those of the pairs that no earlier part had."""
        keep = ((x.old[i] & x.old[j]) == 0) & (np.minimum(x.size[i], x.size[j]) >= np.maximum(x.size[i], x.size[j]) * (threshold - 1e-9))
        i, j = i[keep], j[keep]
        for words in (near[:1], near[1:], whole if longest > width else whole[:0]):
            if len(i) and len(words):
                differ = sum(np.bitwise_count(w[i] ^ w[j]).astype(np.int32) for w in words)
                keep = differ <= (x.size[i].astype(np.int64) + x.size[j]) * share + 1e-6
                i, j = i[keep], j[keep]
        for earlier in keys[:part]:
            if not len(i):
                return
            keep = earlier[i] != earlier[j]
            i, j = i[keep], j[keep]
        if len(i):
            found.append((i, j))

    for part, key in enumerate(keys):
        order = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], key[order[1:]] != key[order[:-1]]]))
        lengths = np.diff(np.append(starts, n))
        short = (lengths > 1) & (lengths <= _RUN)
        # place of each text within its run of equal keys, and how many follow it there
        run = lengths[short]
        place = np.repeat(starts[short] + run, run)
        at = np.arange(len(place)) - np.repeat(np.cumsum(run) - run, run) + np.repeat(starts[short], run)
        for step in range(1, int(run.max()) if len(run) else 1):
            keep = at + step < place
            at, place = at[keep], place[keep]
            take(order[at], order[at + step], part)
        for start, length in zip(starts[lengths > _RUN].tolist(), lengths[lengths > _RUN].tolist()):
            own = order[start : start + length]
            size, words = x.size[own], np.ascontiguousarray(near[:, own])
            rows = 16 if length > 2048 else 64
            for a in range(0, length, rows):
                b = min(a + rows, length)
                end = int(np.searchsorted(size, size[b - 1] / (threshold - 1e-9), "right"))
                for c in range(a, end, _COLUMNS):
                    d = min(c + _COLUMNS, end)
                    apart = None
                    for w in words:
                        here = np.bitwise_count(w[a:b, None] ^ w[None, c:d])
                        here = here if width < 256 else here.astype(np.uint16)
                        apart = here if apart is None else np.add(apart, here, out=apart)
                    i, j = np.nonzero(apart <= (int(size[b - 1]) + int(size[d - 1])) * share + 1e-6)
                    i, j = i + a, j + c
                    keep = i < j
                    take(own[i[keep]], own[j[keep]], part)
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _telling(keys: np.ndarray) -> bool:
    """Whether equal keys, by those of four parts, bring up far fewer pairs than there are."""
    n, some = keys.shape[1], keys[:4]
    met = sum(int((np.unique(k, return_counts=True)[1].astype(np.int64) ** 2).sum()) for k in some)
    return met * len(keys) / len(some) * 2 < n * n


def _met(threshold: float):
    """Candidate pairs of rows (bucket, grp, p, q, block, tid, old, size, bits, keys) that are sorted by bucket, grp, p and q."""

    def pairs(key: tuple, parts: list[list[np.ndarray]]) -> pa.RecordBatch | None:
        blocks, *rest, keys = (np.concatenate(c) if len(c) > 1 else c[0] for c in zip(*parts))
        bucket, _, p, q = key
        first = blocks == p
        if len(blocks) < 2 or keys[0] is None and p != q and (first.all() or not first.any()):
            return None
        if keys[0] is not None:
            x = y = _Block(*rest)
            held = np.ascontiguousarray(np.frombuffer(b"".join(keys[x.order]), np.uint32).reshape(len(keys), -1).T)
            i, j = _alike(x, held, threshold) if p < 0 or len(keys) > 64 and _telling(held) else _near(x, x, threshold)
        else:
            x = _Block(*(c if p == q else c[first] for c in rest))
            y = x if p == q else _Block(*(c[~first] for c in rest))
            i, j = _near(x, y, threshold)
        if not len(i):
            return None
        a, b = x.tid[i], y.tid[j]
        return pa.RecordBatch.from_arrays([pa.array([bucket] * len(a), pa.string()), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["bucket", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            buckets, (g, p, q) = batch.column(0), (batch.column(i).to_numpy() for i in (1, 2, 3))
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4, 10)]
            names = pc.dictionary_encode(buckets).indices.to_numpy()
            ends = np.flatnonzero((np.diff(names) != 0) | (np.diff(g) != 0) | (np.diff(p) != 0) | (np.diff(q) != 0)) + 1
            for a, b in zip([0, *ends.tolist()], [*ends.tolist(), batch.num_rows]):
                own = (buckets[a].as_py(), int(g[a]), int(p[a]), int(q[a]))
                if own != key and held:
                    if (out := pairs(key, held)) is not None:
                        yield out
                    held = []
                key = own
                held.append([c[a:b] for c in columns])
        if held and (out := pairs(key, held)) is not None:
            yield out

    return run


def _candidates(signed: DataFrame, threshold: float) -> DataFrame:
    """(bucket, a, b), a < b, of all pairs that may reach the threshold."""
    spark = signed.sparkSession
    keys, columns = ["bucket", "grp"], ["bucket", "grp", "p", "q", "block", "tid", "old", "size", "bits", "keys"]
    # of two texts one is of the group itself, and one not old
    once = F.col("old").cast("int")
    rows = signed.select(*keys, "tid", once.alias("old"), "size", "bits", "keys", "first")
    rows = rows.unionByName(signed.where("beyond").select("bucket", (F.col("grp") + 1).alias("grp"), "tid", (once + 2).alias("old"), "size", "bits", F.col("keys_after").alias("keys"), F.col("first_after").alias("first")))
    zero = lambda c: F.lit(0).alias(c)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the keys of the first part stand for all
    met = rows.groupBy(*keys, "first").agg(F.count("*").alias("n"), F.max(F.coalesce(F.length("keys"), F.lit(0)) / 4).alias("parts"))
    groups = met.groupBy(*keys).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n") * F.col("parts")).alias("met"), F.max("parts").alias("parts")).where(F.col("total") > LARGE)
    all_meet = (F.col("parts") == 0) | (F.col("met") * 2 >= F.col("total") * F.col("total"))
    groups = cut(groups.select(*keys, "total", "parts", F.when(all_meet, "blocks").when(F.col("total") > WHOLE, "keys").alias("how")).where("how IS NOT NULL"), "groups")
    ways = {r["how"]: (int(r["total"]), float(r["tasks"])) for r in groups.groupBy("how").agg(F.sum("total").alias("total"), F.sum(F.col("parts") * F.ceil(F.col("total") / WHOLE)).alias("tasks")).collect()}
    if not ways:
        rows = rows.select(*keys, zero("p"), zero("q"), zero("block"), *columns[5:])
        return _compared(rows, parts, threshold)
    known = rows.join(F.broadcast(groups), keys, "left")
    out = known.where("how IS NULL").select(*keys, zero("p"), zero("q"), zero("block"), *columns[5:])
    if "keys" in ways:
        parts = max(parts, min(1000, int(ways["keys"][1])))
        shared = known.where("how = 'keys'").select("*", F.posexplode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("at", "_at"))
        shared = shared.withColumn("keys", F.substring("keys", F.col("at") * 4 + 1, F.lit(4)))
        where = F.pmod(F.xxhash64("keys"), F.ceil(F.col("total") / WHOLE)).cast("int")
        out = out.unionByName(shared.select(*keys, (-1 - F.col("at")).alias("p"), where.alias("q"), zero("block"), *columns[5:]))
    if "blocks" in ways:
        about = Window.partitionBy(*keys)
        dense = known.where("how = 'blocks'")
        sizes = dense.groupBy(*keys, "size").agg(F.count("*").alias("n")).withColumn("total", F.sum("n").over(about))
        sizes = cut(sizes.withColumn("before", F.sum("n").over(about.orderBy("size")) - F.col("n")).withColumn("each", F.greatest(F.lit(LARGE), F.least(F.lit(WIDEST), F.ceil(F.col("total") / PIECES)))), "sizes")
        place = lambda at: F.floor(at / F.col("each")).cast("int")
        blocks = sizes.select(*keys, "size", F.explode(F.sequence(place(F.col("before")), place(F.col("before") + F.col("n") - 1))).alias("block")).groupBy(*keys, "block").agg(F.min("size").alias("least"), F.max("size").alias("most"))
        x, y = blocks.alias("x"), blocks.alias("y")
        meet = (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.grp") == F.col("y.grp")) & (F.col("x.block") <= F.col("y.block")) & (F.col("x.most") >= F.col("y.least") * (threshold - 1e-9))
        pairs = cut(x.join(y, meet).select(F.col("x.bucket").alias("bucket"), F.col("x.grp").alias("grp"), F.col("x.block").alias("p"), F.col("y.block").alias("q")), "blocks")
        # tasks are few bytes and much comparing, so their number follows the pairs of blocks
        parts = max(parts, min(1000, pairs.count()))
        slots = pairs.select(*keys, "p", "q", F.explode(F.array_distinct(F.array("p", "q"))).alias("block"))
        # a text's place within its set size is a hash of its id
        placed = dense.drop("total").join(sizes, [*keys, "size"]).withColumn("block", place(F.col("before") + F.pmod(F.xxhash64("tid"), F.col("n"))))
        out = out.unionByName(placed.withColumn("keys", F.lit(None).cast("binary")).join(slots, [*keys, "block"]).select(*columns))
    found = _compared(out, parts, threshold)
    return found.distinct() if "keys" in ways else found


def _compared(rows: DataFrame, parts: int, threshold: float) -> DataFrame:
    rows = rows.repartition(parts, "bucket", "grp", "p", "q").sortWithinPartitions("bucket", "grp", "p", "q")
    return rows.mapInArrow(_met(threshold), "bucket string, a long, b long")


def _verified(n: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known: dict[tuple, set] = {}
            out: list[tuple] = []
            for bucket, a, b, x, y in zip(*(batch.column(i).to_pylist() for i in range(5))):
                for key, text in (((bucket, a), x), ((bucket, b), y)):
                    if key not in known:
                        known[key] = grams(text, n)
                value = similarity(known[bucket, a], known[bucket, b])
                if value >= threshold:
                    out.append((bucket, a, b, value))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.float64()))], names=["bucket", "a", "b", "jaccard"])

    return run


def similar_edges(texts: DataFrame, n: int, threshold: float, old: Column | None = None) -> DataFrame:
    """(bucket, a, b, jaccard) of all pairs a < b of one bucket of (bucket, tid, norm) at the threshold or more.

    Every text is in its bucket once, under a tid of its own. Two texts for which ``old`` is true are not compared.
    Empty texts have no pair, nor have null ones; an empty table gives no rows. Nothing is capped.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be above 0")
    held = cut(texts.where("norm <> ''").select("bucket", "tid", "norm", (F.lit(False) if old is None else old).alias("old")), "texts")
    signed = cut(held.mapInArrow(_signed(n, threshold), "bucket string, tid long, old boolean, size int, bits binary, grp int, keys binary, first long, beyond boolean, keys_after binary, first_after long"), "bits")
    pairs = cut(_candidates(signed, threshold), "pairs")
    named = held.select("bucket", "tid", "norm")
    if pairs.count() <= FEW:
        # the others' texts aren't shuffled
        ids = pairs.select("bucket", F.col("a").alias("tid")).unionByName(pairs.select("bucket", F.col("b").alias("tid"))).distinct()
        named = cut(named.join(F.broadcast(ids), ["bucket", "tid"], "left_semi"), "named")
    left, right = (named.select("bucket", F.col("tid").alias(c), F.col("norm").alias(c + "_text")) for c in ("a", "b"))
    both = pairs.join(left, ["bucket", "a"]).join(right, ["bucket", "b"]).select("bucket", "a", "b", "a_text", "b_text")
    return both.mapInArrow(_verified(n, threshold), "bucket string, a long, b long, jaccard double")
