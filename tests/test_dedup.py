"""Closed forms against a sequential model."""

import os
import random
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from corpusmill.functions.normal_text import gram_set, grams, jaccard, normal, similarity
from corpusmill.operators import dedup as D
from corpusmill.plans.scratch import cut

WORDS = ["да", "нет", "Может", "быть", "ну", "что", "там"]


def stream(seed, n=60, rules=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 6)))
        if rows and rng.random() < 0.4:
            text = rng.choice(rows)[2]
            if rng.random() < 0.6:
                text += rng.choice(["!", " да", "х", "."])
        rows.append((f"r{rng.randrange(rules)}", i, text))
    return rows


def sequential(rows, p, prior=()):
    state, out = {}, {}
    for rule, seq, text in [*prior, *rows]:
        b = p.name if p.scope == "global" else f"{rule}:{p.name}"
        seen, quota, recent = state.setdefault(b, (set(), Counter(), deque(maxlen=max(1, p.max_compare))))
        n = normal(text or "")
        prefix = " ".join(n.split()[: p.prefix_words])
        if p.exact and n in seen:
            v = D.EXACT
        elif p.prefix_enabled and quota[prefix] >= p.prefix_max:
            v = D.PREFIX
        elif p.ngram_enabled and any(jaccard(gram_set(n), g) >= p.threshold for g in recent):
            v = D.NEAR
        else:
            v = D.OK
            seen.add(n)
            quota[prefix] += 1
            recent.append(gram_set(n))
        out[rule, seq] = v
    return {(r, s): out[r, s] for r, s, _ in rows}


POLICIES = [
    D.DedupPolicy("a", ngram_enabled=False, prefix_words=2, prefix_max=3),
    D.DedupPolicy("b", ngram_enabled=False, prefix_enabled=False),
    D.DedupPolicy("c", exact=False, ngram_enabled=False, prefix_words=1, prefix_max=4),
    D.DedupPolicy("d", prefix_words=2, prefix_max=4, threshold=0.7, max_compare=3),
    D.DedupPolicy("e", scope="global", prefix_enabled=False, threshold=0.6, max_compare=0),
    D.DedupPolicy("f", exact=False, prefix_enabled=False, threshold=0.8, max_compare=5),
]


@pytest.mark.parametrize("policy", POLICIES, ids=lambda p: p.name)
def test_verdicts_equal_the_sequential_ones(spark, policy):
    for seed in (1, 2):
        rows = stream(seed)
        df = spark.createDataFrame([(*r, "clash") for r in rows], "rule_id string, seq long, text string, extra string")
        got = {(r["rule_id"], r["seq"]): r["verdict"] for r in D.dedup(df, policy).collect()}
        assert got == sequential(rows, policy)


def test_resumed_in_two_halves(spark):
    policy = POLICIES[3]
    rows = stream(7, 80)
    whole = sequential(rows, policy)
    make = lambda part: spark.createDataFrame(part, "rule_id string, seq long, text string")
    first = D.dedup(make(rows[:40]), policy)
    later = D.dedup(make(rows[40:]), policy, prior=first.where("verdict = 'ok'").select("rule_id", "seq", "text"))
    got = {(r["rule_id"], r["seq"]): r["verdict"] for part in (first, later) for r in part.collect()}
    assert got == whole


def test_many_rows_equal_the_sequential_ones(spark):
    """20,000 rows of few buckets with repeats, full prefixes and similar texts; every text is accepted once."""
    rng = random.Random(3)
    words = ["".join(rng.choice("абвгдежз") for _ in range(rng.randrange(2, 6))) for _ in range(60)]
    rows = []
    for i in range(20_000):
        if rows and rng.random() < 0.5:
            text = rng.choice(rows[-400:])[2]
            text = text + rng.choice(["!", " да", "х", " ё"]) if rng.random() < 0.5 else text
        else:
            text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))
        rows.append(("r" if rng.random() < 0.8 else f"s{i % 3}", i, text))
    policy = D.DedupPolicy("m", prefix_words=2, prefix_max=12, threshold=0.8, max_compare=150)
    df = spark.createDataFrame(rows, "rule_id string, seq long, text string").repartition(13)
    got = {(r["rule_id"], r["seq"]): r["verdict"] for r in D.dedup(df, policy).collect()}
    want = sequential(rows, policy)
    assert got == want and set(Counter(want.values())) == {D.OK, D.EXACT, D.PREFIX, D.NEAR}


def test_no_text_is_accepted_twice_at_size(spark):
    """The largest given tables: every row has one verdict, no text is accepted twice and no prefix is over its quota."""
    from corpusmill.plans import queries as Q

    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        pytest.skip("the given tables are not here")
    stream_ = Q._stream(spark, folder)
    out = cut(D.prepare(D.dedup(stream_, Q.FULL), Q.FULL).select("bucket", "seq", "norm", "prefix", "verdict"))
    ok = out.where("verdict = 'ok'")
    assert out.count() == stream_.count() == out.select("bucket", "seq").distinct().count()
    assert ok.groupBy("bucket", "norm").count().where("count > 1").isEmpty() and ok.groupBy("bucket", "prefix").count().where(F.col("count") > Q.FULL.prefix_max).isEmpty()


@pytest.mark.parametrize("ngrams", [True, False])
@pytest.mark.parametrize("exact", [True, False])
def test_prior_rows_are_state_whatever_they_are(spark, ngrams, exact):
    """Prior rows that the policy would reject still count, as they were accepted before; rows without a number of their own too."""
    policy = D.DedupPolicy("p", exact=exact, prefix_words=1, prefix_max=3, threshold=0.7, max_compare=2, ngram_enabled=ngrams)
    make = lambda part: spark.createDataFrame(part, "rule_id string, seq long, text string")
    prior = [("r", 0, "один два три четыре"), ("r", 0, "один два три четыре"), ("r", 0, "один два три четыре!!"), ("r", 4, "семь восемь девять десять"), ("r", 5, "шесть")]
    rows = [("r", 1, "один другой текст"), ("r", 2, "семь восемь девять десят"), ("r", 3, "шесть"), ("r", 4, "новый"), ("r", 5, "новый"), ("r", 6, "один два три четыре")]
    got = {r["seq"]: r["verdict"] for r in D.dedup(make(rows), policy, prior=make(prior)).collect()}
    near, twice = (D.NEAR if ngrams else D.OK), (D.EXACT if exact else D.NEAR if ngrams else D.OK)
    assert got == {1: D.PREFIX, 2: near, 3: twice, 4: D.OK, 5: twice, 6: D.EXACT if exact else D.PREFIX}


@pytest.mark.parametrize("settings", [{}, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}, {"spark.sql.adaptive.enabled": "false"}], ids=["default", "uncoalesced", "static"])
@pytest.mark.parametrize("buckets", [1, 1000])
def test_running_count_of_many_rows(spark, settings, buckets):
    """Every row comes back with the right number, whatever the partitions are."""
    settings = {"spark.sql.shuffle.partitions": "32", **settings}
    before = {k: spark.conf.get(k, None) for k in settings}
    n = 400_000
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        seq = F.pmod(F.col("id") * 7919, F.lit(n))
        rows = spark.range(n).select(F.format_string("b%d", F.pmod(seq, F.lit(buckets))).alias("bucket"), seq.alias("seq"))
        # every second row of a bucket has the flag: before the j-th row there are (j + 1) // 2
        place = F.floor(F.col("seq") / buckets)
        got = D.running_count(rows, F.pmod(F.floor(F.col("seq") / buckets), F.lit(2)) == 0, "k")
        wrong, found = got.agg(F.sum((F.col("k") != F.floor((place + 1) / 2)).cast("long")).alias("w"), F.countDistinct("seq").alias("n")).first()
        assert (wrong, found) == (0, n)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_cap_and_rules_in_order(spark):
    rows = [("r0", i, f"t {i}") for i in range(6)] + [("r1", i, f"t {i}") for i in range(6)]
    df = spark.createDataFrame(rows, "rule_id string, seq long, text string")
    policy = D.DedupPolicy("g", scope="global", prefix_enabled=False, ngram_enabled=False)
    got = {(r["rule_id"], r["seq"]): r["verdict"] for r in D.dedup_rules_in_order(df, policy, [("r0", 2), ("r1", 3)]).collect()}
    assert [got["r0", i] for i in range(6)] == ["ok", "ok"] + ["unprocessed"] * 4
    assert [got["r1", i] for i in range(6)] == ["duplicate_exact", "duplicate_exact", "ok", "ok", "ok", "unprocessed"]
    zero = D.cap(D.dedup(df, policy), spark.createDataFrame([("r0", 0)], "rule_id string, target int"))
    assert {r["verdict"] for r in zero.where("rule_id = 'r0'").collect()} == {"unprocessed"}


def test_empty_table_nulls_and_ties(spark):
    for policy in POLICIES:
        empty = spark.createDataFrame([], "rule_id string, seq long, text string")
        assert D.dedup(empty, policy).count() == 0
        rows = spark.createDataFrame([(None, 1, None), (None, 2, None), ("r", 3, "")], "rule_id string, seq long, text string")
        assert D.dedup(rows, policy).count() == 3


@pytest.mark.parametrize("n", [3, 2, 4])
def test_edges_equal_brute_force(spark, n):
    rng = random.Random(5)
    base = ["".join(rng.choice("абвгд 😀") for _ in range(40)).strip() for _ in range(12)]
    texts = sorted({normal(b[: rng.randrange(20, 41)] + rng.choice(["", "x", "yz"])) for b in base for _ in range(4)} | {"а", "аб", ""})
    df = spark.createDataFrame([("b", i, t, i % 5 == 0) for i, t in enumerate(texts)], "bucket string, tid long, norm string, before boolean")
    sets = [grams(t, n) for t in texts]
    for t in (0.6, 0.88):
        got = {(r["a"], r["b"]) for r in D.similar_edges(df, n, t).collect()}
        want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if texts[i] and similarity(sets[i], sets[j]) >= t}
        assert got == want and (t > 0.8 or want)
    new = {(r["a"], r["b"]) for r in D.similar_edges(df, n, 0.6, F.col("before")).collect()}
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if texts[i] and (i % 5 or j % 5) and similarity(sets[i], sets[j]) >= 0.6}
    assert new == want and D.similar_edges(df.limit(0), n, 0.6).count() == 0
    with pytest.raises(ValueError):
        D.similar_edges(df, n, 0)


def test_similar_replies_equal_brute_force(spark, tmp_path):
    from corpusmill.plans.queries import QUERIES

    rng = random.Random(8)
    word = lambda: "".join(rng.choice("абвгдежз") for _ in range(5))
    base = [" ".join(word() for _ in range(40)) for _ in range(6)]
    rows = [(i, rng.choice(["r", "s", None]), (rng.choice(base) + rng.choice(["", " да", " ещё " + word(), "!"])) if i % 9 else None) for i in range(80)]
    spark.createDataFrame(rows, "response_id long, rule_id string, raw_text string").write.parquet(f"{tmp_path}/api_response.parquet")
    got = {(r["bucket"], r["first_id"], r["response_id"]) for r in QUERIES["similar_replies"](spark, str(tmp_path)).collect()}
    first = {}
    for i, rule, text in rows:
        if text is not None:
            first.setdefault((rule or "", normal(text)), i)
    held = sorted((b, i, grams(t, 3)) for (b, t), i in first.items())
    want = {(b, i, j) for b, i, x in held for c, j, y in held if b == c and i < j and similarity(x, y) >= 0.88}
    assert want and got == want


def _templated(rng, count, length):
    """Texts of one template and few words, some of them nearly equal."""
    words = ["".join(rng.choice("абвгдежзик") for _ in range(6)) for _ in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(length(rng))) for _ in range(count)]
    return sorted({normal(b) for b in base} | {normal(b + rng.choice([" да", " нет", ""]) + b[: rng.randrange(9)]) for b in base[::3]})


def test_large_bucket_meets_by_blocks(spark, monkeypatch):
    from corpusmill.operators import similarity as S

    # blocks of 40 texts, of any length up to several thousand n-grams
    monkeypatch.setattr(S, "LARGE", 40)
    monkeypatch.setattr(S, "WIDEST", 50)
    rng = random.Random(11)
    texts = _templated(rng, 200, lambda r: r.choice([4, 12, 12, 12, 40, 300]))
    rows = [("hot", i, t, i % 4 == 0) for i, t in enumerate(texts)] + [("few", i, t, False) for i, t in enumerate(texts[:9])]
    sets = [grams(t, 3) for t in texts]
    df = spark.createDataFrame(rows, "bucket string, tid long, norm string, before boolean")
    for t in (0.75, 1.0):
        want = {("hot", i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if (i % 4 or j % 4) and similarity(sets[i], sets[j]) >= t}
        few = {("few", i, j) for i in range(9) for j in range(i + 1, 9) if similarity(sets[i], sets[j]) >= t}
        got = [(r["bucket"], r["a"], r["b"]) for r in S.similar_edges(df, 3, t, F.col("before")).collect()]
        assert len(got) == len(set(got)) and set(got) == want | few and (want or t == 1.0)


def test_chance_pairs_of_a_template_are_not_verified():
    import numpy as np
    from corpusmill.operators import similarity as S

    # all pairs share many n-grams, also rare ones; the texts of a bucket all met before
    rng = random.Random(12)
    texts = _templated(rng, 600, lambda r: r.randrange(20, 30))
    sets = S._sets(texts, 3)
    held = np.array(S._rows_of_bits(sets, [S._width(len(s), 0.75) for s in sets]), object)
    block = S._Block(np.arange(len(texts)), np.zeros(len(texts), bool), np.array([len(s) for s in sets]), held)
    i, j = S._near(block, block, 0.75)
    met = {frozenset((int(block.tid[a]), int(block.tid[b]))) for a, b in zip(i, j)}
    want = {frozenset((a, b)) for a in range(len(texts)) for b in range(a) if similarity(grams(texts[a], 3), grams(texts[b], 3)) >= 0.75}
    assert want and want <= met and len(met) == len(i) <= 2 * len(want)


def test_only_texts_with_an_equal_part_meet(spark, monkeypatch):
    import numpy as np
    from corpusmill.operators import similarity as S

    rng = random.Random(13)
    words = ["".join(rng.choice("абвгдежзиклмнопрст") for _ in range(6)) for _ in range(500)]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 8, 9, 10, 11]))) for _ in range(300)]
    texts = sorted({normal(b) for b in base} | {normal(b + rng.choice([" да", "а", " не"])) for b in base[::2]})
    sets = [grams(t, 3) for t in texts]
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if similarity(sets[i], sets[j]) >= 0.86}
    # far fewer pairs have an equal key than there are, and none that is similar is lost
    codes, sizes = S._codes(texts, 3)
    parts = np.full(len(texts), S._parts(int(sizes.max()), 0.86))
    mixed = S._mixed(codes)
    block = S._Block(np.arange(len(texts)), np.zeros(len(texts), np.int64), sizes, np.array(S._bits(mixed, sizes, [64] * len(texts)), object))
    keys = np.array(S._keys(mixed, sizes, parts), object)[block.order]
    keys = np.ascontiguousarray(np.frombuffer(b"".join(keys), np.uint32).reshape(len(texts), -1).T)
    i, j = S._alike(block, keys, 0.86)
    met = [(min(a, b), max(a, b)) for a, b in zip(block.tid[i].tolist(), block.tid[j].tolist())]
    assert want and S._telling(keys) and want <= set(met) and len(met) == len(set(met)) < 2 * len(want)
    # parts that are shared out by key give each pair once
    monkeypatch.setattr(S, "LARGE", 30)
    monkeypatch.setattr(S, "WHOLE", 40)
    df = spark.createDataFrame([("b", i, t, i % 4 == 0) for i, t in enumerate(texts)], "bucket string, tid long, norm string, before boolean")
    got = [(r["a"], r["b"]) for r in S.similar_edges(df, 3, 0.86, F.col("before")).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, j) for i, j in want if i % 4 or j % 4}
