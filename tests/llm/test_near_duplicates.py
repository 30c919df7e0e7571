"""Near-duplicate classes and incremental batches against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.functions.normal_text import gram_set, jaccard, normal
from corpusmill.llm import batch_dedup
from corpusmill.llm import near_duplicates as ND
from corpusmill.llm.batch_dedup import BatchDeduplicator, repeats_of_earlier_batches
from corpusmill.llm.fingerprint import blocks, most_differing, sketch


def family(rng, text, n):
    """Altered versions: swapped letters, dropped words, changed case."""
    out = []
    for _ in range(n):
        words = text.split()
        for _ in range(rng.randrange(0, 3)):
            i = rng.randrange(len(words))
            words[i] = words[i][::-1] if rng.random() < 0.5 else words[i] + "х"
        out.append((" ".join(words)).upper() if rng.random() < 0.2 else " ".join(words))
    return out


def collection(seed, families=25, singles=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ка", "ро", "ми", "зу", "тел", "вин", "ста", "кру"]) for _ in range(rng.randrange(1, 5)))
    text = lambda: " ".join(word() for _ in range(rng.randrange(8, 60)))
    texts = [t for _ in range(families) for t in family(rng, text(), rng.randrange(1, 7))] + [text() for _ in range(singles)]
    texts += [None, "", "  ", "короткий", texts[0], texts[0], texts[1]]
    rng.shuffle(texts)
    return texts


def brute(texts, threshold=0.75, least=40):
    held = [(i, normal(t)) for i, t in texts if t is not None and len(normal(t)) >= least]
    parent = {i: i for i, _ in held}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, gram_set(t)) for i, t in held]
    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            if jaccard(x, y) >= threshold:
                ri, rj = root(i), root(j)
                parent[max(ri, rj)] = min(ri, rj)
    return {(i, root(i)) for i, _ in held if root(i) != i}


def table(spark, texts):
    return spark.createDataFrame([(i, t, "clash", i % 4) for i, t in texts], "key long, body string, id string, node int")


def test_classes_equal_brute_force(spark):
    texts = list(enumerate(collection(3)))
    got = {(r["id"], r["first_id"]) for r in ND.near_duplicate_classes(table(spark, texts), "key", "body").where("id <> first_id").collect()}
    want = brute(texts)
    assert want and got == want


def test_crowded_buckets_take_the_exact_way_round(spark):
    """With every bucket of two or more counted as crowded the classes stay the same."""
    of = (np.repeat(np.int64(7), 40), np.arange(40), [np.zeros(40, np.uint64)] * 2, 10)
    a, b, member = ND.bucket_pairs(*of, 1, 1)
    assert len(a) == len(b) == 0 and len(member) == 40
    a, b, member = ND.bucket_pairs(*of)
    assert len(a) == 780 and len(member) == 0
    a, b, member = ND.bucket_pairs(*of, hot=np.arange(40) == 3)
    assert len(a) == 0 and len(member) == 40
    texts = list(enumerate(collection(4, 8, 10)))
    for how in ({"small": 1, "wide": 1}, {"crowd": 1}):
        got = {(r["id"], r["first_id"]) for r in ND.near_duplicate_classes(table(spark, texts), "key", "body", **how).where("id <> first_id").collect()}
        assert got == brute(texts)


def test_many_copies_and_one_family(spark):
    base = "сегодня мы записали номер телефона и проверили его два раза подряд"
    texts = [(i, base if i % 3 else f"{base} раз {i}") for i in range(900)] + [(1000, None), (1001, "совсем другой текст, который ни на что здесь не похож, правда")]
    rows = ND.near_duplicate_classes(table(spark, texts), "key", "body").collect()
    assert {r["first_id"] for r in rows} == {0} and len(rows) == 900


def test_empty_and_tiny_tables(spark):
    for texts in ([], [(1, None)], [(1, "а")], [(1, "длинный текст без пары, которого в таблице больше нет нигде")]):
        assert ND.near_duplicate_classes(table(spark, texts), "key", "body").count() == 0


def test_very_long_text(spark):
    long = " ".join(f"слово{i % 977}" for i in range(60_000))
    rows = ND.near_duplicate_classes(table(spark, [(1, long), (2, long + " конец")]), "key", "body").collect()
    assert {(r["id"], r["first_id"]) for r in rows} == {(1, 1), (2, 1)}


def test_fingerprints_follow_similarity():
    rng = random.Random(9)
    text = " ".join("".join(rng.choice("абвгдежз") for _ in range(6)) for _ in range(60))
    other = text[:150] + "яяя" + text[160:]
    words = blocks([normal(text), normal(other), normal(text[::-1])])
    assert words.shape == (3, 40)
    s = sketch(words).view(np.uint64)
    apart = lambda i, j: int(np.bitwise_count(s[i] ^ s[j]).sum())
    assert apart(0, 1) < most_differing(128, 0.75) < apart(0, 2)


@pytest.mark.parametrize("seed", [5])
def test_batches_equal_one_pass(spark, seed):
    texts = list(enumerate(collection(seed)))
    df = spark.createDataFrame([(i, t, i * 4 // len(texts)) for i, t in texts], "key long, body string, batch int")
    classes = brute(texts)
    first = dict(classes)
    least = {}
    for i, _ in texts:
        least[first.get(i, i)] = min(least.get(first.get(i, i), 99), i * 4 // len(texts))
    want = {(f, i) for i, f in classes if i * 4 // len(texts) > least[f]}
    got = {(r["first_id"], r["id"]) for r in repeats_of_earlier_batches(df, "key", "batch", "body").collect()}
    assert want and got == want


def test_ingest_finds_history_and_bridges(spark):
    a = "раз два три четыре пять шесть семь восемь девять десять одиннадцать двенадцать тринадцать"
    state = BatchDeduplicator(spark)
    make = lambda rows: spark.createDataFrame(rows, "id long, text string")
    assert state.ingest(make([(1, a), (2, None)]), "id", "text").count() == 0
    assert {tuple(r) for r in state.ingest(make([(3, a.upper()), (4, a + " да"), (5, "x")]), "id", "text").collect()} == {(3, 1), (4, 1)}
    assert state.ingest(make([]), "id", "text").count() == 0
    assert {(r["id"], r["first_id"]) for r in state.classes().collect()} == {(1, 1), (3, 1), (4, 1)}
    state.close()


def test_bridge_to_an_old_text_in_a_large_block(spark, monkeypatch):
    """A new text that links to the first text of a large block also meets an old member outside that one's class."""
    rng = random.Random(11)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(6))
    top = [word("абвгдежзиклмнопрст") for _ in range(60)]
    old = [word("уфхцчшщыэюя") for _ in range(8)] + top[8:]
    bridge = old[:4] + top[4:]
    top, old, bridge = (" ".join(t) for t in (top, old, bridge))
    x, y, z = (gram_set(normal(t)) for t in (top, old, bridge))
    assert jaccard(x, y) < 0.8 <= min(jaccard(x, z), jaccard(y, z))
    others = [" ".join(word("абвгдежзиклмнопрст") for _ in range(20)) for _ in range(40)]
    features = batch_dedup._features

    def one_block(batches, least_chars):
        for batch in features(batches, least_chars):
            yield batch.set_column(5, "keys", pa.array([[7]] * batch.num_rows, pa.list_(pa.int64())))

    monkeypatch.setattr(batch_dedup, "_features", one_block)
    state = BatchDeduplicator(spark, threshold=0.8)
    make = lambda rows: spark.createDataFrame(rows, "id long, text string")
    assert state.ingest(make([(1, top), (2, old), *enumerate(others, 100)]), "id", "text").count() == 0
    assert {tuple(r) for r in state.ingest(make([(900, bridge)]), "id", "text").collect()} == {(900, 1), (900, 2)}
    assert {(r["id"], r["first_id"]) for r in state.classes().collect()} == {(1, 1), (2, 1), (900, 1)}
    state.close()


def test_state_is_opened_again_and_a_failed_ingest_repeated(spark, tmp_path, monkeypatch):
    """A second process goes on from the folder; what an uncommitted ingest left is overwritten; block files are merged."""
    folder = str(tmp_path / "state")
    texts = list(enumerate(collection(6, 12, 20)))
    make = lambda part: spark.createDataFrame(part, "id long, text string")
    n = len(texts)
    for k, (lo, hi) in enumerate(((0, n // 2), (n // 2, n * 3 // 4), (n * 3 // 4, n))):
        state = BatchDeduplicator(spark, folder, compact_every=2)
        assert state.batches == k
        if k == 1:
            monkeypatch.setattr(BatchDeduplicator, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
            with pytest.raises(RuntimeError):
                state.ingest(make(texts[lo:hi]), "id", "text")
            monkeypatch.undo()
            state.close()
            state = BatchDeduplicator(spark, folder, compact_every=2)
            assert state.batches == 1
        state.ingest(make(texts[lo:hi]), "id", "text")
        state.close()
    state = BatchDeduplicator(spark, folder)
    assert (state.batches, state.merged) == (3, 2)
    assert {(r["id"], r["first_id"]) for r in state.classes().where("id <> first_id").collect()} == brute(texts)
    state.close()
    with pytest.raises(ValueError):
        BatchDeduplicator(spark, folder, threshold=0.9)


def test_new_text_joins_a_crowded_history(spark):
    """300 old variants of which hardly two are linked, and one new text linked to each: all are one class, as in problem 5."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("абвгдежзиклмнопрстуф") for _ in range(7))
    base = [word() for _ in range(60)]

    def variant():
        out = list(base)
        for i in rng.sample(range(60), 7):
            out[i] = word()
        return " ".join(out)

    old = [(i, variant()) for i in range(300)]
    new = (900, " ".join(base))
    least = min(jaccard(gram_set(normal(t)), gram_set(normal(new[1]))) for _, t in old)
    assert least >= 0.75 and len(brute(old)) < 30
    state = BatchDeduplicator(spark)
    make = lambda rows: spark.createDataFrame(rows, "id long, text string")
    state.ingest(make(old), "id", "text")
    state.ingest(make([new]), "id", "text")
    got = {(r["id"], r["first_id"]) for r in state.classes().collect()}
    state.close()
    # two texts at 0.75 to 0.8 share none of 40 words in up to 1.5 % of cases, and every member has one link here
    assert {f for _, f in got} == {0} and len(got) >= 297
    whole = {r["id"] for r in ND.near_duplicate_classes(make([*old, new]).withColumnRenamed("id", "key").withColumnRenamed("text", "body"), "key", "body").collect()}
    assert {i for i, _ in got} <= whole and len(whole) >= len(got)


def test_no_batches(spark):
    df = spark.createDataFrame([], "key long, body string, batch int")
    assert repeats_of_earlier_batches(df, "key", "batch", "body").count() == 0
