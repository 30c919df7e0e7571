"""Column expressions against plain Python on adversarial strings."""

import random
import re

from pyspark.sql import functions as F

from corpusmill.functions import normalize as NZ
from corpusmill.functions import numbers as N
from corpusmill.functions import text as X
from corpusmill.functions.normal_text import gram_set, jaccard, least_overlap, normal

PIECES = ["а", "Ё", "ё", "b", "Z", " ", "\t", "\n", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "٣", "²", "7", "🙂", '"', "«", "»", "(", "]", ".", ",", "!", "слово", "word", "\r\n", ""]


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(0, 14))) for _ in range(n)] + ["", " ", "\xa0", "a" * 3000, "я" * 5]


def column(spark, texts, **expressions):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return {r["i"]: r for r in df.select("i", *(e.alias(k) for k, e in expressions.items())).collect()}


def test_measures_agree_with_python(spark):
    texts = corpus()
    t = F.col("t")
    got = column(spark, texts, words=X.count_words(t), cyr=X.count_cyrillic(t), lat=X.count_latin(t), digit=X.contains_digit(t), col=X.collapse_spaces(t), strip=X.strip(t), lines=X.split_lines(t), occ=X.occurrences(t, "а"))
    for i, s in enumerate(texts):
        r = got[i]
        assert r["words"] == len(re.findall(r"\S+", s))
        assert r["cyr"] == len(re.findall("[ЁёА-Яа-я]", s)) and r["lat"] == len(re.findall("[A-Za-z]", s))
        assert r["digit"] == bool(re.search(r"\d", s))
        assert r["col"] == re.sub(r"\s+", " ", s).strip() and r["strip"] == s.strip()
        assert [x for x in r["lines"] if x] == [x for x in s.splitlines() if x]
        assert r["occ"] == s.count("а")


def test_normalization_prefix_and_ngrams(spark):
    texts = corpus(seed=2)
    norm = NZ.normalize(F.col("t"))
    got = column(spark, texts, norm=norm, p3=NZ.prefix_key(norm, 3), m1=NZ.prefix_key(norm, -1), zero=NZ.prefix_key(norm, 0), grams=NZ.char_ngrams(norm, 3), raw=NZ.normalize(F.col("t"), lowercase=False, trim_punctuation=False))
    for i, s in enumerate(texts):
        n, r = normal(s), got[i]
        assert r["norm"] == n and r["zero"] == ""
        assert r["p3"] == " ".join(n.split()[:3]) and r["m1"] == " ".join(n.split()[:-1])
        flat = re.sub(r"\s+", " ", n.strip())
        want = set() if not flat else {flat} if len(flat) <= 3 else {flat[k : k + 3] for k in range(len(flat) - 2)}
        assert set(r["grams"]) == want and len(r["grams"]) == len(want)
        assert r["raw"] == re.sub(r"\s+", " ", s.strip()).replace("ё", "е").replace("Ё", "Е")


def test_jaccard_of_both_forms(spark):
    pairs = [("", ""), ("", "abc"), ("abcdef", "abcdeg"), ("abc", "abc"), ("ab", "ab")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [r["j"] for r in df.select(NZ.jaccard(NZ.char_ngrams(F.col("a"), 3), NZ.char_ngrams(F.col("b"), 3)).alias("j")).collect()]
    assert got == [1.0, 0.0, 3 / 5, 1.0, 1.0]
    assert [jaccard(gram_set(a), gram_set(b)) for a, b in pairs] == got
    assert least_overlap(4, 4, 0.75) == 4 and least_overlap(7, 7, 0.75) == 6


def test_nulls_give_nulls(spark):
    df = spark.createDataFrame([(None,)], "t string")
    t = F.col("t")
    row = df.select(X.count_words(t).alias("a"), NZ.normalize(t).alias("b"), X.collapse_spaces(t).alias("c"), NZ.prefix_key(NZ.normalize(t), 2).alias("d")).first()
    assert all(v is None for v in row)


def test_lists_and_mappings(spark):
    df = spark.createDataFrame([(["a", "b"], [("k", ["x", "y"]), ("e", [])]), ([], [])], "l array<string>, m array<struct<key:string,values:array<string>>>")
    rows = df.select(X.format_list(F.col("l")).alias("l"), X.format_mapping(F.col("m")).alias("m")).collect()
    assert rows[0]["l"] == "- a\n- b" and rows[0]["m"] == "- k: x, y\n- e: none"
    assert rows[1]["l"] == "- none" and rows[1]["m"] == "- none"


def test_patterns_mean_the_same_in_java(spark):
    texts = corpus(seed=3) + ["данная фраза", "prompté", "верни", "a-b", "тест\n"]
    for pattern in [r"\bword\b", r"\bданн(?:ая|ый)\b", r"^\s*[-*0-9]+[.)\s]", r"\w+\s\d", r"[\w.]+$", r"слов\w*", r"[^\s]\.", r"\Wb"]:
        java = X.java_pattern(pattern, True)
        assert java is not None
        got = column(spark, texts, hit=F.col("t").rlike(java))
        assert [got[i]["hit"] for i in range(len(texts))] == [bool(re.search(pattern, s, re.I)) for s in texts], pattern
    assert X.java_pattern(r"(?P<x>a)") is None and X.java_pattern(r"a\Z") is None


def test_number_words(spark):
    df = spark.range(1000).select("id", N.number_to_words(F.col("id").cast("int")).alias("w"))
    got = {r["id"]: r["w"] for r in df.collect()}
    assert got[0] == "ноль" and got[19] == "девятнадцать" and got[40] == "сорок" and got[105] == "сто пять" and got[999] == "девятьсот девяносто девять"
    assert len(set(got.values())) == 1000
    rows = spark.createDataFrame([("007",), ("00",), ("12",), ("x",), ("1234",), ("555",)], "d string")
    r = {x["d"]: x for x in rows.select("d", N.fixed_width_words(F.col("d")).alias("w"), N.repeat_words(F.col("d")).alias("r"), N.digit_words(F.col("d")).alias("s")).collect()}
    assert r["007"]["w"] in N.readings("007") and "две нуля семь" in N.readings("007")
    assert r["00"]["w"] in ("ноль ноль", "две нуля") and r["12"]["w"] == "двенадцать" and r["x"]["w"] is None and r["1234"]["w"] is None
    assert r["555"]["r"] == "три пятерки" and r["12"]["r"] is None and r["12"]["s"] == "один два" and r["x"]["s"] is None
