import json

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import parsers as P


def parse(spark, parser, raws):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raws)], "i int, raw string")
    return [r["x"] for r in df.select("i", P.items(parser, F.col("raw")).alias("x")).orderBy("i").collect()]


def test_json_array(spark):
    cases = {
        '["a", " b ", "", 1, null, {"x": 1}]': ["a", "b"], 'Sure: ["a"] done': ["a"], '{"k": ["a"]}': None, '["a"] ["b"]': None, '["a",]': None, "": None, "[]": [], '{"k":1} ["a"]': ["a"],
        '["a", NaN]': ["a"], "text": None, '"x"': None, "[" * 3: None,
    }
    assert parse(spark, "json_array", list(cases)) == list(cases.values())
    assert parse(spark, "json_array", [None]) == [None]
    assert P.json_strings("[" * 100_000) is None


def test_answer_tags(spark):
    cases = {"<ANSWER> a\n b </answer> <answer>\"q'</answer>": ["a b", "q"], "<answer></answer>": [], "<answer>x": [], "none": [], "": []}
    assert parse(spark, "answer_tags", list(cases)) == list(cases.values())


def test_lines(spark):
    cases = {"1. x\n- y\r\n* z": ["x", "y", "z"], "a b\x1cc": ["a", "b", "c"], "24/7 ok": ["/7 ok"], "\n \n": [], "": []}
    assert parse(spark, "lines", list(cases)) == list(cases.values())


def test_unknown_parser_and_numbering(spark):
    with pytest.raises(ValueError):
        P.items("xml", F.lit(""))
    df = spark.createDataFrame([(1, ["a", "b"], "keep"), (2, [], "gone"), (3, None, "gone")], "id int, items array<string>, text_extra string")
    rows = sorted(map(tuple, P.explode_candidates(df).collect()))
    assert rows == [(1, "keep", 1, "a"), (1, "keep", 2, "b")]
    empty = spark.createDataFrame([], "id int, items array<string>")
    assert P.explode_candidates(empty).count() == 0


def test_replies_of_the_table(spark, data):
    raw = spark.read.parquet(f"{data}/api_response.parquet").select("raw_text")
    for row in raw.select("raw_text", P.items("json_array", F.col("raw_text")).alias("x")).collect():
        try:
            value = json.loads(row["raw_text"] or "!")
        except ValueError:
            continue
        if isinstance(value, list):
            assert row["x"] == [v.strip() for v in value if isinstance(v, str) and v.strip()]


def test_replies_are_parsed_once_for_candidates(spark):
    df = spark.createDataFrame([(1, "a\nb"), (2, ""), (3, None)], "id long, raw string")
    rows = P.explode_candidates(df.select("id", P.items("lines", F.col("raw")).alias("items")))
    assert sorted(map(tuple, rows.collect())) == [(1, 1, "a"), (1, 2, "b")] and not rows.schema["candidate_index"].nullable
    # a filter on the items below the explode would hold the parser a second time
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "size(" not in plan
