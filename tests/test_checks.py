import pytest
from pyspark.sql import functions as F

from corpusmill.operators import validators as V
from corpusmill.operators.checks import Check, chain, describe, supported_types


def reasons(spark, checks, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["r"] for r in df.select("i", chain(checks, F.col("t")).alias("r")).orderBy("i").collect()]


CASES = [
    ("word_count_between", {"min": 2, "max": 3}, {"a": "too_few_words", "a b": None, "a b c": None, "a b c d": "too_many_words", "": "too_few_words"}),
    ("char_count_between", {"min": 2, "max": 3}, {"я": "too_few_chars", "🙂🙂": None, "abcd": "too_many_chars"}),
    ("require_contains_any", {"values": ["CRM", "x"]}, {"in CRM": None, "crm": "missing_required_fragment"}),
    ("require_contains_any", {"values": ["CRM"], "case_sensitive": False}, {"crm": None, "c": "missing_required_fragment"}),
    ("require_contains_any", {"values": []}, {"a": "missing_required_fragment"}),
    ("require_contains_all", {"values": ["a", "b"]}, {"ab": None, "a": "missing_required_fragment"}),
    ("require_contains_all", {"values": []}, {"a": None}),
    ("reject_contains_any", {"values": ["bad"]}, {"bad": "forbidden_fragment", "good": None}),
    ("require_regex_any", {"patterns": [r"\d{2}", r"(?P<n>q)\Z"]}, {"x 12": None, "x 1": "regex_required_pattern_missing", "q": None}),
    ("require_regex_any", {"patterns": []}, {"a": "regex_required_pattern_missing"}),
    ("reject_regex_any", {"patterns": [r"\bslow\b"]}, {"slow": "forbidden_regex", "slowly": None}),
    ("russian_text", {"min_cyrillic_chars": 2, "max_latin_chars": 1, "allow_latin_inside": ["CRM"]}, {"да CRM": None, "д": "not_enough_cyrillic", "да yes": "too_much_latin"}),
    ("no_digits", {}, {"a": None, "٣": "digits_present"}),
    ("require_digits", {}, {"a1": None, "a": "digits_missing", "²": "digits_missing"}),
    ("no_latin", {"allow_inside": ["API"]}, {"мой API": None, "мой api": "latin_present"}),
    ("not_instruction_echo", {"extra_patterns": ["секрет"]}, {"- a": "list_item_echo", "* a": "list_item_echo", "a\nb": "multiline_echo", "Return it": "instruction_echo", "returned": None, "ВЕРНИ": "instruction_echo", "инструкция": "instruction_echo", "СЕКРЕТ": "instruction_echo", "prompté": None}),
]


@pytest.mark.parametrize("kind,params,cases", CASES)
def test_each_reason(spark, kind, params, cases):
    got = reasons(spark, [Check(kind, params)], list(cases))
    assert got == [w and f"{kind}:{w}" for w in cases.values()]


def test_first_failure_wins_and_nulls(spark):
    checks = [Check("no_digits"), Check("word_count_between", {"min": 2, "max": 9})]
    assert reasons(spark, checks, ["1", "a", "a b", None]) == ["no_digits:digits_present", "word_count_between:too_few_words", None, "null_text"]
    assert reasons(spark, [], ["", None]) == [None, "null_text"]


def test_errors_and_descriptions():
    assert len(supported_types()) == 12
    with pytest.raises(ValueError):
        chain([Check("nope")], F.lit("a"))
    with pytest.raises(KeyError):
        chain([Check("word_count_between", {"min": 1})], F.lit("a"))
    assert describe([Check("word_count_between", {"min": 1, "max": 2}), Check("no_latin", {"allow_inside": ["A", "B"]})]) == ["word count must be between 1 and 2", "must not contain Latin characters outside: A, B"]


def _reasons(spark, texts, validator):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["r"] for r in df.select("i", validator(F.col("t")).alias("r")).orderBy("i").collect()]


@pytest.mark.parametrize(
    "name, cases",
    [
        ("sahara", {"  это моя пустыня Сахара тут ": None, "a  b c d пустыня Сахара": "bad_spacing", "это моя пустыня Сахара тут\n": "multiline", "это моя — пустыня Сахара (тут)": None, "это моя: пустыня Сахара тут": "written_or_dialog_punctuation", "1. это моя пустыня Сахара": "written_style", "моя пустыня Сахара тут": "sentence_fragment", "это моя пустыня Сахара тут,": "sentence_fragment", "это моя пустыня тут же": "required_fragment_count", None: None}),
        ("refuseniks", {"тут живёт много отказников у нас": None, "тут живёт много отказниковых людей": "required_word_not_standalone"}),
        ("question_check", {"скажи мне это ещё раз Окей?": None, "скажи мне это ещё раз": "question_marker_count", "Окей? скажи мне это ещё раз": "question_marker_not_final", "да? скажи мне ещё раз Окей?": "question_mark_count"}),
        ("one_c", {"мы ведём учёт в 1С каждый день": None, "мы ведём учёт в 1С и 1с": "wrong_one_c_spelling"}),
        ("api", {"наш менеджер открыл API для каждого клиента": None, "наш менеджер открыл API для Telegram клиента": "other_protected_term_present", "мы вчера открыли API для всех людей": "business_context_missing", "клиент увидел котик и API вчера днём": "random_topic", "клиент открыл API": "sentence_fragment"}),
        ("max", {"менеджер написал клиенту в Max сегодня утром": None, "менеджер увидел клиента и Max сегодня утром": "max_context_missing", "менеджер Максим написал клиенту в Max утром": "max_as_person_name", "сообщение клиента Max менеджер увидел утром": None, "это сообщени для клиента Max команда увидела": None}),
    ],
)
def test_validators(spark, name, cases):
    assert _reasons(spark, cases, V.VALIDATORS[name]) == list(cases.values())


def test_dictation_is_wrapped(spark):
    cases = spark.createDataFrame([("c1", "восемь, семь", "87", 1, "extra"), ("c1", "восемь, девять", "89", 2, "again"), ("c2", None, "1", 3, ""), (None, "x", "2", 4, "")], "case_id string, spoken string, phone_digits string, case_order int, text string")
    rows = spark.createDataFrame([(1, "c1", "Да: ВОСЕМЬ девять."), (2, "c1", "восемь, девять это 89"), (3, "c1", "нет, восемь, семь"), (4, "c9", "x"), (5, None, "x"), (6, "c2", "x"), (7, "c1", None)], "i int, callback_anchor string, text string")
    out = V.wraps_dictation(rows, cases)
    got = {r["i"]: r["reason"] for r in out.collect()}
    assert got == {1: None, 2: "canonical_digits_leaked", 3: "source_spoken_missing_or_changed", 4: "unknown_case", 5: "unknown_case", 6: "source_spoken_missing_or_changed", 7: "source_spoken_missing_or_changed"}
    assert out.where("i = 1").first()["case"]["text"] == "again" and V.wraps_dictation(rows, cases.limit(0)).where("reason = 'unknown_case'").count() == 7
