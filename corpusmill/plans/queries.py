"""The engine's own queries over the given tables; each reads its whole tables. SQL for comparison: oracle.py."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as NZ
from ..functions import numbers as N
from ..functions import text as X
from ..operators import callbacks as U
from ..operators import dedup as D
from ..operators import parsers as P
from ..operators import phone as PH
from ..operators import prompts as R
from ..operators import report as A
from ..operators import validators as V
from ..operators.checks import Check, chain, describe

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _check(name: str, *checks: Check) -> None:
    """A query with the first failure of the checks for every document."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return _table(spark, folder, "documents").select("doc_id", chain(list(checks), F.col("text")).alias("reason"))

    run.__name__ = name
    query(run)


WORDS = Check("word_count_between", {"min": 20, "max": 120})
CHARS = Check("char_count_between", {"min": 100, "max": 900})
ANY = Check("require_contains_any", {"values": ["номер", "batch", "The "], "case_sensitive": True})
ANY_CI = Check("require_contains_any", {"values": ["НОМЕР", "Batch"], "case_sensitive": False})
ALL = Check("require_contains_all", {"values": [". ", ", "]})
REJECT = Check("reject_contains_any", {"values": ["QD-", "\r\n"]})
NEED_RX = Check("require_regex_any", {"patterns": ["[A-Z]{2}-[0-9]{4,5}", "[0-9]+,[0-9] %"]})
NO_RX = Check("reject_regex_any", {"patterns": ["[!?]{2}", "(json|yaml)"]})
RUSSIAN = Check("russian_text", {"min_cyrillic_chars": 50, "max_latin_chars": 10, "allow_latin_inside": ["QD", "KR", "LS", "TM", "ZV"]})
NO_LATIN = Check("no_latin", {"allow_inside": ["QD", "KR", "LS", "TM", "ZV"]})
_check("check_word_count", WORDS)
_check("check_char_count", CHARS)
_check("check_contains_any", ANY)
_check("check_contains_any_ci", ANY_CI)
_check("check_contains_all", ALL)
_check("check_reject_contains_any", REJECT)
_check("check_require_regex", NEED_RX)
_check("check_reject_regex", NO_RX)
_check("check_russian_text", RUSSIAN)
_check("check_no_latin", NO_LATIN)
_check("check_no_digits", Check("no_digits"))
_check("check_require_digits", Check("require_digits"))
_check("check_instruction_echo", Check("not_instruction_echo"))
CHAIN = [Check("word_count_between", {"min": 4, "max": 30}), Check("require_contains_any", {"values": ["е", "a", "の", "的"]}), Check("not_instruction_echo")]


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "lang", P.items("lines", F.col("text")).alias("items"))
    return P.explode_candidates(docs)


@query
def check_chain_first_fail(spark: SparkSession, folder: str) -> DataFrame:
    rows = _lines(spark, folder).select("lang", F.coalesce(chain(CHAIN, F.col("text")), F.lit("accepted")).alias("reason"))
    return rows.groupBy("lang", "reason").agg(F.count("*").alias("n"))


@query
def parse_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).select("doc_id", "candidate_index", "text")


def _replies(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "api_response").select("response_id", "rule_id", "request_index", "raw_text")


@query
def parse_answer_tags(spark: SparkSession, folder: str) -> DataFrame:
    return P.explode_candidates(_replies(spark, folder).select("response_id", P.items("answer_tags", F.col("raw_text")).alias("items")))


@query
def parse_json_array(spark: SparkSession, folder: str) -> DataFrame:
    """All replies by the strict JSON parser (Arrow UDF). Compared with Python's own json in the tests."""
    return P.explode_candidates(_replies(spark, folder).select("response_id", P.items("json_array", F.col("raw_text")).alias("items")))


def _parsed(spark: SparkSession, folder: str) -> DataFrame:
    rules = F.broadcast(_table(spark, folder, "rule_config").select("rule_id", "parser"))
    return _replies(spark, folder).join(rules, "rule_id").withColumn("items", P.items_by(F.col("parser"), F.col("raw_text")))


@query
def parse_errors(spark: SparkSession, folder: str) -> DataFrame:
    return A.parsed_candidates(_parsed(spark, folder))


@query
def normalize_text(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "documents").select("doc_id", NZ.normalize(F.col("text")).alias("norm"))


@query
def prefix_key(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "documents").select("doc_id", NZ.prefix_key(NZ.normalize(F.col("text")), 4).alias("prefix"))


@query
def char_ngrams_count(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "documents").select("doc_id", F.size(NZ.char_ngrams(NZ.normalize(F.col("text")), 3)).alias("n"))


@query
def text_measures(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    return _table(spark, folder, "documents").select(
        "doc_id", X.count_words(t).cast("long").alias("words"), X.count_cyrillic(t).cast("long").alias("cyrillic"), X.count_latin(t).cast("long").alias("latin"),
        X.contains_digit(t).alias("digit"), X.occurrences(t, ". ").cast("long").alias("stops"), X.collapse_spaces(t).alias("collapsed"),
        X.strip_fragments(t, ["QD-", "номер", "Q"]).alias("stripped"),
    )


@query
def spoken_form(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "phone_variant").select("variant_id", V.spoken_form(F.col("spoken")).alias("spoken"))


@query
def jaccard_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Dictations of one number, as it is written, that are similar at 0.75."""
    rows = _table(spark, folder, "phone_variant").where("spoken IS NOT NULL").select(F.coalesce("phone_digits", F.lit("")).alias("bucket"), NZ.normalize(F.col("spoken")).alias("norm"), "variant_id")
    texts = rows.groupBy("bucket", "norm").agg(F.min("variant_id").alias("tid"))
    names = texts.select("bucket", "tid", F.md5("norm").alias("m"))
    edges = D.similar_edges(texts, 3, 0.75)
    left, right = names.select("bucket", F.col("tid").alias("a"), F.col("m").alias("ma")), names.select("bucket", F.col("tid").alias("b"), F.col("m").alias("mb"))
    return edges.join(left, ["bucket", "a"]).join(right, ["bucket", "b"]).select("bucket", F.least("ma", "mb").alias("text_a"), F.greatest("ma", "mb").alias("text_b"), F.round("jaccard", 6).alias("jaccard"))


def _stream(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates in order: the lines of the documents, by document and line; the rule is the document's."""
    docs = _table(spark, folder, "documents").select("doc_id", F.coalesce("rule_id", F.lit("none")).alias("rule_id"), P.items("lines", F.col("text")).alias("items"))
    return P.explode_candidates(docs).withColumn("seq", F.col("doc_id") * 1_000_000 + F.col("candidate_index")).select("rule_id", "seq", "text")


PLAIN = D.DedupPolicy("plain", prefix_enabled=False, ngram_enabled=False)
PREFIXED = D.DedupPolicy("prefixed", prefix_words=2, prefix_max=3, ngram_enabled=False)
LOOSE = D.DedupPolicy("loose", exact=False, prefix_words=2, prefix_max=3, ngram_enabled=False)
WIDE = D.DedupPolicy("wide", scope="global", prefix_words=2, prefix_max=5, ngram_enabled=False)
FULL = D.DedupPolicy("full", prefix_words=3, prefix_max=20, threshold=0.86, max_compare=3000)


def _dedup(name: str, policy: D.DedupPolicy) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return D.dedup(_stream(spark, folder), policy).select("rule_id", "seq", "verdict")

    run.__name__ = name
    query(run)


_dedup("dedup_exact", PLAIN)
_dedup("dedup_prefix", LOOSE)
_dedup("dedup_exact_prefix", PREFIXED)
_dedup("dedup_global_scope", WIDE)
_dedup("dedup_ngram_greedy", FULL)
CAP = 40


@query
def dedup_exact_prefix_cap(spark: SparkSession, folder: str) -> DataFrame:
    rules = _table(spark, folder, "rule_config").select("rule_id", F.lit(CAP).alias("target"))
    return D.cap(D.dedup(_stream(spark, folder), PREFIXED), rules).select("rule_id", "seq", "verdict")


@query
def quota_limit(spark: SparkSession, folder: str) -> DataFrame:
    rules = _table(spark, folder, "rule_config").select("rule_id", (F.col("target_count") / 100).cast("int").alias("target"))
    rows = _stream(spark, folder).withColumn("verdict", F.lit(D.OK))
    return D.cap(rows, rules).groupBy("rule_id", "verdict").agg(F.count("*").alias("n"))


@query
def resume_incremental(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the second half of all ids, judged with the accepted rows of the first half as state."""
    rows = _stream(spark, folder)
    middle = _table(spark, folder, "documents").agg(F.floor(F.avg("doc_id")).alias("m")).first()["m"] or 0
    first = D.dedup(rows.where(F.col("seq") < middle * 1_000_000), PREFIXED)
    later = D.dedup(rows.where(F.col("seq") >= middle * 1_000_000), PREFIXED, prior=first.where("verdict = 'ok'").select("rule_id", "text", "seq"))
    return first.unionByName(later).select("rule_id", "seq", "verdict")


def _verdicts(spark: SparkSession, folder: str) -> DataFrame:
    rows = P.explode_candidates(_parsed(spark, folder).where("items IS NOT NULL").select("rule_id", "response_id", "items"))
    checks = [Check("word_count_between", {"min": 4, "max": 60}), Check("not_instruction_echo")]
    return rows.withColumn("seq", F.col("response_id") * 1_000_000 + F.col("candidate_index")).withColumn("reason", chain(checks, F.col("text")))


@query
def report_rejections(spark: SparkSession, folder: str) -> DataFrame:
    return A.counts_by_reason(_verdicts(spark, folder))


def _per_rule(spark: SparkSession, folder: str) -> DataFrame:
    rules = _table(spark, folder, "rule_config").select("rule_id", F.col("target_count").alias("target"))
    return A.accepted_and_remaining(_verdicts(spark, folder), rules, F.col("reason").isNull())


@query
def report_rules(spark: SparkSession, folder: str) -> DataFrame:
    return _per_rule(spark, folder)


@query
def report_totals(spark: SparkSession, folder: str) -> DataFrame:
    return A.totals(_per_rule(spark, folder))


@query
def report_status(spark: SparkSession, folder: str) -> DataFrame:
    asked = _table(spark, folder, "prompt_request").groupBy("rule_id").agg(F.count("*").alias("requests"))
    rows = _per_rule(spark, folder).join(asked, "rule_id", "left").withColumn("requests", F.coalesce("requests", F.lit(0)))
    return rows.select("rule_id", A.rule_status(F.col("accepted"), (F.col("target") / 20).cast("int"), F.col("requests"), 120, F.lit(0), 50).alias("status"))


@query
def report_samples(spark: SparkSession, folder: str) -> DataFrame:
    rows = _verdicts(spark, folder).where("reason IS NOT NULL")
    return A.first_samples(rows, 5).select("rule_id", "n", "reason", "text")


@query
def report_reasons_map(spark: SparkSession, folder: str) -> DataFrame:
    rows = A.reasons_map(A.counts_by_reason(_verdicts(spark, folder)))
    return rows.select("rule_id", F.to_json("rejected").alias("rejected"))


@query
def validator_shape(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).select("doc_id", "candidate_index", V.shape(F.col("text")).alias("reason"))


@query
def validator_question_marker(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).select("doc_id", "candidate_index", V.question_marker(F.col("text"), markers=["раз?", "again?", "цифре?"]).alias("reason"))


@query
def validator_required_fragment(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    return _lines(spark, folder).select("doc_id", "candidate_index", V.required_fragment(t, "номер", standalone=True).alias("standalone"), V.spelled_fragment(t, "номер", ["Номер"], "wrong_spelling").alias("spelled"))


@query
def validator_term_phrase(spark: SparkSession, folder: str) -> DataFrame:
    t = F.col("text")
    other = V.term_phrase(t, "окно", ["окно", "правило"], ["номер", "текст", "снова", "окн"], off_topic=["погода", "лес"])
    return _lines(spark, folder).select("doc_id", "candidate_index", other.alias("reason"), V.channel_term_phrase(t, "номер", [r"\bна\s+номер\b", r"\bномер\b.*\bтекст"], r"\bномерк\w*\b").alias("channel"))


@query
def validator_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Every validator of the phrase sets on every line; a line's last word is exchanged for the validator's term, so that each meets texts that hold it."""
    terms = dict(ai_mop="АИ МОП", amocrm="AmoCRM", bitrix="Bitrix", api="API", whatsapp="WhatsApp", telegram="Telegram", max="Max", sahara="пустыня Сахара", refuseniks="отказников", question_check="Понятно?", one_c="1С")
    rows = _lines(spark, folder).withColumn("last", F.element_at(NZ.words(F.col("text")), -1))
    rows = rows.withColumn("begin", F.expr("left(text, char_length(text) - char_length(last))")).select("doc_id", "candidate_index", "begin")
    # a plan for each: together their code would be too long to be compiled
    each = [rows.select("doc_id", "candidate_index", F.lit(name).alias("validator"), V.VALIDATORS[name](F.concat("begin", F.lit(term))).alias("reason")) for name, term in terms.items()]
    return reduce(DataFrame.unionByName, each)


@query
def anchor_join_validate(spark: SparkSession, folder: str) -> DataFrame:
    return _wrapped(spark, folder).select("mapping_id", "reason")


def _wrapped(spark: SparkSession, folder: str) -> DataFrame:
    cases = _table(spark, folder, "phone_variant").select("case_id", "phone_digits", "target_digits", "expected_result", "kind", "spoken", "variant_id")
    rows = _table(spark, folder, "accepted_mapping").select("mapping_id", F.col("case_id").alias("callback_anchor"), F.col("llm_text").alias("text"))
    return V.wraps_dictation(rows, cases, order="variant_id")


@query
def accepted_case_log(spark: SparkSession, folder: str) -> DataFrame:
    return PH.accepted_log(_wrapped(spark, folder), created_at=F.lit(0))


@query
def used_case_log(spark: SparkSession, folder: str) -> DataFrame:
    cases = _table(spark, folder, "phone_variant").select("variant_id", "case_id", "kind", "target_digits", "expected_result")
    return PH.used_log(PH.assign_cyclically(_table(spark, folder, "prompt_request").select("request_id"), cases, "request_id", "variant_id"), F.lit(0))


@query
def cyclic_assignment(spark: SparkSession, folder: str) -> DataFrame:
    requests = _table(spark, folder, "prompt_request").select("request_id")
    cases = _table(spark, folder, "phone_variant").select("variant_id", "case_id")
    return PH.assign_cyclically(requests, cases, "request_id", "variant_id").select("request_id", "use_index", "variant_id")


@query
def case_prompt_block(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "phone_variant").select("variant_id", PH.case_block().alias("block"))


@query
def number_words(spark: SparkSession, folder: str) -> DataFrame:
    """Tail blocks of all numbers in words; numbers are read digit by digit and as values."""
    digits = F.regexp_extract("phone_digits", r"(\d{3})$", 1)
    rows = _table(spark, folder, "phone_variant").select("variant_id", digits.alias("d"))
    return rows.select("variant_id", N.digit_words(F.col("d")).alias("digit_words"), N.number_to_words(F.when(F.col("d") != "", F.col("d")).cast("int")).alias("value_words"), N.repeat_words(F.col("d")).alias("repeat_words"))


@query
def block_words(spark: SparkSession, folder: str) -> DataFrame:
    """Tail blocks of all numbers read in one of the ways that keep leading zeros, apart and in one word."""
    rows = _table(spark, folder, "phone_variant").select("variant_id", F.regexp_extract("phone_digits", r"([0-9]{3})$", 1).alias("d"))
    return rows.select("variant_id", N.fixed_width_words(F.col("d"), F.col("variant_id")).alias("words"), N.compact_words(F.col("d"), F.col("variant_id")).alias("glued"))


@query
def rule_checks(spark: SparkSession, folder: str) -> DataFrame:
    """What the checks of each rule say of themselves in a prompt."""
    return _table(spark, folder, "documents").select("doc_id", F.lit("\n".join(describe([WORDS, ANY, REJECT, NO_RX, RUSSIAN, NO_LATIN, *(Check(t) for t in ("no_digits", "require_digits", "not_instruction_echo"))]))).alias("checks"))


@query
def requests_planned(spark: SparkSession, folder: str) -> DataFrame:
    """The next cycle's requests of each rule, after its last recorded one."""
    last = _table(spark, folder, "prompt_request").groupBy("rule_id").agg(F.max("request_index").alias("last"), F.count("*").alias("n"))
    rules = _table(spark, folder, "rule_config").join(last, "rule_id", "left")
    size = R.planned(F.col("target_count") - F.coalesce("n", F.lit(0)), F.col("batch_size"), 4, 3, F.lit(10_000) - F.coalesce("last", F.lit(0)))
    return rules.select("rule_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("k"), F.coalesce("last", F.lit(0)).alias("last"), size.alias("size")).where("k <= size").select("rule_id", (F.col("last") + F.col("k")).alias("request_index"))


@query
def report_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Errors of each rule by type: replies that failed, and replies that the parser rejects."""
    rows = _table(spark, folder, "api_response").join(F.broadcast(_table(spark, folder, "rule_config").select("rule_id", "parser")), "rule_id")
    return A.error_counts(rows.withColumn("items", P.items_by(F.col("parser"), F.col("raw_text"))))


@query
def similar_replies(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate replies of each rule over the whole reply table, by the rule's bucket."""
    rows = _table(spark, folder, "api_response").where("raw_text IS NOT NULL").select(F.coalesce("rule_id", F.lit("")).alias("bucket"), NZ.normalize(F.col("raw_text")).alias("norm"), "response_id")
    texts = rows.groupBy("bucket", "norm").agg(F.min("response_id").alias("tid"))
    return D.similar_edges(texts, 3, 0.88).select("bucket", F.col("a").alias("first_id"), F.col("b").alias("response_id"), "jaccard")


@query
def phone_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Generated cases, as many numbers as there are suppliers."""
    count = _table(spark, folder, "supplier").count()
    rows = PH.expand_variants(PH.phone_numbers(spark, count))
    return rows.select("case_id", "phone_digits", "target_digits", "expected_result", "kind", "variant_index", F.array_join("blocks", "-").alias("blocks"), "spoken", F.array_join("notes", ",").alias("notes"))


DIVERSITY = [("scene", ["call", "note", "chat", "desk"], 2), ("tone", ["calm", "brisk", "warm"], 1), ("off", ["x"], 0)]


@query
def diversity_sample(spark: SparkSession, folder: str) -> DataFrame:
    requests = _table(spark, folder, "prompt_request").select("request_id", "rule_id", F.col("request_id").alias("request_index"))
    rows = R.sample_diversity(requests, DIVERSITY)
    return rows.select("request_index", F.posexplode("diversity").alias("dim", "d")).select("request_index", "dim", F.col("d.key").alias("dimension"), F.array_join("d.values", "|").alias("picked"))


@query
def prompt_render(spark: SparkSession, folder: str) -> DataFrame:
    requests = _table(spark, folder, "prompt_request").select("rule_id", F.col("request_id").alias("request_index"))
    user = R.render_user_prompt("Write {batch_size} for {rule_id}.\n{checks}\n{diversity}\n{{x}} {output_contract}\n", "any", "goal", 5, ["a"], [], [Check("no_digits")], " JSON ", F.col("diversity"))
    return R.sample_diversity(requests, DIVERSITY).select("request_index", user.alias("user_prompt"))


@query
def format_examples(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "rule_config").select("rule_id", X.format_list(F.col("examples.positive")).alias("positive"), X.format_list(F.col("examples.negative")).alias("negative"))


def _no_placeholder(text: str | None) -> tuple[bool, str]:
    if text is None:
        raise ValueError("no text")
    low = text.lower()
    return ("дом" not in low and "placeholder" not in low), "placeholder_text"


@query
def callback_post_validation(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "accepted_mapping").select("mapping_id", U.post_validation([_no_placeholder], F.col("llm_text")).alias("v"))
    return rows.select("mapping_id", "v.accepted", "v.reason", F.col("v.error").isNotNull().alias("failed"))


@query
def accepted_records(spark: SparkSession, folder: str) -> DataFrame:
    """The flat record of each accepted candidate."""
    rows = _verdicts(spark, folder).where("reason IS NULL")
    return rows.select("rule_id", "text", "response_id", "candidate_index")


@query
def completion_replay(spark: SparkSession, folder: str) -> DataFrame:
    """Prompts with their recorded reply; of several the greatest text."""
    from ..sources.completion import replay

    prompts = _table(spark, folder, "prompt_request").where("rule_id IS NOT NULL").select("rule_id", "request_index").distinct()
    return replay(prompts, _replies(spark, folder))
