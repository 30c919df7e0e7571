"""Dictation cases: unique numbers, their eleven variants, cyclic assignment and prompt blocks, from spark.range alone.

Numbers come from a bijection on the index space, so they are unique without a shuffle; every choice is a hash of the
seed, the number and the variant, so a case is the same in every run and on every cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import numbers as N

# How recognizers misspell number words, in this order; filler words of a dictation.
MISSPELLINGS = {"девятьсот": "девятсот", "семьдесят": "семсят", "пятьдесят": "писят", "девяносто": "девясат", "двадцать": "двацать", "одиннадцать": "одинадацать", "восемнадцать": "восемьнадцать", "шестнадцать": "шеснадцать"}
FILLERS = ["так", "секунду", "записывайте", "дальше", "угу"]
_STEP = 6_700_417  # prime to every number of blocks, as checked below


def phone_numbers(spark: SparkSession, count: int, operator_min: int = 880, operator_max: int = 899, seed: int = 42) -> DataFrame:
    """(index 1..count, blocks array of widths 1, 3, 3, 2, 2). More numbers than there are is a ValueError."""
    if operator_min > operator_max or not 0 <= operator_min or operator_max > 999:
        raise ValueError("operator_min must be <= operator_max, within 0..999")
    space = (operator_max - operator_min + 1) * 10**7
    if count > space:
        raise ValueError(f"only {space} numbers exist")
    if space % _STEP == 0:
        raise ValueError("the operator range gives a space that the step divides")
    at = F.pmod(F.col("id") * _STEP + F.lit(seed * 1_000_003), F.lit(space))
    operator, rest = F.floor(at / 10**7) + operator_min, F.pmod(at, F.lit(10**7))
    pad = lambda c, n: F.lpad(c.cast("long").cast("string"), n, "0")
    blocks = F.array(F.lit("8"), pad(operator, 3), pad(F.floor(rest / 10**4), 3), pad(F.floor(F.pmod(rest, F.lit(10**4)) / 100), 2), pad(F.pmod(rest, F.lit(100)), 2))
    return spark.range(1, count + 1).select(F.col("id").alias("index"), blocks.alias("blocks"))


def expand_variants(phones: DataFrame, seed: int = 42) -> DataFrame:
    """Eleven cases for each number: one ideal, five noisy, five incomplete."""
    b = [F.col("blocks")[i] for i in range(5)]
    digits = F.array_join("blocks", "")

    def words(i: int, salt: str) -> Column:
        return N.fixed_width_words(b[i], F.col("index"), F.lit(f"{seed}:{salt}:{i}"))

    def glued(i: int, salt: str) -> Column:
        return N.compact_words(b[i], F.col("index"), F.lit(f"{seed}:{salt}:{i}"))

    def choose(salt: str, *options: Column) -> Column:
        return N.pick(F.array(*options), F.col("index"), F.lit(f"{seed}:{salt}"))

    def chance(salt: str, share: float) -> Column:
        return F.pmod(N.drawn(F.col("index"), F.lit(f"{seed}:{salt}")), F.lit(1000)) < int(1000 * share)

    ideal = F.concat_ws(" ", F.lit("восемь"), *(words(i, "ideal") for i in range(1, 5)))
    mixed = F.concat_ws(" ", choose("m0", F.lit("8"), F.lit("+7"), F.lit("семь")), words(1, "m"), *(choose(f"m{i}", b[i], words(i, "m")) for i in (2, 3, 4)))
    glue = F.concat_ws(" ", F.lit("восемь"), glued(1, "g"), choose("g2", glued(2, "g"), words(2, "g")), glued(3, "g"), choose("g4", glued(4, "g"), words(4, "g")))
    filler = lambda salt: choose(salt, *map(F.lit, FILLERS))
    split = F.concat(F.lit("записывайте "), words(0, "f"), F.lit(", "), words(1, "f"), F.lit(", "), filler("f1"), F.lit(", "), words(2, "f"), F.lit(", "), filler("f2"), F.lit(", "), words(3, "f"), F.lit(" "), words(4, "f"), F.lit(", все"))
    typos = N.replace_all(ideal, MISSPELLINGS)
    said = lambda i: F.when(N.repeat_words(b[i]).isNotNull() & chance(f"r{i}", 0.8), N.repeat_words(b[i])).when(F.contains(b[i], F.lit("0")) & chance(f"d{i}", 0.7), N.digit_words(b[i])).otherwise(words(i, "r"))
    repeats = F.concat_ws(" ", choose("r0", F.lit("восемь"), F.lit("8")), *(said(i) for i in range(1, 5)))
    w = [F.lit("восемь"), *(words(i, "i") for i in range(1, 5))]
    none = F.lit(None).cast("string")

    def case(kind: str, i: int, target: Column, expected: Column, spoken: Column, note: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(i).alias("variant_index"), target.alias("target_digits"), expected.alias("expected_result"), spoken.alias("spoken"), F.array(F.lit(note)).alias("notes"))

    cases = [case("complete_ideal", 0, digits, digits, ideal, "ideal")]
    cases += [case("complete_noisy", i, digits, digits, s, f"noise_{i}") for i, s in enumerate((mixed, glue, split, typos, repeats), 1)]
    parts = [("missing_prefix", 1, 5), ("only_prefix", 0, 1), ("missing_middle_and_tail", 0, 2), ("missing_both_tail_blocks", 0, 3), ("missing_last_tail_block", 0, 4)]
    cases += [case("incomplete", i, F.concat(*b[x:y]), none, F.concat_ws(" ", *w[x:y]), note) for i, (note, x, y) in enumerate(parts, 1)]
    out = phones.select("index", "blocks", digits.alias("phone_digits"), F.inline(F.array(*cases)))
    return out.withColumn("case_id", F.format_string("phone_%06d__%s_%d", "index", "kind", "variant_index"))


def assign_cyclically(requests: DataFrame, cases: DataFrame, order: str, case_order: str, already: int = 0) -> DataFrame:
    """Each request, in order, gets the next case; after the last one the first follows.

    ``cases`` is numbered by ranges (no single-task sort of all rows); requests likewise. No cases: no rows.
    """
    from .dedup import running_count

    number = lambda df, by: running_count(df.withColumn("bucket", F.lit("")).withColumn("seq", F.col(by).cast("long")), F.lit(True), "_n").drop("bucket", "seq")
    n = cases.count()
    if not n:
        return number(requests, order).join(number(cases, case_order), "_n").drop("_n").limit(0)
    left = number(requests, order).withColumn("use_index", F.col("_n") + already).withColumn("_n", F.pmod(F.col("use_index"), F.lit(n)))
    return left.join(number(cases, case_order), "_n").drop("_n")


def used_log(assigned: DataFrame, created_at: Column | None = None) -> DataFrame:
    """The log of used cases, one row for each assigned one: created_at_unix, use_index, case_id, kind, target_digits, expected_result."""
    now = F.unix_micros(F.current_timestamp()) / 1e6 if created_at is None else created_at
    return assigned.select(now.cast("double").alias("created_at_unix"), "use_index", "case_id", "kind", "target_digits", "expected_result")


def accepted_log(judged: DataFrame, text: str = "text", created_at: Column | None = None) -> DataFrame:
    """The log of texts that wrap their case's dictation (validators.wraps_dictation), with the case's fields."""
    now = F.unix_micros(F.current_timestamp()) / 1e6 if created_at is None else created_at
    fields = ("case_id", "phone_digits", "target_digits", "expected_result", "kind", "spoken")
    return judged.where("reason IS NULL").select(now.cast("double").alias("created_at_unix"), *(F.col(f"case.{f}").alias(f) for f in fields), F.col(text).alias("llm_text"))


def case_block(template: str = "CASE {case_id}\nkind: {kind}\ntarget: {target_digits}\nresult: {expected_result}\n<<<{spoken}>>>") -> Column:
    """The template with the case's fields; a null field reads ``null``."""
    out, rest = [], template
    while rest:
        text, _, rest = rest.partition("{")
        out.append(F.lit(text))
        if rest:
            name, _, rest = rest.partition("}")
            out.append(F.coalesce(F.col(name).cast("string"), F.lit("null")))
    return F.concat(*out)
