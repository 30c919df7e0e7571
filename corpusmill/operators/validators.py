"""Validators of phrase sets as ordered reasons, like the checks; terms and word lists are parameters with the usual sets as defaults.

A null text has no reason. White space at the ends of a text is allowed, but for line breaks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .callbacks import anchored_by_table
from .checks import matches

# Marks that a spoken phrase has none of.
WRITTEN_MARKS = ['"', "'", "`", "«", "»", "[", "]", "{", "}", "<", ">", "|", ":", ";"]
# Markers that a question phrase ends with.
QUESTION_MARKERS = ["Окей?", "Хорошо?", "Договорились?", "Алло?", "Понятно?"]
# Terms of which a phrase holds exactly one.
PROTECTED_TERMS = ["АИ МОП", "AmoCRM", "Bitrix", "API", "WhatsApp", "Telegram", "Max"]
# Beginnings of words of which one must be found beside the term.
CONTEXT_WORDS = (
    "аккаунт аналитик бот воронк встреч диалог договор задач заявк звон интеграц канал клиент команд контакт лид менеджер мессендж напомин обращени "
    "оператор оплат отчет поддержк продаж проект рассыл сделк сервис сообщени соглас статус уведомлен чат crm црм"
).split()
# Words that are off the topic.
OFF_TOPIC_WORDS = "одуванчик ромашк пирож котик погода лес море кухн огород".split()
# Patterns of written style or of an echoed task, for phrases with a term and for targeted phrases.
WRITTEN_STYLE = [r"^\s*[-*0-9]+[.)\s]", r"\bjson\b", r"\bmarkdown\b", r"\bprompt\b", r"\brule\b", r"\bexample\b", r"\bсгенерируй\b", r"\bверни\b"]
TERM_STYLE = [*WRITTEN_STYLE, r"\bданн(?:ая|ый|ое|ые)\b", r"\bвышеуказан", r"\bнижеследующ", r"\bнастоящ(?:им|ая|ий|ее)\b", r"\bследует отметить\b", r"\bв рамках настоящего\b"]
TARGETED_STYLE = [*WRITTEN_STYLE, r"\bфраза\s+с\b", r"\bобязательн\w*\s+(?:слов|термин|фрагмент)"]
# Settings in which the term Max is a channel, and the pattern of the person's name.
CHANNEL_SETTINGS = [
    r"\bв\s+Max\b", r"\bчерез\s+Max\b", r"\bиз\s+Max\b", r"\bдля\s+Max\b", r"\bканал\w*\s+Max\b", r"\bчат\w*\s+Max\b",
    r"\bсообщени\w*\s+.*\bMax\b", r"\bMax\b.*\bсообщени", r"\bMax\b.*\bканал", r"\bMax\b.*\bчат",
]
PERSON_NAME = r"\bмаксим\w*\b"


def _or(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _spacing(t: Column) -> list[Column]:
    return [
        F.when(X.strip(t) != X.collapse_spaces(t), "bad_spacing"),
        F.when(F.contains(t, F.lit("\n")) | F.contains(t, F.lit("\r")), "multiline"),
        F.when(_or([F.contains(t, F.lit(m)) for m in WRITTEN_MARKS]), "written_or_dialog_punctuation"),
    ]


def _style(t: Column, patterns: list[str]) -> Column:
    return F.when(_or([matches(F.lower(t), p, True) for p in patterns]), "written_style")


def _fragment(t: Column, least_words: int) -> Column:
    """An empty text, one that ends in a comma, or one of too few words of letters and digits."""
    words = F.regexp_count(t, F.lit("[A-Za-zА-Яа-яЁё0-9]+"))
    return F.when(X.strip(t).endswith(",") | (words < least_words), "sentence_fragment")


def shape(t: Column, patterns: list[str] | None = None, least_words: int = 5) -> Column:
    """bad_spacing, multiline, written_or_dialog_punctuation, written_style, sentence_fragment; null if none."""
    return F.coalesce(*_spacing(t), _style(t, TARGETED_STYLE if patterns is None else patterns), _fragment(t, least_words))


def required_fragment(t: Column, part: str, patterns: list[str] | None = None, standalone: bool = False) -> Column:
    """The shape, then the fragment exactly once, then (if asked) as a word of its own."""
    reasons = [shape(t, patterns), F.when(X.occurrences(t, part) != 1, "required_fragment_count")]
    if standalone:
        reasons.append(F.when(~matches(t, rf"(?<![A-Za-zА-Яа-яЁё]){X.literal_pattern(part)}(?![A-Za-zА-Яа-яЁё])"), "required_word_not_standalone"))
    return F.coalesce(*reasons)


def spelled_fragment(t: Column, part: str, wrong: list[str], reason: str, patterns: list[str] | None = None) -> Column:
    """The required fragment, then none of its wrong spellings."""
    return F.coalesce(required_fragment(t, part, patterns), F.when(_or([F.contains(t, F.lit(w)) for w in wrong]), reason))


def question_marker(t: Column, patterns: list[str] | None = None, markers: list[str] | None = None) -> Column:
    """The shape, then exactly one marker, at the end, and no other question mark."""
    markers = QUESTION_MARKERS if markers is None else markers
    count = reduce(lambda a, m: a + X.occurrences(t, m), markers, F.lit(0))
    last = _or([t.endswith(m) for m in markers])
    return F.coalesce(shape(t, patterns), F.when(count != 1, "question_marker_count"), F.when(~last, "question_marker_not_final"), F.when(X.occurrences(t, "?") != 1, "question_mark_count"))


def term_phrase(t: Column, term: str, terms: list[str] | None = None, context: list[str] | None = None, patterns: list[str] | None = None, off_topic: list[str] | None = None, least_words: int = 6) -> Column:
    """One term exactly once and no other of ``terms``, some context word beside it, no written style, no off-topic word, no fragment."""
    terms, context = PROTECTED_TERMS if terms is None else terms, CONTEXT_WORDS if context is None else context
    off_topic = OFF_TOPIC_WORDS if off_topic is None else off_topic
    low = F.lower(t)
    beside = F.replace(low, F.lit(term.lower()), F.lit(" "))
    return F.coalesce(
        *_spacing(t),
        F.when(X.occurrences(t, term) != 1, "required_term_count"),
        F.when(_or([F.contains(t, F.lit(o)) for o in terms if o != term]), "other_protected_term_present"),
        F.when(~_or([F.contains(beside, F.lit(w)) for w in context]), "business_context_missing"),
        _style(t, TERM_STYLE if patterns is None else patterns),
        F.when(_or([F.contains(low, F.lit(w)) for w in off_topic]), "random_topic"),
        _fragment(t, least_words),
    )


def channel_term_phrase(t: Column, term: str = "Max", settings: list[str] | None = None, name: str = PERSON_NAME) -> Column:
    """The term phrase, then the term in one of its settings, then no person's name."""
    settings = CHANNEL_SETTINGS if settings is None else settings
    return F.coalesce(term_phrase(t, term), F.when(~_or([matches(t, s, True) for s in settings]), "max_context_missing"), F.when(matches(F.lower(t), name), "max_as_person_name"))


#: The validators of the phrase sets by name.
VALIDATORS = {
    "ai_mop": lambda t: term_phrase(t, "АИ МОП"),
    "amocrm": lambda t: term_phrase(t, "AmoCRM"),
    "bitrix": lambda t: term_phrase(t, "Bitrix"),
    "api": lambda t: term_phrase(t, "API"),
    "whatsapp": lambda t: term_phrase(t, "WhatsApp"),
    "telegram": lambda t: term_phrase(t, "Telegram"),
    "max": channel_term_phrase,
    "sahara": lambda t: required_fragment(t, "пустыня Сахара"),
    "refuseniks": lambda t: required_fragment(t, "отказников", standalone=True),
    "question_check": question_marker,
    "one_c": lambda t: spelled_fragment(t, "1С", ["1C", "1с"], "wrong_one_c_spelling"),
}


def spoken_form(t: Column) -> Column:
    """Lower case, ё as е, punctuation as spaces, collapsed: the form in which a dictation is looked for."""
    return X.collapse_spaces(F.regexp_replace(F.translate(F.lower(t), "ё", "е"), r"""[.,;:!?"'`«»()\[\]{}<>/\\|]+""", " "))


def wraps_dictation(df: DataFrame, cases: DataFrame, text: str = "text", anchor: str = "callback_anchor", order: str = "case_order") -> DataFrame:
    """``df`` plus the case of its anchor and a reason: unknown_case, source_spoken_missing_or_changed, canonical_digits_leaked or null.

    ``cases`` has case_id, spoken, phone_digits and others, all of which are added; of several cases with an id the one
    with the greatest ``order`` counts. A null text, or a case without a dictation, is source_spoken_missing_or_changed.
    """
    out = anchored_by_table(df, cases, anchor, "case_id", order)
    t, spoken = F.col(text), F.col("case.spoken")
    there = F.contains(t, spoken) | F.contains(spoken_form(t), spoken_form(spoken))
    why = F.when(F.col("case").isNull(), "unknown_case").when(~F.coalesce(there, F.lit(False)), "source_spoken_missing_or_changed").when(F.contains(t, F.col("case.phone_digits")), "canonical_digits_leaked")
    return out.withColumn("reason", why)
