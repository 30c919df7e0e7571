"""Defective prompt and response pairs.

The first defect that fits, in this order: empty_answer, truncated_answer (truncation.py), refusal, question_copy,
wrong_language. Copies: shingle containment of the response in the prompt (or coverage of the prompt by the response)
brings a pair up, and the longest common subsequence of their tokens confirms it. Refusals: the whole response is
aligned with refusal templates by the same subsequence. Languages are told by script and by function words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .truncation import truncation

SHINGLE = 3
CONTAINED, COVERED, ALIGNED = 0.7, 0.5, 0.6

# What assistants say to decline a task; "_" stands for any one word.
REFUSALS = [
    "не могу выполнить _ просьбу", "не могу выполнить _ запрос", "не могу выполнить _ задание", "не могу помочь с этим", "помочь с этим _ не получится",
    "вынужден отказаться от", "вынуждена отказаться от", "вынужден отклонить", "не стану писать", "не буду писать такие", "мне нельзя создавать", "я составить не готов", "я составить не готова",
    "запроса противоречит моим правилам", "противоречит моим правилам", "не имею права создавать", "я не могу создавать", "не могу написать такой", "не могу сгенерировать",
    "can't help with that", "cannot help with that", "can't help with this", "cannot help with this", "can't assist with", "cannot assist with", "must decline this request", "have to decline this",
    "am unable to write", "am unable to help", "am not able to help", "am unable to assist", "won't be able to produce", "won't be able to help", "would go against my guidelines", "goes against my guidelines", "not allowed to create",
    "can't fulfill this request", "cannot fulfill this request", "can't create that", "cannot create such",
    "muss ich das ablehnen", "muss ich ablehnen", "muss diese anfrage ablehnen", "ich solche texte nicht verfassen", "dabei kann ich nicht helfen", "dabei nicht helfen", "kann ich nicht weiterhelfen", "nicht mit meinen richtlinien vereinbar", "verstößt gegen meine richtlinien", "ich diese bitte nicht erfüllen", "kann ich diese anfrage nicht", "kann ich dir nicht helfen", "kann ich ihnen nicht helfen",
    "je ne peux pas répondre à cette demande", "je ne peux pas vous aider", "je ne peux pas aider", "je dois refuser", "je dois décliner", "contraire à mes règles",
    "no puedo ayudar con", "no puedo ayudarle con", "no puedo cumplir esta", "debo rechazar esta", "no me está permitido", "va contra mis normas",
    "не можу виконати", "не можу допомогти з", "мушу відмовитися", "змушений відмовити", "суперечить моїм правилам",
    "δεν μπορώ να βοηθήσω", "δεν μπορώ να εκπληρώσω", "չեմ կարող օգնել", "չեմ կարող կատարել", "لا أستطيع المساعدة", "لا يمكنني المساعدة", "لا أستطيع تنفيذ", "لا يمكنني تنفيذ", "मदद नहीं कर सकता", "मदद नहीं कर सकती", "도와드릴 수 없습니다", "도와 드릴 수 없습니다", "응할 수 없습니다",
]
# The same as slots of alternatives, in order: what is refused, the work, and the task's name.
REFUSAL_SLOTS = [
    ["can't cannot won't unable refuse decline not", "help assist comply fulfill fulfil complete write create generate produce provide", "request task instruction instructions prompt"],
    ["не", "могу смогу буду стану", "выполнить выполнять помочь написать писать создать создавать сгенерировать составить составлять подготовить предоставить", "запрос запросом просьбу просьбой задание заданием задачу задачей тексты"],
    ["não", "posso consigo", "ajudar atender cumprir escrever criar gerar", "pedido solicitação tarefa isso"],
    ["nie", "mogę jestem", "pomóc spełnić wykonać napisać stworzyć", "prośby prośbę tym zadania polecenia"],
    ["non", "posso", "aiutare aiutarti soddisfare scrivere creare", "richiesta compito questo"],
    ["kann werde darf", "anfrage aufgabe auftrag bitte", "nicht", "erfüllen bearbeiten ausführen"],
    ["peux", "pas", "aider répondre accomplir écrire créer", "demande tâche"],
    ["no", "puedo", "ayudar ayudarte cumplir completar escribir crear generar", "solicitud petición tarefa tarea"],
    ["as", "an", "ai language", "model"], ["как", "языковая", "модель"], ["como", "modelo", "de", "lenguaje linguagem"], ["jako", "model", "językowy"],
]
#: Words that may stand between two slots.
SLOT_GAP = 3
# The same for scripts without spaces.
REFUSALS_UNSPACED = ["无法完成", "无法帮助", "无法协助", "不能帮助", "无法提供", "拒绝这个请求", "お手伝いできません", "お応えできません", "お答えできません", "お断りします", "ไม่สามารถช่วย", "ไม่สามารถทำตาม"]
# Frequent words of languages that share a script.
FUNCTION_WORDS = {
    "en": "the a an and is are was to of in on for with you your we i it that this will can could by from at have be not please me my our he she they what when which because after before".split(),
    "de": "der die das und ist sind war zu von in im auf für mit sie ihr ihre wir ich es dass diese wird werden kann können nicht bitte mich uns er um den dem ein eine einen noch einmal am bei kommen liegt hat".split(),
    "fr": "le la les et est sont un une des du de à au pour avec vous votre nous je il elle que ce cette sera peut ne pas dans sur qui a été plus par faut se".split(),
    "es": "el la los las y es son un una de del a al para con usted su nosotros yo que este esta será puede no en por se ha fue hay más antes otra vez llaman".split(),
    "it": "il lo gli e è sono un una di del per con che questo non si nel alla".split(),
    "ru": "и в не на что с по к за у от до из мы вы я он она они это как но бы же ещё уже для при или так".split(),
    "uk": "і в не на що з по до за у від із ми ви я він вона вони це як але би ж ще вже для при або та й чи є про хто".split(),
}
_CYRILLIC, _LATIN = {"ru", "uk"}, {"en", "de", "fr", "es", "it"}
_SCRIPTS = [
    ("latin", re.compile(r"[A-Za-zÀ-ɏ]")), ("cyrillic", re.compile(r"[Ѐ-ӿ]")), ("kana", re.compile(r"[぀-ヿ]")), ("han", re.compile(r"[㐀-鿿]")), ("hangul", re.compile(r"[가-힯ᄀ-ᇿ]")),
    ("thai", re.compile(r"[฀-๿]")), ("devanagari", re.compile(r"[ऀ-ॿ]")), ("arabic", re.compile(r"[؀-ۿ]")), ("greek", re.compile(r"[Ͱ-Ͽ]")), ("armenian", re.compile(r"[԰-֏]")),
]
_SCRIPT_OF = {"ru": "cyrillic", "uk": "cyrillic", "bg": "cyrillic", "ja": "kana", "zh": "han", "ko": "hangul", "th": "thai", "hi": "devanagari", "ar": "arabic", "el": "greek", "hy": "armenian"}
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_WRAPPER = re.compile(r"```[a-zA-Z]*|</?answer>|\\[nrt\"]|\b(?:null|none)\b", re.I)
_NUMBERING = re.compile(r"^\s*\d{1,3}[.)]\s*$", re.M)


def plain(text: str) -> str:
    return _WRAPPER.sub(" ", text)


def is_empty(text: str | None) -> bool:
    """Nothing but wrappers, marks, numbering and blank or invisible characters."""
    return text is None or not any(c.isalnum() for c in _NUMBERING.sub("", plain(text)))


def _words(text: str) -> list[str]:
    return _WORD.findall(plain(text).replace("’", "'").lower())


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for w in b:
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


# cut as texts are cut, so that a template of a script with vowel signs meets what the text gives
_TEMPLATES = [[w for part in t.split() for w in (["_"] if part == "_" else _words(part))] for t in REFUSALS]
_RARE = [max((w for w in t if w != "_"), key=len) for t in _TEMPLATES]


_SLOTS = [[frozenset(alternatives.split()) for alternatives in slots] for slots in REFUSAL_SLOTS]


def _slots_align(words: list[str], held: set[str]) -> bool:
    """Whether words of a template's slots follow each other, each at most SLOT_GAP words after the one before."""
    for slots in _SLOTS:
        if any(held.isdisjoint(slot) for slot in slots):
            continue
        reach = [i for i, w in enumerate(words) if w in slots[0]]
        for slot in slots[1:]:
            reach = sorted({j for i in reach for j in range(i + 1, min(len(words), i + 2 + SLOT_GAP)) if words[j] in slot})
        if reach:
            return True
    return False


class _Text:
    """A text with what several tests need of it, each computed once."""

    def __init__(self, text: str):
        self.body = plain(text)
        self.words = [w for w in _WORD.findall(self.body.replace("’", "'").lower())]


def _of(text: str | _Text) -> _Text:
    return text if isinstance(text, _Text) else _Text(text)


def is_refusal(text: str | _Text) -> bool:
    """It holds a template anywhere: all its words in order, within the template's length and one word more."""
    text = _of(text)
    held = set(text.words)
    for template, rare in zip(_TEMPLATES, _RARE):
        if rare not in held:
            continue
        fixed = [w for w in template if w != "_"]
        span = len(template) + 1
        for at in (i for i, w in enumerate(text.words) if w == fixed[0]):
            if common_subsequence(fixed, text.words[at : at + span]) == len(fixed):
                return True
    if _slots_align(text.words, held):
        return True
    if not _UNSPACED_REFUSAL.search(text.body):
        return False
    bare = re.sub(r"\s+", "", text.body)
    return any(t in bare for t in REFUSALS_UNSPACED)


#: Only texts with a character of these scripts can hold an unspaced template.
_UNSPACED_REFUSAL = re.compile("[" + "".join(sorted({t[0] for t in REFUSALS_UNSPACED})) + "]")


def is_copy(prompt: str | None | _Text, text: str | _Text) -> bool:
    asked, given = _of(prompt or "").words, _of(text).words
    if len(asked) < SHINGLE or len(given) < SHINGLE:
        return False
    a, b = (list(zip(*(w[k:] for k in range(SHINGLE)))) for w in (asked, given))
    in_a, in_b = set(a), set(b)
    if in_a.isdisjoint(in_b):
        return False
    contained, covered = sum(x in in_a for x in b) / len(b), sum(x in in_b for x in a) / len(a)
    if not (covered >= COVERED or (contained >= CONTAINED and covered >= COVERED / 2)):
        return False
    return common_subsequence(asked, given) / min(len(asked), len(given)) >= ALIGNED


@lru_cache(maxsize=1 << 16)
def _script_of_char(c: str) -> str | None:
    return next((name for name, rx in _SCRIPTS if rx.match(c)), None)


def _scripts(body: str) -> dict[str, int]:
    counts = {name: 0 for name, _ in _SCRIPTS}
    for c, n in Counter(body).items():
        script = _script_of_char(c)
        if script:
            counts[script] += n
    return counts


def language(text: str | _Text, hint: str | None = None) -> str | None:
    """Language code, or the script's name where the script doesn't tell; null without letters."""
    text = _of(text)
    counts = _scripts(text.body)
    letters = sum(counts.values())
    if not letters:
        return None
    if counts["kana"] > 0.1 * letters:
        return "ja"
    script = max(counts, key=lambda k: counts[k])
    own = {v: k for k, v in _SCRIPT_OF.items() if v not in ("cyrillic",)}
    if script in own:
        return own[script]
    among = _CYRILLIC if script == "cyrillic" else _LATIN
    score = {k: sum(w in held for w in text.words) for k, held in _FUNCTION.items() if k in among}
    low = text.body.lower()
    if script == "cyrillic":
        score["uk"] += 3 * len(re.findall(r"[іїєґ]", low))
        score["ru"] += 3 * len(re.findall(r"[ыэъё]", low))
    else:
        score["de"] += 2 * len(re.findall(r"[äöüß]", low))
        score["fr"] += 2 * len(re.findall(r"[èêçœàûîô]", low))
        score["es"] += 2 * len(re.findall(r"[ñ¿¡íóáú]", low))
    best = max(score, key=lambda k: (score[k], k == hint))
    return best if score[best] else script


_FUNCTION = {k: set(v) for k, v in FUNCTION_WORDS.items()}
#: Words from which a text without any function word of its asked language is in another one.
TELLING = 12


def is_wrong_language(text: str | _Text, asked: str | None) -> bool:
    """Wholly in another language; a text whose language can't be told, or with no language asked, is not.

    A text of TELLING words or more in the asked language's script that holds no function word of it is wrong too,
    whichever language it is in.
    """
    if not asked:
        return False
    text = _of(text)
    asked = asked.strip().lower().split("-")[0]
    want = _SCRIPT_OF.get(asked, "latin")
    got = language(text, asked)
    if got is None or got == asked:
        return False
    if got in ("latin", "cyrillic") and got == want:
        return asked in _FUNCTION and len(text.words) >= TELLING
    if got in _SCRIPT_OF.values() or got == "latin":
        return got != want
    if _SCRIPT_OF.get(got, "latin") != want:
        return _scripts(text.body)[want] < 0.3 * sum(c.isalpha() for c in text.body)
    return True


def _classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: list[tuple[int, str]] = []
        for i, prompt, raw, lang, cut_off in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if is_empty(raw):
                found.append((i, "empty_answer"))
                continue
            if cut_off:
                found.append((i, "truncated_answer"))
                continue
            text = _Text(raw)
            asked = _Text(prompt or "")
            if is_refusal(text):
                found.append((i, "refusal"))
            elif is_copy(asked, text):
                found.append((i, "question_copy"))
            elif is_wrong_language(text, lang or language(asked)):
                found.append((i, "wrong_language"))
        yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string())], names=["response_id", "defect"])


def pair_defects(responses: DataFrame, prompts: DataFrame, rules: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """(response_id, defect) of each defective pair of a response and the prompt of its request_id.

    ``rules`` (a fixed handful of rows) has (rule_id, answer_lang); a prompt whose rule is unknown asks for its own
    language. Responses without request_id or without its prompt are no pair; a response delivered twice is two
    pairs. Empty tables give no rows.

    Truncation is judged over all responses, those without request_id too, and over ``others``: further records
    (table_name, id, source, text) of the corpus, of tables not named "api_response".
    """
    rows = responses.where("request_id IS NOT NULL").select("response_id", "request_id", F.col("rule_id").alias("reply_rule"), F.col("raw_text").alias("text"))
    records = responses.select(F.lit("api_response").alias("table_name"), F.col("response_id").alias("id"), "source", F.col("raw_text").alias("text"))
    records = others.select("table_name", "id", "source", "text").unionByName(records) if others is not None else records
    damaged = truncation(records).where("truncated AND table_name = 'api_response'").select(F.col("id").alias("response_id"), F.lit(True).alias("cut_off")).distinct()
    asked = prompts.select("request_id", F.col("rule_id").alias("prompt_rule"), F.col("user_prompt_after_callbacks").alias("prompt"))
    langs = F.broadcast(rules.select("rule_id", "answer_lang").dropDuplicates(["rule_id"]))
    pairs = rows.join(asked, "request_id").withColumn("rule_id", F.coalesce("prompt_rule", "reply_rule")).join(langs, "rule_id", "left").join(damaged, "response_id", "left")
    return pairs.select("response_id", "prompt", "text", "answer_lang", F.coalesce("cut_off", F.lit(False)).alias("cut_off")).mapInArrow(_classify, "response_id long, defect string")
