"""Truncation, pair defects and sentences on small fixtures."""

import random

import pytest

from corpusmill.llm import pair_defects as D
from corpusmill.llm.queries import p1_found, p3_found
from corpusmill.llm.sentences import WordLattice, sentences, split_sentences, vocabulary
from corpusmill.llm.truncation import open_format, truncation, truncation_by_source

SUBJECTS = ["The courier", "Our manager", "The client", "A neighbour", "The operator"]
ENDS = ["called about the parcel", "waits for an answer", "closed the last ticket", "moved the visit to Friday", "asked for the address again"]


def texts(n, seed=1):
    rng = random.Random(seed)
    return [" ".join(f"{rng.choice(SUBJECTS)} {rng.choice(ENDS)}." for _ in range(rng.randrange(4, 9))) for _ in range(n)]


def test_cut_records_are_found(spark):
    whole = texts(400)
    rows = [("t", i, "a" if i % 2 else "b", t) for i, t in enumerate(whole)]
    cut = {}
    for i in range(0, 60, 3):
        name, k, source, t = rows[i]
        at = t[: len(t) - 3 - i % 7]  # inside the last words or between them
        rows[i] = (name, k, source, at)
        cut[i] = at
    rows[301] = ("t", 301, "a", whole[301][:-1])  # only its full stop is missing
    rows += [("t", 900, "a", None), ("t", 901, "a", ""), ("t", 902, "a", " \n"), ("t", 903, None, whole[5]), ("t", 904, "a", "???")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "table_name string, id long, source string, text string, token string")
    out = {r["id"]: r for r in truncation(df).collect()}
    assert set(out) == set(range(400)) | {903}
    flagged = {i for i, r in out.items() if r["truncated"]}
    assert set(cut) - flagged == set() and 301 not in flagged and len(flagged - set(cut)) == 0
    shares = {r["source"]: r["share"] for r in truncation_by_source(truncation(df)).collect()}
    assert shares["b"] > 0 and shares[None] == 0


def test_empty_table_has_no_truncation(spark):
    df = spark.createDataFrame([], "table_name string, id long, source string, text string")
    assert truncation(df).count() == 0


def test_open_formats():
    assert open_format('["a", "b') and open_format('```json\n["a",') and open_format("<answer>a</answer> <answer>b")
    assert not open_format('["a"]') and not open_format('```json\n["a"]\n```') and not open_format("<answer>a</answer>") and not open_format("plain [text")


@pytest.mark.parametrize("text,empty", [(None, True), ("", True), ("[]", True), ('[""]', True), ("```json\n[]\n```", True), ("1.\n2.", True), ("​", True), ("[null]", True), ("a", False), ("7", False), ("1. x", False)])
def test_empty_answers(text, empty):
    assert D.is_empty(text) is empty


@pytest.mark.parametrize("text,refused", [
    ("I'm sorry, but I can’t help with that.", True), ("К сожалению, я не могу выполнить эту просьбу.", True), ("Es tut mir leid, aber muss ich das ablehnen.", True), ("抱歉，我无法完成这个请求。", True),
    ("I can't talk right now, so please ring me again.", False), ("Не могу сейчас говорить, перезвоните мне.", False), ("Ich kann gerade nicht sprechen.", False), ("", False),
])
def test_refusals(text, refused):
    assert D.is_refusal(text) is refused


@pytest.mark.parametrize("text,refused", [
    ("You asked me for five lines of a caller. " * 8 + "I'm sorry, but I can't help with that.", True), ("您要我写几句关于快递的话。" * 8 + "抱歉，我无法完成这个请求。", True),
    ("क्षमा करें, मैं इस अनुरोध में मदद नहीं कर सकता।", True), ("क्षमा करें, मैं इसमें मदद नहीं कर सकती।", True), ("मैं आपकी मदद कर सकता हूँ।", False), ("You asked me for five lines of a caller. " * 12, False),
])
def test_refusals_anywhere_and_with_vowel_signs(text, refused):
    assert D.is_refusal(text) is refused


@pytest.mark.parametrize("text", [
    "I'm sorry, but I cannot complete that particular request.", "As an AI language model, I have no phone.", "Извините, я не смогу выполнить ваш запрос.", "Desculpe, não posso atender a esse pedido.",
    "Przykro mi, nie mogę wykonać tego polecenia.", "Mi dispiace, non posso soddisfare la tua richiesta.", "Diese Bitte muss warten, ich kann Ihre Anfrage leider nicht bearbeiten.",
])
def test_refusals_of_other_wordings(text):
    assert D.is_refusal(text) and D.is_refusal("слово " * 200 + text)


def test_a_language_without_a_word_list_is_not_the_asked_one():
    polish = "Dzień dobry, proszę podać numer telefonu jeszcze raz, ponieważ poprzednia wiadomość została ucięta przez system"
    assert D.is_wrong_language(polish, "en") and not D.is_wrong_language("Anna Kowalska, Warszawa", "en")


def test_copies_and_languages():
    prompt = "Write five short lines of a courier on the phone about a late parcel.\nKeep a calm tone."
    assert D.is_copy(prompt, "> " + prompt.upper()) and D.is_copy(prompt, "Write five short lines of a courier on the phone about a late parcel")
    assert not D.is_copy(prompt, "The courier is late. Your parcel comes tomorrow.") and not D.is_copy(None, "a b c d") and not D.is_copy(prompt, "")
    assert D.language("Мы перезвоним вам, и это не займёт много времени") == "ru" and D.language("Хто відповідає за чергу?") == "uk"
    assert D.language("Wir verschieben den Termin") == "de" and D.language("¿A qué número debemos llamar?") == "es" and D.language("番号をもう一度") == "ja" and D.language("123") is None
    assert D.is_wrong_language("The parcel is late", "ru") and not D.is_wrong_language("Клиент просит отчёт из API", "ru") and D.is_wrong_language("Le lot est conforme", "en") and not D.is_wrong_language("OK", "en") and not D.is_wrong_language("x", None)
    assert D.common_subsequence("a b c d".split(), "b x d".split()) == 2 and D.common_subsequence([], ["a"]) == 0


def test_pairs_of_tables(spark):
    prompts = spark.createDataFrame([(1, "r", "Write some lines about parcels please, in a calm tone"), (2, None, None)], "request_id long, rule_id string, user_prompt_after_callbacks string")
    rules = spark.createDataFrame([("r", "en"), ("r", "en")], "rule_id string, answer_lang string")
    rows = [(1, 1, "r", "s", None), (2, 1, "r", "s", "I must decline this request."), (3, 1, "r", "s", "Write some lines about parcels please, in a calm tone."), (4, 1, "r", "s", "Посылка уже у нас, мы перезвоним."), (5, 1, "r", "s", "The parcel is here."), (6, None, "r", "s", None), (7, 99, "r", "s", None), (8, 2, None, None, "Fine."), (9, 1, "r", "s", '["The parcel is he'), (10, 1, "r", "s", None)]
    responses = spark.createDataFrame(rows, "response_id long, request_id long, rule_id string, source string, raw_text string")
    got = {r["response_id"]: r["defect"] for r in D.pair_defects(responses, prompts, rules).collect()}
    assert got == {1: "empty_answer", 10: "empty_answer", 2: "refusal", 3: "question_copy", 4: "wrong_language", 9: "truncated_answer"}
    assert D.pair_defects(responses.limit(0), prompts, rules).count() == 0


def test_pairs_are_truncated_as_in_p1(spark, tmp_path):
    """The full form of a reply's cut word stands in accepted_mapping only."""
    rng = random.Random(3)
    name = lambda n: "".join(rng.choice("bcdfghjklmnp") for _ in range(n))
    replies = [f"please call {name(5 + i % 6)}" for i in range(40)] + ["please call wareho", "Please ring the caller back soon because the parcel has come to the desk."]
    write = lambda rows, schema, table: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
    write([(i, 1, None, "s", t) for i, t in enumerate(replies)] + [(90, None, None, "s", "Loose.")], "response_id long, request_id long, rule_id string, source string, raw_text string", "api_response")
    write([(i, "m", f"The warehouse is open in {i}.") for i in range(3)], "mapping_id long, source string, llm_text string", "accepted_mapping")
    write([(1, None, "Write the names of your callers")], "request_id long, rule_id string, user_prompt_after_callbacks string", "prompt_request")
    write([("r", "en")], "rule_id string, answer_lang string", "rule_config")
    got = {r["response_id"] for r in p3_found(spark, str(tmp_path)).where("defect = 'truncated_answer'").collect()}
    assert got == {r["record_id"] for r in p1_found(spark, str(tmp_path)).where("table_name = 'api_response'").collect()} == {40}


SPLITS = [
    ["Mr. Smith rang at 7.44 a.m. and left a code.", "Okay.", "The U.S. desk is open."],
    ['A reply such as "Sure. Here it is." does not count.', "Is it empty again?!", "Well... the second block was lost."],
    ["«Куда вам перезвонить?» — спросил бот.", "В 2020 г. правило давало до 9 тыс. фраз.", "По словам Л. Д. Иванова, ул. Мира, д. 4."],
    ["Проверили номера, имена и т. д.", "Скидка составила 13,6 %, т. е. 4142 руб. по тарифу «А. Б»."],
    ["Der Lauf endete am 6. Januar um 19.52 Uhr.", "Die Firma X GmbH & Co. KG hat z. B. Felder usw.", "Er sagte: „Moment. Ich suche.“", "Gut."],
    ["Los EE. UU. no usan este canal.", "¿A qué número?", "El Sr. Paz llama antes de las 13.55 h.", "Véase el art. 9.2."],
    ["La réponse « Voici. C'est tout. » a été refusée.", "Le taux passe à 2,7 %, c.-à-d. 4651 lignes."],
    ["Was it late for 73 sec.", "The end.", "👍 Fine."],
]


@pytest.mark.parametrize("parts", SPLITS)
def test_spaced_scripts(parts):
    text = " ".join(parts).replace(". 👍 ", ". 👍 ")
    got = [text[a:b] for a, b in sentences(text)]
    want = [p for p in parts]
    if "👍" in text:
        want = ["Was it late for 73 sec.", "The end. 👍", "Fine."]
    assert got == want


@pytest.mark.parametrize("parts", [
    ["真的吗？！", "客户说：“等一下。我找张纸。”", "“您要留哪个号码？”助手问道。", "嗯……最后一段没有听清。"],
    ["「少々お待ちください。紙を探します」と客は言った。", "番号をもう一度お願いします！"],
    ["क्या खिड़की फिर से खाली है?", "डॉ. नालवी ने नियम सं. 9571 की जाँच की।"],
])
def test_other_terminators(parts):
    text = ("" if "。" in parts[-1] or "！" in parts[-1] else " ").join(parts)
    assert [text[a:b] for a, b in sentences(text)] == parts


def test_thai_gaps_and_lattice():
    parts = ["เวอร์ชัน 1.3.14 แก้ปัญหาข้อความขาดแล้วครับ", "หน้าต่าง QD-72474 ว่างอีกแล้วหรือครับ", "ใครดูแลคิวของมารินคะ"]
    text = " ".join(parts)
    assert [text[a:b] for a, b in sentences(text)] == parts
    assert WordLattice({"ab": 1.0, "abc": 1.0, "d": 1.0}).cut("abcd") == ["abc", "d"]
    # runs far longer than a word on both sides of a gap
    long = ["ก" * 500 + "ครับ", "ข" * 500 + "ค่ะ"]
    assert [" ".join(long)[a:b] for a, b in sentences(" ".join(long))] == long


@pytest.mark.parametrize("parts", [
    ["ຂ້ອຍໄດ້ຮັບແລ້ວເຈົ້າ", "ໝາຍເລກຫຍັງບໍ"],
    ["ខ្ញុំបានទទួលហើយ។", "តើលេខអ្វី?"],
    ["ကျွန်တော်လက်ခံရရှိပြီ။", "နံပါတ်ဘယ်လောက်လဲ။"],
    ["我收到了号码吗", "请再说一次"],
    ["番号を確認しました", "次に名前をお願いします"],
])
def test_scripts_without_spaces(parts):
    text = ("" if parts[0][-1] in "吗た" else " ").join(parts)
    assert [text[a:b] for a, b in sentences(text)] == parts


def test_a_quotation_of_any_length_stays_in_its_sentence():
    for n in (20, 50, 400):
        text = "Он ответил: «" + "Да. Нет. Потом. " * n + "Всё» и ушёл. Потом вернулся."
        assert [text[a:b] for a, b in sentences(text)] == [text[: text.index(" Потом вернулся")], "Потом вернулся."]


def test_vocabulary_is_of_the_corpus(spark):
    rng = random.Random(1)
    kana = lambda: "".join(chr(rng.randrange(0x3041, 0x3097)) for _ in range(30))
    df = spark.createDataFrame([(kana() + "電話番号" + kana(),) for _ in range(50)] + [(None,), ("only latin",)], "t string")
    words = vocabulary(df, "t")
    assert "電話番号" in words and "話番" not in words and not any(w.isascii() for w in words)
    assert vocabulary(df.limit(0), "t") == {}


def test_layouts():
    cases = {
        "Notes\n\nOne two three. Four\nfive": None,
        "1. One. Two\n2. Three": ["1. One. Two", "2. Three"],
        "бот: Да. Нет.\nклиент: Ага.": ["бот: Да.", "Нет.", "клиент: Ага."],
        "линия слушает\nзапишите номер\nспасибо": ["линия слушает", "запишите номер", "спасибо"],
        "Конец.Начало новой фразы.": ["Конец.", "Начало новой фразы."],
    }
    for text, want in cases.items():
        got = [text[a:b] for a, b in sentences(text)]
        assert want is None or got == want, got
    wrapped = "The first sentence of this paragraph is long\nenough to be wrapped over several lines of the\nsame width. The second one follows it closely\nand ends here."
    assert len(sentences(wrapped)) == 2


def test_spans_never_overlap_and_cover_the_text(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    texts_ = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = split_sentences(docs, "doc_id", "text").collect()
    by = {}
    for r in rows:
        by.setdefault(r["id"], []).append((r["start_char"], r["end_char"]))
    for i, text in texts_.items():
        spans = sorted(by.get(i, []))
        assert bool(spans) == bool(text and text.strip())
        assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
        left = "".join((text or "")[x:y] for x, y in zip([0] + [s[1] for s in spans], [s[0] for s in spans] + [len(text or "")]))
        assert not left.strip()
    assert all(texts_[r["id"]][r["start_char"] : r["end_char"]].strip() == texts_[r["id"]][r["start_char"] : r["end_char"]] for r in rows)
    assert sentences(None) == [] and sentences("") == [] and sentences(" \n") == []
