"""DuckDB SQL of the engine's queries, over the same tables."""

from __future__ import annotations

from ..functions.normal_text import EDGE_CHARS
from ..functions.text import LINE_END, NOT_WS, WS, WS_CHARS, WORD_LEFT, WORD_RIGHT
from ..operators.checks import ECHO_BEGINNINGS, ECHO_WORDS
from ..operators.parsers import BULLET_CHARS
from ..operators.validators import CONTEXT_WORDS, OFF_TOPIC_WORDS

_q = lambda s: "'" + s.replace("'", "''") + "'"
_WS, _EDGE, _BULLET = _q(WS_CHARS), _q(EDGE_CHARS), _q(BULLET_CHARS)
_collapse = lambda t: f"trim(regexp_replace({t}, '{WS}+', ' ', 'g'))"
_count = lambda t, p: f"len(regexp_extract_all({t}, '{p}'))"
_words = lambda t: _count(t, NOT_WS + "+")
_norm = lambda t: f"trim(lower(translate(regexp_replace(trim({t}, {_WS}), '{WS}+', ' ', 'g'), 'ёЁ', 'еЕ')), {_EDGE})"
_ECHO = f"{WORD_LEFT}(?:{'|'.join(ECHO_WORDS)}){WORD_RIGHT}|{WORD_LEFT}(?:{'|'.join(ECHO_BEGINNINGS)})"
_echo = lambda t: (
    f"CASE WHEN starts_with({t}, '-') OR starts_with({t}, '*') THEN 'not_instruction_echo:list_item_echo' WHEN contains({t}, chr(10)) THEN 'not_instruction_echo:multiline_echo' WHEN regexp_matches({t}, '{_ECHO}', 'i') THEN 'not_instruction_echo:instruction_echo' END"
)
_range = lambda n, name, lo, hi, what: f"CASE WHEN {n} < {lo} THEN '{name}:too_few_{what}' WHEN {n} > {hi} THEN '{name}:too_many_{what}' END"


_times = lambda t, p: f"((length({t}) - length(replace({t}, {_q(p)}, ''))) // {len(p)})"


def _strip(t: str, parts: list[str]) -> str:
    for p in sorted(parts, key=len, reverse=True):
        t = f"replace({t}, {_q(p)}, ' ')"
    return _collapse(t)


def _docs(case: str) -> str:
    return f"SELECT doc_id, CASE WHEN text IS NULL THEN 'null_text' ELSE {case} END AS reason FROM documents"


_CODES = ["QD", "KR", "LS", "TM", "ZV"]
_lines_of = lambda t: f"list_filter(list_transform(regexp_split_to_array({t}, '{LINE_END}'), lambda x: trim(ltrim(trim(x, {_WS}), {_BULLET}), {_WS})), lambda x: x <> '')"
_LINES = f"(SELECT doc_id, lang, coalesce(rule_id, 'none') AS rule_id, unnest(range(1, len(l) + 1)) AS candidate_index, unnest(l) AS text FROM (SELECT doc_id, lang, rule_id, {_lines_of('text')} AS l FROM documents))"
_STREAM = f"(SELECT rule_id, doc_id * 1000000 + candidate_index AS seq, text, {_norm('text')} AS norm FROM {_LINES})"
_prefix = lambda n, k: f"array_to_string(regexp_extract_all({n}, '{NOT_WS}+')[1:{k}], ' ')"


def _dedup(scope: str, exact: bool, words: int | None, most: int) -> str:
    """The closed window forms of ordered deduplication."""
    bucket = "'all'" if scope == "global" else "rule_id"
    rows = f"(SELECT rule_id, seq, {bucket} AS b, norm AS n, {_prefix('norm', words) if words else chr(39) * 2} AS p FROM {_STREAM})"
    if not exact:
        return f"SELECT rule_id, seq, CASE WHEN row_number() OVER (PARTITION BY b, p ORDER BY seq) <= {most} THEN 'ok' ELSE 'prefix_overuse' END AS verdict FROM {rows}"
    one = f"(SELECT *, row_number() OVER (PARTITION BY b, n ORDER BY seq) AS rn FROM {rows})"
    two = f"(SELECT *, sum(CASE WHEN rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY b, p ORDER BY seq) AS dr FROM {one})"
    three = f"(SELECT *, first_value(dr) OVER (PARTITION BY b, n ORDER BY seq) AS fr FROM {two})"
    quota = f"fr <= {most}" if words else "true"
    return f"SELECT rule_id, seq, CASE WHEN {quota} AND rn = 1 THEN 'ok' WHEN {quota} THEN 'duplicate_exact' ELSE 'prefix_overuse' END AS verdict FROM {three}"


def _cap(rows: str, target: str) -> str:
    before = f"(SELECT d.*, coalesce(sum(CASE WHEN verdict = 'ok' THEN 1 ELSE 0 END) OVER (PARTITION BY d.rule_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, {target} AS target FROM ({rows}) d LEFT JOIN rule_config c USING (rule_id))"
    return f"SELECT rule_id, seq, CASE WHEN target IS NOT NULL AND before >= target THEN 'unprocessed' ELSE verdict END AS verdict FROM {before}"


_TAGS = f"list_filter(list_transform(regexp_extract_all(raw_text, '(?is)<answer>{WS}*(.*?){WS}*</answer>', 1), lambda x: trim({_collapse('x')}, {_q(chr(34) + chr(39))})), lambda x: x <> '')"
_L, _R = r"(?:^|[^\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|$)"
_MARKS = ['"', "'", "`", "«", "»", "[", "]", "{", "}", "<", ">", "|", ":", ";"]
_PLAIN_STYLE = [rf"^{WS}*[-*0-9]+(?:[.)]|{WS})", *(rf"{_L}{w}{_R}" for w in ("json", "markdown", "prompt", "rule", "example", "сгенерируй", "верни"))]
_TERM_STYLE = [*_PLAIN_STYLE, rf"{_L}данн(?:ая|ый|ое|ые){_R}", rf"{_L}вышеуказан", rf"{_L}нижеследующ", rf"{_L}настоящ(?:им|ая|ий|ее){_R}", rf"{_L}следует отметить{_R}", rf"{_L}в рамках настоящего{_R}"]
_TARGETED = [*_PLAIN_STYLE, rf"{_L}фраза{WS}+с{_R}", rf"{_L}обязательн[\p{{L}}\p{{N}}_]*{WS}+(?:слов|термин|фрагмент)"]
_or = lambda parts: "(" + " OR ".join(parts) + ")"
_spaced = lambda t: f"WHEN trim({t}, {_WS}) <> {_collapse(t)} THEN 'bad_spacing' WHEN contains({t}, chr(10)) OR contains({t}, chr(13)) THEN 'multiline' WHEN {_or(f'contains({t}, {_q(m)})' for m in _MARKS)} THEN 'written_or_dialog_punctuation'"
_styled = lambda t, patterns: f"WHEN {_or(f'regexp_matches(lower({t}), {_q(p)})' for p in patterns)} THEN 'written_style'"
_short = lambda t, n: f"WHEN ends_with(trim({t}, {_WS}), ',') OR {_count(t, '[A-Za-zА-Яа-яЁё0-9]+')} < {n} THEN 'sentence_fragment'"
_shape = lambda t: f"CASE {_spaced(t)} {_styled(t, _TARGETED)} {_short(t, 5)} END"


def _term(t: str, term: str, others: list[str], context: list[str], off: list[str]) -> str:
    rest = f"replace(lower({t}), {_q(term.lower())}, ' ')"
    other = f"WHEN {_or(f'contains({t}, {_q(o)})' for o in others if o != term)} THEN 'other_protected_term_present'"
    return f"CASE {_spaced(t)} WHEN {_times(t, term)} <> 1 THEN 'required_term_count' {other} WHEN NOT {_or(f'contains({rest}, {_q(w)})' for w in context)} THEN 'business_context_missing' {_styled(t, _TERM_STYLE)} WHEN {_or(f'contains(lower({t}), {_q(w)})' for w in off)} THEN 'random_topic' {_short(t, 6)} END"


_fragment = lambda t, part: f"coalesce({_shape(t)}, CASE WHEN {_times(t, part)} <> 1 THEN 'required_fragment_count' END)"
_alone = lambda t, part: f"coalesce({_fragment(t, part)}, CASE WHEN NOT regexp_matches({t}, {_q(f'(?:^|[^A-Za-zА-Яа-яЁё]){part}(?:[^A-Za-zА-Яа-яЁё]|$)')}) THEN 'required_word_not_standalone' END)"
_spelled = lambda t, part, wrong, why: f"coalesce({_fragment(t, part)}, CASE WHEN {_or(f'contains({t}, {_q(w)})' for w in wrong)} THEN {_q(why)} END)"
_question = lambda t, markers: f"coalesce({_shape(t)}, CASE WHEN {' + '.join(_times(t, m) for m in markers)} <> 1 THEN 'question_marker_count' WHEN NOT {_or(f'ends_with({t}, {_q(m)})' for m in markers)} THEN 'question_marker_not_final' WHEN {_times(t, '?')} <> 1 THEN 'question_mark_count' END)"
_W = r"[\p{L}\p{N}_]"
_TO = r"(?:[^\p{L}\p{N}_]|[^\p{L}\p{N}_].*[^\p{L}\p{N}_])"  # from a word's end to a later word's beginning
_CHANNEL = [*(rf"{_L}{p}{WS}+max{_R}" for p in ("в", "через", "из", "для", f"канал{_W}*", f"чат{_W}*")), rf"{_L}сообщени{_W}*{WS}+(?:.*[^\p{{L}}\p{{N}}_])?max{_R}", *(rf"{_L}max{_TO}{p}" for p in ("сообщени", "канал", "чат"))]
_in_setting = lambda t, inner, settings, name: f"coalesce({inner}, CASE WHEN NOT {_or(f'regexp_matches(lower({t}), {_q(p)})' for p in settings)} THEN 'max_context_missing' WHEN regexp_matches(lower({t}), {_q(name)}) THEN 'max_as_person_name' END)"
_TERMS = ["АИ МОП", "AmoCRM", "Bitrix", "API", "WhatsApp", "Telegram", "Max"]
_term_of = lambda t, term: _term(t, term, _TERMS, CONTEXT_WORDS, OFF_TOPIC_WORDS)
_held = lambda term: f"(left(text, length(text) - length(last)) || {_q(term)})"
_SETS = {
    **{n: _term_of(_held(t), t) for n, t in zip(("ai_mop", "amocrm", "bitrix", "api", "whatsapp", "telegram"), _TERMS)},
    "max": _in_setting(_held("Max"), _term_of(_held("Max"), "Max"), _CHANNEL, rf"{_L}максим{_W}*{_R}"),
    "sahara": _fragment(_held("пустыня Сахара"), "пустыня Сахара"),
    "refuseniks": _alone(_held("отказников"), "отказников"),
    "question_check": _question(_held("Понятно?"), ["Окей?", "Хорошо?", "Договорились?", "Алло?", "Понятно?"]),
    "one_c": _spelled(_held("1С"), "1С", ["1C", "1с"], "wrong_one_c_spelling"),
}
_spoken = lambda t: _collapse(f"regexp_replace(replace(lower({t}), 'ё', 'е'), " + _q(r"""[.,;:!?"'`«»()\[\]{}<>/\\|]+""") + ", ' ', 'g')")
_markers = ["раз?", "again?", "цифре?"]

_D = "['ноль','один','два','три','четыре','пять','шесть','семь','восемь','девять']"
_T = "['десять','одиннадцать','двенадцать','тринадцать','четырнадцать','пятнадцать','шестнадцать','семнадцать','восемнадцать','девятнадцать']"
_TT = "['','','двадцать','тридцать','сорок','пятьдесят','шестьдесят','семьдесят','восемьдесят','девяносто']"
_H = "['','сто','двести','триста','четыреста','пятьсот','шестьсот','семьсот','восемьсот','девятьсот']"
_R_WORDS = "['нуля','единицы','двойки','тройки','четверки','пятерки','шестерки','семерки','восьмерки','девятки']"
_DIV = "[{{'k':'scene','v':['call','note','chat','desk'],'n':2,'i':0}},{{'k':'tone','v':['calm','brisk','warm'],'n':1,'i':1}}]".replace("{{", "{").replace("}}", "}")
_SAMPLED = f"""(SELECT request_id AS request_index, d.i AS dim, d.k AS dimension, array_to_string(list_transform(list_sort(list_transform(range(0, len(d.v)), lambda j: md5(concat_ws(':', '42', rule_id, request_id, d.k, j, d.v[j + 1])) || '|' || d.v[j + 1]))[1:d.n], lambda x: x[34:]), '|') AS picked
  FROM (SELECT request_id, rule_id, unnest({_DIV}) AS d FROM prompt_request))"""

_LINE = "doc_id, candidate_index::INTEGER AS candidate_index"
_WRAPPED = f"""(WITH c AS (SELECT case_id, arg_max({{'case_id': case_id, 'phone_digits': phone_digits, 'target_digits': target_digits, 'expected_result': expected_result, 'kind': kind, 'spoken': spoken}}, variant_id) AS case_ FROM phone_variant WHERE case_id IS NOT NULL GROUP BY case_id)
SELECT mapping_id, llm_text, case_, CASE WHEN c.case_id IS NULL THEN 'unknown_case' WHEN NOT coalesce(contains(llm_text, case_.spoken) OR contains({_spoken('llm_text')}, {_spoken('case_.spoken')}), false) THEN 'source_spoken_missing_or_changed' WHEN contains(llm_text, case_.phone_digits) THEN 'canonical_digits_leaked' END AS reason FROM accepted_mapping a LEFT JOIN c ON a.case_id = c.case_id)"""
_slice = lambda t: f"substring({t}, strpos({t}, '['), length({t}) - strpos(reverse({t}), ']') + 2 - strpos({t}, '['))"


def _json_of(t: str) -> str:
    """Stripped non-empty strings of a JSON array, from the widest bracketed slice where the whole is no JSON; else null."""
    whole = f"CASE WHEN json_valid({t}) THEN {t} WHEN contains({t}, '[') AND contains({t}, ']') AND json_valid({_slice(t)}) THEN {_slice(t)} END"
    strings = "list_filter(list_transform(list_filter(json_extract(j, '$[*]'), lambda x: json_type(x) = 'VARCHAR'), lambda x: trim(x->>'$', " + _WS + ")), lambda x: x <> '')"
    return f"(SELECT CASE WHEN json_type(j) = 'ARRAY' THEN {strings} END FROM (SELECT {whole} AS j))"


_PARSED = f"(SELECT response_id, rule_id, raw_text, CASE parser WHEN 'lines' THEN {_lines_of('raw_text')} WHEN 'answer_tags' THEN {_TAGS} WHEN 'json_array' THEN {_json_of('raw_text')} END AS items FROM api_response JOIN rule_config USING (rule_id))"
_ITEMS = f"(SELECT rule_id, response_id, unnest(range(1, len(items) + 1))::INTEGER AS candidate_index, unnest(items) AS text FROM {_PARSED})"
_JUDGED = f"(SELECT *, response_id * 1000000 + candidate_index AS seq, coalesce({_range(_words('text'), 'word_count_between', 4, 60, 'words')}, {_echo('text')}) AS reason FROM {_ITEMS})"
_PER_RULE = f"(SELECT rule_id, target_count AS target, coalesce(k, 0) AS accepted, greatest(target_count - coalesce(k, 0), 0) AS remaining FROM rule_config LEFT JOIN (SELECT rule_id, count(*) AS k FROM {_JUDGED} WHERE reason IS NULL GROUP BY rule_id) USING (rule_id))"
_SAID = (
    "word count must be between 20 and 120\nmust contain at least one of: номер, batch, The \nmust not contain any of: QD-, \r\n\nmust not match any regex: [!?]{2}, (json|yaml)\n"
    "must be Russian-context text with at least 50 Cyrillic chars and at most 10 Latin chars\nmust not contain Latin characters outside: QD, KR, LS, TM, ZV\n"
    "must not contain decimal digits\nmust contain at least one decimal digit\nmust not echo prompts, formatting instructions, markdown, or metadata"
)
_drawn = lambda keys: f"('0x' || substr(md5(concat_ws(':', {keys})), 1, 8))::BIGINT"
_one_of = lambda options, keys: f"({options})[{_drawn(keys)} % len({options}) + 1]"
_in_words = lambda v: f"(CASE WHEN {v} = 0 THEN 'ноль' ELSE trim(concat_ws(' ', CASE WHEN {v} >= 100 THEN {_H}[{v} // 100 + 1] END, CASE WHEN {v} % 100 BETWEEN 10 AND 19 THEN {_T}[{v} % 10 + 1] WHEN {v} % 100 >= 20 THEN {_TT}[{v} % 100 // 10 + 1] END, CASE WHEN {v} % 10 > 0 AND {v} % 100 NOT BETWEEN 10 AND 19 THEN {_D}[{v} % 10 + 1] END)) END)"
_each_digit = lambda d: f"array_to_string(list_transform(string_split({d}, ''), lambda x: {_D}[x::INTEGER + 1]), ' ')"


def _read(d: str, keys: str) -> str:
    """One of the readings of a block of one to three digits that keep its leading zeros."""
    rest = f"ltrim({d}, '0')"
    zeros = f"(length({d}) - length({rest}))"
    value = f"CASE WHEN {rest} <> '' THEN ' ' || {_in_words(f'try_cast({d} AS INTEGER)')} ELSE '' END"
    single = f"trim(repeat('ноль ', {zeros}))"
    many = f"CASE {zeros} WHEN 2 THEN ['две нуля' || {value}] WHEN 3 THEN ['три нуля' || {value}] ELSE [] END"
    digits = f"CASE WHEN {rest} <> '' THEN [{single} || ' ' || {_each_digit(rest)}] ELSE [] END"
    options = f"CASE WHEN {zeros} = 0 THEN [{_in_words(f'try_cast({d} AS INTEGER)')}] ELSE list_concat([{single} || {value}], {many}, {digits}) END"
    return f"CASE WHEN regexp_matches({d}, '^[0-9]{{1,3}}$') THEN (SELECT {_one_of('o', keys)} FROM (SELECT {options} AS o)) END"


def _phone_cases() -> str:
    """Eleven cases of each number, from the same index space; choices are drawn by md5."""
    at = "((i * 6700417 + 42 * 1000003) % 200000000)"
    numbers = f"SELECT i AS idx, '8' AS b0, lpad(({at} // 10000000 + 880)::VARCHAR, 3, '0') AS b1, lpad(({at} % 10000000 // 10000)::VARCHAR, 3, '0') AS b2, lpad(({at} % 10000 // 100)::VARCHAR, 2, '0') AS b3, lpad(({at} % 100)::VARCHAR, 2, '0') AS b4 FROM (SELECT unnest(range(1, (SELECT count(*) FROM supplier) + 1)) AS i)"
    key = lambda salt: f"idx, '42:{salt}'"
    words = lambda i, salt: _read(f"b{i}", f"b{i}, {key(f'{salt}:{i}')}")
    glued = lambda i, salt: f"replace({words(i, salt)}, ' ', '')"
    choose = lambda salt, *options: _one_of("[" + ", ".join(options) + "]", key(salt))
    chance = lambda salt, share: f"{_drawn(key(salt))} % 1000 < {int(1000 * share)}"
    repeated = lambda i: f"CASE WHEN length(b{i}) IN (2, 3) AND replace(b{i}, b{i}[1], '') = '' THEN CASE length(b{i}) WHEN 2 THEN 'две ' ELSE 'три ' END || {_R_WORDS}[b{i}[1]::INTEGER + 1] END"
    said = lambda i: f"CASE WHEN {repeated(i)} IS NOT NULL AND {chance(f'r{i}', 0.8)} THEN {repeated(i)} WHEN contains(b{i}, '0') AND {chance(f'd{i}', 0.7)} THEN {_each_digit(f'b{i}')} ELSE {words(i, 'r')} END"
    filler = lambda salt: choose(salt, "'так'", "'секунду'", "'записывайте'", "'дальше'", "'угу'")
    join = lambda *parts: f"concat_ws(' ', {', '.join(parts)})"
    ideal = join("'восемь'", *(words(i, "ideal") for i in range(1, 5)))
    typos = ideal
    for right, wrong in (("девятьсот", "девятсот"), ("семьдесят", "семсят"), ("пятьдесят", "писят"), ("девяносто", "девясат"), ("двадцать", "двацать"), ("одиннадцать", "одинадацать"), ("восемнадцать", "восемьнадцать"), ("шестнадцать", "шеснадцать")):
        typos = f"replace({typos}, '{right}', '{wrong}')"
    mixed = join(choose("m0", "'8'", "'+7'", "'семь'"), words(1, "m"), *(choose(f"m{i}", f"b{i}", words(i, "m")) for i in (2, 3, 4)))
    glue = join("'восемь'", glued(1, "g"), choose("g2", glued(2, "g"), words(2, "g")), glued(3, "g"), choose("g4", glued(4, "g"), words(4, "g")))
    split = f"'записывайте ' || {words(0, 'f')} || ', ' || {words(1, 'f')} || ', ' || {filler('f1')} || ', ' || {words(2, 'f')} || ', ' || {filler('f2')} || ', ' || {words(3, 'f')} || ' ' || {words(4, 'f')} || ', все'"
    repeats = join(choose("r0", "'восемь'", "'8'"), *(said(i) for i in range(1, 5)))
    w = ["'восемь'", *(words(i, "i") for i in range(1, 5))]
    whole = "b0 || b1 || b2 || b3 || b4"
    cases = [("complete_ideal", 0, whole, whole, ideal, "ideal")]
    cases += [("complete_noisy", i, whole, whole, x, f"noise_{i}") for i, x in enumerate((mixed, glue, split, typos, repeats), 1)]
    for i, (note, x, y) in enumerate((("missing_prefix", 1, 5), ("only_prefix", 0, 1), ("missing_middle_and_tail", 0, 2), ("missing_both_tail_blocks", 0, 3), ("missing_last_tail_block", 0, 4)), 1):
        cases.append(("incomplete", i, " || ".join(f"b{j}" for j in range(x, y)), "NULL", join(*w[x:y]), note))
    each = " UNION ALL ".join(f"SELECT printf('phone_%06d__%s_%d', idx, '{k}', {i}) AS case_id, {whole} AS phone_digits, {target} AS target_digits, {expected}::VARCHAR AS expected_result, '{k}' AS kind, {i}::INTEGER AS variant_index, concat_ws('-', b0, b1, b2, b3, b4) AS blocks, {spoken} AS spoken, '{note}' AS notes FROM n" for k, i, target, expected, spoken, note in cases)
    return f"WITH n AS ({numbers}) {each}"


#: The whole stream row by row: the k-th row of every bucket meets the accepted rows of its bucket so far.
_SEQUENTIAL = f"""WITH RECURSIVE s AS MATERIALIZED (SELECT rule_id, seq, norm, {_prefix('norm', 3)} AS prefix, row_number() OVER (PARTITION BY rule_id ORDER BY seq) AS k FROM {_STREAM}),
t AS MATERIALIZED (SELECT rule_id, norm, row_number() OVER (ORDER BY rule_id, norm) AS tid FROM (SELECT DISTINCT rule_id, norm FROM s)),
p AS MATERIALIZED (SELECT rule_id, prefix, row_number() OVER (ORDER BY rule_id, prefix) AS pid FROM (SELECT DISTINCT rule_id, prefix FROM s)),
g AS MATERIALIZED (SELECT rule_id, tid, unnest(CASE WHEN norm = '' THEN [] WHEN length(norm) <= 3 THEN [norm] ELSE list_distinct(list_transform(range(1, length(norm) - 1), lambda i: substring(norm, i, 3))) END) AS g FROM t),
z AS MATERIALIZED (SELECT tid, count(*) AS size FROM g GROUP BY tid),
e AS MATERIALIZED (SELECT x.tid AS a, y.tid AS b FROM g x JOIN g y ON x.rule_id = y.rule_id AND x.g = y.g AND x.tid <> y.tid JOIN z zx ON zx.tid = x.tid JOIN z zy ON zy.tid = y.tid WHERE least(zx.size, zy.size) >= 0.85 * greatest(zx.size, zy.size)
  GROUP BY x.tid, y.tid, zx.size, zy.size HAVING count(*) / (zx.size + zy.size - count(*)) >= 0.86),
n AS MATERIALIZED (SELECT a AS tid, list(b) AS near FROM e GROUP BY a),
r AS MATERIALIZED (SELECT s.rule_id, s.seq, s.k, t.tid, p.pid, coalesce(n.near, []) AS near FROM s JOIN t USING (rule_id, norm) JOIN p USING (rule_id, prefix) LEFT JOIN n USING (tid)),
w(rule_id, seq, k, verdict, texts, prefixes) AS (
  SELECT rule_id, NULL::BIGINT, 0::BIGINT, NULL::VARCHAR, []::BIGINT[], []::BIGINT[] FROM (SELECT DISTINCT rule_id FROM s)
  UNION ALL
  SELECT rule_id, seq, k, verdict, CASE WHEN verdict = 'ok' THEN list_append(texts, tid) ELSE texts END, CASE WHEN verdict = 'ok' THEN list_append(prefixes, pid) ELSE prefixes END FROM (
    SELECT r.*, w.texts, w.prefixes, CASE WHEN list_contains(w.texts, r.tid) THEN 'duplicate_exact' WHEN len(list_filter(w.prefixes, lambda x: x = r.pid)) >= 20 THEN 'prefix_overuse' WHEN list_has_any(w.texts[-3000:], r.near) THEN 'ngram_near_duplicate' ELSE 'ok' END AS verdict
    FROM w JOIN r ON r.rule_id = w.rule_id AND r.k = w.k + 1))
SELECT rule_id, seq, verdict FROM w WHERE k > 0"""

SQL: dict[str, str] = {
    "check_word_count": _docs(_range(_words("text"), "word_count_between", 20, 120, "words")),
    "check_char_count": _docs(_range("length(text)", "char_count_between", 100, 900, "chars")),
    "check_contains_any": _docs("CASE WHEN NOT (contains(text, 'номер') OR contains(text, 'batch') OR contains(text, 'The ')) THEN 'require_contains_any:missing_required_fragment' END"),
    "check_contains_any_ci": _docs("CASE WHEN NOT (contains(lower(text), 'номер') OR contains(lower(text), 'batch')) THEN 'require_contains_any:missing_required_fragment' END"),
    "check_contains_all": _docs("CASE WHEN NOT (contains(text, '. ') AND contains(text, ', ')) THEN 'require_contains_all:missing_required_fragment' END"),
    "check_reject_contains_any": _docs("CASE WHEN contains(text, 'QD-') OR contains(text, chr(13) || chr(10)) THEN 'reject_contains_any:forbidden_fragment' END"),
    "check_require_regex": _docs("CASE WHEN NOT (regexp_matches(text, '[A-Z]{2}-[0-9]{4,5}') OR regexp_matches(text, '[0-9]+,[0-9] %')) THEN 'require_regex_any:regex_required_pattern_missing' END"),
    "check_reject_regex": _docs("CASE WHEN regexp_matches(text, '[!?]{2}') OR regexp_matches(text, '(json|yaml)') THEN 'reject_regex_any:forbidden_regex' END"),
    "check_russian_text": _docs(f"CASE WHEN {_count(_strip('text', _CODES), '[ЁёА-Яа-я]')} < 50 THEN 'russian_text:not_enough_cyrillic' WHEN {_count(_strip('text', _CODES), '[A-Za-z]')} > 10 THEN 'russian_text:too_much_latin' END"),
    "check_no_latin": _docs(f"CASE WHEN {_count(_strip('text', _CODES), '[A-Za-z]')} > 0 THEN 'no_latin:latin_present' END"),
    "check_no_digits": _docs(r"CASE WHEN regexp_matches(text, '\p{Nd}') THEN 'no_digits:digits_present' END"),
    "check_require_digits": _docs(r"CASE WHEN NOT regexp_matches(text, '\p{Nd}') THEN 'require_digits:digits_missing' END"),
    "check_instruction_echo": _docs(_echo("text")),
    "check_chain_first_fail": f"SELECT lang, reason, count(*) AS n FROM (SELECT lang, coalesce({_range(_words('text'), 'word_count_between', 4, 30, 'words')}, CASE WHEN NOT (contains(text, 'е') OR contains(text, 'a') OR contains(text, 'の') OR contains(text, '的')) THEN 'require_contains_any:missing_required_fragment' END, {_echo('text')}, 'accepted') AS reason FROM {_LINES}) GROUP BY ALL",
    "parse_lines": f"SELECT doc_id, candidate_index::INTEGER AS candidate_index, text FROM {_LINES}",
    "parse_answer_tags": f"SELECT response_id, unnest(range(1, len(l) + 1))::INTEGER AS candidate_index, unnest(l) AS text FROM (SELECT response_id, {_TAGS} AS l FROM api_response)",
    "normalize_text": f"SELECT doc_id, {_norm('text')} AS norm FROM documents",
    "prefix_key": f"SELECT doc_id, {_prefix(_norm('text'), 4)} AS prefix FROM documents",
    "char_ngrams_count": f"SELECT doc_id, (CASE WHEN n = '' THEN 0 WHEN length(n) <= 3 THEN 1 ELSE len(list_distinct(list_transform(range(1, length(n) - 1), lambda i: substring(n, i, 3)))) END)::INTEGER AS n FROM (SELECT doc_id, {_collapse(_norm('text'))} AS n FROM documents)",
    "jaccard_pairs": f"""WITH t AS (SELECT DISTINCT coalesce(phone_digits, '') AS bucket, {_norm('spoken')} AS norm FROM phone_variant WHERE spoken IS NOT NULL),
g AS (SELECT bucket, norm, CASE WHEN norm = '' THEN [] WHEN length(norm) <= 3 THEN [norm] ELSE list_distinct(list_transform(range(1, length(norm) - 1), lambda i: substring(norm, i, 3))) END AS g FROM t),
p AS (SELECT a.bucket AS bucket, a.norm AS x, b.norm AS y, len(list_intersect(a.g, b.g)) AS shared, len(a.g) + len(b.g) AS total FROM g a JOIN g b ON a.bucket = b.bucket AND a.norm < b.norm)
SELECT bucket, least(md5(x), md5(y)) AS text_a, greatest(md5(x), md5(y)) AS text_b, round(shared / (total - shared), 6) AS jaccard FROM p WHERE total > shared AND shared / (total - shared) >= 0.75""",
    "text_measures": f"SELECT doc_id, {_words('text')} AS words, {_count('text', '[ЁёА-Яа-я]')} AS cyrillic, {_count('text', '[A-Za-z]')} AS latin, regexp_matches(text, '\\p{{Nd}}') AS digit, {_times('text', '. ')} AS stops, {_collapse('text')} AS collapsed, {_strip('text', ['QD-', 'номер', 'Q'])} AS stripped FROM documents",
    "spoken_form": f"SELECT variant_id, {_spoken('spoken')} AS spoken FROM phone_variant",
    "dedup_exact": _dedup("rule", True, None, 0),
    "dedup_prefix": _dedup("rule", False, 2, 3),
    "dedup_exact_prefix": _dedup("rule", True, 2, 3),
    "dedup_global_scope": _dedup("global", True, 2, 5),
    "resume_incremental": _dedup("rule", True, 2, 3),
    "dedup_exact_prefix_cap": _cap(_dedup("rule", True, 2, 3), "CASE WHEN c.rule_id IS NOT NULL THEN 40 END"),
    "quota_limit": f"SELECT rule_id, verdict, count(*) AS n FROM ({_cap(f'SELECT rule_id, seq, {_q(chr(111) + chr(107))} AS verdict FROM {_STREAM}', 'c.target_count // 100')}) GROUP BY ALL",
    "validator_shape": f"SELECT {_LINE}, {_shape('text')} AS reason FROM {_LINES}",
    "validator_question_marker": f"SELECT {_LINE}, {_question('text', _markers)} AS reason FROM {_LINES}",
    "validator_required_fragment": f"SELECT {_LINE}, {_alone('text', 'номер')} AS standalone, {_spelled('text', 'номер', ['Номер'], 'wrong_spelling')} AS spelled FROM {_LINES}",
    "validator_term_phrase": f"SELECT {_LINE}, {_term('text', 'окно', ['окно', 'правило'], ['номер', 'текст', 'снова', 'окн'], ['погода', 'лес'])} AS reason, {_in_setting('text', _term_of('text', 'номер'), [f'{_L}на{WS}+номер{_R}', f'{_L}номер{_TO}текст'], f'{_L}номерк{_W}*{_R}')} AS channel FROM {_LINES}",
    "validator_sets": " UNION ALL ".join(f"SELECT {_LINE}, '{n}' AS validator, {sql} AS reason FROM (SELECT *, regexp_extract_all(text, '{NOT_WS}+')[-1] AS last FROM {_LINES})" for n, sql in _SETS.items()),
    "anchor_join_validate": f"SELECT mapping_id, reason FROM {_WRAPPED}",
    "accepted_case_log": f"SELECT 0::DOUBLE AS created_at_unix, c.* FROM (SELECT case_.*, llm_text FROM {_WRAPPED} WHERE reason IS NULL) c",
    "used_case_log": "WITH c AS (SELECT *, row_number() OVER (ORDER BY variant_id) - 1 AS k FROM phone_variant), r AS (SELECT row_number() OVER (ORDER BY request_id) - 1 AS use_index FROM prompt_request) SELECT 0::DOUBLE AS created_at_unix, use_index, case_id, kind, target_digits, expected_result FROM r JOIN c ON c.k = r.use_index % (SELECT count(*) FROM phone_variant)",
    "parse_json_array": f"SELECT response_id, unnest(range(1, len(l) + 1))::INTEGER AS candidate_index, unnest(l) AS text FROM (SELECT response_id, {_json_of('raw_text')} AS l FROM api_response)",
    "parse_errors": f"SELECT rule_id, count(*) AS api_requests, sum(coalesce(len(items), 0))::BIGINT AS parsed_candidates, count(*) FILTER (items IS NULL) AS parse_errors FROM {_PARSED} GROUP BY rule_id",
    "report_errors": f"SELECT rule_id, error, count(*) AS n FROM (SELECT rule_id, CASE WHEN raw_text IS NULL THEN 'api_error' WHEN items IS NULL THEN 'parse_error' END AS error FROM {_PARSED}) WHERE error IS NOT NULL GROUP BY ALL",
    "report_rejections": f"SELECT rule_id, reason, count(*) AS n FROM {_JUDGED} WHERE reason IS NOT NULL GROUP BY ALL",
    "report_rules": f"SELECT * FROM {_PER_RULE}",
    "report_totals": f"SELECT sum(target)::BIGINT AS target, sum(accepted)::BIGINT AS accepted, sum(remaining)::BIGINT AS remaining FROM {_PER_RULE}",
    "report_status": f"SELECT rule_id, CASE WHEN accepted >= target // 20 THEN 'done' WHEN coalesce(requests, 0) >= 120 THEN 'request_limit_reached' WHEN coalesce(requests, 0) > 0 THEN 'running' ELSE 'pending' END AS status FROM {_PER_RULE} LEFT JOIN (SELECT rule_id, count(*) AS requests FROM prompt_request GROUP BY rule_id) USING (rule_id)",
    "report_samples": f"SELECT rule_id, n::INTEGER AS n, reason, text FROM (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY seq) AS n FROM {_JUDGED} WHERE reason IS NOT NULL) WHERE n <= 5",
    "report_reasons_map": f"""SELECT rule_id, '{{' || string_agg('"' || reason || '":' || n, ',' ORDER BY reason) || '}}' AS rejected FROM (SELECT rule_id, reason, count(*) AS n FROM {_JUDGED} WHERE reason IS NOT NULL GROUP BY ALL) GROUP BY rule_id""",
    "accepted_records": f"SELECT rule_id, text, response_id, candidate_index FROM {_JUDGED} WHERE reason IS NULL",
    "requests_planned": "WITH p AS (SELECT rule_id, count(*) AS n, max(request_index) AS last FROM prompt_request GROUP BY rule_id), s AS (SELECT c.rule_id, coalesce(last, 0) AS last, greatest(0, least(4, 3, greatest(1, ceil((target_count - coalesce(n, 0)) / greatest(1, batch_size))), 10000 - coalesce(last, 0))) AS size FROM rule_config c LEFT JOIN p USING (rule_id)) SELECT rule_id, (last + k)::INTEGER AS request_index FROM s, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE k <= size",
    "rule_checks": f"SELECT doc_id, {_q(_SAID)} AS checks FROM documents",
    "block_words": f"SELECT variant_id, {_read('d', 'd, variant_id')} AS words, replace({_read('d', 'd, variant_id')}, ' ', '') AS glued FROM (SELECT variant_id, CASE WHEN phone_digits IS NOT NULL THEN regexp_extract(phone_digits, '([0-9]{{3}})$', 1) END AS d FROM phone_variant)",
    "phone_cases": _phone_cases(),
    "dedup_ngram_greedy": _SEQUENTIAL,
    "cyclic_assignment": "WITH c AS (SELECT variant_id, row_number() OVER (ORDER BY variant_id) - 1 AS k FROM phone_variant), r AS (SELECT request_id, row_number() OVER (ORDER BY request_id) - 1 AS use_index FROM prompt_request) SELECT request_id, use_index, variant_id FROM r JOIN c ON c.k = r.use_index % (SELECT count(*) FROM phone_variant)",
    "case_prompt_block": "SELECT variant_id, 'CASE ' || coalesce(case_id, 'null') || chr(10) || 'kind: ' || coalesce(kind, 'null') || chr(10) || 'target: ' || coalesce(target_digits, 'null') || chr(10) || 'result: ' || coalesce(expected_result, 'null') || chr(10) || '<<<' || coalesce(spoken, 'null') || '>>>' AS block FROM phone_variant",
    "number_words": f"SELECT variant_id, CASE WHEN d = '' THEN '' ELSE array_to_string(list_transform(string_split(d, ''), lambda x: {_D}[x::INTEGER + 1]), ' ') END AS digit_words, CASE WHEN v IS NULL THEN NULL WHEN v = 0 THEN 'ноль' ELSE trim(concat_ws(' ', CASE WHEN v >= 100 THEN {_H}[v // 100 + 1] END, CASE WHEN v % 100 BETWEEN 10 AND 19 THEN {_T}[v % 10 + 1] WHEN v % 100 >= 20 THEN {_TT}[v % 100 // 10 + 1] END, CASE WHEN v % 10 > 0 AND v % 100 NOT BETWEEN 10 AND 19 THEN {_D}[v % 10 + 1] END)) END AS value_words, CASE WHEN d <> '' AND d[1] = d[2] AND d[2] = d[3] THEN 'три ' || {_R_WORDS}[try_cast(d[1] AS INTEGER) + 1] END AS repeat_words FROM (SELECT variant_id, d, CASE WHEN d <> '' THEN d::INTEGER END AS v FROM (SELECT variant_id, CASE WHEN phone_digits IS NOT NULL THEN regexp_extract(phone_digits, '([0-9]{{3}})$', 1) END AS d FROM phone_variant))",
    "diversity_sample": f"SELECT request_index, dim::INTEGER AS dim, dimension, picked FROM {_SAMPLED}",
    "prompt_render": f"SELECT request_index, 'Write 5 for any.' || chr(10) || '- must not contain decimal digits' || chr(10) || string_agg('- ' || dimension || ': ' || replace(picked, '|', ', '), chr(10) ORDER BY dim) || chr(10) || '{{x}} JSON' AS user_prompt FROM {_SAMPLED} GROUP BY request_index",
    "format_examples": "SELECT rule_id, CASE WHEN coalesce(len(examples.positive), 0) < 1 THEN '- none' ELSE array_to_string(list_transform(examples.positive, lambda x: '- ' || x), chr(10)) END AS positive, CASE WHEN coalesce(len(examples.negative), 0) < 1 THEN '- none' ELSE array_to_string(list_transform(examples.negative, lambda x: '- ' || x), chr(10)) END AS negative FROM rule_config",
    "callback_post_validation": "SELECT mapping_id, llm_text IS NOT NULL AND NOT contains(lower(llm_text), 'дом') AND NOT contains(lower(llm_text), 'placeholder') AS accepted, CASE WHEN llm_text IS NULL THEN 'post_validation_callback_error' WHEN contains(lower(llm_text), 'дом') OR contains(lower(llm_text), 'placeholder') THEN 'post_validation:placeholder_text' END AS reason, llm_text IS NULL AS failed FROM accepted_mapping",
    "completion_replay": "SELECT rule_id, request_index, r.raw_text AS raw_text, CASE WHEN r.raw_text IS NULL THEN 'no recorded reply' END AS error FROM (SELECT DISTINCT rule_id, request_index FROM prompt_request WHERE rule_id IS NOT NULL) LEFT JOIN (SELECT rule_id, request_index, max(raw_text) AS raw_text FROM api_response GROUP BY ALL) r USING (rule_id, request_index)",
}
