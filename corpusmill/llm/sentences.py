"""Sentence boundaries in texts of mixed languages, scripts and layouts.

1. Lines. A line break ends a unit unless it lies inside a wrapped paragraph: the text's lines fill a common width,
   and the next line's first word would not have fitted. List items, speaker turns, headings and recognizer lines are
   units of their own.
2. Gaps. In spaced scripts every terminator opens a small lattice of readings: abbreviation, initial, ordinal,
   number, address, quoted speech, trailing off, or end. What stands before and after decides. In scripts without
   spaces a word lattice over the corpus's own vocabulary gives the last word before and the first word after a gap;
   the gap is a boundary if the first is a closing particle, unless the second joins what follows to it.
3. Closing quotes, brackets and emoji go to the sentence before them; terminators inside quotes or brackets that are
   closed in the same unit don't end a sentence, except at the end of quoted speech that a colon introduced.

Offsets count code points. Null, empty and blank texts have no sentences. Texts are processed whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import cut

# Abbreviations that a name or number follows, so they never end a sentence.
OPEN_ABBREVIATIONS = set(
    "mr mrs ms dr prof st no vs sec cf approx fig ver vol mt sr jr rev gen "
    "hr fr nr abschn str bzw ca vgl abb z b d "
    "mme mlle art chap "
    "sra srta dra pág núm véase ej "
    "ул д кв корп стр рис см ср напр прил гл им г-н г-жа тел пер просп обл оф каб т п дом пл наб "
    "вул буд кв ім див напр пор тов п "
    "डॉ सं श्री पृ "
    "د أ م "
    "κ δρ σελ δηλ αρ "
    "p pp n".split()
)
# Abbreviations that may stand at a sentence's end too; a capital or an opening word after them decides.
END_ABBREVIATIONS = set(
    "etc usw dgl ltd inc co corp bros a.m p.m u.s e.u u.k s.a s.l s.r.l ph.d jan feb mar apr jun jul aug sep sept oct nov dec min sek sec std "
    "uu ee.uu h s seg "
    "г гг в вв руб коп тыс млн млрд мин сек с ч т.д т.п т.ч др пр е т.е н.э "
    "грн тис хв год р рр ін "
    "μ.μ π.μ κ.λπ κ.ά "
    "d.h z.b u.a c.-à-d c e.g i.e т.к т.н т.з".split()
)
#: Of the above, those that always go on.
NEVER_END = set("e.g i.e d.h z.b c.-à-d т.е т.к т.н т.з т.ч е".split())
# By script, particles and endings that close a sentence, words that join what follows to it, and words that open one.
FINALS = {
    "thai": "ครับ ค่ะ คะ นะครับ นะคะ จ้ะ จ้า ฮะ นะ สิ".split(),
    "lao": "ຄັບ ເຈົ້າ ເດີ ແດ່ ບໍ ນໍ".split(),
    "khmer": "ទេ ណា៎ បាទ ចាស ហើយ".split(),
    "burmese": "တယ် ပါတယ် မယ် ပါမယ် ပြီ ပါပြီ လား သလား ဘူး ပါ".split(),
    "cjk": "吗 呢 吧 啊 呀 嘛 了 です ます でした ました ません ください ですか ますか ましょう でしょう ですね ますね ですよ だ".split(),
}
JOINS = {
    "thai": "และ หรือ แต่ ที่ ซึ่ง ว่า เพราะ".split(),
    "lao": "ແລະ ຫຼື ແຕ່ ທີ່ ວ່າ ເພາະ".split(),
    "khmer": "និង ឬ ប៉ុន្តែ ដែល ថា ព្រោះ".split(),
    "burmese": "နှင့် သို့မဟုတ် ဒါပေမယ့် လို့ ဆိုတာ".split(),
    "cjk": "和 或 但 的 と が けど から ので って".split(),
}
OPENERS = {"cjk": "请 我们 我 你 您 他 她 这 那 然后 但是 所以 如果 现在 因为 不过 另外 次に それ これ では はい いいえ また そして 私 もう なお ただし お 番号 今".split()}
#: Length of the longest word of the vocabulary, how often a word must be seen for each character of the corpus, and how many words are kept.
LONGEST_WORD, LEAST_SHARE, VOCABULARY = 6, 2e-5, 50_000
#: How much more often the parts of a word meet than by chance.
COHESION = 20.0

_OPEN, _CLOSE = "«“‘„([{「『（【〈《‹", "»”’“)]}」』）】〉》›"
_PAIR = {"«": "»", "“": "”", "„": "“”", "(": ")", "[": "]", "{": "}", "「": "」", "『": "』", "（": "）", "【": "】", "〈": "〉", "《": "》", "‹": "›"}
_EMOJI = r"[\U0001F000-\U0001FAFF☀-➿⬀-⯿⌀-⏿️‍⃣]"
_END = re.compile(r"[.!?…。！？｡։।॥؟۔;;៕។။།༎።፧‼⁇⁈⁉]+")
_EMOJI_TAIL = re.compile(rf"(?:[ \t\u00a0]*{_EMOJI}+)*")
_ONE_EMOJI = re.compile(_EMOJI)
_ONLY_EMOJI = re.compile(rf"(?:{_EMOJI}+[ \t ]*)+")
_MARKER = re.compile(r"[ \t ]*(?:[-*•‣◦·▪]|\d{1,3}[.)]|[a-zа-я][)]|\(\d{1,3}\)|[①-⑳])[ \t ]+\S")
_SPEAKER = re.compile(r"[ \t ]*(?:\[[^\[\]\n]{1,30}\]|[^\W\d_][^\s:：.,!?«\"(。！？，、…“”„「」『』（）؟।։;；]{0,24}(?:[ \t][^\W\d_][^\s:：.,!?«\"(。！？，、…“”„「」『』（）؟।։;；]{0,20}){0,1}\.?[:：]|[^\W\d_]\.?[:：]|[–—])(?=\s|[^\x00-˿/\d])")
_HARD_END = re.compile(rf"[.!?…。！？｡։।॥؟۔;;][\"»”’“'\)\]\}}」』）】〉》›*_]*(?:\s*{_EMOJI}+)*\s*$")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ]")
_UNSPACED = {"thai": "\u0e00-\u0e7f", "lao": "\u0e80-\u0eff", "khmer": "\u1780-\u17ff\u19e0-\u19ff", "burmese": "\u1000-\u109f", "cjk": "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f"}
_RUN = re.compile("|".join(f"(?P<{name}>[{body}]+)" for name, body in _UNSPACED.items()))
_SPACELESS = re.compile("[" + "".join(_UNSPACED.values()) + "]")
_WORD_BEFORE = re.compile(r"(?:[^\W\d_]+[-'’.]+)*[^\W_]*[^\W\d_][̀-ͯऀ-ॿ]*$")
_BREAK = re.compile(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]")


class WordLattice:
    """Cheapest path through the words of a run: each word costs its rarity, an unknown character more than any word."""

    def __init__(self, costs: dict[str, float] | None = None):
        known = {w: 3.0 for table in (FINALS, JOINS, OPENERS) for words in table.values() for w in words}
        self.costs = {w: min(c, known.get(w, c)) for w, c in {**known, **(costs or {})}.items()}
        self.unknown = 1.0 + max(self.costs.values())
        self.longest = max(map(len, self.costs))

    def cut(self, run: str) -> list[str]:
        best: list[tuple[float, int]] = [(0.0, 0)]
        for end in range(1, len(run) + 1):
            options = [(best[end - 1][0] + self.unknown, end - 1)]
            for start in range(max(0, end - self.longest), end):
                cost = self.costs.get(run[start:end])
                if cost is not None:
                    options.append((best[start][0] + cost, start))
            best.append(min(options))
        out, end = [], len(run)
        while end:
            start = best[end][1]
            out.append(run[start:end])
            end = start
        return out[::-1]


_PLAIN_LATTICE = WordLattice()


def _substrings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: Counter[str] = Counter()
        for text in batch.column(0).to_pylist():
            if text and _SPACELESS.search(text):
                for m in _RUN.finditer(text):
                    run = m.group(0)
                    for n in range(1, LONGEST_WORD + 1):
                        seen.update(run[i : i + n] for i in range(len(run) - n + 1))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])


def vocabulary(df: DataFrame, text_col: str) -> dict[str, float]:
    """Words of the scripts without spaces, from all texts of the corpus, each with its cost (its rarity in nats).

    A word is a run of up to LONGEST_WORD characters whose parts meet COHESION times more often than by chance, and
    that is not nearly always part of one longer run. Counts are combined in the workers; runs seen less often than
    LEAST_SHARE of all characters are no words, so at most LONGEST_WORD / LEAST_SHARE runs exist, of which VOCABULARY are read.
    """
    counts = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_substrings, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = cut(counts, "substrings")
    total = counts.where("char_length(word) = 1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = counts.where(F.col("n") >= max(3, int(total * LEAST_SHARE))).orderBy(F.desc("n"), "word").limit(VOCABULARY).collect()
    held = {r["word"]: r["n"] for r in rows}
    longer: dict[str, int] = {}
    for w, n in held.items():
        for part in (w[1:], w[:-1]):
            longer[part] = max(longer.get(part, 0), n)
    out = {}
    for w, n in held.items():
        tight = all(n * total >= COHESION * held[w[:i]] * held[w[i:]] for i in range(1, len(w)) if w[:i] in held and w[i:] in held)
        if len(w) == 1 or (tight and longer.get(w, 0) < 0.9 * n):
            out[w] = math.log(total / n)
    return out


def _lines(text: str) -> list[tuple[int, int]]:
    out, at = [], 0
    for m in _BREAK.finditer(text):
        out.append((at, m.start()))
        at = m.end()
    out.append((at, len(text)))
    return out


def _first_word(line: str) -> int:
    line = line.lstrip()
    if not line:
        return 0
    if _SPACELESS.match(line):
        return 1
    return len(line.split(None, 1)[0])


def _forced(a: str, b: str, width: int) -> bool:
    return len(a.rstrip()) + 1 + _first_word(b) > width


def _units(text: str) -> list[tuple[int, int, bool]]:
    """Stretches that no sentence crosses: (start, end, is one sentence as a whole)."""
    lines = _lines(text)
    body = [text[a:b] for a, b in lines]
    filled = [i for i, s in enumerate(body) if s.strip()]
    if not filled:
        return []
    lengths = sorted((len(s.rstrip()) for s in body), reverse=True)
    # the common width: the greatest length that enough other lines come near, as a changed line may stick out
    enough = max(1, len(filled) * 15 // 100)
    width = next((a for a, c in zip(lengths, lengths[enough:]) if a - c <= 6), lengths[0])
    marker = {i for i in filled if _MARKER.match(body[i])}
    speaker = {i for i in filled if i not in marker and _SPEAKER.match(body[i])}
    if len(speaker) == 1 and len(filled) > 2 and not body[next(iter(speaker))].lstrip().startswith("["):
        only = next(iter(speaker))
        if only and only - 1 in filled and not _HARD_END.search(body[only - 1]):
            speaker = set()
    soft = [i for i in filled if i + 1 < len(body) and body[i + 1].strip() and i + 1 not in marker and i + 1 not in speaker and not _HARD_END.search(body[i])]
    hits = [i for i in soft if _forced(body[i], body[i + 1], width)]
    every = [i for i in filled if i + 1 < len(body) and body[i + 1].strip() and i + 1 not in marker and i + 1 not in speaker]
    filling = [i for i in every if _forced(body[i], body[i + 1], width)]
    wrapped = 30 <= width <= 140 and bool(hits) and len(filling) >= 0.7 * len(every) and bool(_END.search(text))
    punctuated = bool(_END.search(text))
    out: list[tuple[int, int, bool]] = []
    start = None
    item = False
    for i in filled:
        a, b = lines[i]
        if start is None:
            start, item = a, i in marker
        following = i + 1 if i + 1 < len(body) and body[i + 1].strip() else None
        go_on = False
        if following is not None and following not in marker and following not in speaker:
            if wrapped and _forced(body[i], body[following], width):
                go_on = True
            elif punctuated and i not in marker and body[following].lstrip()[:1].islower() and not _HARD_END.search(body[i]):
                go_on = bool(_END.search(body[i]) or _END.search(body[following]) or not body[i].lstrip()[:1].islower())
            elif item and not _HARD_END.search(body[i]) and body[following][:1] in " \t" and i in marker and following not in marker:
                go_on = True
        if not go_on:
            out.append((start, b, item))
            start = None
    return out


def _openers(text: str, a: int, b: int) -> tuple[list[int], set[int]]:
    """For every position of text[a:b] the start of the outermost quote or bracket around it, or -1; where pairs close. Unclosed ones don't count."""
    state = [-1] * (b - a)
    stack: list[tuple[str, int]] = []
    spans: list[tuple[int, int]] = []
    for i in range(a, b):
        c = text[i]
        if c == '"':
            if stack and stack[-1][0] == '"':
                spans.append((stack.pop()[1], i))
            elif any(x[0] == '"' for x in stack):
                while stack:
                    kind, at = stack.pop()
                    if kind == '"':
                        spans.append((at, i))
                        break
            else:
                stack.append(('"', i))
        elif stack and c in _PAIR.get(stack[-1][0], ""):
            spans.append((stack.pop()[1], i))
        elif c in _PAIR:
            stack.append((c, i))
        elif c in ")]}»”」』）】〉》" and any(c in _PAIR.get(x[0], "") for x in stack):
            while stack:
                kind, at = stack.pop()
                if c in _PAIR.get(kind, ""):
                    spans.append((at, i))
                    break
    for s, e in sorted(spans, key=lambda x: x[0] - x[1]):
        for i in range(s, e + 1):
            if state[i - a] < 0:
                state[i - a] = s
    return state, {e for _, e in spans}


def _tail(text: str, at: int, b: int, closing: set[int]) -> tuple[int, int]:
    """Ends of the closing quotes and brackets, and of the emoji, that follow a terminator."""
    while at < b and (at in closing or text[at] in ")]}»”」』）】〉》›*_"):
        at += 1
    return at, _EMOJI_TAIL.match(text, at, b).end()


def _boundary(text: str, a: int, b: int, m: re.Match[str], inside: list[int], closing: set[int], begin: int) -> int:
    """End of the sentence that the terminator ``m`` closes, or -1."""
    mark = m.group(0)
    closed_at, end = _tail(text, m.end(), b, closing)
    close, emoji, after = closed_at > m.end(), end > closed_at, text[end:b]
    at = m.start()
    rest = after.lstrip()
    gap = len(after) - len(rest)
    if not rest:
        return b
    nxt = rest[0]
    word = rest[1:2] if nxt in "«“„‘\"([¿¡'「『" and len(rest) > 1 else nxt
    opener = inside[at - a]
    if mark[0] in ";;":
        greek = any("Ͱ" <= c <= "Ͽ" for c in text[max(a, at - 12) : at])
        if not greek:
            return -1
    if opener >= 0:
        if not close or (closed_at < b and inside[closed_at - a] == opener):
            return -1
        lead = text[begin:opener].strip()
        if text[opener] in "([（【{":
            # a bracketed aside is its own sentence only where it begins one
            return end if not lead and (word.isupper() or not word.islower()) and gap else -1
        if not lead or nxt in ",-–—，、" or word.islower():
            return -1
        if _CJK.match(nxt) or _CJK.match(word):
            return end if lead[-1:] in ":：,，" or re.search(r"[说道問言]$", lead) else -1
        if not gap:
            return -1
        if lead[-1:] in ":：,،" or word.isupper() or word.isdigit() or not word.isalpha():
            return end
        return end if lead[-1:] in ":：" else -1
    if any(c in mark for c in "。！？｡") or mark[0] in "։।॥۔៕។။།༎።፧‼⁇⁈⁉":
        return -1 if nxt in "，、,—–" else end
    if mark[0] in "!?؟" or (mark[-1] in "!?؟" and mark[0] != "."):
        if nxt in ",;—–-" or word.islower():
            return -1
        return end if gap or emoji or word.isupper() or nxt in "¿¡«„\"“「" or not word.isascii() else -1
    if set(mark) <= {"…"} or (len(mark) > 1 and set(mark) <= {".", "…"}):
        if _CJK.match(nxt) and not gap:
            return -1
        if word.islower() or nxt in ",;:)—–-" or not (gap or emoji or word.isupper()):
            return -1
        return end
    if mark[0] in ";;":
        return end if gap or emoji else -1
    if mark != "." and mark[-1] in "!?":
        return -1 if word.islower() else end
    # a single full stop
    before = text[begin:at]
    previous = before[-1:]
    if nxt in ",;:!?…)—–" and not close:
        return -1
    if nxt in ",;:—–-":
        return -1
    w = _WORD_BEFORE.search(before)
    token = w.group(0) if w else ""
    if not gap and not emoji:
        if close and previous:
            return end if word.isupper() or nxt in "«„“¿¡" else -1
        if not (word.isupper() or _CJK.match(nxt) or nxt in "«„“¿¡" or (word.isalpha() and not word.isascii() and not word.islower())):
            return -1
        if not previous or (len(token) == 1 and token.isupper()):
            return -1
        if re.search(r"[/@\\]\S*$|\w+\.\w+$", before) and word.isascii():
            return -1
        if "." in token and token[-1:].isupper():
            return -1
        return end if (previous.islower() or previous.isdigit() or previous in ")»”\"%" or (len(token) > 1 and not token.isascii())) else -1
    if emoji:
        return end
    low = token.lower().strip("-'’")
    spaced = re.search(r"([^\W\d_]{1,2})\.\s?([^\W\d_]{1,2})$", before)
    pair = f"{spaced[1]}.{spaced[2]}".lower() if spaced else ""
    if word.islower():
        return -1
    if re.search(r"\d\s*$", before[: len(before) - len(token)]) and token in _UNITS:
        return end
    if pair in NEVER_END or low in NEVER_END:
        return -1
    if pair in END_ABBREVIATIONS or low in END_ABBREVIATIONS:
        if low in OPEN_ABBREVIATIONS and pair not in END_ABBREVIATIONS and low not in ("с", "в", "ч"):
            return -1
        if low == "г" and not pair and not re.search(r"\d\s*г$", before):
            return -1
        if low in ("с", "в", "ч", "h", "s", "р") and not re.search(r"\d\s*\w$", before):
            return -1 if len(token) == 1 and token.isupper() else (-1 if low in ("в", "с", "ч") else end)
        if low == "co" and re.match(r"(?:KG|OHG|KGaA)\b", rest):
            return -1
        if word.isdigit():
            return -1 if low not in ("etc", "usw", "т.д", "т.п", "др") and pair not in ("т.д", "т.п") else end
        return end
    if len(token) == 1 and token.isupper() and token.isalpha() and not _CJK.match(token):
        return -1
    if re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", token) and token.isupper():
        return end if word.isupper() and rest.split(None, 1)[0] in _ENGLISH_OPENERS else -1
    if low in OPEN_ABBREVIATIONS:
        return -1
    if len(token) == 2 and token.isupper() and token[0] == token[1] and re.match(r"([^\W\d_])\1\.", rest):
        return -1
    if re.search(r"(?:^|\s)\d{1,2}$", before) and nxt.isalpha():
        following = re.match(r"[^\W\d_]+", rest)
        if following and following.group(0) in _GERMAN_ORDINAL_NOUNS:
            return -1
        if not before.strip().strip("0123456789"):
            return -1
    return end


_ENGLISH_OPENERS = set("The A An It He She They We You I In On At This That These Those Is Are Was Were Did Do Does Please Who What When Where Why How Well Okay No Yes Mr. Ms. Dr. Mrs.".split())
#: Units that end a sentence when they follow a number and a capital follows them.
_UNITS = set("sec sek min ms s h с сек мин ч г гг руб коп тыс млн млрд шт кг км м см т грн хв р год seg km kg cm mm m g l t".split())
#: Nouns that a German ordinal stands before.
_GERMAN_ORDINAL_NOUNS = set("Januar Februar März April Mai Juni Juli August September Oktober November Dezember Charge Stapel Block Lauf Satz Abschnitt Tag Woche Monat Jahr Mal Version Regel".split())


def _script(m: re.Match[str]) -> str:
    return m.lastgroup or ""


_GAP = re.compile(r"[  \u3000\t]+|\r?\n\s*")
_BEFORE_GAP = "\"”'.!?…)»"


def _particle_gaps(text: str, a: int, b: int, lattice: WordLattice) -> list[int]:
    """Ends of sentences in text[a:b] that no terminator marks, in scripts without spaces.

    At a space: the word before it closes a sentence, and the word after it joins nothing to it. Where a stretch of
    Chinese or Japanese has no terminator at all: inside a run too, if a closing word is followed by an opening one.
    """
    runs = {m.start(): m for m in _RUN.finditer(text, a, b)}
    ends = {m.end(): at for at, m in runs.items()}
    known: dict[int, list[str]] = {}

    def words(at: int) -> list[str]:
        # only runs beside a gap, or without any terminator around, are ever segmented
        if at not in known:
            known[at] = lattice.cut(runs[at].group(0))
        return known[at]

    out = []
    for m in _GAP.finditer(text, a, b):
        at = m.start()
        while at > a and (text[at - 1] in _BEFORE_GAP or text[at - 1].isspace() or _ONE_EMOJI.match(text[at - 1])):
            at -= 1
        if at not in ends or m.end() >= b:
            continue
        if not _closes(words(ends[at]), FINALS[_script(runs[ends[at]])]):
            continue
        if m.end() in runs and words(m.end())[0] in JOINS[_script(runs[m.end()])]:
            continue
        if not _ONLY_EMOJI.match(text, m.end(), b):
            out.append(m.start())
    if not _END.search(text, a, b):
        for at, m in runs.items():
            script = _script(m)
            if script in OPENERS:
                parts = words(at)
                for i, (x, y) in enumerate(zip(parts, parts[1:])):
                    at += len(x)
                    if x in FINALS[script] and y in OPENERS[script]:
                        out.append(at)
    return out


def _closes(words: list[str], finals: list[str]) -> bool:
    """The last word is a closing one, or a word of the vocabulary that ends in one of two characters or more."""
    return words[-1] in finals or any(len(f) > 1 and words[-1].endswith(f) for f in finals)


def sentences(text: str | None, lattice: WordLattice = _PLAIN_LATTICE) -> list[tuple[int, int]]:
    """(start, end) of each sentence, trimmed of white space."""
    if not text or not text.strip():
        return []
    spans: list[tuple[int, int]] = []
    for a, b, whole in _units(text):
        if whole:
            spans.append((a, b))
            continue
        inside, closing = _openers(text, a, b)
        label = _SPEAKER.match(text, a, b)
        begin = a
        cuts = {c for c in (_particle_gaps(text, a, b, lattice) if _SPACELESS.search(text, a, b) else []) if inside[c - a] < 0}
        at = label.end() if label else a
        ends: list[int] = sorted(cuts)
        for m in _END.finditer(text, at, b):
            start = max([begin, *(c for c in ends if c <= m.start())]) if ends else begin
            lead = label.end() if label and start == a else start
            e = _boundary(text, a, b, m, inside, closing, lead)
            if 0 < e < b:
                ends.append(e)
                ends.sort()
                begin = e
        points = [a, *sorted(set(ends)), b]
        for s, e in zip(points, points[1:]):
            spans.append((s, e))
    out: list[tuple[int, int]] = []
    for s, e in spans:
        piece = text[s:e]
        left = len(piece) - len(piece.lstrip())
        if left == len(piece):
            continue
        s, e = s + left, s + len(piece.rstrip())
        if out and _ONLY_EMOJI.fullmatch(text[s:e]) and not _BREAK.search(text[out[-1][1] : s]):
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def _mapper(lattice: WordLattice):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids, starts, ends = [], [], []
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for s, e in sentences(text, lattice):
                        ids.append(i)
                        starts.append(s)
                        ends.append(e)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.array(starts, np.int32)), pa.array(np.array(ends, np.int32))], names=["id", "start_char", "end_char"])

    return run


def split_sentences(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, start_char, end_char), a row for each sentence of each text.

    One pass counts the vocabulary of the scripts without spaces, one splits; only the counts are shuffled.
    """
    lattice = WordLattice(vocabulary(df, text_col))
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_mapper(lattice), "id long, start_char int, end_char int")
