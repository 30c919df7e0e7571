"""Records whose text lost its end to a field limit or a broken transfer.

1. A vocabulary of the whole corpus: of each word the records that hold it, and those that hold it before their end. Words held by at least ``COMMON`` of the records are
   common; there are at most (words per record) / COMMON of them, so the driver may hold them. All others are masked.
2. For every run of up to four masked tokens: how often it occurs, and how often a sentence, line or text ends there.
   The share of ends is that of the run, smoothed by its shorter end's share, without the text that is judged.
3. The last token of each text is walked down the vocabulary's trie (as a join with all proper prefixes of known
   words): a proper prefix of known words that no text holds before its end is a cut word.
4. Length evidence: a source has a limit if its longest values pile up at one length in characters or in bytes.

A record is damaged if its format was left open, its last character is a broken byte, its last word is cut, or its last
run of tokens is one at which texts rarely end. Text that only lacks a full stop, or trails off where others do, is whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import cut, new_path

COMMON = 0.002
#: Occurrences that the share of a run's shorter end counts for.
PRIOR = 2.0
#: Share of a source's records that pile up at its greatest length.
PILE = 0.01
#: Occurrences of a run from which a full stop after it may be taken for an appended one.
SURE = 50
_TOKEN = re.compile(r"(?:[A-Za-z]{1,3}-)?\d+(?:[.,:/]\d+)*|[^\W\d_]+(?:['’-][^\W\d_]+)*|\.{2,}|[^\w\s]|\n")
_FENCE = re.compile(r"```[a-zA-Z]*")
_FULL = set(".!?。！？｡।։؟;")
_LONG = {"…", "...", "....", "..", "……"}
_QUOTES = set("\"'«»“”„‘’`()[]{}*_<>「」『』（）")


def _clean(text: str) -> str:
    """Line breaks as one character; JSON escapes, fences and tags resolved."""
    text = _FENCE.sub("\n", text.replace("\\n", "\n").replace('\\"', '"').replace("\\r", ""))
    return re.sub(r"</?answer>?", "\n", re.sub(r"\r\n?", "\n", text), flags=re.I)


def open_format(text: str) -> bool:
    """A JSON array or an answer tag that the text opens and never closes."""
    body = _FENCE.sub("", text).strip()
    if re.match(r"\[\s*\"", body):
        return not body.rstrip().endswith("]")
    low = text.lower()
    last = low.rfind("<answer>")
    if last >= 0 and low.rfind("</answer>") < last and "</answer>" in low[:last]:
        return True
    if last >= 0 and "</answer>" not in low and low.count("<answer>") == 1 and low.lstrip().startswith("<answer>"):
        return True
    return bool(re.search(r"</?a?n?s?w?e?r?$", low)) and "<answer>" in low


def _walk(text: str) -> tuple[list[str], list[str]]:
    """Words, numbers and inner marks, and how each ends: I inside, F full stop or line end, L trailing off, T the text's bare end."""
    tokens: list[str] = []
    hows: list[str] = []
    for t in _TOKEN.findall(_clean(text)):
        if t in _FULL or t == "\n":
            if hows and hows[-1] == "I":
                hows[-1] = "F"
        elif t in _LONG:
            if hows and hows[-1] == "I":
                hows[-1] = "L"
        elif t not in _QUOTES:
            tokens.append(t.lower())
            hows.append("I")
    if hows and hows[-1] == "I":
        hows[-1] = "T"
    return tokens, hows


def _mask(token: str, common: frozenset[str]) -> str:
    if token[-1].isdigit():
        return "#"
    return token if token in common or not token[0].isalpha() else "*"


_SEP = "\x1f"
_APPENDED = re.compile(r"[.!?。！？｡।։؟;][\"'»”’“`)\]}>\s]*$")
_WRAPPED_END = re.compile(r"(```|</answer>)\s*$", re.I)
_WALKED = (
    "kind int, table_name string, id long, source string, chars int, bytes int, tokens string, hows string, last array<string>, how string, broken boolean, open boolean, word string, n long, inner long"
)
RECORD, WORD = 0, 1


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The only pass over the texts: a row of tokens for each record, and each batch's vocabulary with its counts."""
    for batch in batches:
        rows: list[tuple] = []
        seen: Counter[str] = Counter()
        inner: Counter[str] = Counter()
        for name, i, source, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if not text:
                continue
            tokens, hows = _walk(text)
            if not tokens:
                continue
            words, before = {t for t in tokens if t[0].isalpha()}, {t for t in tokens[:-1] if t[0].isalpha()}
            seen.update(words)
            inner.update(before)
            final, how = tokens[-1], hows[-1]
            if how == "F" and final[0].isalpha() and final not in before:
                inner[final] += 1
            last = None
            if any(t[0].isalnum() for t in tokens):
                start = max((k + 1 for k in range(len(tokens) - 1) if hows[k] != "I"), default=0)
                last = (["^"] * 4 + tokens[start:])[-4:]
                if how == "F" and not _APPENDED.search(_WRAPPED_END.sub("", text.rstrip())):
                    how = "T"
            tail = text.rstrip().rstrip("\"'`]})…. ")
            rows.append((RECORD, name, i, source, len(text), len(text.encode("utf-8", "surrogatepass")), _SEP.join(tokens), "".join(hows), last, how, tail.endswith("�"), open_format(text), None, None, None))
        none = (None,) * 11
        rows.extend((WORD, *none, w, n, inner[w]) for w, n in seen.items())
        cols = list(zip(*rows)) or [()] * 15
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.bool_(), pa.bool_(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[c.split()[0] for c in _WALKED.split(", ")])


#: Distinct masked tokens that one block of texts may hold; four of their numbers make a key of 60 bits.
_MOST = 1 << 15


def _block_runs(ids: list[int], hows: str, names: list[str]) -> pa.RecordBatch:
    """Runs of one to four tokens of a block: occurrences, ends and trailing ends, counted by sorted integer keys."""
    token, how = np.array(ids, np.int64), np.frombuffer(hows.encode(), np.uint8)
    end = how != ord("I")
    begin = np.r_[True, end[:-1]]
    place = np.arange(len(token)) - np.maximum.accumulate(np.where(begin, np.arange(len(token)), 0))
    key, cols = token.copy(), ([], [], [], [])
    for k in range(1, 5):
        if k > 1:
            before = np.where(place >= k - 1, np.r_[np.zeros(k - 1, np.int64), token[: len(token) - k + 1]][: len(token)], 0)
            key = key + (before << (15 * (k - 1)))
        found, at = np.unique(key, return_inverse=True)
        digits = [(found >> (15 * j)) & (_MOST - 1) for j in range(k - 1, -1, -1)]
        cols[0].extend(" ".join(names[i] for i in row) for row in zip(*(d.tolist() for d in digits)))
        for c, weight in zip(cols[1:], (None, end, how == ord("L"))):
            c.append(np.bincount(at, weight, len(found)).astype(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(np.concatenate(c)) for c in cols[1:])], names=["run", "n", "ends", "trails"])


def _count_runs(common: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number: dict[str, int] = {"^": 0}
            known: dict[str, int] = {}
            ids: list[int] = []
            hows: list[str] = []
            for tokens, how in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = tokens.split(_SEP)
                for t in own:
                    if t not in known:
                        known[t] = number.setdefault(_mask(t, common), len(number))
                ids.extend([known[t] for t in own])
                hows.append(how)
                if len(number) > _MOST - 5000:
                    yield _block_runs(ids, "".join(hows), list(number))
                    number, known, ids, hows = {"^": 0}, {}, [], []
            if ids:
                yield _block_runs(ids, "".join(hows), list(number))

    return run


_LAST = "table_name string, id long, source string, chars int, bytes int, token string, how string, broken boolean, open boolean, run1 string, run2 string, run3 string, run4 string"


def _last_runs(common: frozenset[str]):
    """Each record with its masked last runs of one to four tokens instead of ``last``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masked = [[t if t == "^" else _mask(t, common) for t in last] for last in batch.column(9).to_pylist()]
            runs = [pa.array([" ".join(m[4 - k :]) for m in masked], pa.string()) for k in (1, 2, 3, 4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:9], *runs], names=[c.split()[0] for c in _LAST.split(", ")])

    return run


def truncation(records: DataFrame) -> DataFrame:
    """(table_name, id, source, chars, bytes, truncated, evidence) of every record of (table_name, id, source, text).

    Null, empty and blank texts, and texts without any word or number, are left out. evidence is format, byte, word or
    sentence, or null where the text is whole. Repeated records count by themselves. An empty table gives no rows.
    """
    rows = records.select("table_name", F.col("id").cast("long").alias("id"), F.col("source").cast("string").alias("source"), "text")
    path = new_path(records.sparkSession, "walked")
    rows.mapInArrow(_walked, _WALKED).write.partitionBy("kind").parquet(path)
    walked = records.sparkSession.read.schema(_WALKED).parquet(path)
    vocabulary = cut(walked.where(F.col("kind") == WORD).groupBy("word").agg(F.sum("n").alias("n"), F.sum("inner").alias("inner")), "vocabulary")
    held = walked.where(F.col("kind") == RECORD)
    total = rows.where("text IS NOT NULL").count()
    least = max(4, int(total * COMMON))
    common = frozenset(r["word"] for r in vocabulary.where(F.col("n") >= least).collect())  # bounded: see the module's text
    judged = held.where("last IS NOT NULL").select("table_name", "id", "source", "chars", "bytes", F.element_at("last", -1).alias("token"), "how", "broken", "open", "last")
    last = cut(judged.mapInArrow(_last_runs(common), _LAST), "last")
    wanted = last.select(F.explode(F.array("run1", "run2", "run3", "run4")).alias("run")).distinct()
    runs = held.select("tokens", "hows").mapInArrow(_count_runs(common), "run string, n long, ends long, trails long").groupBy("run").agg(*(F.sum(c).alias(c) for c in ("n", "ends", "trails")))
    runs = cut(runs.join(wanted, "run", "left_semi"), "runs")

    # the trie: all proper prefixes of words that two records or more hold
    known = vocabulary.where("n > 1 AND inner > 0 AND char_length(word) > 1")
    prefixes = known.select(F.explode(F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda k: F.substring("word", F.lit(1), k))).alias("token")).distinct()
    ends = last.select("token").distinct().join(vocabulary.select(F.col("word").alias("token"), "n", "inner"), "token", "left")
    unknown = ends.where(f"coalesce(inner, 0) = 0 AND coalesce(n, 0) < {least}").select("token")
    partial = cut(unknown.join(prefixes.withColumn("cut_word", F.lit(True)), "token", "left"), "partial").withColumn("unknown", F.lit(True))

    limits = last.groupBy("table_name", "source").agg(F.max("chars").alias("max_chars"), F.max("bytes").alias("max_bytes"), F.count("*").alias("n"))
    near = last.join(limits, (last.source.eqNullSafe(limits.source)) & (last.table_name == limits.table_name)).select(last["*"], "max_chars", "max_bytes", F.col("n").alias("of"))
    piles = near.groupBy("table_name", "source").agg(F.first("of").alias("of"), F.first("max_chars").alias("max_chars"), F.first("max_bytes").alias("max_bytes"), F.sum((F.col("chars") == F.col("max_chars")).cast("int")).alias("c"), F.sum((F.col("bytes") >= F.col("max_bytes") - 3).cast("int")).alias("b"))
    piled = (F.col("c") >= F.greatest(F.lit(5), F.col("of") * PILE)).alias("char_limit"), (F.col("b") >= F.greatest(F.lit(5), F.col("of") * PILE)).alias("byte_limit")
    at = piles.select("table_name", "source", "max_chars", "max_bytes", *piled)
    out = last.join(at, (last.source.eqNullSafe(at.source)) & (last.table_name == at.table_name)).select(last["*"], ((F.col("char_limit") & (F.col("chars") == F.col("max_chars"))) | (F.col("byte_limit") & (F.col("bytes") >= F.col("max_bytes") - 3))).alias("at_limit"))
    for k in (1, 2, 3, 4):
        out = out.join(runs.select(F.col("run").alias(f"run{k}"), *(F.col(c).alias(f"{c}{k}") for c in ("n", "ends", "trails"))), f"run{k}", "left")
    out = out.join(partial, "token", "left")

    def share(what: str, how: str):
        value = F.lit(0.3)
        for k in (1, 2, 3, 4):
            own = F.when(F.col("how").isin(*how), 1).otherwise(0)
            value = (F.coalesce(F.col(f"{what}{k}"), F.lit(1)) - own + PRIOR * value) / (F.coalesce(F.col(f"n{k}"), F.lit(1)) - 1 + PRIOR)
        return value

    ends, trails = share("ends", "FLT"), share("trails", "L")
    unknown = F.coalesce("unknown", F.lit(False)) & F.col("token").rlike(r"\p{L}") & (F.col("how") != "F")
    cut_word = unknown & (F.coalesce("cut_word", F.lit(False)) | F.col("at_limit"))
    low = (
        F.when(F.col("how") == "F", (ends < 0.01) & (F.col("n4") >= SURE))
        .when(F.col("how") == "L", trails < 0.3)
        .otherwise(ends < F.when(F.col("at_limit"), 0.8).otherwise(0.45))
    )
    low = low | (F.col("at_limit") & (F.col("how") != "F") & (F.col("run1") == "*"))
    evidence = F.when(F.col("open"), "format").when(F.col("broken"), "byte").when(cut_word, "word").when(low, "sentence")
    return out.select("table_name", "id", "source", "chars", "bytes", "at_limit", evidence.isNotNull().alias("truncated"), evidence.alias("evidence"), "token", "how", F.round(ends, 3).alias("end_share"), "run4", "run3", "n3", "ends3", "trails3")


def truncation_by_source(found: DataFrame) -> DataFrame:
    """(table_name, source, records, truncated, share): how often each source truncates."""
    per = found.groupBy("table_name", "source").agg(F.count("*").alias("records"), F.sum(F.col("truncated").cast("long")).alias("truncated"))
    return per.withColumn("share", F.round(F.col("truncated") / F.col("records"), 6))
