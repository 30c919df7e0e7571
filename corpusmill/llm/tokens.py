"""Encoding of whole tables by a public byte-level BPE vocabulary, by a pair occurrence index.

All new pre-tokens of an Arrow batch are laid out as one sequence of byte symbols. An index maps each mergeable pair's
rank to all positions at which it occurs; the active ranks are applied in ascending order, each to all its positions
from left to right, and only the lists of the pairs next to a merge are updated. A worker keeps the ids of pre-tokens
it has met, so each is merged once.

Ids of a null and of an empty text are an empty array. Special tokens are never produced: their strings are plain text.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie; a parameter, as they are never part of the repository.
TOKENIZER_FOLDER = os.environ.get("TOKENIZER_FOLDER", "/opt/tokenizers")
#: Fixed value: how the byte_bpe_50k vocabulary's texts are cut into pre-tokens.
PRE_TOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens a worker remembers before it starts anew.
REMEMBERED = 500_000


class PairIndexEncoder:
    def __init__(self, path: str, pattern: str = PRE_TOKEN):
        import regex

        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                if (a := self.ranks.get(token[:cut])) is not None and (b := self.ranks.get(token[cut:])) is not None:
                    self.pairs[a << 20 | b] = rank
        self.split = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word."""
        single, rank_of = self.single, self.pairs.get
        token = [single[b] for w in words for b in w]
        size = len(token)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        starts, at = [], 0
        for w in words:
            starts.append(at)
            if w:
                before[at] = -1
                at += len(w)
                after[at - 1] = -1
        places: dict[int, list[int]] = {}
        for i in range(size - 1):
            if after[i] != -1 and (r := rank_of(token[i] << 20 | token[i + 1])) is not None:
                if r in places:
                    places[r].append(i)
                else:
                    places[r] = [i]
        active = list(places)
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            spots = places.pop(rank)
            spots.sort()
            for i in spots:
                j = after[i]
                if j < 0 or token[i] < 0 or rank_of(token[i] << 20 | token[j]) != rank:
                    continue
                token[i], token[j] = rank, -1
                k = after[i] = after[j]
                after[j] = -1
                if k >= 0:
                    before[k] = i
                    if (r := rank_of(rank << 20 | token[k])) is not None:
                        if r in places:
                            places[r].append(i)
                        else:
                            places[r] = [i]
                            heapq.heappush(active, r)
                h = before[i]
                if h >= 0 and (r := rank_of(token[h] << 20 | rank)) is not None:
                    if r in places:
                        places[r].append(h)
                    else:
                        places[r] = [h]
                        heapq.heappush(active, r)
        out = []
        for w, i in zip(words, starts):
            ids = []
            if w:
                while i >= 0:
                    ids.append(token[i])
                    i = after[i]
            out.append(ids)
        return out

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        parts = [self.split(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        fresh = list({w for p in parts for w in p if w not in self.known})
        self.known.update(zip(fresh, self.merge([w.encode("utf-8", "surrogatepass") for w in fresh])))
        known = self.known
        return [[i for w in p for i in known[w]] for p in parts]


_LOADED: dict[str, PairIndexEncoder] = {}


def encoder(name: str = "byte_bpe_50k", folder: str | None = None) -> PairIndexEncoder:
    path = f"{folder or TOKENIZER_FOLDER}/{name}.tiktoken"
    if path not in _LOADED:
        _LOADED[path] = PairIndexEncoder(path)
    return _LOADED[path]


def _mapper(name: str, folder: str | None, sizes_only: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(name, folder)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ids = code.encode(part.column(1).to_pylist())
                lengths = np.fromiter(map(len, ids), np.int32, len(ids))
                if sizes_only:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lengths)], names=["id", "n_tokens"])
                else:
                    flat = pa.array([i for x in ids for i in x], pa.int32())
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32)), flat)], names=["id", "ids"])

    return run


def encode_table(df: DataFrame, id_col: str, text_col: str, tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(id, ids array<int>) of each row, in one pass without a shuffle. Null and empty texts: an empty array."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_mapper(tokenizer, folder, False), "id long, ids array<int>")


def token_counts(df: DataFrame, id_col: str, text_col: str, tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """(id, n_tokens) of each row; 0 for null and empty texts."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_mapper(tokenizer, folder, True), "id long, n_tokens int")
