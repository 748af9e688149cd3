"""Problem 8: token ids by a public byte-level BPE vocabulary.

Pieces cut by the vocabulary's pattern are merged by a priority queue of merge ranks over a doubly
linked list of symbols; an entry whose pair has changed since it was pushed is stale and skipped. A
worker keeps the ids of pieces it has seen in a memo of bounded size (a pure function of the piece,
so results don't depend on it). Ids are decoded by concatenating the vocabulary's byte strings.

Defined results: null and empty text give an empty list; white space is text; text that looks like a
special token is ordinary text.
"""

from __future__ import annotations

import base64
import functools
import importlib.util
import os
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weirstone.llm.spread import spread

#: Pieces remembered by one Python worker (some 40 MB).
MEMO = 150_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """A file of the installed public vocabularies; any other path may be passed instead."""
    return os.path.join(os.path.dirname(importlib.util.find_spec("public_tokenizers").origin), name)


class ByteBPE:
    """Encoder and decoder of one vocabulary of ranked byte strings."""

    def __init__(self, path: str):
        import public_tokenizers
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.byte_ids = [self.ranks[bytes([b])] for b in range(256)]
        get = self.ranks.get
        self.pairs = {}
        for t, i in self.ranks.items():
            for cut in range(1, len(t)):
                if (a := get(t[:cut])) is not None and (b := get(t[cut:])) is not None:
                    self.pairs[a << 24 | b] = i
        self.memo: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        get, ids = self.pairs.get, [self.byte_ids[b] for b in piece]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        wanted = [get(ids[i] << 24 | ids[i + 1], -1) for i in range(n - 1)]
        wanted.append(-1)
        queue = [r << 40 | i for i, r in enumerate(wanted) if r >= 0]
        heapify(queue)
        while queue:
            top = heappop(queue)
            i, rank = top & 0xFFFFFFFFFF, top >> 40
            if wanted[i] != rank:
                continue
            gone = after[i]
            ids[i], wanted[gone], ids[gone] = rank, -1, -1
            k = after[i] = after[gone]
            wanted[i] = -1
            if k < n:
                before[k] = i
                r = wanted[i] = get(rank << 24 | ids[k], -1)
                if r >= 0:
                    heappush(queue, r << 40 | i)
            h = before[i]
            if h >= 0:
                r = wanted[h] = get(ids[h] << 24 | rank, -1)
                if r >= 0:
                    heappush(queue, r << 40 | h)
        return [x for x in ids if x >= 0]

    def _ids(self, piece: str) -> tuple[int, ...]:
        """The ids of a piece that isn't remembered yet."""
        if len(self.memo) >= MEMO:
            self.memo.clear()
        ids = tuple(self.merge(piece.encode("utf-8", "surrogatepass")))
        if len(piece) <= 64:
            self.memo[piece] = ids
        return ids

    def encode_into(self, text: str, out: list[int]) -> None:
        """Appends the ids of ``text`` to ``out``."""
        pieces = self.find(text)
        for piece, ids in zip(pieces, map(self.memo.get, pieces)):
            out += ids if ids is not None else self._ids(piece)

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        self.encode_into(text, out)
        return out

    def count(self, text: str) -> int:
        """The number of ids of ``text``, without making them."""
        pieces = self.find(text)
        return sum([len(ids if ids is not None else self._ids(piece)) for piece, ids in zip(pieces, map(self.memo.get, pieces))])

    def decode(self, ids: list[int]) -> str:
        return b"".join([self.tokens[i] for i in ids]).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    """One encoder per Python worker and vocabulary."""
    return ByteBPE(path)


def _arrow_ids(texts: list[str | None], bpe: ByteBPE) -> pa.Array:
    """One flat array of ids for all texts, cut into lists by offsets."""
    flat: list[int] = []
    ends = [0]
    for t in texts:
        if t:
            bpe.encode_into(t, flat)
        ends.append(len(flat))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, np.int32)))


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, ids array<int>)."""
    path = path or vocabulary_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), _arrow_ids(b.column(1).to_pylist(), bpe)], names=["k", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(key, text)).mapInArrow(work, f"k {kind}, ids array<int>").withColumnRenamed("k", key)


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(key, n_tokens bigint): 0 for null and empty text. Only the counts leave Python."""
    path = path or vocabulary_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            n = [bpe.count(t) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["k", "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    return spread(df.select(key, text)).mapInArrow(work, f"k {kind}, n_tokens bigint").withColumnRenamed("k", key)


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(key, text): the concatenated vocabulary strings; null ids stay null."""
    path = path or vocabulary_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path)
        for b in batches:
            out = [None if x is None else bpe.decode(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["k", "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, ids).mapInArrow(work, f"k {kind}, text string").withColumnRenamed("k", key)
