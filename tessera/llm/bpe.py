"""Byte-level BPE over whole texts in padded numpy matrices.

Texts are cut into pieces by the vocabulary's pattern.  The distinct pieces of a
batch are bucketed by length into padded matrices of token ids.  In each round
every row merges its leftmost pair of minimum rank: pair ranks come from an
open-addressing hash table, the merged column is compacted away, and rows
without a mergeable pair leave the matrix.  Results are remembered per piece.

A vocabulary has a fixed size, so shipping it to the workers is bounded.
Null and empty texts give an empty list.  No special tokens exist: a text that
spells one is ordinary text.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.workspace import spread

#: Fixed value: the cutting pattern that belongs to this family of vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces above this many bytes go through a heap, whose work grows as n log n.
LONG_PIECE = 1024
#: Pieces whose ids a worker remembers; at the limit it starts anew.
REMEMBERED = 400_000
_NONE = np.int64(2**62)


class PairTable:
    """Rank of a pair of token ids, by vectorised open addressing."""

    def __init__(self, ranks: dict[bytes, int]):
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        keys = (np.array(left, np.int64) << 32) | np.array(right, np.int64)
        self.mask = np.int64((1 << int(len(keys) * 4).bit_length()) - 1)
        self.keys = np.full(int(self.mask) + 1, -1, np.int64)
        self.ranks = np.full(int(self.mask) + 1, _NONE, np.int64)
        todo, at = np.arange(len(keys)), self._slot(keys)
        values = np.array(rank, np.int64)
        while len(todo):  # the first of those that want a free slot gets it; the others go on to the next
            free = self.keys[at] == -1
            slots, first = np.unique(at[free], return_index=True)
            winners = np.flatnonzero(free)[first]
            self.keys[slots] = keys[todo[winners]]
            self.ranks[slots] = values[todo[winners]]
            rest = np.ones(len(todo), bool)
            rest[winners] = False
            todo, at = todo[rest], (at[rest] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((x >> np.uint64(29)).astype(np.int64)) & self.mask

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs (a, b); ``_NONE`` where there is no such token or a side is padding."""
        shape = a.shape
        keys = ((a.astype(np.int64) << 32) | (b.astype(np.int64) & 0xFFFFFFFF)).ravel()
        out = np.full(keys.shape, _NONE, np.int64)
        todo = np.flatnonzero((a.ravel() >= 0) & (b.ravel() >= 0))
        at = self._slot(keys[todo])
        while len(todo):
            here = self.keys[at]
            hit = here == keys[todo]
            out[todo[hit]] = self.ranks[at[hit]]
            on = ~hit & (here != -1)
            todo, at = todo[on], (at[on] + 1) & self.mask
        return out.reshape(shape)


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.cut = regex.compile(pattern)
        self.table = PairTable(ranks)
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.known: dict[str, list[int]] = {}

    @classmethod
    def from_file(cls, path: str) -> Encoder:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def _merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pieces of similar length, one row each."""
        width = max(map(len, pieces))
        m = np.full((len(pieces), width), -1, np.int32)
        for i, p in enumerate(pieces):
            m[i, : len(p)] = self.of_byte[np.frombuffer(p, np.uint8)]
        out: list[list[int]] = [[] for _ in pieces]
        rows = np.arange(len(pieces))
        rank = self.table.get(m[:, :-1], m[:, 1:])
        while len(rows):
            if rank.shape[1] == 0:
                done = np.ones(len(rows), bool)
            else:
                at = rank.argmin(axis=1)
                best = rank[np.arange(len(rows)), at]
                done = best == _NONE
            for i in np.flatnonzero(done):
                ids = m[i]
                out[rows[i]] = ids[ids >= 0].tolist()
            if done.all():
                break
            go = ~done
            m, rank, rows, at, best = m[go], rank[go], rows[go], at[go], best[go]
            n = np.arange(len(rows))
            m[n, at] = best
            cols = np.arange(m.shape[1] - 1)
            shift = cols[None, :] > at[:, None]
            m = np.where(shift, m[:, 1:], m[:, :-1])  # compaction: what follows the merged pair moves up
            rank = np.where(cols[None, :-1] >= at[:, None], rank[:, 1:], rank[:, :-1]) if m.shape[1] > 1 else rank[:, :0]
            if m.shape[1] > 1:
                right = np.minimum(at, m.shape[1] - 2)
                rank[n, right] = self.table.get(m[n, right], m[n, right + 1])
                left = np.maximum(at - 1, 0)
                rank[n, left] = self.table.get(m[n, left], m[n, left + 1])
        return out

    def _merge_long(self, piece: bytes) -> list[int]:
        ids = self.of_byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        first = self.table.get(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r < _NONE]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            j = nxt[i]
            if j < n:
                r = int(self.table.get(np.array([ids[i]]), np.array([ids[j]]))[0])
                if r < _NONE:
                    heapq.heappush(heap, (r, i, ids[i], ids[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j] = r, False
            nxt[i] = nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            offer(i)
            if prv[i] >= 0:
                offer(prv[i])
        return [x for x, ok in zip(ids, alive, strict=True) if ok]

    def learn(self, pieces: set[str]) -> None:
        buckets: dict[int, list[str]] = {}
        for p in pieces:
            b = p.encode()
            if b in self.ranks:
                self.known[p] = [self.ranks[b]]
            elif len(b) > LONG_PIECE:
                self.known[p] = self._merge_long(b)
            else:
                buckets.setdefault(max(4, 1 << (len(b) - 1).bit_length()), []).append(p)
        for width, own in buckets.items():
            step = max(1, 4_000_000 // (width * 8))
            for i in range(0, len(own), step):
                part = own[i : i + step]
                self.known.update(zip(part, self._merge([p.encode() for p in part]), strict=True))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [self.cut.findall(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        self.learn({p for pieces in cut for p in pieces if p not in known})
        return [np.array([i for p in pieces for i in known[p]], np.int32) for pieces in cut]


def encode_texts(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, ids array<int>): one row per input row, repeated keys included.

    ``vocabulary`` is the path of a rank file, the same on every executor.  A map
    without shuffle; only the two named columns are read.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = Encoder.from_file(vocabulary)
        for b in batches:
            for i in range(0, len(b), 1000):
                part = b.iloc[i : i + 1000]
                yield pd.DataFrame({"key": part["key"], "ids": enc.encode([t if isinstance(t, str) else None for t in part["text"]])})

    rows = spread(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    return rows.mapInPandas(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)
