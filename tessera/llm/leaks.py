"""Evaluation texts inside training texts: a stored positional inverted index.

``build_index`` writes the postings of all words of all documents, once, as a
table that can be asked again: every shard of documents gives one row per term
with the term's documents and positions, so a term that every text has is spread
over as many rows as there are shards.

``leaks`` asks it with the test texts, in blocks of ``BLOCK`` items.  The index is
read for the block's terms only and gathered by shard, which bounds what a task
holds.  Of every window of a test text the three rarest terms of the shard are
taken; with at most one changed word two of them stand at their places, so their
posting lists, each shifted by the term's place, are intersected in pairs.  Every
start that survives is compared word by word: a *phrase* has all words of a
window; *changed* has one other word in place of one; *shifted* has one word more
or one less.

Defined cases: null, empty and blank texts hold nothing; rows without a key are
left out; a test text of fewer words than a window is never found; repeated
documents and test items are each reported once per key and item.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.workspace import Workspace, spread

#: Words in a row that make a leak, and how many of them may be changed.
WINDOW, CHANGED = 12, 1
#: Words of a shard.
SHARD = 400_000
#: Test items that are asked at once: what one call ships to the workers.
BLOCK = 2000
_LINK = re.compile(r"!?\[([^\]\n]*)\]\([^)\n]*\)")
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]*>|&(?:[a-z]+|#\d+);")
_LABEL = re.compile(r"^[\s>*_#\-]*(?:q|a|p|r|question|answer|pergunta|resposta)\s*[*_]*\s*[:.)][*_]*\s", re.I | re.M)
_GONE = re.compile("[­​-‏⁠﻿]")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Words of a text without case, accents, punctuation, line breaks, markup and speaker labels."""
    if not text:
        return []
    text = _GONE.sub("", text)
    if "](" in text:
        text = _LINK.sub(r"\1", text)
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    text = _LABEL.sub(" ", text)
    if text.isascii():
        return _WORD.findall(text.lower())
    text = unicodedata.normalize("NFKD", text)
    return _WORD.findall("".join(c for c in text if not unicodedata.combining(c)).casefold())


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", shard: int = SHARD) -> DataFrame:
    """(shard, term, keys, positions) of all words of all documents, one row per term and shard; parallel arrays in order.

    The empty term has the lengths of a shard's documents.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows(keys: list, lengths: list[int], tokens: list[str]) -> pd.DataFrame:
            codes, terms = pd.factorize(np.array(tokens, dtype=object))
            order = np.argsort(codes, kind="stable")
            cuts = np.flatnonzero(np.diff(codes[order])) + 1
            owner = np.repeat(np.arange(len(lengths)), lengths)
            place = np.concatenate([np.arange(n, dtype=np.int32) for n in lengths])
            names = np.array(keys, dtype=None if isinstance(keys[0], (int, np.integer)) else object)
            ks, ps = np.split(names[owner[order]], cuts), np.split(place[order], cuts)
            nonlocal made
            made += 1
            ks, ps = [*ks, names], [*ps, np.array(lengths, np.int32)]  # under the empty term, the lengths of all documents
            return pd.DataFrame({"shard": part * 1_000_000 + made, "term": [*terms, ""], "keys": ks, "positions": ps})

        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        keys, lengths, tokens = [], [], []
        for b in batches:
            for k, t in zip(b["key"], b["text"], strict=True):
                own = words(t) if isinstance(t, str) else []
                if own:
                    keys.append(k)
                    lengths.append(len(own))
                    tokens += own
                if len(tokens) >= shard:
                    yield rows(keys, lengths, tokens)
                    keys, lengths, tokens = [], [], []
        if tokens:
            yield rows(keys, lengths, tokens)

    own = spread(docs.where(F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text")))
    return own.mapInPandas(run, f"shard bigint, term string, keys array<{_kind(docs, key)}>, positions array<int>")


class Shard:
    """Words of some documents as numbers of test terms, in reading order, and where each term stands."""

    def __init__(self, terms: np.ndarray, keys: list[np.ndarray], positions: list[np.ndarray], size: int):
        n = [len(p) for p in positions]
        self.keys, own = np.unique(np.concatenate(keys), return_inverse=True)
        place, no = np.concatenate(positions).astype(np.int64), np.repeat(terms, n)
        last = np.zeros(len(self.keys), np.int64)
        np.maximum.at(last, own[no < 0], place[no < 0] - 1)  # the lengths
        own, place, no = own[no >= 0], place[no >= 0], no[no >= 0]
        begin = np.cumsum(np.concatenate([[0], last + 1 + 2 * WINDOW])) + 2 * WINDOW
        self.ids = np.full(int(begin[-1]) + 2 * WINDOW, -1, np.int32)
        self.doc = np.full(len(self.ids), -1, np.int32)
        at = begin[own] + place
        self.ids[at] = no
        self.begin, self.end = begin[:-1], begin[:-1] + last + 1
        for d, (a, z) in enumerate(zip(begin[:-1], last, strict=True)):
            self.doc[a : a + z + 1] = d
        held = np.flatnonzero(self.ids >= 0)
        self.postings = held[np.argsort(self.ids[held], kind="stable")]
        self.starts = np.searchsorted(self.ids[self.postings], np.arange(size + 1))
        self.df = np.diff(self.starts)

    def find(self, test: np.ndarray) -> dict[int, str]:
        """Documents (by number) that hold a window of the test text, and how."""
        df, pairs = self.df[test], set()
        for s in range(len(test) - WINDOW + 1):
            a = np.sort(s + np.argsort(df[s : s + WINDOW], kind="stable")[: CHANGED + 2])
            pairs.update((int(a[i]), int(a[j])) for i in range(len(a)) for j in range(i) if df[a[i]] and df[a[j]])
        at = lambda i: self.postings[self.starts[test[i]] : self.starts[test[i] + 1]] - i
        places = [np.intersect1d(at(i), at(j), assume_unique=True) for i, j in pairs]
        d = np.unique(np.concatenate(places)) if places else np.empty(0, np.int64)
        out: dict[int, str] = {}
        if not len(d):
            return out
        where = d[:, None] + np.arange(len(test))[None, :]
        inside = (where >= 0) & (where < len(self.ids))
        where = np.where(inside, where, 0)
        same = (self.ids[where] == test[None, :]) & inside
        run = np.cumsum(np.pad(same, ((0, 0), (1, 0))), axis=1)
        held = (run[:, WINDOW:] - run[:, :-WINDOW]).max(axis=1)
        plain, near = test.tolist(), np.flatnonzero(held * 2 >= WINDOW - 2)
        for r in near.tolist():
            k = int(d[r])
            for doc in np.unique(self.doc[where[r]][same[r]]).tolist():  # a long test text may lie across several documents
                if out.get(doc) == "phrase":
                    continue
                low = max(int(self.begin[doc]), k - WINDOW)
                how = match(self.ids[low : min(int(self.end[doc]), k + len(test) + WINDOW)].tolist(), plain, k - low)
                if how and (doc not in out or how < out[doc] or how == "phrase"):
                    out[doc] = how
        return out


def match(doc: Sequence, test: Sequence, start: int) -> str | None:
    """How a test text's windows are found around one alignment: "phrase", "changed", "shifted" or not at all."""
    low, high = max(0, -start), min(len(test), len(doc) - start)
    same = [doc[start + i] == test[i] for i in range(low, high)]
    run = sum(same[:WINDOW])
    best = run if len(same) >= WINDOW else -1
    for i in range(WINDOW, len(same)):
        run += same[i] - same[i - WINDOW]
        best = max(best, run)
    if best >= WINDOW - CHANGED:
        return "phrase" if best == WINDOW else "changed"
    if max(best, run) * 2 < WINDOW - 2:  # on one side of a gap stands half a window at least
        return None
    return "shifted" if any(_joined(doc, test, a, b) for a, b in ((start, start - 1), (start, start + 1), (start - 1, start), (start + 1, start))) else None


def _joined(doc: Sequence, test: Sequence, first: int, then: int) -> bool:
    """Whether a run at one alignment goes on at the next, with one word less or more in the document, over a window's length."""
    ends = [0] * (len(test) + 1)  # length of the run that ends before i
    for i in range(len(test)):
        ends[i + 1] = ends[i] + 1 if 0 <= first + i < len(doc) and doc[first + i] == test[i] else 0
    lost, n = then < first, 0
    for i in range(len(test) - 1, -1, -1):
        n = n + 1 if 0 <= then + i < len(doc) and doc[then + i] == test[i] else 0
        gap = i - lost  # where the first run ends: in front of the word that the document lacks
        if n and gap > 0 and ends[gap] and ends[gap] + n + lost >= WINDOW:
            return True
    return False


def leaks(docs: DataFrame, tests: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", texts: list[list[str]] | None = None, index: DataFrame | None = None) -> DataFrame:
    """(key, item, match) for every document and test item found in it; the best of phrase, changed and shifted.

    ``texts`` names the test texts of an item as lists of columns to be joined;
    ``index`` is a stored index of the documents, built and written here if not given.
    """
    ws = Workspace(docs.sparkSession, "leaks")
    index = index if index is not None else ws.write(build_index(docs, key, text))[1]
    texts = texts or [["passage"], ["question", "answer"]]
    schema = f"key {_kind(docs, key)}, item {_kind(tests, item)}, match string"
    asked = tests.where(F.col(item).isNotNull()).select(F.col(item).alias("item"), *sorted({c for cols in texts for c in cols}))
    blocks = max(1, -(-asked.count() // BLOCK))
    out = None
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()
        part = _block(index, [(r["item"], [words(" ".join(r[c] or "" for c in cols)) for cols in texts]) for r in own], schema)
        out = part if out is None else out.unionByName(part)
    best = out.groupBy("key", "item").agg(F.min(F.struct((F.col("match") != "phrase").alias("no"), "match")).alias("m"))
    return best.select(F.col("key").alias(key), F.col("item").alias(item), F.col("m.match").alias("match"))


def _block(index: DataFrame, held: list[tuple[object, list[list[str]]]], schema: str) -> DataFrame:
    """What a bounded number of test items have in common with the indexed documents."""
    terms: dict[str, int] = {}
    coded = [(i, np.array([terms.setdefault(w, len(terms)) for w in s], np.int32)) for i, seqs in held for s in seqs if len(s) >= WINDOW]
    spark = index.sparkSession
    numbers = spark.createDataFrame(pd.DataFrame({"term": ["", *terms], "no": [-1, *terms.values()]}), "term string, no int")
    posted = index.join(F.broadcast(numbers), "term").select("shard", "no", "keys", "positions")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shard = Shard(rows["no"].to_numpy(np.int32), list(rows["keys"]), list(rows["positions"]), len(terms))
        found = [(shard.keys[d], i, how) for i, test in coded for d, how in shard.find(test).items()]
        return pd.DataFrame(found, columns=["key", "item", "match"])

    return posted.groupBy("shard").applyInPandas(run, schema)
