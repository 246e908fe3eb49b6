"""Model boundaries.  A model is a picklable factory; each worker builds it once.

No model is bundled: defaults are the hashed bag of words (embedder), word
overlap (reranker) and the extractive summary, all plain expressions.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def rerank(self, query: str, texts: list[str]) -> list[float]: ...


class TextModel(Protocol):
    """Extracts, generates or judges: a system prompt and a text to (answer, input tokens, output tokens)."""

    def complete(self, system: str, text: str) -> tuple[str, int, int]: ...


def embed(df: DataFrame, text: str, factory: Callable[[], Embedder], out: str = "vector") -> DataFrame:
    """``df`` with an array<float> column of the model's vectors; null texts have null vectors."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = factory()
        for s in batches:
            have = s[s.notna()]
            got = dict(zip(have.index, model.embed(have.tolist()), strict=True))
            yield pd.Series([got.get(i) for i in s.index], index=s.index)

    return df.withColumn(out, run(F.col(text)))


def complete(df: DataFrame, system: str, text: str, factory: Callable[[], TextModel], retries: int = 2, json_only: bool = False) -> DataFrame:
    """``df`` with answer, input_tokens, output_tokens, latency_ms and error.

    A failing row gets its error and no usage, and fails nothing else.  With
    ``json_only`` an answer that holds no JSON object is asked for again; fences
    around it are stripped.
    """
    schema = "answer string, input_tokens bigint, output_tokens bigint, latency_ms double, error string"

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = factory()
        for s in batches:
            rows = []
            for x in s:
                began, row = time.monotonic(), None
                for left in range(retries, -1, -1):
                    try:
                        answer, n, m = model.complete(system, x or "")
                        if json_only:
                            answer = answer[answer.index("{") : answer.rindex("}") + 1]
                            json.loads(answer)
                        row = (answer, n, m, (time.monotonic() - began) * 1000, None)
                        break
                    except Exception as e:  # the row's error is its result
                        if not left:
                            row = (None, None, None, None, f"{type(e).__name__}: {e}"[:500])
                rows.append(row)
            yield pd.DataFrame(rows, columns=["answer", "input_tokens", "output_tokens", "latency_ms", "error"])

    return df.withColumn("r", run(F.col(text))).select(*[F.col(c) for c in df.columns], "r.*")


def rerank_scores(df: DataFrame, query: str, text: str, factory: Callable[[], Reranker], out: str = "score") -> DataFrame:
    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = factory()
        for q, t in batches:
            yield pd.Series([model.rerank(a, [b])[0] for a, b in zip(q, t, strict=True)])

    return df.withColumn(out, run(F.col(query), F.col(text)))


def clamped(score: str) -> Column:
    """Judge scores lie between 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(score)))
