"""Files as DataFrames: notes, source trees, query sets, PDF pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGES = "book string, number int, lines array<string>, line_sizes array<double>"


def text_files(spark: SparkSession, root: str, pattern: str = "*.md") -> DataFrame:
    """(path, stem, text) of all files below a folder that match; paths are relative to it."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    at = F.col("_metadata.file_path")
    rel = F.regexp_replace(F.url_decode(at), "^.*?" + root.rstrip("/").replace(".", r"\.") + "/", "")
    return raw.select(rel.alias("path"), F.col("value").alias("text")).withColumn("stem", F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)).select("path", "stem", "text")


def source_tree(spark: SparkSession, root: str) -> DataFrame:
    """Python and Java files, the blank ones left out."""
    return text_files(spark, root, "*.{py,java}").where(F.trim("text") != "")


def query_set(spark: SparkSession, path: str) -> DataFrame:
    """The cases of a query-set file {"queries": [{…}]}."""
    schema = "queries array<struct<id: string, question: string, category: string, graph_favored: boolean, relevant_sources: array<string>, relevant_labels: array<string>, answer_key: string, note: string>>"
    return spark.read.option("multiLine", True).schema(schema).json(path).select(F.inline("queries"))


def pdf_pages(spark: SparkSession, root: str, parser: Callable[[bytes], list[tuple[list[str], list[float]]]]) -> DataFrame:
    """Pages of PDF files by an injected parser (bytes to a list of lines and sizes per page); no parser is bundled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                book = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
                for n, (lines, sizes) in enumerate(parser(bytes(content)), 1):
                    kept = [(x, float(s)) for x, s in zip(lines, sizes, strict=True) if x.strip()]
                    rows.append((book, n, [x for x, _ in kept], [s for _, s in kept]))
            yield pd.DataFrame(rows, columns=["book", "number", "lines", "line_sizes"])

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", True).load(root)
    return raw.select("path", "content").mapInPandas(run, PAGES)


def cached_answers(spark: SparkSession, path: str, fingerprint: str) -> DataFrame | None:
    """Answers written under this fingerprint, or nothing if the inputs changed."""
    try:
        own = spark.read.parquet(path).where(F.col("fingerprint") == fingerprint)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    return own if own.limit(1).count() else None


def save_answers(answers: DataFrame, path: str, fingerprint: str) -> None:
    answers.withColumn("fingerprint", F.lit(fingerprint)).write.mode("overwrite").parquet(path)
