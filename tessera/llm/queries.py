"""Registered queries of the text operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import encode_texts
from tessera.llm.leaks import leaks
from tessera.llm.pairs import pair_defects
from tessera.llm.privacy import personal_data
from tessera.llm.scans import Scans, paragraphs
from tessera.sources.tables import table

#: Rank file of the public vocabulary; the cluster may name another place.
_VOCABULARY = ("spark.tessera.vocabulary", "/opt/tokenizers/byte_bpe_50k.tiktoken")


# -- 2: broken prompt and response pairs ---------------------------------------------------


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pair_defects(table(spark, d, "responses"), table(spark, d, "eval_queries"))


def p2_by_arm(spark: SparkSession, d: str) -> DataFrame:
    arms = table(spark, d, "responses").select("response_id", "arm")
    return p2_found(spark, d).join(arms, "response_id").groupBy("arm", "defect").agg(F.count(F.lit(1)).alias("n_responses"))


# -- 4: noise in text from scanned pages ---------------------------------------------------


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return Scans(table(spark, d, "book_pages")).found()


def p4_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return paragraphs(table(spark, d, "book_pages"))


# -- 6: encoding with a public tokenizer ---------------------------------------------------


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode_texts(table(spark, d, "documents"), spark.conf.get(*_VOCABULARY))


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    ids = p6_ids(spark, d).select("doc_id", F.size("ids").alias("n_tokens"))
    docs = table(spark, d, "documents").select("doc_id", "source")
    return docs.join(ids, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


# -- 7: evaluation texts in training texts -------------------------------------------------


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks(table(spark, d, "documents"), table(spark, d, "heldout_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Passages with at most one word changed into another."""
    return _leaks(spark, d).where("match <> 'shifted'").select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    per_item = _leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("match") == "phrase").alias("n_phrase"), F.count_if(F.col("match") == "shifted").alias("n_shifted"))
    return table(spark, d, "heldout_items").select("item_id", "suite").join(per_item, "item_id")


# -- 8: personal data ----------------------------------------------------------------------


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    found = personal_data(table(spark, d, "documents")).select("doc_id", F.explode(F.array_distinct("found")).alias("f"))
    return found.select("doc_id", F.col("f.kind").alias("kind"), F.col("f.line_no").cast("int").alias("line_no"))


def p8_redacted(spark: SparkSession, d: str) -> DataFrame:
    return personal_data(table(spark, d, "documents")).select("doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (p2_found, p2_by_arm, p4_found, p4_paragraphs, p6_ids, p6_counts, p7_found, p7_items, p8_found, p8_redacted)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {}
