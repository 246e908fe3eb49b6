"""Hashed bags of words and exact cosine search, on the JVM side.

The default embedder counts words in ``DIMENSIONS`` buckets of their md5, so any
SQL engine can recompute it.  A bag is stored sparse, one row per bucket; only
pairs that share a bucket can have a similarity above zero.

``nearest`` finds the best k without meeting all those pairs.  Buckets are rare
or common in the index.  What shares a rare bucket with a query is scored in
full; what shares only common ones cannot score above the length of the query's
common part over its whole length.  A query whose k-th best candidate lies above
that bound is done; the others, and they alone, meet the common buckets too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import terms
from tessera.operators.hotkeys import pieces_of
from tessera.workspace import Workspace

DIMENSIONS = 4096
#: A bucket is rare if at most this share of the index holds it.
RARE = 0.01
#: Rows of bags of queries that are shipped to all tasks.
FEW = 1 << 17


def bucket(word: Column) -> Column:
    return (F.conv(F.substring(F.md5(word.cast("binary")), 1, 8), 16, 10).cast("bigint") % DIMENSIONS).cast("int")


def bags(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, bucket, c, norm) of a text column; rows without words have no bag.

    A bag has at most ``DIMENSIONS`` rows, so the norm is a window over few rows
    that shares the shuffle of the counts.
    """
    words = df.select(key, F.explode(terms(text)).alias("w"))
    counts = words.groupBy(key, bucket(F.col("w")).alias("bucket")).agg(F.count(F.lit(1)).alias("c"))
    return counts.withColumn("norm", F.sum(F.col("c") * F.col("c")).over(Window.partitionBy(key)))


def _score(dot: Column) -> Column:
    return dot / F.sqrt((F.col("qn") * F.col("norm")).cast("double"))


def _asked(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", "bucket", F.col("c").alias("qc"), F.col("norm").alias("qn"))


def _frequencies(index: DataFrame) -> DataFrame:
    """(bucket, n_salts): at most ``DIMENSIONS`` rows; into how many parts a bucket's postings are split."""
    df = index.groupBy("bucket").agg(F.count(F.lit(1)).alias("df"))
    total = df.agg(F.sum("df").alias("t")).scalar()
    return df.withColumn("n_salts", F.ceil(F.col("df") * pieces_of(index.sparkSession) / total).cast("int"))


def similarities(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query_id, key, score) of all pairs above zero; bags of ``query_id`` and ``key``.

    The postings of a common bucket are split over several tasks.
    """
    hot = F.broadcast(_frequencies(index))
    i = index.join(hot, "bucket").withColumn("salt", F.pmod(F.xxhash64("key"), F.col("n_salts")))
    q = _asked(queries).join(hot, "bucket").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_salts").cast("bigint") - 1)))
    pairs = q.select("query_id", "bucket", "salt", "qc", "qn").join(i.select("key", "bucket", "salt", "c", "norm"), ["bucket", "salt"])
    return pairs.groupBy("query_id", "key", "qn", "norm").agg(F.sum(F.col("qc") * F.col("c")).alias("dot")).select("query_id", "key", _score(F.col("dot")).alias("score"))


def _met(queries: DataFrame, index: DataFrame) -> DataFrame:
    """The same for few queries, which are shipped to all tasks: an index in buckets of its keys is not moved, nor are the pairs."""
    pairs = index.join(F.broadcast(_asked(queries)), "bucket")
    return pairs.groupBy("query_id", "key", "qn", "norm").agg(F.sum(F.col("qc") * F.col("c")).alias("dot")).select("query_id", "key", _score(F.col("dot")).alias("score"))


def scores_of(pairs: DataFrame, queries: DataFrame, index: DataFrame, few: bool = False) -> DataFrame:
    """(query_id, key, score) above zero of the given pairs (query_id, key) only; few queries are shipped to all tasks."""
    asked = F.broadcast(_asked(queries)) if few else _asked(queries)
    p = pairs.select("query_id", "key").distinct().join(index, "key").join(asked, ["query_id", "bucket"])
    return p.groupBy("query_id", "key", "qn", "norm").agg(F.sum(F.col("qc") * F.col("c")).alias("dot")).select("query_id", "key", _score(F.col("dot")).alias("score"))


def nearest(queries: DataFrame, index: DataFrame, k: int, tie: DataFrame | None = None, rare: float = RARE, stored: bool = False) -> DataFrame:
    """(query_id, key, score, rank): the best ``k`` by cosine, exactly as from all pairs.

    ``tie`` (key, tie…) orders equal scores by its second column, and only keys in it
    count; without it the key does.  ``stored``: the index is a written table already;
    if it lies in buckets of its keys, few queries meet it where it lies.
    """
    ws = Workspace(queries.sparkSession, "nearest")
    (at_asked, asked), (at_index, index) = ws.write(queries), (None, index) if stored else ws.write(index)
    own = tie if tie is not None else index.select("key", F.col("key").alias("tie")).distinct()
    by = own.columns[1]
    size = max(index.select("key").distinct().count() * rare, k)
    at_freq, freq = ws.write(index.groupBy("bucket").agg(F.count(F.lit(1)).alias("df")))
    kept = F.broadcast(freq.where(F.col("df") <= size).select("bucket"))
    few = asked.count() <= FEW
    words = asked.join(kept, "bucket", "left_semi").select("query_id", "bucket")
    some = index.select("key", "bucket").join(F.broadcast(words) if few else words, "bucket").select("query_id", "key")
    at_first, first = ws.write(scores_of(some, asked, index, few).join(own, "key"))
    best = top(first, k, by)
    reached = best.where(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    rest = asked.join(kept, "bucket", "left_anti").groupBy("query_id", "norm").agg(F.sum(F.col("c") * F.col("c")).alias("r"))
    bound = rest.select("query_id", F.sqrt(F.col("r").cast("double") / F.col("norm")).alias("bound"))
    at_open, open_ = ws.write(bound.join(reached, "query_id", "left").where("kth is null or kth <= bound + 1e-9").select("query_id"))
    if not open_.isEmpty():
        again = asked.join(open_, "query_id", "left_semi")
        whole = (_met(again, index) if few else similarities(again, index)).join(own, "key").select("query_id", "key", "score", by)
        best = top(first.join(open_, "query_id", "left_anti").select("query_id", "key", "score", by).unionByName(whole), k, by)
    best = ws.write(best)[1]
    for at in (at_asked, at_index, at_freq, at_first, at_open):
        if at:
            ws.drop(at)
    return best


def top(scored: DataFrame, k: int, tie: str) -> DataFrame:
    """The best ``k`` per query by score, ties by ``tie``; column ``rank`` from 1.

    A rank filter on a window keeps the best k of every task before the shuffle.
    """
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vector_top_k(queries: DataFrame, index: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """Exact cosine top-k of dense vectors: (query_id, key, score, rank).

    ``queries`` (query_id, vector) is a stated query set; it meets the index in
    blocks of about ``block`` vectors, by hash, each shipped to all tasks.  Every task
    keeps the best k of its rows, so the shuffle carries k rows per task and query.
    Zero vectors score 0; ties go to the smaller key.
    """
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    q = queries.select("query_id", F.col("vector").alias("qv"), norm(F.col("vector")).alias("qn"))
    i = index.select("key", "vector", norm(F.col("vector")).alias("n"))
    dot = F.aggregate(F.zip_with("qv", "vector", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    score = F.when(F.col("qn") * F.col("n") == 0, F.lit(0.0)).otherwise(dot / (F.col("qn") * F.col("n")))
    blocks = -(-q.count() // block)
    parts = []
    for b in range(max(blocks, 1)):
        own = q if blocks <= 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        parts.append(top(i.crossJoin(F.broadcast(own)).select("query_id", "key", score.alias("score")), k, "key"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
