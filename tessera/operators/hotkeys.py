"""Per-key totals where a few keys hold most rows: exact offset chunking.

A key is *hot* when it has more rows than one chunk, and a chunk holds
``rows / pieces`` rows, so at most ``pieces`` keys are hot, whatever the data.

Hot keys: the rows are pre-aggregated per (key, value); rows per key are
counted per input partition (a content-defined slice of the value space, so a
retried task sees the same slice); a prefix sum over these counts gives every
slice its offset within the key; rows are numbered by slice and value; equal
runs of positions form the chunks; every chunk yields an ordered boundary state
(rows, distinct values, first and last value, time range), and the states of a
key are merged in order, a value that continues across a boundary counted once.

The other keys have fewer rows than a chunk each, so one shuffle on the key
completes them; a key is then simply a chunk of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.workspace import Workspace, shuffle_partitions


def pieces_of(spark: SparkSession) -> int:
    """Chunks into which all rows are divided: some per shuffle partition, and
    at least 200, so that a key with one percent of all rows is always hot."""
    return max(16 * shuffle_partitions(spark), 200)


def same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality of key columns; null is a key like any other."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def hot_keys(df: DataFrame, keys: list[str], pieces: int | None = None) -> DataFrame:
    """(keys…, rows_of_key, rows_of_all) for the keys above one chunk.

    At most ``pieces`` rows for any input.  The count per key is combined on the
    map side, so a hot key costs one row per task.
    """
    pieces = pieces or pieces_of(df.sparkSession)
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows_of_key"))
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return per_key.withColumn("rows_of_all", total).where(F.col("rows_of_key") * pieces > F.col("rows_of_all"))


def salts(big: DataFrame, keys: list[str], pieces: int | None = None) -> DataFrame:
    """(keys…, n_salts) of the hot keys: into how many parts the rows of each are to be split."""
    pieces = pieces or pieces_of(big.sparkSession)
    hot = hot_keys(big.select(*keys).dropna(), keys, pieces)
    return hot.select(*keys, F.ceil(F.col("rows_of_key") * pieces / F.col("rows_of_all")).cast("int").alias("n_salts"))


def with_salt(big: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """``big`` with a column ``salt``: 0, or for hot keys a hash of the whole row."""
    own = F.pmod(F.xxhash64(*[F.col(c) for c in big.columns if "map" not in big.schema[c].dataType.simpleString()]), F.col("n_salts")).cast("int")
    return big.join(F.broadcast(hot), keys, "left").withColumn("salt", F.coalesce(own, F.lit(0))).select(*big.columns, "salt")


def for_salts(small: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """``small`` with one row per salt of its key."""
    n = F.coalesce(F.col("n_salts"), F.lit(1))
    return small.join(F.broadcast(hot), keys, "left").select(*small.columns, F.explode(F.sequence(F.lit(0), n - 1)).alias("salt"))


def key_totals(df: DataFrame, keys: list[str], value: str, at: str, pieces: int | None = None) -> DataFrame:
    """Per key: n_rows, n_values (distinct non-null ``value``), first_at, last_at.

    Null keys form a key; null values count as rows but not as values; null
    times are ignored; an empty input gives no rows; repeated rows all count.
    Columns other than the named ones are ignored, so their names cannot clash.
    """
    spark = df.sparkSession
    pieces = pieces or pieces_of(spark)
    slices = shuffle_partitions(spark)
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(
        *[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(value).alias("value"), F.col(at).alias("at")
    )
    ws = Workspace(spark, "hotkeys")
    hot = ws.write(hot_keys(rows, names, pieces).withColumn("key_no", F.row_number().over(Window.orderBy(*names))).select(
        *[F.col(n).alias(f"h_{n}") for n in names], "key_no", "rows_of_all"
    ))[1]
    match = F.lit(True)
    for n in names:
        match = match & F.col(n).eqNullSafe(F.col(f"h_{n}"))

    # Hot keys: a small integer stands for the key from here on.
    pre = ws.write(
        rows.join(F.broadcast(hot), match)
        .groupBy("key_no", "value")
        .agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"), F.first("rows_of_all").alias("rows_of_all"))
        .withColumn("slice", F.pmod(F.xxhash64("value"), F.lit(slices)))
    )[1]
    cells = pre.groupBy("key_no", "slice").agg(F.count(F.lit(1)).alias("c"))
    before = Window.partitionBy("key_no").orderBy("slice")
    offsets = cells.select("key_no", "slice", (F.sum("c").over(before) - F.col("c")).alias("offset"))
    in_slice = Window.partitionBy("key_no", "slice").orderBy(F.col("value").asc_nulls_first())
    numbered = (
        pre.withColumn("r", F.row_number().over(in_slice))
        .join(offsets, ["key_no", "slice"])
        .withColumn("pos", F.col("offset") + F.col("r") - 1)
        .withColumn("chunk", F.floor(F.col("pos") / F.ceil(F.col("rows_of_all") / F.lit(pieces))))
    )
    states = numbered.groupBy("key_no", "chunk").agg(
        F.sum("n").alias("n"),
        F.count("value").alias("d"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.min_by("value", "pos").alias("first_value"),
        F.max_by("value", "pos").alias("last_value"),
    )
    ordered = Window.partitionBy("key_no").orderBy("chunk")
    merged = (
        states.withColumn("goes_on", (F.lag("last_value").over(ordered) == F.col("first_value")).cast("long"))
        .groupBy("key_no")
        .agg(
            F.sum("n").alias("n_rows"),
            (F.sum("d") - F.sum(F.coalesce("goes_on", F.lit(0)))).alias("n_values"),
            F.min("lo").alias("first_at"),
            F.max("hi").alias("last_at"),
        )
    )
    out = [F.col(n).alias(k) for n, k in zip(names, keys, strict=True)]
    totals = ["n_rows", "n_values", "first_at", "last_at"]
    hot_part = merged.join(F.broadcast(hot), "key_no").select(
        *[F.col(f"h_{n}").alias(k) for n, k in zip(names, keys, strict=True)], *totals
    )

    # The rest: each key fits one chunk; one exchange serves both groupings.
    cold_part = (
        rows.join(F.broadcast(hot), match, "left_anti")
        .repartition(*names)
        .groupBy(*names, "value")
        .agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("lo"), F.max("at").alias("hi"))
        .groupBy(*names)
        .agg(F.sum("n").alias("n_rows"), F.count("value").alias("n_values"), F.min("lo").alias("first_at"), F.max("hi").alias("last_at"))
        .select(*out, *totals)
    )
    return hot_part.unionByName(cold_part)


def heavy_share(totals: DataFrame, percent: int, rows: DataFrame) -> DataFrame:
    """Keys of ``totals`` with at least ``percent`` of all ``rows`` (integer arithmetic).

    The rows are counted by themselves, which for files reads no column.
    """
    n_all = rows.agg(F.count(F.lit(1)).alias("n")).scalar()
    return totals.where(F.col("n_rows") * 100 >= n_all * percent)
