"""Edge and node arrivals as a stream (an extension: the graph model itself knows no streams)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tessera.operators.store import last_wins


def upsert_stream(arrivals: DataFrame, keys: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Writes every micro-batch, reduced to its last row per key, as a partition ``batch``.

    A batch that is retried overwrites its own partition, so replays change nothing.
    Readers take ``current(spark.read.parquet(path), keys)``.
    """

    def write(batch: DataFrame, n: int) -> None:
        last_wins(batch, keys).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return arrivals.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(table: DataFrame, keys: list[str]) -> DataFrame:
    return last_wins(table.drop("batch"), keys)


def windowed_counts(events: DataFrame, at: str = "ts", every: str = "1 hour", late: str = "2 hours", key: str = "event_type") -> DataFrame:
    """Arrivals per window and key; rows later than the watermark are dropped by a stream, none by a batch."""
    return events.withWatermark(at, late).groupBy(F.window(at, every).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(
        F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("window_start"), key, "n"
    )
