"""Shared folder for tables that cut lineage, and sizes derived from the session.

Iterative operators write each round to parquet under ``spark.checkpoint.dir``,
a folder every executor sees, and go on from the written table: a lost executor
costs a re-read, never a recomputation of all earlier rounds.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_SETTING = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; where it is unset (tests, a
    single machine) a temporary one is made and remembered in the session."""
    at = spark.conf.get(_SETTING, None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_SETTING} to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set(_SETTING, at)
        atexit.register(_remove_local, at)
    return at


def _remove_local(at: str) -> None:
    import shutil

    shutil.rmtree(at.removeprefix("file://"), ignore_errors=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan over at least as many tasks as there are cores.

    A few small files would give a few tasks, while Python work per row is heavy;
    an input of enough splits is left alone, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


@contextmanager
def no_shuffle_left(spark: SparkSession) -> Iterator[None]:
    """Jobs within remove their shuffle files when they end.

    What they wrote is read from then on, so nothing asks for the files again; else
    they stay on the executors' disks until the driver happens to collect its garbage.
    """
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


class Workspace:
    """A folder of intermediate tables of one operator run.

    ``write`` materialises a frame and returns it read back; ``drop`` removes a
    table that no later step reads.  What is left goes when the driver exits.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        self._tables: list[str] = []
        atexit.register(self.close)

    def write(self, df: DataFrame, by: list[str] | None = None) -> tuple[str, DataFrame]:
        self._n += 1
        path = f"{self.root}/t{self._n:04d}"
        out = df.write.mode("overwrite").option("compression", "zstd")
        if by:
            out = out.partitionBy(*by)
        with no_shuffle_left(self.spark):
            out.parquet(path)
        schema = df.schema
        if by:  # the partition columns come last when read
            schema = T.StructType([f for f in schema if f.name not in by] + [schema[c] for c in by])
        return path, self.spark.read.schema(schema).parquet(path)

    def write_bucketed(self, df: DataFrame, by: list[str], distinct: bool = False, placed: bool = False) -> DataFrame:
        """Written as a table of hash buckets, one per shuffle partition, so that joins on ``by`` move the other side only.

        ``placed``: the rows are already partitioned like this and don't move.
        """
        self._n += 1
        name, n = f"t_{uuid.uuid4().hex}", shuffle_partitions(self.spark)
        rows = df if placed else df.repartition(n, *by)
        with no_shuffle_left(self.spark):
            (rows.distinct() if distinct else rows).write.bucketBy(n, *by).sortBy(*by).option("compression", "zstd").option("path", f"{self.root}/t{self._n:04d}").saveAsTable(name)
        self._tables.append(name)
        return self.spark.table(name)

    def read(self, paths: list[str], schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths)

    def drop(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def close(self) -> None:
        try:
            for name in self._tables:
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            self.drop(self.root)
        except Exception:  # the session may be gone already
            pass
