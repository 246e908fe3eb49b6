"""References to records that do not exist, are deleted, or came later.

References carry one or more key columns, each of which may be null.  They are
grouped by null mask and every mask is joined on its non-null columns only:

* ``simple``: a reference with any null column refers to nothing;
* ``partial``: the non-null columns must be found together in one target row;
* ``full``: either all columns are null, or none is; a mixed mask is an orphan.

A reference whose columns are all null is never an orphan.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.hotkeys import hot_keys

MATCHES = ("simple", "partial", "full")


def lifetimes(nodes: DataFrame, key: str = "id") -> DataFrame:
    """(key, first_at, gone_at): first arrival, and the deletion of the last row.

    The last row is the one with the highest ``ord``; rows without ``ord`` count
    as the earliest.  Null keys are left out.
    """
    last = F.struct(F.coalesce(F.col("ord"), F.lit(-(2**63))).alias("o"), F.col("deleted_at").alias("gone_at"))
    return (
        nodes.where(F.col(key).isNotNull())
        .select(F.col(key), "ingested_at", last.alias("last"))
        .groupBy(key)
        .agg(F.min("ingested_at").alias("first_at"), F.max("last").alias("last"))
        .select(key, "first_at", F.col("last.gone_at").alias("gone_at"))
    )


def hot_safe_left_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on non-null keys, unique on the right, that no hot key slows.

    The keys above one chunk of the left side (a bounded number) are joined
    against a broadcast of their right rows; the rest is shuffled.  The added
    column ``found`` tells matches from non-matches.
    """
    right = right.withColumn("found", F.lit(True))
    hot = hot_keys(left, keys).select(*keys)
    left_hot = left.join(F.broadcast(hot), keys, "left_semi")
    left_cold = left.join(F.broadcast(hot), keys, "left_anti")
    right_hot = right.join(F.broadcast(hot), keys, "left_semi")
    return left_hot.join(F.broadcast(right_hot), keys, "left").unionByName(left_cold.join(right, keys, "left"))


def _reason(at: str) -> Column:
    """Why a reference made at ``at`` finds no live target; null if it does."""
    late, gone = F.col("first_at") > F.col(at), F.col("gone_at") <= F.col(at)
    return F.when(F.col("found").isNull(), "missing").when(late, "late").when(gone, "deleted")


def orphans(refs: DataFrame, keys: list[str], targets: DataFrame, match: str = "simple", at: str | None = None) -> DataFrame:
    """The rows of ``refs`` without a target, one null mask at a time, with a ``reason``.

    ``targets`` has the same key columns and may repeat keys.  All columns of
    ``refs`` are kept, but for one called ``reason``; repeated references are all reported.

    Undated, every reason is ``missing``.  With ``at``, the time of a reference,
    targets also have first_at and gone_at, and the join of each mask brings them
    along: of the targets that match, the first arrival, and the last deletion if
    all are deleted.  A target that came after the reference is ``late``, one gone
    by then ``deleted``.  A null time makes a found reference neither.
    """
    if match not in MATCHES:
        raise ValueError(f"match must be one of {MATCHES}")
    own, names = refs.columns, [f"r_{c}" for c in refs.columns]  # so that no column of the references clashes
    refs, targets = refs.toDF(*names), targets.withColumnsRenamed({k: f"r_{k}" for k in keys})
    keys, at = [f"r_{k}" for k in keys], at and f"r_{at}"
    parts = []
    for mask in product((True, False), repeat=len(keys)):
        present = [k for k, there in zip(keys, mask, strict=True) if there]
        if not present or (match == "simple" and len(present) < len(keys)):
            continue
        of_mask = refs
        for k, there in zip(keys, mask, strict=True):
            of_mask = of_mask.where(F.col(k).isNotNull() if there else F.col(k).isNull())
        if match == "full" and len(present) < len(keys):
            parts.append(of_mask.withColumn("reason", F.lit("missing")))
            continue
        known = targets.dropna(subset=present).groupBy(*present)
        if at is None:
            found = hot_safe_left_join(of_mask, known.agg(F.lit(1).alias("one")).drop("one"), present)
            reason = F.when(F.col("found").isNull(), "missing")
        else:
            gone = F.when(F.count("gone_at") == F.count(F.lit(1)), F.max("gone_at"))
            found = hot_safe_left_join(of_mask, known.agg(F.min("first_at").alias("first_at"), gone.alias("gone_at")), present)
            reason = _reason(at)
        parts.append(found.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(*refs.columns, "reason"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, own, strict=True) if c != "reason"], "reason")


def dated_orphans(refs: DataFrame, key: str, at: str, nodes: DataFrame) -> DataFrame:
    """``refs`` with a ``reason``, by the lifetimes of the rows of ``nodes`` (key, ord, ingested_at, deleted_at)."""
    return orphans(refs, [key], lifetimes(nodes, key), at=at)
