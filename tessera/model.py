"""Data model: closed type sets, schemas, validation at the boundary."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The closed sets of the data model.
NODE_TYPES = ("file", "module", "class", "function", "entity", "concept", "section", "community")
EDGE_TYPES = (
    "defines", "imports", "calls", "inherits", "references",
    "relates_to", "mentions", "requires", "resists", "immune_to", "vulnerable_to", "inhabits", "summons",
    "contains",
)
STRUCTURAL_EDGES = EDGE_TYPES[:5]
#: What retrieval leaves out unless told otherwise: the community overlay.
OVERLAY_NODES, OVERLAY_EDGES = ("community",), ("contains",)

_ATTRS = T.MapType(T.StringType(), T.StringType())
NODE_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType(), False) for c in ("id", "type", "label")] + [T.StructField("attrs", _ATTRS), T.StructField("ord", T.LongType())]
)
EDGE_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType(), False) for c in ("src", "dst", "type")] + [T.StructField("attrs", _ATTRS), T.StructField("ord", T.LongType())]
)


class Subgraph(NamedTuple):
    """Nodes and directed edges, keyed by ``query_id``."""

    nodes: DataFrame
    edges: DataFrame


def _checked(df: DataFrame, column: str, allowed: tuple[str, ...]) -> Column:
    bad = F.raise_error(F.concat(F.lit(f"unknown {column}: "), F.coalesce(F.col(column), F.lit("null")))).cast("string")
    return F.when(F.col(column).isin(*allowed), F.col(column)).otherwise(bad)


def validated_nodes(df: DataFrame) -> DataFrame:
    """Rows as they are; reading one with an unknown node type fails."""
    return df.withColumn("type", _checked(df, "type", NODE_TYPES))


def validated_edges(df: DataFrame) -> DataFrame:
    return df.withColumn("type", _checked(df, "type", EDGE_TYPES))
