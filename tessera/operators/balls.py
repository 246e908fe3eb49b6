"""What many questions reach, as bits beside each node, and the best of it.

Seeds that touch a hub reach most of the graph within two steps, so rows of
(question, node) grow with their product.  Here a node holds one bit per
question (of a block of at most ``BLOCK``), a step along the arcs is a bitwise
OR, and pairs are made of the nodes alone that can be among the best.

Scores are ``base + factor * similarity``: the base belongs to the node, and few
nodes have a similarity to a question.  With the nodes in order of (base, id),
the best ``m`` of a question are among its first ``m`` nodes in that order and
its best ``m`` similar ones.  All of it is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.workspace import Workspace, shuffle_partitions

BLOCK = 1024
#: Nodes whose bits are packed into one row.
SLICE = 4096


def has(bits: str = "bits", q: str = "q") -> Column:
    """Whether question ``q`` is among the bits."""
    return F.expr(f"getbit({bits}[cast({q} div 64 as int)], {q} % 64) = 1")


def _packed(parts: Iterator):
    import numpy as np
    import pandas as pd
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 32
    for p in parts:
        for at in range(0, len(p), SLICE):
            x = p.iloc[at : at + SLICE]
            bits = np.ascontiguousarray(np.vstack(x["bits"].to_list()).astype("<i8")).view(np.uint8)
            counts = np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            yield pd.DataFrame({"block": [block], "ids": [x["id"].to_list()], "base": [x["base"].to_numpy()], "bits": [bits.tobytes()], "counts": [counts]})
            block += 1


def _first(parts: Iterator):
    import numpy as np
    import pandas as pd

    for p in parts:
        for ids, base, bits, qs, most in zip(p["ids"], p["base"], p["bits"], p["qs"], p["most"]):
            ids, base = np.asarray(ids, dtype=object), np.asarray(base)
            m = np.frombuffer(bits, np.uint8).reshape(len(ids), -1)
            for q, n in zip(qs, most):
                at = np.flatnonzero((m[:, q >> 3] >> (q & 7)) & 1)[:n]
                yield pd.DataFrame({"q": np.full(len(at), q, np.int32), "id": ids[at], "score": base[at]})


class Ball:
    """(id, label, base, bits): nodes of a graph with the questions that reach them."""

    def __init__(self, ws: Workspace, nodes: DataFrame, bits: DataFrame, pagerank: DataFrame | None, weight: float):
        x = bits.join(nodes.select("id", "label"), "id")
        if pagerank is not None:
            x = x.join(pagerank, "id", "left")
        base = F.lit(0.0) if pagerank is None else F.lit(weight) * F.coalesce("pr", F.lit(0.0))
        self.ws, self.factor = ws, 1.0 if pagerank is None else 1 - weight
        at_nodes, self.nodes = ws.write(x.select("id", "label", base.alias("base"), "bits"))
        order = [F.col("base").desc(), F.col("id")]
        rows = self.nodes.select("id", "base", "bits").repartitionByRange(shuffle_partitions(ws.spark), *order).sortWithinPartitions(*order)
        at_blocks, self.blocks = ws.write(rows.mapInPandas(_packed, "block bigint, ids array<string>, base array<double>, bits binary, counts array<bigint>"))
        self._at = at_nodes, at_blocks

    def drop(self) -> None:
        """Removes its tables, when what was asked of it is written."""
        for at in self._at:
            self.ws.drop(at)

    def first(self, open_: DataFrame, m: int) -> DataFrame:
        """(q, id, score): the first ``m`` nodes of each open question by (base, id); the score is the base."""
        n = self.blocks.select("block", F.posexplode("counts").alias("q", "n")).where("n > 0").join(F.broadcast(open_.select("q")), "q")
        before = F.sum("n").over(Window.partitionBy("q").orderBy("block")) - F.col("n")
        need = n.withColumn("most", F.lit(m) - before).where("most > 0").groupBy("block").agg(F.collect_list(F.struct("q", F.col("most").cast("int").alias("most"))).alias("x"))
        rows = self.blocks.drop("counts").join(need.select("block", F.col("x.q").alias("qs"), F.col("x.most").alias("most")), "block")
        return rows.mapInPandas(_first, "q int, id string, score double")

    def similar(self, open_: DataFrame, asked: DataFrame, index: DataFrame) -> DataFrame:
        """(q, id, score) of all nodes of a ball that share a word with their question; bags (q, bucket, c, norm) and (key, bucket, c, norm).

        The index is stored in buckets of its keys and everything is grouped by node, so neither it nor the pairs are moved.
        """
        q = F.broadcast(asked.join(F.broadcast(open_.select("q")), "q").select("q", "bucket", F.col("c").alias("qc"), F.col("norm").alias("qn")))
        i = index.select(F.col("key").alias("id"), "bucket", "c", "norm").join(self.nodes.select("id", "base", "bits"), "id")
        dots = i.join(q, "bucket").where(has()).groupBy("id", "q", "qn", "norm", "base").agg(F.sum(F.col("qc") * F.col("c")).alias("dot"))
        score = F.lit(self.factor) * (F.col("dot") / F.sqrt((F.col("qn") * F.col("norm")).cast("double"))) + F.col("base")
        return dots.select("q", "id", score.alias("score"))

    def best(self, open_: DataFrame, m: int, asked: DataFrame, index: DataFrame, seeds: DataFrame) -> DataFrame:
        """(q, id, score): the best ``m`` of each open question by (score, id); seeds (q, id) score 1."""
        w = Window.partitionBy("q").orderBy(F.col("score").desc(), "id")
        similar = self.similar(open_, asked, index).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= m).drop("rank")
        own = seeds.join(F.broadcast(open_.select("q")), "q").join(self.nodes.select("id"), "id", "left_semi").select("q", "id", F.lit(1.0).alias("score"))
        pairs = self.first(open_, m).unionByName(similar).unionByName(own).groupBy("q", "id").agg(F.max("score").alias("score"))
        return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= m).drop("rank")

    def relations(self, pairs: DataFrame, edges: DataFrame, few: bool = False) -> DataFrame:
        """(id, out): of the nodes in ``pairs`` their outgoing edges by arrival, as (ord, rel, bits of the target); few pairs are shipped to the edges."""
        ids = pairs.select(F.col("id").alias("src")).distinct()
        to = self.nodes.select(F.col("id").alias("dst"), F.coalesce("label", "id").alias("to"), "bits")
        e = edges.select("src", "dst", "type", "ord").join(F.broadcast(ids) if few else ids, "src", "left_semi").join(to, "dst")
        rel = F.struct("ord", F.concat_ws(" ", "type", "to").alias("rel"), "bits")
        return e.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(rel)).alias("out"))
