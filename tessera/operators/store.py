"""Graph store over two DataFrames: upserts, expansion, paths, PageRank, persistence."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.model import EDGE_SCHEMA, NODE_SCHEMA, Subgraph, validated_edges, validated_nodes
from tessera.operators import intask
from tessera.operators.hotkeys import for_salts, salts, with_salt
from tessera.workspace import Workspace

#: Rounds of an iteration that are planned together before the result is written.
CUT = 5
_NODE = ["id", "type", "label", "attrs", "ord"]
_EDGE = ["src", "dst", "type", "attrs", "ord"]


def last_wins(df: DataFrame, keys: list[str]) -> DataFrame:
    """The row of the highest ``ord`` per key, whole: attributes are replaced, not merged."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), "ord").alias("r")).select(*keys, "r.*").select(*df.columns)


def first_seen(df: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), "ord").alias("r")).select(*keys, "r.*").select(*df.columns)


class GraphStore:
    """Immutable: every upsert gives a new store.  An edge without both nodes is dropped."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes = nodes.select(*_NODE)
        self.edges = _linked(self.nodes, edges.select(*_EDGE))
        self._raw_edges = edges.select(*_EDGE)
        self._around: tuple[DataFrame, DataFrame] | None = None
        self._arrived: DataFrame | None = None

    @classmethod
    def from_arrivals(cls, nodes: DataFrame, edges: DataFrame) -> GraphStore:
        """The present graph of arrival logs: last row per key, deleted nodes gone."""
        deleted = F.col("deleted_at").isNotNull() if "deleted_at" in nodes.columns else F.lit(False)
        rows = nodes.withColumn("gone", deleted).select(*_NODE, "gone").where("id is not null")
        now = last_wins(rows, ["id"]).where("not gone").drop("gone")
        arrived = edges.select(*_EDGE).where("src is not null and dst is not null and type is not null")
        g = _trusted(now, last_wins(_linked(now, arrived), ["src", "dst", "type"]))
        g._raw_edges, g._arrived = last_wins(arrived, ["src", "dst", "type"]), arrived
        return g

    def upsert_nodes(self, new: DataFrame) -> GraphStore:
        return GraphStore(last_wins(self.nodes.unionByName(validated_nodes(new).select(*_NODE)), ["id"]), self._raw_edges)

    def upsert_edges(self, new: DataFrame) -> GraphStore:
        return GraphStore(self.nodes, last_wins(self._raw_edges.unionByName(validated_edges(new).select(*_EDGE)), ["src", "dst", "type"]))

    def stored(self) -> GraphStore:
        """The same graph over tables written to the shared folder: what reads it more than once then reads files."""
        ws = Workspace(self.nodes.sparkSession, "graph")
        nodes = ws.write(self.nodes)[1]
        edges = self.edges if self._arrived is None else last_wins(_linked(nodes, self._arrived), ["src", "dst", "type"])  # the nodes are not made once more
        return _trusted(nodes, ws.write(edges)[1])

    def bare(self) -> GraphStore:
        """The same graph, its edges without their attributes; those don't move then."""
        drop = lambda e: e.withColumn("attrs", F.lit(None).cast(e.schema["attrs"].dataType)).select(*_EDGE)
        if self._arrived is not None:
            g = _trusted(self.nodes, last_wins(_linked(self.nodes, drop(self._arrived)), ["src", "dst", "type"]))
            g._arrived = drop(self._arrived)
            g._raw_edges = last_wins(g._arrived, ["src", "dst", "type"])
            return g
        g = _trusted(self.nodes, drop(self.edges))
        g._raw_edges = drop(self._raw_edges)
        return g

    def with_edges(self, edges: DataFrame) -> GraphStore:
        """The same nodes with edges that are known to lie between them."""
        return _trusted(self.nodes, edges)

    # -- pruning and expansion ---------------------------------------------------------

    def pruned(self, no_nodes: Collection[str] = (), no_edges: Collection[str] = ()) -> GraphStore:
        """Exclusions come before traversal, so an excluded hub shortens no distance."""
        if not no_nodes and not no_edges:
            return self
        edges = self.edges.where(~F.col("type").isin(*no_edges)) if no_edges else self.edges
        if not no_nodes:
            return _trusted(self.nodes, edges)
        kept = F.coalesce(~F.col("type").isin(*no_nodes), F.lit(False))
        gone = Workspace(self.nodes.sparkSession, "pruned").write(self.nodes.where(~kept).select("id"))[1]
        for end in ("src", "dst"):  # all ends are nodes; those that go are few as a rule, so their table is broadcast and no edge moves
            edges = edges.join(gone.withColumnRenamed("id", end), end, "left_anti").select(*_EDGE)
        return _trusted(self.nodes.where(kept), edges)

    def adjacency(self) -> tuple[DataFrame, DataFrame]:
        """(id, to, salt) in both directions, and (id, n_salts) of the hubs; written once per store, in buckets, so that a step moves no arcs."""
        if self._around is None:
            ws = Workspace(self.nodes.sparkSession, "adjacency")
            both = self.edges.select(F.col("src").alias("id"), F.col("dst").alias("to")).unionByName(self.edges.select(F.col("dst").alias("id"), F.col("src").alias("to")))
            hubs = ws.write(salts(both, ["id"]))[1]
            self._around = ws.write_bucketed(with_salt(both, ["id"], hubs), ["id", "salt"], distinct=True), hubs
        return self._around

    def reach(self, seeds: DataFrame, hops: int) -> DataFrame:
        """(query_id, id, hop) within ``hops`` undirected steps of seeds (query_id, id); unknown seeds are skipped.

        The arcs of a hub are split over several tasks.
        """
        seen = seeds.select("query_id", "id").distinct().join(self.nodes.select("id"), "id", "left_semi").select("query_id", "id", F.lit(0).alias("hop"))
        if not hops:
            return seen
        around, hubs = self.adjacency()
        for h in range(1, hops + 1):
            step = for_salts(seen.where(F.col("hop") == h - 1), ["id"], hubs).join(around, ["id", "salt"]).select("query_id", F.col("to").alias("id"), F.lit(h).alias("hop"))
            seen = seen.unionByName(step).groupBy("query_id", "id").agg(F.min("hop").alias("hop"))
        return seen

    def reach_bits(self, seeds: DataFrame, hops: int, words: int) -> DataFrame:
        """(id, bits): which questions reach a node, of seeds (id, q) with q from 0 to ``64 * words - 1``; bit q % 64 of long q div 64."""
        ws, cols = Workspace(self.nodes.sparkSession, "bits"), [f"b{k}" for k in range(words)]
        own = [F.bit_or(F.expr(f"if(q div 64 = {k}, shiftleft(1L, q % 64), 0L)")).alias(c) for k, c in enumerate(cols)]
        at, near = ws.write(seeds.join(self.nodes.select("id"), "id", "left_semi").groupBy("id").agg(*own))
        around, hubs = self.adjacency() if hops else (None, None)
        for _ in range(hops):
            step = for_salts(near, ["id"], hubs).join(around, ["id", "salt"]).select(F.col("to").alias("id"), *cols)
            old = at
            at, near = ws.write(near.unionByName(step).groupBy("id").agg(*[F.bit_or(c).alias(c) for c in cols]))
            ws.drop(old)
        return near.select("id", F.array(*cols).alias("bits"))

    def subgraph(self, seeds: DataFrame, hops: int, no_nodes: Collection[str] = (), no_edges: Collection[str] = ()) -> Subgraph:
        """Nodes within reach and all edges of the pruned graph between them, also those on no path."""
        g = self.pruned(no_nodes, no_edges)
        r = Workspace(self.nodes.sparkSession, "reach").write(g.reach(seeds, hops))[1]
        ends = r.select("query_id", "id")
        out = ends.withColumnRenamed("id", "src").join(g.edges, "src")
        edges = out.join(ends.withColumnRenamed("id", "dst"), ["query_id", "dst"], "left_semi")
        return Subgraph(r.join(g.nodes, "id").select("query_id", "hop", *_NODE), edges.select("query_id", *_EDGE))

    def neighbors(self, node: str, hops: int = 1, no_nodes: Collection[str] = (), no_edges: Collection[str] = ()) -> Subgraph:
        seeds = self.nodes.sparkSession.createDataFrame([("q", node)], "query_id string, id string")
        return self.subgraph(seeds, hops, no_nodes, no_edges)

    def shortest_paths(self, pairs: DataFrame, max_hops: int | None = None, no_nodes: Collection[str] = (), no_edges: Collection[str] = ()) -> DataFrame:
        """(query_id, path) of the shortest directed path for pairs (query_id, src, dst).

        Of equally short paths the smallest by its ids in order; pairs without a path
        (of at most ``max_hops`` edges, if given) are missing; equal ends give a path of one.
        A graph that one task holds is searched there from both ends of a pair, until
        they meet or one has nothing new.  A larger one is searched backwards from each
        distinct ``dst`` until all its pairs are found or nothing new is met.
        """
        g = self.pruned(no_nodes, no_edges)
        ws = Workspace(self.nodes.sparkSession, "paths")
        pairs = pairs.select("query_id", "src", "dst").join(g.nodes.select(F.col("id").alias("src")), "src", "left_semi").join(g.nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
        pairs = ws.write(pairs.select("query_id", F.col("src").alias("id"), F.col("dst").alias("goal")))[1]
        arcs = ws.write(g.edges.select(F.col("src").alias("to"), F.col("dst").alias("id")).distinct())[1]
        if arcs.count() <= intask.IN_TASK:
            ends = pairs.select(F.col("id").alias("src"), F.col("goal").alias("dst"))
            found = intask.paths(ws, arcs.select(F.col("to").alias("src"), F.col("id").alias("dst")), intask.numbered(ws, g.nodes), ends.distinct(), max_hops)
            return pairs.join(found.select(F.col("src").alias("id"), F.col("dst").alias("goal"), "path"), ["id", "goal"]).select("query_id", "path")
        at, step = ws.write(pairs.select("goal", F.col("goal").alias("id"), F.array("goal").alias("path")).distinct())
        seen, known = [at], step
        while (max_hops is None or len(seen) <= max_hops) and not step.isEmpty():
            left = pairs.join(known.select("goal", "id"), ["goal", "id"], "left_anti").select("goal").distinct()
            front = step.join(left, "goal", "left_semi").join(arcs, "id").groupBy("goal", F.col("to").alias("id")).agg(F.min("path").alias("path"))
            front = front.join(known.select("goal", "id"), ["goal", "id"], "left_anti")
            at, step = ws.write(front.select("goal", "id", F.concat(F.array("id"), "path").alias("path")))
            seen.append(at)
            known = ws.read(seen, step.schema)
        return pairs.join(known, ["goal", "id"]).select("query_id", "path")

    # -- PageRank ----------------------------------------------------------------------

    def pagerank(self, iterations: int = 100, alpha: float = 0.85, tolerance: float | None = 1e-6) -> DataFrame:
        """(id, score) on the undirected, unpruned graph; scores sum to one.

        The weight between two nodes is the number of distinct edge types between
        them in either direction.  Isolated nodes all have one score, a number on
        the driver, and spread their mass evenly.  Without a tolerance all
        iterations run.

        The arcs are written once, bucketed by their start, those of a hub over
        several buckets; a round moves the scores to them and the contributions
        back, and never the arcs.
        """
        spark = self.nodes.sparkSession
        ws = Workspace(spark, "pagerank")
        both = self.edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), "type").unionByName(self.edges.select(F.col("dst").alias("u"), F.col("src").alias("v"), "type"))
        weights = ws.write(both.distinct().groupBy("u", "v").agg(F.count(F.lit(1)).cast("double").alias("w")))[1]
        degree = ws.write(weights.groupBy("u").agg(F.sum("w").alias("d")))[1]
        hubs = ws.write(salts(weights, ["u"]))[1]
        shares = with_salt(weights, ["u"], hubs).join(for_salts(degree, ["u"], hubs), ["u", "salt"])
        arcs = ws.write_bucketed(shares.select("u", "salt", "v", (F.col("w") / F.col("d")).alias("share")), ["u", "salt"])
        n, linked = self.nodes.count(), degree.count()
        if not n:
            return self.nodes.select("id", F.lit(0.0).alias("score"))
        rank, alone, path = degree.select(F.col("u").alias("id"), F.lit(1.0 / n).alias("score")), 1.0 / n, None
        for i in range(1, iterations + 1):
            base = (1 - alpha) / n + alpha * (n - linked) * alone / n
            given = for_salts(rank.select(F.col("id").alias("u"), "score"), ["u"], hubs).join(arcs, ["u", "salt"])
            new = given.groupBy(F.col("v").alias("id")).agg((F.lit(base) + F.lit(alpha) * F.sum(F.col("score") * F.col("share"))).alias("score"))
            moved, alone, old = abs(base - alone) * (n - linked), base, rank
            rank = new
            if tolerance is None and i % CUT and i < iterations:
                continue
            at, rank = ws.write(new)
            if tolerance is not None:
                change = rank.join(old.withColumnRenamed("score", "old"), "id").agg(F.sum(F.abs(F.col("score") - F.col("old")))).first()[0] or 0.0
                if change + moved < n * tolerance:
                    break
            if path:
                ws.drop(path)
            path = at
        return self.nodes.select("id").join(rank, "id", "left").select("id", F.coalesce("score", F.lit(alone)).alias("score"))

    # -- persistence -------------------------------------------------------------------

    def save(self, path: str) -> None:
        self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        self.edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> GraphStore:
        return cls(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))

    @classmethod
    def load_json(cls, spark: SparkSession, path: str) -> GraphStore:
        """One JSON object {"nodes": […], "edges": […]}; ``ord`` is the place in the list."""
        n = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in NODE_SCHEMA if f.name != "ord")
        e = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in EDGE_SCHEMA if f.name != "ord")
        doc = spark.read.option("multiLine", True).schema(f"nodes array<struct<{n}>>, edges array<struct<{e}>>").json(path)
        nodes = doc.select(F.posexplode("nodes").alias("ord", "x")).select("x.*", F.col("ord").cast("bigint").alias("ord"))
        edges = doc.select(F.posexplode("edges").alias("ord", "x")).select("x.*", F.col("ord").cast("bigint").alias("ord"))
        return cls(nodes, edges)

    def save_json(self, path: str) -> None:
        """One JSON object {"nodes": […], "edges": […]} by arrival, as ``load_json`` reads it.

        A single document is written by the driver, row by row from a sorted stream of
        partitions; a large graph exports as JSON lines instead.
        """
        import json

        def rows(df: DataFrame, *names: str):
            for r in df.select("ord", F.to_json(F.struct(*names)).alias("j")).orderBy("ord", "j").select("j").toLocalIterator():
                yield r.j

        with open(path, "w", encoding="utf-8") as out:
            for key, df, names in (("nodes", self.nodes, ("id", "type", "label", "attrs")), ("edges", self.edges, ("src", "dst", "type", "attrs"))):
                out.write(("{" if key == "nodes" else ",") + json.dumps(key) + ": [")
                for i, j in enumerate(rows(df, *names)):
                    out.write((",\n" if i else "\n") + j)
                out.write("]")
            out.write("}\n")

    def views(self, prefix: str = "") -> None:
        """Temporary views ``nodes`` and ``edges`` of the present graph, for SQL."""
        self.nodes.createOrReplaceTempView(f"{prefix}nodes")
        self.edges.createOrReplaceTempView(f"{prefix}edges")

    def save_json_lines(self, path: str) -> None:
        """Nodes and edges as JSON lines in two folders: what a large graph exports as."""
        self.nodes.write.mode("overwrite").json(f"{path}/nodes")
        self.edges.write.mode("overwrite").json(f"{path}/edges")


def _linked(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges whose two ends are nodes; the rows of a hub are split by the adaptive skew join, which may split a semi-join's left side."""
    live = nodes.select("id")
    return edges.join(live.withColumnRenamed("id", "src"), "src", "left_semi").join(live.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def _trusted(nodes: DataFrame, edges: DataFrame) -> GraphStore:
    g = GraphStore.__new__(GraphStore)
    g.nodes, g.edges, g._raw_edges, g._around, g._arrived = nodes, edges, edges, None, None
    return g
