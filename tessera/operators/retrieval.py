"""Retrieval arms: every arm turns (query_id, query, budget) into ranked segments.

Segments are (query_id, mode, rank, text, source, score, cost, running_tokens).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import named_entities, token_estimate
from tessera.model import OVERLAY_EDGES, OVERLAY_NODES, Subgraph
from tessera.operators import held, intask
from tessera.operators.balls import BLOCK, Ball
from tessera.operators.similarity import bags, nearest
from tessera.operators.store import GraphStore
from tessera.workspace import Workspace, shuffle_partitions

RRF_K = 60
POOL_BUDGET = 50_000
#: Segments made at first for a question: some, and one for so many tokens of its budget.
FIRST, FIRST_COST = 64, 8
#: Pairs of a question and a node that are shipped to all tasks: a block of questions of 1500 tokens has so many.
FEW = 1 << 18

#: Attributes as text, by key.
SHOWN = "array_join(transform(array_sort(map_entries(attrs)), e -> e.key || ': ' || e.value), '; ')"

Cost = Callable[[Column], Column]


def pack(segments: DataFrame, mode: str, cost: Cost = token_estimate, order: list[Column] | None = None) -> DataFrame:
    """The ordered prefix that fits ``budget``; the first segment always stays.

    Costs are never negative, so the running sum grows and "stop at the first
    overflow" is a plain filter on it.
    """
    order = order or [F.col("score").desc(), F.col("source")]
    w = Window.partitionBy("query_id").orderBy(*order)
    ranked = segments.withColumn("cost", cost(F.col("text"))).withColumn("rank", F.row_number().over(w))
    ranked = ranked.withColumn("running_tokens", F.sum("cost").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kept = ranked.where((F.col("rank") == 1) | (F.col("running_tokens") <= F.col("budget")))
    return kept.select("query_id", F.lit(mode).alias("mode"), "rank", "text", "source", "score", "cost", "running_tokens")


def relation_text(sub: Subgraph) -> DataFrame:
    """(query_id, id, rels): outgoing edges inside the subgraph as "type target; …" by arrival."""
    labels = sub.nodes.select("query_id", F.col("id").alias("dst"), F.col("label").alias("to"))
    rows = sub.edges.join(labels, ["query_id", "dst"], "left").select("query_id", "src", "ord", F.concat_ws(" ", "type", F.coalesce("to", "dst")).alias("rel"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "rel"))), lambda x: x["rel"])
    return rows.groupBy("query_id", F.col("src").alias("id")).agg(F.array_join(parts, "; ").alias("rels"))


def node_text(attrs: bool) -> Column:
    """``label — rels``, with attributes ``— k: v; …`` by key if asked for."""
    more = F.nullif(F.expr(SHOWN), F.lit("")) if attrs else F.lit(None).cast("string")
    return F.concat_ws(" — ", "label", F.nullif("rels", F.lit("")), more)


class Retriever:
    """Arms over one graph and, for the vector arm, documents (label, text, ord)."""

    def __init__(self, store: GraphStore, documents: DataFrame | None = None, hops: int = 2, anchors: int = 3):
        self.store, self.documents, self.hops, self.anchors = store, documents, hops, anchors
        self._labels: DataFrame | None = None
        self._texts: DataFrame | None = None
        self._bags: DataFrame | None = None
        self._open: GraphStore | None = None
        self._arcs: int | None = None

    def label_bags(self) -> DataFrame:
        if self._labels is None:
            nodes = self.store.nodes.select(F.col("id").alias("key"), "label")
            self._labels = bags(nodes.repartition(shuffle_partitions(nodes.sparkSession), "key"), "key", "label")  # the labels move once, and no bag does
        return self._labels

    def asked(self, queries: DataFrame) -> DataFrame:
        return bags(queries.select("query_id", "query"), "query_id", "query")

    def _best_nodes(self, queries: DataFrame, k: int, overlay: bool) -> DataFrame:
        """(query_id, id, score, rank): the nodes whose label is most like the query, ties by arrival."""
        nodes = self.store.nodes if overlay else self.store.nodes.where(~F.col("type").isin(*OVERLAY_NODES))
        tie = nodes.select(F.col("id").alias("key"), "ord")
        if self._held():
            return held.nearest(Workspace(nodes.sparkSession, "nearest"), self.asked(queries), self._stored_bags(), k, tie).withColumnRenamed("key", "id")
        return nearest(self.asked(queries), self._stored_bags(), k, tie, stored=True).withColumnRenamed("key", "id")

    def _held(self) -> bool:
        """Whether one task holds the graph."""
        if self._arcs is None:
            self._arcs = self._open_graph().edges.count()
        return self._arcs <= intask.IN_TASK

    def _expanded(self, queries: DataFrame, seeds: DataFrame, mode: str, attrs: bool, pagerank: DataFrame | None, weight: float, cost: Cost) -> DataFrame:
        """Segments of what the seeds reach; their source is the node's id, which also orders equal scores."""
        return self._expanded_once(queries, seeds, mode, [attrs], pagerank, weight, cost)[0]

    def _expanded_once(self, queries: DataFrame, seeds: DataFrame, mode: str, attrs: list[bool], pagerank: DataFrame | None, weight: float, cost: Cost) -> list[DataFrame]:
        """The same for each of ``attrs``: they change the text alone, so all are made of the same nodes."""
        spark = self.store.nodes.sparkSession
        ws = Workspace(spark, "expanded")
        g = self._open_graph()
        asked, index = ws.write(self.asked(queries))[1], self._stored_bags()
        place = F.row_number().over(Window.orderBy("query_id")) - 1
        names = ws.write(queries.select("query_id", "budget").withColumn("n", place.cast("int")))[1]
        seeds = ws.write(seeds.select("query_id", "id").distinct().join(names.select("query_id", "n"), "query_id"))[1]
        if pagerank is not None:
            best = pagerank.agg(F.max("score").alias("m")).scalar()
            pagerank = pagerank.select("id", F.round(F.col("score") / best, 9).alias("pr"))
        if cost is token_estimate and self._held():
            found = held.segments(ws, g.nodes, g.edges, index, asked, names, seeds, self.hops, attrs, SHOWN, pagerank, weight, FIRST, FIRST_COST)
            if len(attrs) > 1:
                found = ws.write(found)[1]
            found = found.join(F.broadcast(names.select("query_id", F.col("n").alias("q"))), "q")
            out = ["query_id", F.lit(mode).alias("mode"), "rank", "text", "source", "score", "cost", "running_tokens"]
            return [found.where(F.col("v") == k).select(*out) for k in range(len(attrs))]
        count = names.count()
        texts = [f"text{k}" for k in range(len(attrs))]
        found = [names.select("query_id", *[F.lit("").alias(t) for t in texts], F.lit("").alias("source"), F.lit(0.0).alias("score"), "budget").limit(0)]
        for b in range(0, count, BLOCK):
            own = names.where(F.col("n").between(b, b + BLOCK - 1)).select("query_id", "budget", (F.col("n") - b).alias("q"))
            roots = seeds.where(F.col("n").between(b, b + BLOCK - 1)).select("id", (F.col("n") - b).alias("q"))
            ball = Ball(ws, g.nodes, g.reach_bits(roots, self.hops, -(-min(BLOCK, count - b) // 64)), pagerank, weight)
            found += self._packable(ws, ball, own, roots, asked.join(F.broadcast(own), "query_id"), index, g, attrs, cost)
            ball.drop()
        segments = found[0]
        for x in found[1:]:
            segments = segments.unionByName(x)
        return [pack(segments.withColumnRenamed(t, "text").select("query_id", "text", "source", "score", "budget"), mode, cost) for t in texts]

    def _packable(self, ws: Workspace, ball: Ball, own: DataFrame, seeds: DataFrame, asked: DataFrame, index: DataFrame, g: GraphStore, attrs: list[bool], cost: Cost) -> list[DataFrame]:
        """The best segments of each question, as many as its budget takes and one more at least, or all.

        As many as seem enough are made; a question whose segments end before its
        budget does is asked again for four times as many.
        """
        texts = [f"text{k}" for k in range(len(attrs))]
        m, parts, open_ = FIRST + own.agg(F.max("budget")).first()[0] // FIRST_COST, [], own
        while True:
            at, pairs = ws.write(ball.best(open_, m, asked, index, seeds))
            kept = F.transform(F.filter("out", lambda x: F.getbit(x["bits"][(F.col("q") / 64).cast("int")], F.col("q") % 64) == 1), lambda x: x["rel"])
            few = pairs.count() <= FEW  # then neither the nodes nor the edges are moved to them
            x = g.nodes.select("id", "label", "attrs").join(F.broadcast(pairs) if few else pairs, "id")
            x = x.join(ball.relations(pairs, g.edges, few), "id", "left").withColumn("rels", F.array_join(kept, "; "))
            segments = x.join(F.broadcast(open_), "q").select("q", "query_id", *[node_text(a).alias(t) for a, t in zip(attrs, texts)], F.col("id").alias("source"), "score", "budget")
            segments = ws.write(segments)[1]
            ws.drop(at)
            fewest = F.array_min(F.array(*[F.sum(cost(F.col(t))) for t in texts]))
            made = segments.groupBy("q").agg(F.count(F.lit(1)).alias("made"), fewest.alias("tokens"), F.max("budget").alias("most"))
            short = ws.write(made.where((F.col("made") >= m) & (F.col("tokens") <= F.col("most"))).select("q"))[1]
            parts.append(segments.join(F.broadcast(short), "q", "left_anti").drop("q"))
            if short.isEmpty():
                return parts
            open_, m = own.join(short, "q", "left_semi"), m * 4

    def _open_graph(self) -> GraphStore:
        """The graph without overlay, its edges written without their attributes."""
        if self._open is None:
            g = self.store.pruned(OVERLAY_NODES, OVERLAY_EDGES)
            self._open = g.with_edges(Workspace(g.nodes.sparkSession, "open").write(g.edges.withColumn("attrs", F.lit(None).cast(g.edges.schema["attrs"].dataType)))[1])
        return self._open

    def _stored_bags(self) -> DataFrame:
        if self._bags is None:
            ws = Workspace(self.store.nodes.sparkSession, "bags")
            self._bags = ws.write_bucketed(self.label_bags(), ["key"], placed=True)
            self._labels = self._bags
        return self._bags

    def vector(self, queries: DataFrame, k: int = 5, cost: Cost = token_estimate) -> DataFrame:
        """Documents by the cosine of their whole text."""
        docs = self.documents.select(F.col("ord").alias("key"), "label", "text")
        if self._texts is None:
            ws, n = Workspace(docs.sparkSession, "texts"), shuffle_partitions(docs.sparkSession)
            self._texts = ws.write_bucketed(bags(docs.select("key", "text").repartition(n, "key"), "key", "text"), ["key"], placed=True)
        best = nearest(self.asked(queries), self._texts, k, stored=True).join(docs, "key")
        segments = best.select("query_id", "text", F.col("label").alias("source"), "score", F.col("rank").alias("found"))
        return pack(segments.join(queries.select("query_id", "budget"), "query_id"), "vector", cost, [F.col("found")])

    def seeds(self, queries: DataFrame) -> DataFrame:
        return self._best_nodes(queries, self.anchors, overlay=True).select("query_id", "id")

    def graph(self, queries: DataFrame, attrs: bool = False, pagerank: DataFrame | None = None, weight: float = 0.5, cost: Cost = token_estimate) -> DataFrame:
        """Anchors by label, expanded; PageRank (id, score) blends into the score if given."""
        return self._expanded(queries, self.seeds(queries), "graph", attrs, pagerank, weight, cost)

    def graph_attrs(self, queries: DataFrame, cost: Cost = token_estimate) -> tuple[DataFrame, DataFrame]:
        """The graph arm without and with attributes, of one expansion."""
        plain, shown = self._expanded_once(queries, self.seeds(queries), "graph", [False, True], None, 0.0, cost)
        return plain, shown

    def hybrid(self, queries: DataFrame, k: int = 5, cost: Cost = token_estimate) -> DataFrame:
        """Reciprocal rank fusion of the graph and the vector arm, by lower-case source."""
        return fuse([self.graph(queries, cost=cost), self.vector(queries, k, cost)], queries, cost)

    def entity_seeds(self, queries: DataFrame) -> DataFrame:
        """Best node per entity that the query names; filled up by the query's own best nodes."""
        entities = queries.select("query_id", F.posexplode(named_entities("query")).alias("n", "entity"))
        sub = entities.select(F.concat_ws("#", "query_id", "n").alias("query_id"), F.col("query_id").alias("of"), F.col("entity").alias("query"))
        one = self._best_nodes(sub, 1, overlay=False).join(sub.select("query_id", "of"), "query_id").select(F.col("of").alias("query_id"), "id").distinct()
        few = queries.select("query_id").join(one.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")), "query_id", "left").where(F.coalesce("n", F.lit(0)) < self.anchors)
        fill = self._best_nodes(queries.join(few.select("query_id"), "query_id", "left_semi"), self.anchors, overlay=False).select("query_id", "id")
        return one.unionByName(fill).distinct()

    def multi_anchor(self, queries: DataFrame, cost: Cost = token_estimate) -> DataFrame:
        return self._expanded(queries, self.entity_seeds(queries), "graph", False, None, 0.0, cost)

    def path(self, queries: DataFrame, max_hops: int | None = None, cost: Cost = token_estimate) -> DataFrame:
        """The directed shortest path between the two best nodes; without one, both nodes."""
        two = self._best_nodes(queries, 2, overlay=False)
        pairs = two.groupBy("query_id").agg(F.min_by("id", "rank").alias("src"), F.max_by("id", "rank").alias("dst"))
        found = self.store.shortest_paths(pairs, max_hops, OVERLAY_NODES, OVERLAY_EDGES)
        walk = pairs.join(found, "query_id", "left").select(
            "query_id", F.col("path").isNotNull().alias("linked"), F.coalesce("path", F.array_distinct(F.array("src", "dst"))).alias("path")
        )
        last = F.size("path") - 1
        steps = walk.select("query_id", "linked", last.alias("last"), "path", F.posexplode("path").alias("pos", "id"))
        steps = steps.withColumn("next", F.when(F.col("linked"), F.try_element_at("path", F.col("pos") + 2))).drop("path")
        rel = self.store.pruned(OVERLAY_NODES, OVERLAY_EDGES).edges.groupBy(F.col("src").alias("id"), F.col("dst").alias("next")).agg(F.max_by("type", "ord").alias("rel"))
        x = steps.join(rel, ["id", "next"], "left").join(self.store.nodes.select("id", "label"), "id", "left")
        name = F.coalesce("label", "id")
        text = F.when(F.col("next").isNull(), name).otherwise(F.concat(name, F.lit(" —["), F.coalesce("rel", F.lit("→")), F.lit("]→")))
        ends = (F.col("pos") == 0) | (F.col("pos") == F.col("last"))
        segments = x.select("query_id", text.alias("text"), F.col("id").alias("source"), F.when(ends, 1.0).otherwise(0.7).alias("score"), "pos")
        return pack(segments.join(queries.select("query_id", "budget"), "query_id"), "graph", cost, [F.col("pos")])

    def community(self, queries: DataFrame, summaries: DataFrame, top_k: int = 5, cost: Cost = token_estimate) -> DataFrame:
        """Summaries (id, summary, ord) by the cosine of their text."""
        s = summaries.select(F.col("id").alias("key"), F.col("summary").alias("text"), "ord")
        best = nearest(self.asked(queries), bags(s, "key", "text"), top_k, s.select("key", "ord")).join(s.select("key", "text"), "key")
        segments = best.select("query_id", "text", F.col("key").alias("source"), "score")
        return pack(segments.join(queries.select("query_id", "budget"), "query_id"), "community", cost)


def fuse(arms: list[DataFrame], queries: DataFrame, cost: Cost = token_estimate) -> DataFrame:
    """Reciprocal rank fusion; text and source of the first arm that has it."""
    tagged = [a.select("query_id", F.lit(i).alias("arm"), "rank", "text", "source") for i, a in enumerate(arms)]
    rows = tagged[0]
    for t in tagged[1:]:
        rows = rows.unionByName(t)
    fused = rows.groupBy("query_id", F.lower("source").alias("k")).agg(
        F.sum(F.lit(1.0) / (RRF_K + F.col("rank"))).alias("score"), F.min_by(F.struct("text", "source"), F.struct("arm", "rank")).alias("first")
    )
    segments = fused.select("query_id", "first.text", "first.source", F.round("score", 12).alias("score"))
    return pack(segments.join(queries.select("query_id", "budget"), "query_id"), "hybrid", cost)


def jaccard(query: Column, text: Column) -> Column:
    """Word overlap, the default reranker."""
    from tessera.functions.text import terms

    a, b = F.array_distinct(terms(query)), F.array_distinct(terms(text))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0)).cast("double")


def rerank(segments: DataFrame, queries: DataFrame, k: int = 5, model: Callable[[Column, Column], Column] = jaccard, cost: Cost = token_estimate) -> DataFrame:
    """Segments of a wide pool by the model's score alone, cut to ``k``, then packed."""
    x = segments.select("query_id", "text", "source", "rank").join(queries.select("query_id", "query", "budget"), "query_id")
    scored = x.withColumn("score", model(F.col("query"), F.col("text")))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "rank")
    best = scored.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    return pack(best.drop("rank", "query"), "reranked", cost, [F.col("place")])
