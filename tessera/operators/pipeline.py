"""From sources to graphs and answers: the entry points that tie operators together."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.ports import TextModel, complete
from tessera.functions.text import token_estimate
from tessera.operators.community import extractive_summaries, louvain, named, overlay
from tessera.operators.evaluation import generation_cost, prompt_context
from tessera.operators.code import code_facts, code_graph
from tessera.operators.extraction import merge_relations, note_graph
from tessera.operators.retrieval import Retriever
from tessera.operators.store import GraphStore
from tessera.sources.files import source_tree, text_files

EXTRACTED = "entities array<struct<name: string, kind: string, attrs: map<string,string>>>, relations array<struct<subject: string, predicate: string, object: string>>"
# What extracted kinds become.
KINDS = {"creature": "entity", "person": "entity", "project": "entity", "concept": "concept", "source": "concept", "note": "section"}
SYSTEM = "List the entities and relations that the text states, as one JSON object with the keys entities and relations."


def extract_chunks(chunks: DataFrame, factory: Callable[[], TextModel], keep: Column | None = None, system: str = SYSTEM) -> tuple[GraphStore, DataFrame, DataFrame]:
    """(store, usage, errors) of chunks (chunk_no, text) read by a model.

    A chunk that fails gives neither results nor usage; it is listed in the errors.
    """
    todo = chunks.where(keep) if keep is not None else chunks
    read = complete(todo.select("chunk_no", "text"), system, "text", factory, json_only=True)
    read = read.withColumn("x", F.from_json("answer", EXTRACTED)).persist()
    bad = read.where(F.col("error").isNotNull() | F.col("x.relations").isNull() & F.col("x.entities").isNull())
    good = read.join(bad.select("chunk_no"), "chunk_no", "left_anti")
    kinds = F.create_map(*[F.lit(v) for kv in KINDS.items() for v in kv])
    place = lambda i: (F.col("chunk_no") * 100_000 + i).cast("bigint")
    ents = good.select("chunk_no", F.posexplode("x.entities").alias("i", "e")).select(
        place(F.col("i")).alias("ord"), F.col("e.name").alias("surface"), F.coalesce(kinds[F.lower("e.kind")], F.lit("concept")).alias("type"),
        F.map_filter(F.coalesce("e.attrs", F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull()).alias("attrs"),
    )
    rels = good.select("chunk_no", F.posexplode("x.relations").alias("i", "r")).select(place(F.col("i")).alias("ord"), "r.subject", "r.predicate", "r.object")
    nodes, edges = merge_relations(rels, ents)
    return GraphStore(nodes, edges), extraction_cost(good), bad.select("chunk_no", F.coalesce("error", F.lit("no entities or relations")).alias("error"))


def extraction_cost(read: DataFrame) -> DataFrame:
    """One row: chunks, tokens, dollars."""
    tin, tout = F.coalesce(F.sum("input_tokens"), F.lit(0)), F.coalesce(F.sum("output_tokens"), F.lit(0))
    return read.agg(F.count(F.lit(1)).alias("chunks"), tin.alias("input_tokens"), tout.alias("output_tokens"), F.round(generation_cost(tin, tout), 4).alias("cost_usd"))


def build_vault(spark: SparkSession, root: str) -> GraphStore:
    """The graph of a folder of notes; later files (by path) win."""
    notes = text_files(spark, root, "*.md").select(F.col("stem").alias("id"), "text", "path")
    nodes, edges = note_graph(notes, "id")
    return GraphStore(nodes, edges.dropDuplicates(["src", "dst", "type"]))


def build_code(spark: SparkSession, root: str) -> GraphStore:
    return GraphStore(*code_graph(code_facts(source_tree(spark, root))))


def add_communities(store: GraphStore) -> GraphStore:
    """The store with its community overlay and extractive summaries."""
    c = named(louvain(store))
    n, e = overlay(c, extractive_summaries(c, store.nodes.select("id", F.col("label").alias("text"))))
    return store.upsert_nodes(n).upsert_edges(e)


def totals(store: GraphStore) -> DataFrame:
    """One row: nodes and edges."""
    return store.nodes.agg(F.count(F.lit(1)).alias("nodes")).withColumn("edges", store.edges.agg(F.count(F.lit(1))).scalar())


class GraphContext:
    """Facade for one question at a time over a saved or given graph."""

    def __init__(self, store: GraphStore, hops: int = 2, anchors: int = 3):
        self.spark = store.nodes.sparkSession
        self.retriever = Retriever(store, hops=hops, anchors=anchors)

    @classmethod
    def load(cls, spark: SparkSession, path: str, hops: int = 2, anchors: int = 3) -> GraphContext:
        store = GraphStore.load_json(spark, path) if path.endswith(".json") else GraphStore.load(spark, path)
        return cls(store, hops, anchors)

    def retrieve(self, question: str, token_budget: int = 1000) -> DataFrame:
        q = self.spark.createDataFrame([("q", question, token_budget)], "query_id string, query string, budget int")
        return self.retriever.graph(q)


def sweep(retriever: Retriever, queries: DataFrame, ks: Sequence[int] = (2, 3, 5, 8)) -> DataFrame:
    """Vector segments for every k, with a column ``k``."""
    out = None
    for k in ks:
        part = retriever.vector(queries, k).withColumn("k", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out


def answers(segments: DataFrame, queries: DataFrame, factory: Callable[[], TextModel], arm: str, system: str = "Answer from the context only.") -> DataFrame:
    """(arm, case_id, answer, contexts, input_tokens, output_tokens, latency_ms, error): one generated answer per question."""
    ctx = segments.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]).alias("contexts"))
    asked = queries.select("query_id", "query").join(ctx, "query_id", "left").withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))
    prompt = F.concat_ws("\n\n", prompt_context(), F.concat(F.lit("Question: "), "query"))
    out = complete(asked.withColumn("prompt", prompt), system, "prompt", factory)
    return out.select(F.lit(arm).alias("arm"), F.col("query_id").alias("case_id"), "answer", "contexts", "input_tokens", "output_tokens", "latency_ms", "error")


def judged(responses: DataFrame, queries: DataFrame, factory: Callable[[], TextModel], metrics: Sequence[str] = ("faithfulness", "context_precision"), runs: int = 2) -> DataFrame:
    """(arm, case_id, metric, value): mean of clamped judge scores over repeated runs."""
    ask = responses.join(queries.select(F.col("query_id").alias("case_id"), "query"), "case_id")
    ask = ask.select("arm", "case_id", F.explode(F.sequence(F.lit(1), F.lit(runs))).alias("run"), F.concat_ws("\n", prompt_context(), "query", "answer").alias("text"))
    got = complete(ask, f"Score {', '.join(metrics)} from 0 to 1 as one JSON object.", "text", factory, json_only=True)
    scores = F.from_json("answer", ", ".join(f"{m} double" for m in metrics))
    value = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("s")[m])).alias("value")) for m in metrics]))
    x = got.withColumn("s", scores).select("arm", "case_id", "run", value.alias("m")).select("arm", "case_id", "run", "m.metric", "m.value").where("value is not null")
    return x.groupBy("arm", "case_id", "metric").agg(F.avg("value").alias("value"))


def model_spec(spec: str) -> tuple[str, str | None, str | None]:
    """``model@url@variable`` to its three parts."""
    parts = [*spec.split("@", 2), "", ""][:3]
    return parts[0], parts[1] or None, parts[2] or None


def estimate_tokens(chunks: DataFrame) -> DataFrame:
    """Chunks with the tokens that reading them would cost."""
    return chunks.withColumn("tokens", token_estimate("text"))
