"""Tasks that hold the graph give the results of the joins, each for its share of the questions."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tessera.functions.text import token_estimate
from tessera.model import EDGE_SCHEMA, NODE_SCHEMA
from tessera.operators import held, intask, retrieval
from tessera.operators.store import GraphStore
from tessera.workspace import Workspace


def test_each_share_of_questions_is_a_task_of_its_own(spark):
    q = spark.range(1000).select(F.col("id").alias("q"))
    x = held._shared(Workspace(spark, "shares"), [(spark.range(3).select(F.col("id").alias("n")), "node")], [(q, "question")], 1000)
    got = Counter((r.kind, r.p) for r in x.select("kind", F.spark_partition_id().alias("p")).collect())
    for kind in ("node", "question"):
        assert sum(k == kind for k, _ in got) == 4
    assert len({c for (k, _), c in got.items() if k == "node"}) == 1


@pytest.mark.parametrize("ranked", [False, True])
def test_many_tasks_give_the_rows_of_the_joins(spark, monkeypatch, ranked):
    nodes = [("hub", "concept", "hub", {"k": "v"}, 0)] + [(f"n{i:03d}", "entity", f"w{i} azul" if i % 7 == 0 else f"w{i}", {"a": str(i)} if i % 2 else {}, i + 1) for i in range(90)]
    links = [(f"n{i:03d}", "hub", "resists", {}, i) for i in range(0, 90, 3)] + [(f"n{i:03d}", f"n{i + 1:03d}", "relates_to", {}, 90 + i) for i in range(89) if i % 3 < 2]
    store = GraphStore(spark.createDataFrame(nodes, NODE_SCHEMA), spark.createDataFrame(links, EDGE_SCHEMA))
    q = spark.createDataFrame([(f"q{i:02d}", f"azul w{i} w14", (1, 40, 10_000)[i % 3]) for i in range(70)], "query_id string, query string, budget int")
    pr = spark.createDataFrame([(n[0], 1.0 / (3 + i % 11)) for i, n in enumerate(nodes)], "id string, score double") if ranked else None
    monkeypatch.setattr(held, "QUESTIONS", 16)
    monkeypatch.setattr(held, "BITS", 1)
    monkeypatch.setattr(retrieval, "FIRST", 3)
    monkeypatch.setattr(retrieval, "FIRST_COST", 10**6)

    def found(in_task):
        monkeypatch.setattr(intask, "IN_TASK", in_task)
        r = retrieval.Retriever(store)
        return [rows(x) for x in r._expanded_once(q, r.seeds(q), "graph", [False, True], pr, 0.5, token_estimate)]

    want = found(0)
    assert found(10**6) == want and len(want[0]) > 500
