"""Jobs done whole: no bound on hops, Louvain until nothing moves."""

import os

import pytest

import __spark_entry__ as entry
from tessera.operators import community as co
from tessera.operators.retrieval import Retriever
from tessera.operators.store import GraphStore
from tessera.plans import catalog
from test_store import edges, nodes, path

FOLDER = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


def test_long_paths_are_found(spark):
    ids = [f"n{i:02d}" for i in range(11)]
    links = [(a, b, "relates_to") for a, b in zip(ids, ids[1:])] + [("n03", "x", "relates_to"), ("x", "n05", "relates_to")]
    g = GraphStore(nodes(spark, *ids, "x", "alone"), edges(spark, *links))
    assert path(g, "n00", "n10") == ids
    assert path(g, "n00", "n02", max_hops=1) is None and path(g, "n00", "n02", max_hops=2) == ids[:3]
    assert path(g, "n00", "alone") is None


@tables
def test_shortest_path_beside_plain_search(spark):
    """Level by level from each start; the smallest path of each level is kept."""
    g = catalog.store(spark, FOLDER)
    out = {}
    for r in g.edges.select("src", "dst").distinct().collect():
        out.setdefault(r.src, []).append(r.dst)
    want = set()
    for (start,) in g.nodes.where("ord % 50 = 0").select("id").collect():
        front, known = {start: [start]}, {start}
        while front and "fogo" not in front:
            step = {}
            for p in sorted(front.values(), key=lambda p: [x.encode() for x in p]):
                for t in out.get(p[-1], []):
                    if t not in known:
                        step.setdefault(t, [*p, t])
            known |= set(step)
            front = step
        if front:
            want.add((start, " > ".join(front["fogo"])))
    got = {(r.query_id, r.path) for r in entry.queries()["shortest_path"](spark, FOLDER).collect()}
    assert got == want and max(p.count(" > ") for _, p in got) > 8


def test_louvain_that_is_not_done_is_an_error(spark):
    ring = [f"r{i:02d}" for i in range(24)]
    g = GraphStore(nodes(spark, *ring), edges(spark, *[(a, b, "calls") for a, b in zip(ring, ring[1:] + ring[:1])]))
    with pytest.raises(RuntimeError, match="still gain"):
        co.louvain(g, rounds=2)


#: Queries that ask all questions, and the arm that they ask.
WHOLE = {
    "graph_retrieve": "graph",
    "attrs_delta": "graph_attrs",
    "graph_attrs_retrieve": "graph",
    "graph_pagerank_retrieve": "graph",
    "hybrid_rrf": "hybrid",
    "multi_anchor_retrieve": "multi_anchor",
    "path_retrieve": "path",
    "recall_at_budget": "graph",
    "rerank_topk": "graph",
}


class Asked(Exception):
    pass


@tables
@pytest.mark.parametrize("name", WHOLE)
def test_all_questions_are_asked(spark, monkeypatch, name):
    def arm(self, queries, *_, **__):
        raise Asked({r.query_id for r in queries.select("query_id").collect()})

    monkeypatch.setattr(Retriever, WHOLE[name], arm)
    monkeypatch.setattr(GraphStore, "pagerank", lambda *_, **__: None)
    with pytest.raises(Asked) as e:
        entry.queries()[name](spark, FOLDER)
    ids = {r.id for r in spark.read.parquet(f"{FOLDER}/eval_queries.parquet").select("id").collect()}
    assert e.value.args[0] == ids and len(ids) > 1
    assert "% 50" not in entry.oracle_sql()[name]
