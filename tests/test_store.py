import json

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tessera.model import EDGE_SCHEMA, NODE_SCHEMA
from tessera.operators.store import GraphStore


def nodes(spark, *ids, kind="entity", start=0):
    return spark.createDataFrame([(i, kind, i.upper(), {}, start + n) for n, i in enumerate(ids)], NODE_SCHEMA)


def edges(spark, *triples, start=0):
    return spark.createDataFrame([(s, d, t, {}, start + n) for n, (s, d, t) in enumerate(triples)], EDGE_SCHEMA)


@pytest.fixture(scope="module")
def line(spark):
    return GraphStore(nodes(spark, "a", "b", "c"), edges(spark, ("a", "b", "relates_to"), ("b", "c", "relates_to")))


@pytest.fixture(scope="module")
def hub(spark):
    n = nodes(spark, "a", "b", "c", "d").unionByName(nodes(spark, "comm", kind="community", start=9))
    return GraphStore(n, edges(spark, ("a", "b", "relates_to"), ("b", "c", "relates_to"), ("c", "d", "relates_to"), ("comm", "a", "contains"), ("comm", "d", "contains")))


def ids(sub):
    return {r.id for r in sub.nodes.collect()}


def path(g, a, b, **kw):
    p = g.nodes.sparkSession.createDataFrame([("q", a, b)], "query_id string, src string, dst string")
    got = g.shortest_paths(p, **kw).collect()
    return got[0].path if got else None


def test_expansion_is_undirected_and_paths_are_directed(line):
    assert ids(line.neighbors("a", 1)) == {"a", "b"}
    assert ids(line.neighbors("c", 2)) == {"a", "b", "c"}
    assert rows(line.neighbors("a", 2).edges, "src", "dst") == [("a", "b"), ("b", "c")]
    assert path(line, "a", "c") == ["a", "b", "c"]
    assert path(line, "c", "a") is None and path(line, "a", "ghost") is None and path(line, "b", "b") == ["b"]


def test_upserts_replace_whole_rows(spark, line):
    new = spark.createDataFrame([("a", "concept", "renamed", {"k": "v"}, 50)], NODE_SCHEMA)
    got = line.upsert_nodes(new).neighbors("a", 0).nodes.collect()
    assert [(r.type, r.label, r.attrs) for r in got] == [("concept", "renamed", {"k": "v"})]
    more = line.upsert_edges(edges(spark, ("a", "b", "mentions"), ("a", "ghost", "mentions"), start=50))
    assert rows(more.neighbors("a", 1).edges, "type") == [("mentions",), ("relates_to",)]
    with pytest.raises(Exception, match="unknown type"):
        line.upsert_edges(edges(spark, ("a", "b", "likes"), start=60)).edges.collect()


def test_exclusions_come_before_traversal(hub):
    assert {"comm", "d"} <= ids(hub.neighbors("a", 2))
    no = {"no_nodes": ("community",), "no_edges": ("contains",)}
    assert ids(hub.neighbors("a", 2, **no)) == {"a", "b", "c"}
    assert path(hub, "comm", "d") == ["comm", "d"] and path(hub, "comm", "d", no_edges=("contains",)) is None
    assert ids(hub.neighbors("ghost", 1)) == set()


def test_pagerank(spark):
    g = GraphStore(nodes(spark, "hub", "x", "y", "alone"), edges(spark, ("hub", "x", "resists"), ("hub", "y", "resists")))
    pr = {r.id: r.score for r in g.pagerank().collect()}
    assert abs(sum(pr.values()) - 1) < 1e-6 and pr["hub"] > pr["x"] == pytest.approx(pr["y"])
    two = GraphStore(nodes(spark, "m", "x", "y"), edges(spark, ("m", "x", "resists"), ("m", "x", "mentions"), ("m", "y", "resists")))
    got = {r.id: r.score for r in two.pagerank().collect()}
    assert got["x"] > got["y"]
    assert GraphStore(nodes(spark).limit(0), edges(spark).limit(0)).pagerank().count() == 0


def test_save_and_load(spark, hub, tmp_path):
    hub.save(str(tmp_path / "g"))
    back = GraphStore.load(spark, str(tmp_path / "g"))
    assert ids(back.neighbors("a", 1)) == ids(hub.neighbors("a", 1))
    f = tmp_path / "g.json"
    f.write_text(json.dumps({"nodes": [{"id": "a", "type": "entity", "label": "A", "attrs": {"k": "1"}}, {"id": "b", "type": "entity", "label": "B"}], "edges": [{"src": "a", "dst": "b", "type": "calls", "attrs": {}}]}))
    g = GraphStore.load_json(spark, str(f))
    assert rows(g.nodes, "id", "ord") == [("a", 0), ("b", 1)] and g.edges.count() == 1


def test_arrivals(spark):
    n = nodes(spark, "a", "b").withColumn("deleted_at", F.lit(None).cast("timestamp_ntz"))
    gone = nodes(spark, "b", start=9).withColumn("deleted_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    g = GraphStore.from_arrivals(n.unionByName(gone), edges(spark, ("a", "b", "calls")))
    assert rows(g.nodes, "id") == [("a",)] and g.edges.count() == 0


def test_bare_edges_of_arrivals(spark):
    """The same edges as with attributes, also through stored(), which makes the nodes once; deleted ends and older rows stay gone."""
    n = spark.createDataFrame([("a", "entity", "A", {}, 0), ("b", "entity", "B", {}, 1), ("c", "entity", "C", {}, 2)], NODE_SCHEMA).selectExpr("*", "if(id = 'c', timestamp'2024-01-01', null) deleted_at")
    e = spark.createDataFrame([("a", "b", "resists", {"x": "1"}, 0), ("a", "b", "resists", {"x": "2"}, 5), ("b", "c", "resists", {}, 1), ("b", "a", "calls", {}, 2)], EDGE_SCHEMA)
    g = GraphStore.from_arrivals(n, e)
    want = [("a", "b", "resists", 5), ("b", "a", "calls", 2)]
    for x in (g, g.stored(), g.bare(), g.bare().stored()):
        assert rows(x.edges, "src", "dst", "type", "ord") == want
    assert g.bare().stored().edges.where("attrs is not null").isEmpty() and not g.stored().edges.where("attrs is not null").isEmpty()
