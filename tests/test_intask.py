"""A graph that one task holds is searched and partitioned there, with the results of the rounds of joins."""

import random

import pytest

from conftest import rows
from tessera.operators import community as co
from tessera.operators import intask
from tessera.operators.store import GraphStore
from test_store import edges, nodes


def graph(spark, n, m, seed, kind):
    r = random.Random(seed)
    ids = [f"n{i:03d}" for i in range(n)] + ["é", "Z"]
    links = {(r.choice(ids), r.choice(ids if r.random() < 0.8 else ids[:3]), kind) for _ in range(m)}
    return GraphStore(nodes(spark, *ids), edges(spark, *sorted(links)))


@pytest.mark.parametrize("hops", [None, 3])
def test_paths_without_rounds_of_joins(spark, monkeypatch, hops):
    g = graph(spark, 60, 110, 5, "relates_to")
    r = random.Random(1)
    ids = [x.id for x in g.nodes.collect()]
    pairs = [(f"q{i}", r.choice(ids), r.choice(ids)) for i in range(80)] + [(f"s{i}", x, "n001") for i, x in enumerate(ids)] + [("same", "Z", "Z"), ("twice", "Z", "Z"), ("none", "Z", "ghost")]
    pairs = spark.createDataFrame(pairs, "query_id string, src string, dst string")
    monkeypatch.setattr(intask, "IN_TASK", 0)
    want = rows(g.shortest_paths(pairs, hops))
    monkeypatch.setattr(intask, "IN_TASK", 10**6)
    monkeypatch.setattr(intask, "PAIRS", 50)
    got = g.shortest_paths(pairs, hops)
    assert rows(got) == want and len({q for q, _ in want}) > 20
    assert max(len(p) for _, p in want) > 3


def test_moves_without_rounds_of_joins(spark, monkeypatch):
    g = graph(spark, 80, 160, 2, "calls")
    monkeypatch.setattr(intask, "IN_TASK", 0)
    joined = co.modularity(co.louvain(g), g).first()[0]
    monkeypatch.setattr(intask, "IN_TASK", 10**6)
    monkeypatch.setattr(intask, "MANY", 4)
    monkeypatch.setattr(co, "_moves", lambda *_: pytest.fail("a round of joins"))
    p = co.louvain(g)
    assert rows(p) == rows(co.louvain(g)) and [x[0] for x in rows(p, "id")] == rows_of(g)
    assert co.modularity(p, g).first()[0] > joined - 0.03


def rows_of(g):
    return [x[0] for x in rows(g.nodes, "id")]


def test_no_move_gains_at_the_end_of_a_level():
    import numpy as np

    r = np.random.default_rng(4)
    pairs = np.unique(np.sort(r.integers(0, 300, (900, 2)), axis=1), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    u, v = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
    c = intask._level(u, v, np.ones(len(u), np.int64), 300, len(u), 1000)
    k = np.bincount(u, minlength=300)
    for i in range(300):
        gain = {}
        for j in v[u == i]:
            gain[c[j]] = gain.get(c[j], 0) + len(u)
        for to in {*gain, c[i]}:
            rest = sum(k[j] for j in range(300) if c[j] == to and j != i)
            gain[to] = gain.get(to, 0) - k[i] * rest
        assert max(gain.values()) == gain[c[i]]


def test_moves_one_after_another_have_no_bound(spark, monkeypatch):
    """Large graphs took more rounds than were allowed; each raises modularity, so they end."""
    monkeypatch.setattr(co, "ROUNDS", 2)
    ring = [f"r{i:02d}" for i in range(24)]
    g = GraphStore(nodes(spark, *ring), edges(spark, *[(a, b, "calls") for a, b in zip(ring, ring[1:] + ring[:1])]))
    assert co.modularity(co.louvain(g), g).first()[0] > 0.5


@pytest.mark.parametrize("many", [3, 500])
def test_no_move_gains_without_a_bound(monkeypatch, many):
    """What isn't looked at again, as too little has moved, wouldn't gain."""
    import numpy as np

    monkeypatch.setattr(intask, "MANY", many)
    r = np.random.default_rng(9)
    pairs = np.unique(np.sort(np.stack([r.integers(0, 400, 1500), r.integers(0, 400, 1500) ** 2 // 400], axis=1), axis=1), axis=0)
    pairs = pairs[pairs[:, 0] != pairs[:, 1]]
    u, v = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
    c = np.array(intask._level(u, v, np.ones(len(u), np.int64), 400, len(u), None))
    k = np.bincount(u, minlength=400)
    size = np.bincount(c, weights=k, minlength=400).astype(np.int64)
    into = np.zeros((400, 400), np.int64)
    np.add.at(into, (u, c[v]), len(u))
    gain = np.where(into > 0, into - k[:, None] * (size[None, :] - (c[:, None] == np.arange(400)) * k[:, None]), np.iinfo(np.int64).min)
    stay = into[np.arange(400), c] - k * (size[c] - k)
    assert (gain.max(axis=1) <= np.maximum(stay, gain[np.arange(400), c])).all()
