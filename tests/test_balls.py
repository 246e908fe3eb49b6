"""Expansion by bits beside a plain search, without rows of (question, reached node)."""

import pytest

from tessera.functions.text import token_estimate
from tessera.model import EDGE_SCHEMA, NODE_SCHEMA
from tessera.operators import balls, retrieval
from tessera.operators.store import GraphStore

N, ASKED = 90, 70


@pytest.fixture(scope="module")
def hub(spark):
    """n000… around a hub, every third one with a tail of two; labels share a word with some questions."""
    nodes = [("hub", "concept", "hub", {}, 0)] + [(f"n{i:03d}", "entity", f"w{i} azul" if i % 7 == 0 else f"w{i}", {}, i + 1) for i in range(N)]
    links = [(f"n{i:03d}", "hub", "resists", {}, i) for i in range(0, N, 3)]
    links += [(f"n{i:03d}", f"n{i + 1:03d}", "relates_to", {}, N + i) for i in range(N - 1) if i % 3 < 2]
    return nodes, links, GraphStore(spark.createDataFrame(nodes, NODE_SCHEMA), spark.createDataFrame(links, EDGE_SCHEMA))


def plain(nodes, links, seeds, budget):
    """Two steps from the seeds, scored by shared words, packed in order."""
    near = set(seeds)
    for _ in range(2):
        near |= {b for a, b, *_ in links if a in near} | {a for a, b, *_ in links if b in near}
    label = {n[0]: n[2] for n in nodes}
    words = ["azul", "w7", "w14"]
    out = []
    for v in near:
        own = label[v].split()
        score = 1.0 if v in seeds else len(set(own) & set(words)) / (len(own) * len(words)) ** 0.5
        rels = "; ".join(f"{t} {label[b]}" for a, b, t, _, _ in sorted(links, key=lambda x: x[4]) if a == v and b in near)
        out.append((-score, v, label[v] + (f" — {rels}" if rels else "")))
    total, kept = 0, []
    for i, (s, v, text) in enumerate(sorted(out)):
        total += (len(text) + 3) // 4
        if i and total > budget:
            break
        kept.append((i + 1, v, text, round(-s, 6)))
    return kept


def test_blocks_and_repeats_give_the_plain_result(spark, hub, monkeypatch):
    nodes, links, store = hub
    monkeypatch.setattr(retrieval, "BLOCK", 64)  # two blocks of questions
    monkeypatch.setattr(retrieval, "FIRST", 3)
    monkeypatch.setattr(retrieval, "FIRST_COST", 10**6)  # most questions are asked again
    monkeypatch.setattr(GraphStore, "subgraph", lambda *_: pytest.fail("rows of (question, reached node) were made"))
    budget = {i: (1, 40, 10_000)[i % 3] for i in range(ASKED)}
    q = spark.createDataFrame([(f"q{i:02d}", "azul w7 w14", budget[i]) for i in range(ASKED)], "query_id string, query string, budget int")
    seeds = spark.createDataFrame([(f"q{i:02d}", s) for i in range(ASKED) for s in (f"n{i:03d}", "hub" if i % 2 else f"n{i + 5:03d}")], "query_id string, id string")
    r = retrieval.Retriever(store)
    got = {}
    for x in r._expanded(q, seeds, "graph", False, None, 0.0, token_estimate).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.source, x.text, round(x.score, 6)))
    for i in range(ASKED):
        assert sorted(got[f"q{i:02d}"]) == plain(nodes, links, {f"n{i:03d}", "hub" if i % 2 else f"n{i + 5:03d}"}, budget[i]), i
    assert balls.BLOCK % 64 == 0
