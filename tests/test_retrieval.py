import pytest
from pyspark.sql import functions as F

from conftest import rows
from tessera.functions.text import named_entities, title_case, token_estimate
from tessera.model import EDGE_SCHEMA, NODE_SCHEMA
from tessera.operators.retrieval import Retriever, fuse, pack, rerank
from tessera.operators.similarity import bags, nearest, similarities, top, vector_top_k
from tessera.operators.store import GraphStore


@pytest.fixture(scope="module")
def beasts(spark):
    n = [("goblin", "entity", "Goblin", {"challenge_rating": "5"}, 0), ("fogo", "concept", "fogo", {}, 1), ("caverna", "concept", "caverna", {"tamanho": "grande"}, 2), ("comm", "community", "cave folk", {}, 3)]
    e = [("goblin", "fogo", "resists", {}, 0), ("comm", "goblin", "contains", {}, 1), ("comm", "caverna", "contains", {}, 2)]
    docs = spark.createDataFrame([("Goblin", "um goblin teme o fogo", 0), ("Orc", "orcs dormem", 1)], "label string, text string, ord bigint")
    return Retriever(GraphStore(spark.createDataFrame(n, NODE_SCHEMA), spark.createDataFrame(e, EDGE_SCHEMA)), docs, hops=1, anchors=1)


def ask(spark, *qs, budget=1000):
    return spark.createDataFrame([(f"q{i}", q, budget) for i, q in enumerate(qs)], "query_id string, query string, budget int")


def test_graph_arm(spark, beasts):
    got = {r.source: r for r in beasts.graph(ask(spark, "quem resiste a fogo")).collect()}
    assert set(got) == {"fogo", "goblin"} and got["goblin"].text == "Goblin — resists fogo" and got["fogo"].score == 1.0
    attrs = {r.source: r.text for r in beasts.graph(ask(spark, "goblin"), attrs=True).collect()}
    assert attrs["goblin"] == "Goblin — resists fogo — challenge_rating: 5"


def test_overlay_is_left_out(spark, beasts):
    assert rows(beasts.graph(ask(spark, "goblin")), "source") == [("fogo",), ("goblin",)]


def test_vector_and_empty_index(spark, beasts):
    got = beasts.vector(ask(spark, "fogo goblin")).orderBy("rank").collect()
    assert got[0].source == "Goblin"
    none = Retriever(beasts.store, beasts.documents.limit(0))
    assert none.vector(ask(spark, "fogo")).count() == 0


def test_fusion(spark):
    def arm(*names):
        return spark.createDataFrame([("q0", i + 1, f"{n} text", n) for i, n in enumerate(names)], "query_id string, rank int, text string, source string")

    q = ask(spark, "x")
    got = fuse([arm("a", "b"), arm("b", "c")], q).orderBy("rank").collect()
    assert [r.source for r in got] == ["b", "a", "c"]
    one = fuse([arm("goblin"), arm("Goblin")], q).collect()
    assert [(r.source, r.text) for r in one] == [("goblin", "goblin text")]


def test_paths(spark):
    n = [(c, "entity", c, {}, i) for i, c in enumerate(["alfa", "beta", "gama", "solo"])]
    e = [("alfa", "beta", "requires", {}, 0), ("beta", "gama", "relates_to", {}, 1)]
    r = Retriever(GraphStore(spark.createDataFrame(n, NODE_SCHEMA), spark.createDataFrame(e, EDGE_SCHEMA)))
    got = r.path(ask(spark, "alfa gama")).orderBy("rank").collect()
    assert [x.text for x in got] == ["alfa —[requires]→", "beta —[relates_to]→", "gama"] and [x.score for x in got] == [1.0, 0.7, 1.0]
    assert {x.text for x in r.path(ask(spark, "solo alfa")).collect()} == {"solo", "alfa"}
    assert {x.source for x in r.multi_anchor(ask(spark, "Alfa e Gama")).collect()} == {"alfa", "beta", "gama"}


def test_pack_keeps_the_first_and_stops_at_the_overflow(spark):
    s = spark.createDataFrame([("q", "x" * 400, "a", 3.0, 20), ("q", "y" * 4, "b", 2.0, 20), ("r", "z" * 40, "a", 3.0, 20), ("r", "z" * 40, "b", 2.0, 20), ("r", "z" * 40, "c", 1.0, 20)], "query_id string, text string, source string, score double, budget int")
    assert rows(pack(s, "graph"), "query_id", "source") == [("q", "a"), ("r", "a"), ("r", "b")]


def test_rerank_ignores_earlier_scores(spark):
    q = ask(spark, "red fire")
    pool = spark.createDataFrame([("q0", "blue ice", "a", 1), ("q0", "red fire", "b", 2), ("q0", "red ice", "c", 3)], "query_id string, text string, source string, rank int")
    assert [r.source for r in rerank(pool, q, 2).orderBy("rank").collect()] == ["b", "c"]


def test_vector_top_k(spark):
    i = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.9, 0.1]), (4, [0.0, 0.0])], "key int, vector array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0]), ("z", [0.0, 0.0])], "query_id string, vector array<float>")
    got = vector_top_k(q, i, 2)
    assert [r.key for r in got.where("query_id = 'q'").orderBy("rank").collect()] == [1, 3]
    assert [r.key for r in got.where("query_id = 'z'").orderBy("rank").collect()] == [1, 2]


def test_text(spark):
    df = spark.createDataFrame([("how does AuthService connect to PostgreSQL? see dec-121, AuthService", "FOGO-FÁTUO d'arvit", "abcde")], "q string, t string, c string")
    r = df.select(named_entities("q"), title_case("t"), token_estimate("c"), token_estimate(F.lit(""))).first()
    assert list(r) == [["dec-121", "AuthService", "PostgreSQL"], "Fogo-Fátuo D'Arvit", 2, 0]


@pytest.mark.parametrize("rare", [0.0, 0.05, 0.3, 1.0])
def test_nearest_equals_all_pairs(spark, rare):
    """Whatever counts as rare, the best are those of all pairs; a word that every text has is among them."""
    import random

    r = random.Random(5)
    word = lambda: f"w{int(r.paretovariate(0.7)) % 60}"
    texts = [(i, " ".join(["de"] + [word() for _ in range(r.randrange(1, 9))])) for i in range(150)] + [(900, ""), (901, None), (902, "de")]
    index = bags(spark.createDataFrame(texts, "key int, text string"), "key", "text")
    asked = spark.createDataFrame([(f"q{i}", t) for i, (_, t) in enumerate(texts[:20])] + [("none", "zzz"), ("common", "de")], "query_id string, text string")
    q = bags(asked, "query_id", "text")
    want = rows(top(similarities(q, index), 4, "key"), "query_id", "key", "rank")
    assert rows(nearest(q, index, 4, rare=rare), "query_id", "key", "rank") == want


def test_both_graph_arms_of_one_expansion(spark, beasts, monkeypatch):
    """Texts with and without attributes are those of the two arms; the graph is expanded once, and the bags are moved by no join."""
    q = ask(spark, "goblin", "caverna fogo", budget=6)
    want = [rows(beasts.graph(q, attrs=a)) for a in (False, True)]
    calls, made = [], GraphStore.reach_bits
    monkeypatch.setattr(GraphStore, "reach_bits", lambda *x: calls.append(1) or made(*x))
    assert [rows(x) for x in beasts.graph_attrs(q)] == want and want[0] != want[1]
    assert len(calls) == 1
    assert beasts._stored_bags().groupBy("key").count()._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0


@pytest.mark.parametrize("few", [0, 1 << 17])
def test_nearest_moves_the_index_for_many_questions_only(spark, monkeypatch, few):
    """Questions of common words alone meet all of the index; few of them are shipped to it."""
    from tessera.operators import similarity

    index = bags(spark.createDataFrame([(i, "de " + "abc"[i % 3]) for i in range(30)], "key int, text string"), "key", "text")
    q = bags(spark.createDataFrame([("q0", "de a"), ("q1", "de"), ("q2", "c")], "query_id string, text string"), "query_id", "text")
    want = rows(top(similarities(q, index), 4, "key"), "query_id", "key", "rank", "score")
    calls = []
    monkeypatch.setattr(similarity, "FEW", few)
    monkeypatch.setattr(similarity, "similarities", lambda *x: calls.append(1) or similarities(*x))
    assert rows(nearest(q, index, 4), "query_id", "key", "rank", "score") == want
    assert bool(calls) == (few == 0)


def test_bags_of_texts_are_moved_by_no_join(spark, beasts):
    assert beasts.vector(ask(spark, "fogo goblin"), k=1).first().source == "Goblin"
    assert "Exchange" not in beasts._texts.groupBy("key").count()._jdf.queryExecution().executedPlan().toString()
