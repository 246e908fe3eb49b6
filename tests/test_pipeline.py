import io
import json
import sys
import urllib.error

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from conftest import rows
from tessera.functions.http import post_json, wait_before
from tessera.functions.ports import embed, rerank_scores
from tessera.operators import pipeline
from tessera.sources.files import cached_answers, query_set, save_answers

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Model:
    def complete(self, system, text):
        if "boom" in text:
            raise RuntimeError("no")
        if "Score" in system:
            return '```{"faithfulness": 1.4, "context_precision": 0.5}```', 1, 1
        name = text.split()[0]
        return "```json\n" + json.dumps({"entities": [{"name": name, "kind": "creature", "attrs": {"cr": "1"}}], "relations": [{"subject": name, "predicate": "RESISTS", "object": "fogo"}]}) + "\n```", 10, 5

    def embed(self, texts):
        return [[float(len(t)), 1.0] for t in texts]

    def rerank(self, query, texts):
        return [float(query in t) for t in texts]


def test_model_extraction(spark):
    chunks = spark.createDataFrame([(1, "Goblin vive"), (2, "boom"), (3, "goblin volta"), (4, "skip me")], "chunk_no int, text string")
    store, cost, errors = pipeline.extract_chunks(chunks, Model, keep=~F.col("text").contains("skip"))
    assert rows(store.nodes, "id", "type", "label") == [("fogo", "concept", "fogo"), ("goblin", "entity", "Goblin")]
    assert store.edges.count() == 1 and tuple(cost.first())[:3] == (2, 20, 10)
    assert [(r.chunk_no, "RuntimeError" in r.error) for r in errors.collect()] == [(2, True)]


def test_ports(spark):
    df = spark.createDataFrame([("abc",), (None,)], "t string")
    assert rows(embed(df, "t", Model), "vector") == [([3.0, 1.0],), (None,)] or {str(r.vector) for r in embed(df, "t", Model).collect()} == {"[3.0, 1.0]", "None"}
    assert rerank_scores(df.where("t is not null").withColumn("q", F.lit("b")), "q", "t", Model).first().score == 1.0


def test_answers_and_judge(spark):
    q = spark.createDataFrame([("q1", "who?"), ("q2", "boom")], "query_id string, query string")
    s = spark.createDataFrame([("q1", 2, "b"), ("q1", 1, "a")], "query_id string, rank int, text string")
    a = pipeline.answers(s, q, Model, "graph")
    got = {r.case_id: r for r in a.collect()}
    assert got["q1"].contexts == ["a", "b"] and got["q1"].input_tokens == 10 and got["q2"].error and got["q2"].answer is None
    j = pipeline.judged(a.where("error is null"), q, Model)
    assert rows(j, "metric", "value") == [("context_precision", 0.5), ("faithfulness", 1.0)]


def test_vault_code_and_files(spark, tmp_path):
    v = tmp_path / "vault" / "deep"
    v.mkdir(parents=True)
    (v / "a.md").write_text("---\nrelates_to: [b]\n---\n[x](c.md)")
    (tmp_path / "vault" / "b.md").write_text("plain")
    store = pipeline.build_vault(spark, str(tmp_path / "vault"))
    assert rows(store.edges, "src", "dst", "type") == [("a", "b", "relates_to"), ("a", "c", "references")]
    (tmp_path / "vault" / "m.py").write_text("def f():\n    g()\n\ndef g():\n    pass\n")
    code = pipeline.build_code(spark, str(tmp_path / "vault"))
    assert ("m.py::f", "m.py::g", "calls") in rows(code.edges, "src", "dst", "type")
    assert tuple(pipeline.totals(code).first()) == (3, 3)
    code.save(str(tmp_path / "g"))
    assert pipeline.GraphContext.load(spark, str(tmp_path / "g"), hops=1).retrieve("f", 50).count() > 0
    (tmp_path / "q.json").write_text(json.dumps({"queries": [{"id": "1", "question": "q", "relevant_sources": ["a"]}]}))
    assert query_set(spark, str(tmp_path / "q.json")).first().relevant_sources == ["a"]
    save_answers(spark.createDataFrame([("x",)], "answer string"), str(tmp_path / "ans"), "fp")
    assert cached_answers(spark, str(tmp_path / "ans"), "fp").count() == 1
    assert cached_answers(spark, str(tmp_path / "ans"), "other") is None and cached_answers(spark, str(tmp_path / "nothing"), "fp") is None


def test_posting():
    assert wait_before(0, None) == 2.0 and wait_before(2, None) == 8.0 and wait_before(0, "7") == 7.0
    with pytest.raises(ValueError):
        post_json("ftp://x", {})
    tries, slept = [], []

    def opener(request, timeout):
        tries.append(1)
        if len(tries) < 3:
            raise urllib.error.HTTPError(request.full_url, 503, "busy", {"Retry-After": "1"}, None)
        return io.BytesIO(b'{"ok": true}')

    assert post_json("https://x.test/", {}, sleep=slept.append, opener=opener) == {"ok": True} and slept == [1.0, 1.0]
    assert pipeline.model_spec("m@http://u@KEY") == ("m", "http://u", "KEY") and pipeline.model_spec("m") == ("m", None, None)
