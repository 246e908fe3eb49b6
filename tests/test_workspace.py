"""What a run leaves on disk while it goes on."""

import os

from pyspark.sql import functions as F

from tessera.model import EDGE_SCHEMA, NODE_SCHEMA
from tessera.operators.similarity import nearest
from tessera.operators.store import GraphStore
from tessera.workspace import Workspace, shared_dir


def shuffle_files(spark):
    dirs = [str(d) for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    return {f for d in dirs for _, _, files in os.walk(d) for f in files if f.startswith("shuffle_")}


def tables(spark, name):
    at = shared_dir(spark).removeprefix("file://")
    return {f"{d}/{t}" for d in os.listdir(at) if d.startswith(name) for t in os.listdir(f"{at}/{d}")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    ws, before = Workspace(spark, "left"), shuffle_files(spark)
    x = ws.write(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())[1]
    y = ws.write_bucketed(spark.range(1000).select((F.col("id") % 7).alias("k")), ["k"], distinct=True)
    assert (x.count(), y.count()) == (7, 7)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    shuffled = {f for f in shuffle_files(spark) - before if f.endswith(".data")}
    assert len({f.split("_")[1] for f in shuffled}) <= 2  # those of the two counts


def test_nearest_leaves_its_result_alone(spark):
    shared_dir(spark)
    before = tables(spark, "nearest")
    q = spark.createDataFrame([("q", 1, 1, 1)], "query_id string, bucket int, c bigint, norm bigint")
    i = spark.createDataFrame([(k, 1, k, k * k) for k in (1, 2, 3)], "key int, bucket int, c bigint, norm bigint")
    assert [r.key for r in nearest(q, i, 2).orderBy("rank").collect()] == [1, 2]
    assert len(tables(spark, "nearest") - before) == 1


def test_a_step_from_seeds_moves_no_arcs(spark):
    nodes = spark.createDataFrame([(x, "entity", x, {}, i) for i, x in enumerate("abc")], NODE_SCHEMA)
    g = GraphStore(nodes, spark.createDataFrame([("a", "b", "resists", {}, 0), ("a", "b", "inflicts", {}, 1), ("b", "c", "resists", {}, 2)], EDGE_SCHEMA))
    around = g.adjacency()[0]
    assert sorted((r.id, r.to) for r in around.collect()) == [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")]
    assert "Exchange" not in around.groupBy("id", "salt").count()._jdf.queryExecution().executedPlan().toString()


def test_exclusions_drop_nodes_without_a_type(spark):
    nodes = spark.createDataFrame([("a", "entity", "a", {}, 0), ("b", None, "b", {}, 1), ("c", "community", "c", {}, 2), ("d", "entity", "d", {}, 3)], "id string, type string, label string, attrs map<string,string>, ord bigint")
    edges = spark.createDataFrame([(s, d, "resists", {}, i) for i, (s, d) in enumerate(["ab", "bd", "ac", "cd", "ad"])], EDGE_SCHEMA)
    g = GraphStore(nodes, edges).pruned(["community"], ["contains"])
    assert sorted(r.id for r in g.nodes.collect()) == ["a", "d"]
    assert [(r.src, r.dst) for r in g.edges.collect()] == [("a", "d")]
