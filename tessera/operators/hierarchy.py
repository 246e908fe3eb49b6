"""Parent-child rows to full hierarchies by tree contraction.

Every round rakes all leaves into their parents and then splices out an
independent set of unary nodes (those with one child), so chains shrink by a
constant factor and stars vanish at once; a forest of n nodes is gone after
O(log n) rounds, whatever its depth.  Each round's contractions are written
down.  What never goes is a core of cycles, each shrunk to a self-loop.

The contractions are then undone in reverse: a node finds its parent (and, if
it was spliced out, the child it had) already resolved and takes its root,
depth, path and number of descendants from them.  Nodes of a core lie on a
cycle; what hangs below has no root and is reported as such.

Defined cases: rows with a null type, parent or child are no links; repeated
rows count once; a child with several parents hangs below the smallest one for
root, depth and path, and ``n_parents`` tells, while ``states`` takes all its
parents into account; a row to itself is a cycle of one node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.workspace import Workspace

_STATE = T.StructType(
    [
        T.StructField("t", T.StringType()),
        T.StructField("v", T.StringType()),
        T.StructField("p", T.StringType()),
        T.StructField("w", T.LongType()),  # links from v up to p
        T.StructField("via", T.ArrayType(T.StringType())),  # nodes spliced out between p and v, from the top
        T.StructField("a", T.LongType()),  # nodes already raked into v, and v itself
        T.StructField("e", T.LongType()),  # such nodes of all in via
        T.StructField("c", T.StringType()),  # of a spliced node: the child it had
        T.StructField("ec", T.LongType()),  # and that child's e at that time
        T.StructField("n_parents", T.LongType()),
    ]
)
_DONE = T.StructType(
    [
        T.StructField("t", T.StringType()),
        T.StructField("v", T.StringType()),
        T.StructField("root", T.StringType()),
        T.StructField("depth", T.LongType()),
        T.StructField("path", T.ArrayType(T.StringType())),
        T.StructField("size", T.LongType()),
        T.StructField("state", T.StringType()),
        T.StructField("n_parents", T.LongType()),
    ]
)
_COLS = [f.name for f in _STATE]


def _start(links: DataFrame, kind: str, parent: str, child: str, paths: bool) -> DataFrame:
    rows = links.select(F.col(kind).alias("t"), F.col(parent).alias("p"), F.col(child).alias("v")).dropna().distinct()
    both = rows.select("t", "v", "p").unionByName(rows.select("t", F.col("p").alias("v"), F.lit(None).cast("string").alias("p")))
    return both.groupBy("t", "v").agg(F.min("p").alias("p"), F.count("p").alias("n_parents")).select(
        "t", "v", "p", F.lit(1).cast("long").alias("w"), (F.array() if paths else F.lit(None)).cast("array<string>").alias("via"), F.lit(1).cast("long").alias("a"),
        F.lit(0).cast("long").alias("e"), F.lit(None).cast("string").alias("c"), F.lit(0).cast("long").alias("ec"), "n_parents",
    )


def _priority(node: Column | str, salt: int) -> Column:
    return F.xxhash64("t", node, F.lit(salt))


def _round(s: DataFrame, n: int) -> DataFrame:
    """One rake and one compression; column ``kind``: rake, splice, root or left."""
    links = s.where(F.col("p").isNotNull())
    has_child = links.groupBy("t", "p").agg(F.lit(True).alias("has_child")).withColumnRenamed("p", "v")
    seen = s.join(has_child, ["t", "v"], "left")
    leaf = F.col("has_child").isNull() & F.col("p").isNotNull()
    mass = seen.where(leaf).groupBy("t", "p").agg(F.sum(F.col("a") + F.col("e")).alias("m")).withColumnRenamed("p", "v")
    raked = (
        seen.join(mass, ["t", "v"], "left")
        .withColumn("a", F.col("a") + F.coalesce("m", F.lit(0)))
        .withColumn("kind", F.when(leaf, "rake").otherwise("left"))
    )
    kids = (
        raked.where((F.col("kind") == "left") & F.col("p").isNotNull())
        .groupBy("t", "p")
        .agg(F.count(F.lit(1)).alias("n_kids"), F.min("v").alias("kid"))
        .withColumnRenamed("p", "v")
    )
    own, up, down = _priority("v", n), _priority("p", n), _priority("kid", n)
    splice = (
        (F.col("kind") == "left") & (F.col("n_kids") == 1) & (F.col("p") != F.col("v"))
        & (F.struct(own, "v") > F.struct(up, F.col("p"))) & (F.struct(own, "v") > F.struct(down, F.col("kid")))
    )
    marked = raked.drop("c").join(kids, ["t", "v"], "left").withColumn("splice", F.coalesce(splice, F.lit(False)))
    gone = marked.where("splice").select(
        F.col("t").alias("g_t"), F.col("v").alias("g_v"), F.col("p").alias("g_p"), F.col("w").alias("g_w"), F.col("via").alias("g_via"), F.col("a").alias("g_a"),
        F.col("e").alias("g_e"), F.col("n_parents").alias("g_n"),
    )
    stay = marked.where(~F.col("splice"))
    stay = stay.join(gone, (F.col("t") == F.col("g_t")) & (F.col("p") == F.col("g_v")) & (F.col("kind") == "left"), "left")
    hit = F.col("g_v").isNotNull()
    row = [
        F.struct(
            "t", "v", F.when(hit, F.col("g_p")).otherwise(F.col("p")).alias("p"), (F.col("w") + F.coalesce("g_w", F.lit(0))).alias("w"),
            F.when(hit, F.concat("g_via", F.array("g_v"), "via")).otherwise(F.col("via")).alias("via"), "a",
            (F.col("e") + F.coalesce(F.col("g_a") + F.col("g_e"), F.lit(0))).alias("e"), F.lit(None).cast("string").alias("c"),
            F.lit(0).cast("long").alias("ec"), "n_parents",
            F.when((F.col("kind") == "left") & F.col("p").isNull() & F.col("n_kids").isNull(), "root").otherwise(F.col("kind")).alias("kind"),
        ),
        F.when(
            hit,
            F.struct(
                "t", F.col("g_v").alias("v"), F.col("g_p").alias("p"), F.col("g_w").alias("w"), F.col("g_via").alias("via"), F.col("g_a").alias("a"),
                F.col("g_e").alias("e"), F.col("v").alias("c"), F.col("e").alias("ec"), F.col("g_n").alias("n_parents"), F.lit("splice").alias("kind"),
            ),
        ),
    ]
    both = stay.select(F.explode(F.array_compact(F.array(*row))).alias("r"))
    return both.select(*[F.col(f"r.{c}").alias(c) for c in [*_COLS, "kind"]])


def _resolve(events: DataFrame, done: DataFrame, spliced: bool) -> DataFrame:
    up = done.select("t", F.col("v").alias("p"), F.col("root").alias("u_root"), F.col("depth").alias("u_depth"), F.col("path").alias("u_path"), F.col("state").alias("u_state"))
    x = events.join(up, ["t", "p"])
    size, on = F.col("a"), F.lit(False)
    if spliced:
        x = x.join(done.select("t", F.col("v").alias("c"), F.col("size").alias("c_size"), F.col("state").alias("c_state")), ["t", "c"])
        size, on = F.col("a") + F.col("ec") + F.col("c_size"), F.col("c_state") == "on_cycle"
    state = F.when(on, "on_cycle").when(F.col("u_state") != "tree", "below_cycle").otherwise("tree")
    return x.select(
        "t", "v", F.col("u_root").alias("root"), (F.col("u_depth") + F.col("w")).alias("depth"),
        F.concat("u_path", "via", F.array("v")).alias("path"), F.when(~on, size).alias("size"), state.alias("state"), "n_parents",
    )


def hierarchy(links: DataFrame, kind: str = "type", parent: str = "src", child: str = "dst", paths: bool = True) -> DataFrame:
    """Per kind and node: root, depth, path (from the root to the node),
    n_descendants, state (``tree``, ``on_cycle``, ``below_cycle``), n_parents.

    All paths together grow with the sum of depths; without ``paths`` they are null
    and everything else is the same.  Nodes kept from a root by a cycle have null root, depth and path; nodes on a
    cycle also a null number of descendants.  An empty input gives no rows.
    """
    spark = links.sparkSession
    ws = Workspace(spark, "hierarchy")
    path, s = ws.write(_start(links, kind, parent, child, paths))
    events, n = [], 0
    while s.where(F.col("p").isNotNull() & (F.col("p") != F.col("v"))).limit(1).count():
        n += 1
        at, new = ws.write(_round(s, n), by=["kind"])
        events.append(new)
        s = new.where("kind = 'left'").select(*_COLS)
        if path:
            ws.drop(path)
        path = None
    none = F.lit(None)
    roots = s
    for e in events:
        roots = roots.unionByName(e.where("kind = 'root'").select(*_COLS))
    first = roots.select(
        "t", "v", F.when(F.col("p").isNull(), F.col("v")).alias("root"), F.when(F.col("p").isNull(), F.lit(0).cast("long")).alias("depth"),
        F.when(F.col("p").isNull() & F.lit(paths), F.array("v")).alias("path"), F.when(F.col("p").isNull(), F.col("a")).otherwise(none).alias("size"),
        F.when(F.col("p").isNull(), "tree").otherwise("on_cycle").alias("state"), "n_parents",
    )
    parts = [ws.write(first)[0]]
    for e in reversed(events):
        done = ws.read(parts, _DONE)
        back = _resolve(e.where("kind = 'splice'"), done, spliced=True)
        parts.append(ws.write(back)[0])
        done = ws.read(parts, _DONE)
        parts.append(ws.write(_resolve(e.where("kind = 'rake'"), done, spliced=False))[0])
    return ws.read(parts, _DONE).select(
        F.col("t").alias("type"), F.col("v").alias("id"), "root", "depth", "path", (F.col("size") - 1).alias("n_descendants"), "state", "n_parents"
    )


def states(links: DataFrame, kind: str = "type", parent: str = "src", child: str = "dst") -> DataFrame:
    """(type, id, state) over all distinct links, also where a child has several parents.

    Where no child has, these are the states of ``hierarchy``.  Else the ends of the
    graph are peeled off, the cycles of the remaining core are its strongly
    connected parts, found by colours, and what they reach lies below them.
    """
    ws = Workspace(links.sparkSession, "states")
    rows = ws.write(links.select(F.col(kind).alias("t"), F.col(parent).alias("p"), F.col(child).alias("v")).dropna().distinct())[1]
    if rows.groupBy("t", "v").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return hierarchy(rows, "t", "p", "v", paths=False).select(F.col("type").alias(kind), "id", "state")
    core, on = _peeled(ws, rows), ws.write(rows.where("p = v").select("t", "v"))[1]
    core = ws.write(core.where("p <> v"))[1]
    while not core.isEmpty():
        colour = _spread(ws, core.select("t", F.col("p").alias("v")).unionByName(core.select("t", "v")).distinct().withColumn("c", F.col("v")), core)
        inner = core.join(colour, ["t", "v"]).join(colour.select("t", F.col("v").alias("p"), F.col("c").alias("pc")), ["t", "p"]).where("c = pc").select("t", "c", "p", "v")
        inner = ws.write(inner)[1]
        part = _reached(ws, inner.where("v = c").select("t", "v").distinct(), inner.select("t", F.col("v").alias("a"), F.col("p").alias("b")))
        on = ws.write(on.unionByName(part).distinct())[1]
        tops = colour.where("v = c").select("t", "v").unionByName(part).distinct()
        core = core.join(tops, ["t", "v"], "left_anti").join(tops.withColumnRenamed("v", "p"), ["t", "p"], "left_anti")
        core = _peeled(ws, ws.write(core)[1])
    below = _reached(ws, on, rows.select("t", F.col("p").alias("a"), F.col("v").alias("b")))
    ids = rows.select("t", "v").unionByName(rows.select("t", F.col("p").alias("v"))).distinct()
    x = ids.join(on.withColumn("o", F.lit(True)), ["t", "v"], "left").join(below.withColumn("b", F.lit(True)), ["t", "v"], "left")
    state = F.when(F.col("o"), "on_cycle").when(F.col("b"), "below_cycle").otherwise("tree")
    return x.select(F.col("t").alias(kind), F.col("v").alias("id"), state.alias("state"))


def _peeled(ws: Workspace, core: DataFrame) -> DataFrame:
    """The links whose parent has a parent and whose child has a child, and so on."""
    n = core.count()
    while n:
        kept = core.join(core.select("t", F.col("v").alias("p")).distinct(), ["t", "p"], "left_semi").join(core.select("t", F.col("p").alias("v")).distinct(), ["t", "v"], "left_semi")
        core = ws.write(kept.select("t", "p", "v"))[1]
        n, before = core.count(), n
        if n == before:
            break
    return core


def _spread(ws: Workspace, colour: DataFrame, core: DataFrame) -> DataFrame:
    """Every node with the greatest colour of those that reach it."""
    while True:
        got = core.join(colour.select("t", F.col("v").alias("p"), "c"), ["t", "p"]).select("t", "v", "c")
        new = ws.write(colour.withColumn("old", F.col("c")).unionByName(got.withColumn("old", F.lit(None).cast("string"))).groupBy("t", "v").agg(F.max("c").alias("c"), F.max("old").alias("old")))[1]
        if new.where("c <> old").isEmpty():
            return new.select("t", "v", "c")
        colour = new.select("t", "v", "c")


def _reached(ws: Workspace, seeds: DataFrame, arcs: DataFrame) -> DataFrame:
    """(t, v) of the seeds and all that arcs (t, a, b) lead to from them."""
    at, front = ws.write(seeds.select("t", "v"))
    paths = [at]
    while not front.isEmpty():
        known = ws.read(paths, front.schema)
        at, front = ws.write(front.join(arcs, (front.t == arcs.t) & (front.v == arcs.a)).select(front.t, F.col("b").alias("v")).distinct().join(known, ["t", "v"], "left_anti"))
        paths.append(at)
    return ws.read(paths, front.schema)


def descendants(nodes: DataFrame) -> DataFrame:
    """(type, id, descendant, distance) of all nodes with a path, from the paths."""
    up = nodes.where(F.col("path").isNotNull()).select("type", F.col("id").alias("descendant"), "depth", F.posexplode("path").alias("level", "id"))
    return up.where(F.col("id") != F.col("descendant")).select("type", "id", "descendant", (F.col("depth") - F.col("level")).alias("distance"))
