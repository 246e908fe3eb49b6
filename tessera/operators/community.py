"""Communities by distributed Louvain moves, their ids and their overlay."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.model import STRUCTURAL_EDGES
from tessera.operators import intask
from tessera.operators.store import GraphStore
from tessera.workspace import Workspace

#: Rounds of a level in which half of the nodes move at a time, which needn't end.
ROUNDS = 10_000


def community_id(members: Column) -> Column:
    """Stable id of a sorted member array."""
    return F.concat(F.lit("community:"), F.substring(F.sha1(F.array_join(members, "\n").cast("binary")), 1, 12))


def _moves(ws: Workspace, arcs: DataFrame, nodes: DataFrame, total: float, rounds: int) -> DataFrame:
    """(v, c): every node moves to the neighbouring community of highest modularity gain.

    All nodes of one colour move together; the colour is a hash that changes
    with the round, so no two neighbours swap for ever.  Ties go to the
    smallest community, so the result is the same on every run.  It ends when no
    node of any colour would gain by a move; ``rounds`` without that is an error.
    """
    degree = ws.write(nodes.join(arcs.groupBy(F.col("u").alias("v")).agg(F.sum("w").alias("k")), "v", "left").fillna(0.0, ["k"]))[1]
    label = degree.select("v", "k", F.col("v").alias("c"))
    before = None
    for r in range(rounds):
        size = label.groupBy("c").agg(F.sum("k").alias("sum_c"))
        near = arcs.where("u <> v").join(label.select(F.col("v"), F.col("c").alias("to")), "v").groupBy("u", "to").agg(F.sum("w").alias("w"))
        own = label.withColumnRenamed("v", "u")
        # a node's own community is an option too, without the node itself
        options = own.join(near, "u", "left").unionByName(own.select("u", "k", "c", F.col("c").alias("to"), F.lit(0.0).alias("w"))).where("to is not null")
        options = options.groupBy("u", "k", "c", "to").agg(F.sum("w").alias("w")).join(size.withColumnRenamed("c", "to"), "to")
        rest = F.col("sum_c") - F.when(F.col("to") == F.col("c"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("w") - F.col("k") * rest / F.lit(2 * total), 9)
        best = options.groupBy("u", "k", "c").agg(F.max(F.struct(gain.alias("g"), (F.col("to") == F.col("c")).alias("stay"))).alias("top"), F.collect_set(F.struct(gain.alias("g"), "to")).alias("all"))
        choice = F.array_min(F.transform(F.filter("all", lambda x: x["g"] == F.col("top.g")), lambda x: x["to"]))
        colour = F.pmod(F.xxhash64("u", F.lit(r)), F.lit(2)) == 0
        moved = best.select(F.col("u").alias("v"), "k", (~F.col("top.stay")).alias("gains"), F.when(colour & ~F.col("top.stay"), choice).otherwise(F.col("c")).alias("c"))
        path, new = ws.write(moved)
        if before:
            ws.drop(before)
        before, label = path, new.select("v", "k", "c")
        if new.where("gains").isEmpty():
            return label.select("v", "c")
    raise RuntimeError(f"nodes still gain by moves after {rounds} rounds")


def louvain(store: GraphStore, edge_types: Collection[str] = STRUCTURAL_EDGES, rounds: int | None = None) -> DataFrame:
    """(id, community): levels of local moves and contraction over the structural edges, until contraction changes nothing.

    Self-loops are dropped, parallel edges count once, community nodes are left
    out; a node without structural edges is a community of its own.  Nodes of a graph
    that one task holds move one after another, those of a larger one half at a time;
    either way no node would gain by a move at the end of a level.  Moves one after another
    end by themselves, in as many rounds as they take; those of halves have ``ROUNDS``.
    """
    ws = Workspace(store.nodes.sparkSession, "louvain")
    nodes = ws.write(store.nodes.where("type <> 'community'").select(F.col("id").alias("v")))[1]
    pairs = store.edges.where(F.col("type").isin(*edge_types) & (F.col("src") != F.col("dst"))).select(
        F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")
    ).distinct()
    pairs = pairs.join(nodes, "v", "left_semi").join(nodes.withColumnRenamed("v", "u"), "u", "left_semi").select("u", "v")
    pairs = ws.write(pairs)[1]
    links = pairs.count()
    if not links:
        return nodes.select(F.col("v").alias("id"), F.col("v").alias("community"))
    if 2 * links <= intask.IN_TASK:
        found = intask.communities(ws, pairs, rounds)
        if found is None:
            raise RuntimeError(f"nodes still gain by moves after {rounds} rounds")
        alone = nodes.select(F.col("v").alias("id")).join(found.select("id"), "id", "left_anti")
        return found.unionByName(alone.select("id", F.col("id").alias("c"))).withColumnRenamed("c", "community")
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).withColumn("w", F.lit(1.0))
    arcs = ws.write(both)[1]
    total = arcs.agg(F.sum("w")).first()[0]
    member = nodes.select(F.col("v").alias("id"), F.col("v").alias("c"))
    level = nodes
    before = level.count()
    while True:
        label = _moves(ws, arcs, level, total / 2, ROUNDS if rounds is None else rounds)
        label = ws.write(label)[1]
        member = ws.write(member.join(label.select(F.col("v").alias("c"), F.col("c").alias("to")), "c").select("id", F.col("to").alias("c")))[1]
        level = ws.write(label.select(F.col("c").alias("v")).distinct())[1]
        after = level.count()
        if after == before:
            break
        before = after
        a = arcs.join(label.select(F.col("v").alias("u"), F.col("c").alias("cu")), "u").join(label.select("v", F.col("c").alias("cv")), "v")
        arcs = ws.write(a.groupBy(F.col("cu").alias("u"), F.col("cv").alias("v")).agg(F.sum("w").alias("w")))[1]
    return member.withColumnRenamed("c", "community")


def components(store: GraphStore, edge_types: Collection[str] = STRUCTURAL_EDGES, no_nodes: Collection[str] = ("community",)) -> DataFrame:
    """(id, community): connected components, named by their smallest id.

    Alternates large-star and small-star steps, which halve the distance to the
    smallest id each time; the edge set is cut by writing it out.
    """
    ws = Workspace(store.nodes.sparkSession, "components")
    g = store.pruned(no_nodes)
    pairs = g.edges.where(F.col("type").isin(*edge_types) & (F.col("src") != F.col("dst"))).select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    e = ws.write(pairs)[1]
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        low = low.select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u <> v")
        new = small.unionByName(low2.select("u", F.col("m").alias("v"))).distinct()
        new = ws.write(new)[1]
        changed = new.exceptAll(e).limit(1).count() or e.exceptAll(new).limit(1).count()
        e = new
        if not changed:
            break
    return g.nodes.select("id").join(e.select(F.col("u").alias("id"), F.col("v").alias("community")), "id", "left").select("id", F.coalesce("community", "id").alias("community"))


def named(partition: DataFrame) -> DataFrame:
    """(community_id, members) of (id, community); members in order."""
    groups = partition.groupBy("community").agg(F.array_sort(F.collect_list("id")).alias("members"))
    return groups.select(community_id(F.col("members")).alias("community_id"), "members")


def overlay(communities: DataFrame, summaries: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Community nodes (label = title, attrs) and ``contains`` edges to their members."""
    c = communities
    if summaries is not None:
        c = c.join(summaries.select("community_id", "title", "summary"), "community_id", "left")
    else:
        c = c.withColumn("title", F.col("community_id")).withColumn("summary", F.lit(""))
    attrs = F.create_map(F.lit("title"), F.coalesce("title", "community_id"), F.lit("summary"), F.coalesce("summary", F.lit("")), F.lit("members"), F.size("members").cast("string"))
    base = F.xxhash64("community_id")
    nodes = c.select(F.col("community_id").alias("id"), F.lit("community").alias("type"), F.coalesce("title", "community_id").alias("label"), attrs.alias("attrs"), base.alias("ord"))
    edges = c.select(F.col("community_id").alias("src"), F.posexplode("members").alias("i", "dst")).select(
        "src", "dst", F.lit("contains").alias("type"), F.create_map().cast("map<string,string>").alias("attrs"), F.xxhash64("src", "dst").alias("ord")
    )
    return nodes, edges


def extractive_summaries(communities: DataFrame, member_text: DataFrame, done: DataFrame | None = None, n: int = 5) -> DataFrame:
    """(community_id, title, summary): the default summariser lists the first members by id.

    ``member_text`` is (id, text); a member without text shows its id.  Communities
    already in ``done`` (community_id) are left out: the id is a hash of the members,
    so an unchanged community needs no new summary.
    """
    todo = communities.join(done.select("community_id"), "community_id", "left_anti") if done is not None else communities
    rows = todo.select("community_id", F.size("members").alias("size"), F.posexplode(F.slice("members", 1, n)).alias("i", "id"))
    shown = rows.join(member_text.select("id", "text"), "id", "left").groupBy("community_id", "size").agg(
        F.array_sort(F.collect_list(F.struct("i", F.coalesce("text", "id").alias("t")))).alias("ts")
    )
    return shown.select(
        "community_id", F.col("ts")[0]["t"].alias("title"),
        F.concat(F.array_join(F.transform("ts", lambda x: x["t"]), "; "), F.lit(" ("), F.col("size").cast("string"), F.lit(")")).alias("summary"),
    )


def modularity(partition: DataFrame, store: GraphStore, edge_types: Collection[str] = STRUCTURAL_EDGES) -> DataFrame:
    """One row (modularity) of a partition over the structural edges."""
    pairs = store.edges.where(F.col("type").isin(*edge_types) & (F.col("src") != F.col("dst"))).select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    p = partition.select("id", "community")
    x = pairs.join(p.select(F.col("id").alias("u"), F.col("community").alias("cu")), "u").join(p.select(F.col("id").alias("v"), F.col("community").alias("cv")), "v")
    ends = x.select(F.col("cu").alias("c"), (F.col("cu") == F.col("cv")).cast("long").alias("inside")).unionByName(x.select(F.col("cv").alias("c"), (F.col("cu") == F.col("cv")).cast("long").alias("inside")))
    m2 = ends.agg(F.count(F.lit(1)).cast("double").alias("m")).scalar()
    per = ends.groupBy("c").agg(F.sum("inside").alias("i"), F.count(F.lit(1)).alias("d"))
    return per.agg(F.sum(F.col("i") / m2 - (F.col("d") / m2) * (F.col("d") / m2)).alias("modularity"))


def histogram(communities: DataFrame) -> DataFrame:
    return communities.groupBy(F.size("members").alias("size")).agg(F.count(F.lit(1)).alias("n_communities"))
