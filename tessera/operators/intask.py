"""Searches and moves over a graph that one task holds.

A search or a round of moves over such a graph takes seconds, while a round of
joins moves most of the graph between tasks.  Nodes are numbers in the order of
their ids.  Graphs of more than ``IN_TASK`` arcs take the rounds of joins.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.workspace import Workspace, shuffle_partitions

IN_TASK = 16_000_000
#: Pairs that one task searches before another copy of the graph is read.
PAIRS = 1000
#: A goal of more pairs than this is searched once from the goal, not once for each pair.
SHARED = 8
#: Arcs that make a node a hub for the moves.
MANY = 500


def numbered(ws: Workspace, ids: DataFrame) -> DataFrame:
    """(id, n): distinct ids with their place in their order, from 0."""
    rows = ids.select("id").repartitionByRange(shuffle_partitions(ws.spark), "id").sortWithinPartitions("id").withColumn("m", F.monotonically_increasing_id())
    rows = ws.write(rows.select("id", F.shiftright("m", 33).alias("part"), (F.col("m") % (1 << 33)).alias("i")))[1]
    count = F.count(F.lit(1))
    before = rows.groupBy("part").agg(count.alias("own")).select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("before"))
    return ws.write(rows.join(F.broadcast(before), "part").select("id", (F.col("before") + F.col("i")).alias("n")))[1]


def coded(ws: Workspace, pairs: DataFrame, names: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b): the numbers of two columns of ids."""
    x = pairs.select(F.col(a).alias("a_id"), F.col(b).alias("b_id")).join(names.select(F.col("id").alias("a_id"), F.col("n").alias("a")), "a_id")
    return ws.write(x.join(names.select(F.col("id").alias("b_id"), F.col("n").alias("b")), "b_id").select("a", "b"))[1]


def _columns(parts: Iterator, names: list[str]) -> list:
    import numpy as np

    got = [[p.column(c).to_numpy(zero_copy_only=False).copy() for c in names] for p in parts if p.num_rows]
    return [np.concatenate(x) for x in zip(*got)] if got else [np.zeros(0, np.int64) for _ in names]


# -- paths ---------------------------------------------------------------------------------


def _starts(a, b, n: int):
    """Arcs by their start: where those of a node begin, and where they lead."""
    import numpy as np

    return np.concatenate([[0], np.cumsum(np.bincount(a, minlength=n))]), b[np.argsort(a, kind="stable")]


def _reached(front, begin, to):
    import numpy as np

    count = begin[front + 1] - begin[front]
    at = np.repeat(begin[front] - np.cumsum(count) + count, count) + np.arange(count.sum())
    return np.unique(to[at])


def _grown(level: list, hops, arcs: tuple):
    new = _reached(level[-1], *arcs)
    new = new[hops[new] < 0]
    hops[new] = len(level)
    level.append(new)
    return new


def _walk(start: int, layers: list, left: int, hops, begin, to) -> list[int]:
    """From ``start`` always to the smallest next node: through ``layers``, then down the ``hops`` to the goal from ``left``."""
    import numpy as np

    path = [start]
    for layer in layers:
        t = to[begin[path[-1]] : begin[path[-1] + 1]]
        path.append(int(t[np.isin(t, layer)].min()))
    for h in range(left - 1, -1, -1):
        t = to[begin[path[-1]] : begin[path[-1] + 1]]
        path.append(int(t[hops[t] == h].min()))
    return path


def _searches(a, b, n: int, pairs: list, most: int | None) -> Iterator[list[int]]:
    """The smallest of the shortest paths of each pair (start, goal) that has one, of at most ``most`` arcs."""
    from itertools import groupby

    import numpy as np

    ahead, behind = _starts(a, b, n), _starts(b, a, n)
    far, near = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
    work = lambda level, arcs: int((arcs[0][level[-1] + 1] - arcs[0][level[-1]]).sum())
    for goal, of in groupby(sorted(pairs, key=lambda p: p[1]), key=lambda p: p[1]):
        starts = [s for s, _ in of]
        if len(starts) > SHARED:
            near[goal], back, own = 0, [np.array([goal])], np.array(starts)
            while len(back[-1]) and (most is None or len(back) <= most) and (near[own] < 0).any():
                _grown(back, near, behind)
            yield from (_walk(s, [], int(near[s]), near, *ahead) for s in starts if near[s] >= 0)
            near[np.concatenate(back)] = -1
            continue
        for start in starts:
            out, back = [np.array([start])], [np.array([goal])]
            far[start] = near[goal] = 0
            met = out[0][out[0] == goal]
            while not len(met) and len(out[-1]) and len(back[-1]) and (most is None or len(out) + len(back) - 2 < most):
                if work(out, ahead) <= work(back, behind):  # a level of the side with fewer arcs
                    new = _grown(out, far, ahead)
                    met = new[near[new] >= 0]
                else:
                    new = _grown(back, near, behind)
                    met = new[far[new] >= 0]
            if len(met):
                layers = [met]
                for h in range(len(out) - 2, 0, -1):
                    x = _reached(layers[0], *behind)
                    layers.insert(0, x[far[x] == h])
                yield _walk(start, layers if len(out) > 1 else [], len(back) - 1, near, *ahead)
            far[np.concatenate(out)] = -1
            near[np.concatenate(back)] = -1


def paths(ws: Workspace, arcs: DataFrame, names: DataFrame, pairs: DataFrame, most: int | None) -> DataFrame:
    """(src, dst, path) of distinct pairs (src, dst) of ids over distinct arcs (src, dst); names (id, n) of all nodes."""
    links, asked, n = coded(ws, arcs, names, "src", "dst"), coded(ws, pairs, names, "src", "dst"), names.count()
    shares = min(ws.spark.sparkContext.defaultParallelism, 1 + asked.count() // PAIRS)

    def run(parts):
        import numpy as np
        import pyarrow as pa

        a, b, pair = _columns(parts, ["a", "b", "pair"])
        own, is_pair = list(zip(a[pair].tolist(), b[pair].tolist())), pair
        a, b = a[~is_pair].astype(np.int32), b[~is_pair].astype(np.int32)
        found = list(_searches(a, b, n, own, most)) if own else []
        yield pa.RecordBatch.from_arrays(
            [pa.array([p[0] for p in found], pa.int64()), pa.array([p[-1] for p in found], pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["a", "b", "path"]
        )

    # each task reads the arcs as they are: nothing is shuffled
    rows = links.where("a < 0").withColumn("pair", F.lit(False))  # no rows, but without it Spark takes the single partitions for one
    for k in range(shares):
        own = asked.where(F.pmod(F.xxhash64("b"), F.lit(shares)) == k).withColumn("pair", F.lit(True))
        rows = rows.unionByName(links.withColumn("pair", F.lit(False)).unionByName(own).coalesce(1))
    found = ws.write(rows.mapInArrow(run, "a bigint, b bigint, path array<bigint>"))[1]
    steps = found.select("a", "b", F.posexplode("path").alias("i", "n")).join(names, "n")
    named = steps.groupBy("a", "b").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "id"))), lambda x: x["id"]).alias("path"))
    return named.select(F.col("path")[0].alias("src"), F.element_at("path", -1).alias("dst"), "path")


# -- communities ---------------------------------------------------------------------------


def _summed(keys, w):
    """Distinct keys in order, with the sums of their weights."""
    import numpy as np

    order = np.argsort(keys)
    keys = keys[order]
    if not len(keys):
        return keys, w
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(w[order], first)


def _level(u, v, w, n: int, total: int, rounds: int | None) -> list[int] | None:
    """The community of each node when none would gain by a move, or None after ``rounds``, if given.

    Nodes move one after another, so modularity rises with each move and the moves end.
    A round takes the nodes whose neighbours have moved; without any it looks for nodes
    that would gain, and there it ends if there are none.  Gains are whole numbers:
    ``total`` times the weight into a community less the product of the degrees.

    A node whose neighbours stay can gain only by changed sizes, and a size changes by
    the degrees that move: until these make up for what it would lose, it isn't looked at.
    """
    from itertools import count

    import numpy as np

    degree = np.bincount(u, weights=w, minlength=n).astype(np.int64)
    apart = np.flatnonzero(u != v)
    apart = apart[np.argsort(u[apart], kind="stable")]
    u, to, w, k = u[apart], v[apart], w[apart], degree.tolist()
    first = np.concatenate([[0], np.cumsum(np.bincount(u, minlength=n))])
    many, begin = np.diff(first) > MANY, first.tolist()
    hub = bytearray(many.astype(np.uint8))  # looked at again only where it would gain, not after each move around it
    c, size, sweep, waits = list(range(n)), list(k), range(n), bytearray(hub)
    at, large = np.arange(n), degree.copy()  # c and size once more
    stale, until, moved = np.ones(n, bool), np.zeros(n, np.int64), 0  # a neighbour or the node has moved; the moved degree up to which it can't gain
    for _ in count() if rounds is None else range(rounds):
        if not sweep:
            for part in (~many, many):
                due = np.flatnonzero(part & (stale | (until < moved)))
                slack = _slack(due, first, to, w, degree, at, large, total)
                stale[due], until[due] = False, moved + slack // np.maximum(2 * degree[due], 1)
                sweep = due[slack < 0].tolist()
                if sweep:
                    break
            else:
                return c
        again = set()
        for i in sweep:
            waits[i] = 1
        for i in sweep:
            waits[i] = hub[i]
            lo, hi = begin[i], begin[i + 1]
            near: dict[int, int] = {}
            beside = to[lo:hi].tolist()
            for j, x in zip(beside, w[lo:hi].tolist()):
                near[c[j]] = near.get(c[j], 0) + x
            own, deg = c[i], k[i]
            stay = best = total * near.pop(own, 0) - deg * (size[own] - deg)
            goal = own
            for to_c, x in near.items():
                gain = total * x - deg * size[to_c]
                if gain > best or gain == best > stay and to_c < goal:
                    best, goal = gain, to_c
            if goal != own:
                c[i] = at[i] = goal
                size[own] -= deg
                size[goal] += deg
                large[own], large[goal] = size[own], size[goal]
                moved += deg
                stale[to[lo:hi]] = stale[i] = True
                again.update(j for j in beside if c[j] != goal and not waits[j])
        sweep = sorted(again)
    return None


def _slack(some, first, to, w, degree, c, size, total: int):
    """What each of some nodes would lose at least by a move, all looked at together; below zero it would gain."""
    import numpy as np

    n, each = len(c), first[some + 1] - first[some]
    row = np.repeat(np.arange(len(some)), each)
    arcs = np.repeat(first[some] - np.cumsum(each) + each, each) + np.arange(each.sum())
    key, near = _summed(row * n + c[to[arcs]], w[arcs])
    row, goal = key // n, key % n
    own, deg = goal == c[some][row], degree[some]
    stay = -deg * (size[c[some]] - deg)
    stay[row[own]] += total * near[own]
    best = np.full(len(some), np.iinfo(np.int64).min // 2)
    np.maximum.at(best, row[~own], total * near[~own] - deg[row[~own]] * size[goal[~own]])
    return stay - best


def _louvain(u, v, n: int, rounds: int | None):
    """The community of each node, the number of one of its nodes; None if a level isn't done after ``rounds``, if given."""
    import numpy as np

    u, v = np.concatenate([u, v]), np.concatenate([v, u])
    w = np.ones(len(u), np.int64)
    total, name, member = len(u), np.arange(n), np.arange(n)
    while True:
        c = _level(u, v, w, len(name), total, rounds)
        if c is None:
            return None
        kept, c = np.unique(np.array(c), return_inverse=True)
        member, name = c[member], name[kept]
        if len(kept) == len(c):
            return name[member]
        key, w = _summed(c[u] * len(kept) + c[v], w)
        u, v = key // len(kept), key % len(kept)


def communities(ws: Workspace, pairs: DataFrame, rounds: int | None) -> DataFrame | None:
    """(id, c) of the ends of distinct undirected pairs (u, v) of unlike ids; None if a level isn't done after ``rounds``, if given."""
    ends = ws.write(pairs.select(F.col("u").alias("id")).unionByName(pairs.select(F.col("v").alias("id"))).distinct())[1]
    names = numbered(ws, ends)
    links, n = coded(ws, pairs, names, "u", "v"), names.count()

    def run(parts):
        import numpy as np
        import pyarrow as pa

        c = _louvain(*_columns(parts, ["a", "b"]), n, rounds)
        own = np.array([-1]) if c is None else np.arange(n)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(own if c is None else c, pa.int64())], names=["n", "c"])

    found = ws.write(links.coalesce(1).mapInArrow(run, "n bigint, c bigint"))[1]
    if not found.where("n < 0").isEmpty():
        return None
    return found.join(names, "n").select("id", "c").join(names.select(F.col("n").alias("c"), F.col("id").alias("to")), "c").select("id", F.col("to").alias("c"))
