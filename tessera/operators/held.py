"""The graph arm in tasks that hold the graph, each for a share of the questions.

The same results as by joins (``balls.py``): what questions reach is bits beside the
nodes, their similar nodes come from postings, and costs are sums of lengths, so texts
are made of the kept segments alone.  No row of a question and a node is moved before.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.intask import _columns, numbered
from tessera.workspace import Workspace

#: Questions that one task answers before another copy of the graph is read.
QUESTIONS = 256
#: Bytes of bits of a block of questions in a task, and arcs that are followed together.
BITS, ARCS = 1 << 26, 1 << 18


def _blobs(df: DataFrame, kind: str) -> DataFrame:
    """(kind, blob): rows of a table as a few binaries, which many tasks read cheaply."""

    def pack(parts: Iterator):
        import pyarrow as pa

        for p in parts:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, p.schema) as out:
                out.write_batch(p)
            yield pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["kind", "blob"])

    return df.mapInArrow(pack, "kind string, blob binary")


def _opened(parts: Iterator) -> dict:
    import pyarrow as pa

    found: dict = {}
    for p in parts:
        for kind, blob in zip(p.column("kind").to_pylist(), p.column("blob")):
            found.setdefault(kind, []).append(pa.ipc.open_stream(blob.as_buffer()).read_all())
    return {k: pa.concat_tables(v) for k, v in found.items()}


def _shared(ws: Workspace, common: list[tuple[DataFrame, str]], own: list[tuple[DataFrame, str]], count: int) -> DataFrame:
    """For each task the common tables and its share of the others, by ``q``; nothing is shuffled."""
    shares = max(1, min(ws.spark.sparkContext.defaultParallelism, -(-count // QUESTIONS)))
    held = None
    for df, kind in common:
        x = _blobs(df, kind)
        held = x if held is None else held.unionByName(x)
    held = ws.write(held)[1]
    rows = held.where("kind = ''")  # no rows, but without it Spark takes the single partitions for one
    for k in range(shares):
        one = held
        for df, kind in own:
            one = one.unionByName(_blobs(df.where(F.col("q") % shares == k), kind))
        rows = rows.unionByName(one.coalesce(1))
    return rows


class _Postings:
    """Nodes by the buckets of their labels, and the bags of questions."""

    def __init__(self, got: dict, n: int):
        import numpy as np

        node, bucket, c, norm = _columns(got["posting"].to_batches() if "posting" in got else [], ["n", "bucket", "c", "norm"])
        order = np.argsort(bucket, kind="stable")
        self.node, self.c, self.norm = node[order].astype(np.int32), c[order].astype(np.int32), np.zeros(n, np.int64)
        self.norm[node] = norm
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=1))]).tolist()
        self.bags: dict = {}
        for q, b, x, own in zip(*(v.tolist() for v in _columns(got["bag"].to_batches() if "bag" in got else [], ["q", "bucket", "c", "norm"]))):
            self.bags.setdefault(q, (own, []))[1].append((b, x))

    def scores(self, q: int, kept=None):
        """(nodes, cosines) of the nodes that share a word with a question, of those that are ``kept``."""
        import numpy as np

        own, words = self.bags.get(q, (0, []))
        at = [(slice(self.begin[b], self.begin[b + 1]), x) for b, x in words if b + 1 < len(self.begin)]
        if not at:
            return np.zeros(0, np.int32), np.zeros(0)
        node, dot = np.concatenate([self.node[s] for s, _ in at]), np.concatenate([self.c[s] * x for s, x in at])
        if kept is not None:
            some = kept(node)
            node, dot = node[some], dot[some]
        node, row = np.unique(node, return_inverse=True)
        return node, np.bincount(row, weights=dot, minlength=len(node)) / np.sqrt((own * self.norm[node]).astype(np.float64))


def nearest(ws: Workspace, asked: DataFrame, index: DataFrame, k: int, tie: DataFrame) -> DataFrame:
    """(query_id, key, score, rank): as ``similarity.nearest``; tie (key, ord) of all keys that count."""
    names = numbered(ws, tie.select(F.col("key").alias("id")))
    by = tie.columns[1]
    nodes = tie.join(names, tie["key"] == names["id"]).select("n", F.col(by).cast("bigint").alias("tie"))
    postings = index.join(names.withColumnRenamed("id", "key"), "key").select("n", "bucket", F.col("c").cast("bigint").alias("c"), F.col("norm").cast("bigint").alias("norm"))
    numbers = numbered(ws, asked.select(F.col("query_id").alias("id")).distinct())
    bag = ws.write(asked.join(numbers, asked["query_id"] == numbers["id"]).select(F.col("n").alias("q"), "bucket", F.col("c").cast("bigint").alias("c"), F.col("norm").cast("bigint").alias("norm")))[1]

    def run(parts: Iterator):
        import numpy as np
        import pyarrow as pa

        got = _opened(parts)
        if "bag" not in got:
            return
        at, tie_ = _columns(got["node"].to_batches() if "node" in got else [], ["n", "tie"])
        ties = np.zeros(len(at), np.int64)
        ties[at] = tie_
        p, out = _Postings(got, len(at)), []
        for q in p.bags:
            node, score = p.scores(q)
            if len(node) > k:
                some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
                node, score = node[some], score[some]
            order = np.lexsort((ties[node], -score))[:k]
            out.append((np.full(len(order), q), node[order].astype(np.int64), score[order], np.arange(1, len(order) + 1, dtype=np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["q", "n", "score", "rank"])

    rows = _shared(ws, [(nodes, "node"), (postings, "posting")], [(bag, "bag")], numbers.count())
    best = ws.write(rows.mapInArrow(run, "q bigint, n bigint, score double, rank int"))[1]
    best = best.join(names.withColumnRenamed("id", "key"), "n").drop("n")
    return best.join(numbers.select(F.col("id").alias("query_id"), F.col("n").alias("q")), "q").select("query_id", "key", "score", "rank")


def _spread(near, row, to):
    """Bits of nodes with those of their neighbours; arcs (row, to) by row."""
    import numpy as np

    out, live = near.copy(), near.any(axis=1)
    for lo in range(0, len(to), ARCS):
        at = lo + np.flatnonzero(live[to[lo : lo + ARCS]])
        if len(at):
            r = row[at]
            first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            out[r[first]] |= np.bitwise_or.reduceat(near[to[at]], first, axis=0)
    return out


def _first(order, bit, n: int, m: int):
    """The first ``m`` nodes of a ball in their order."""
    import numpy as np

    found, at, step = [], 0, 4096
    while at < n and sum(map(len, found)) < m:
        part = np.arange(at, min(n, at + step)) if order is None else order[at : at + step]
        found.append(part[bit(part)])
        at, step = at + step, step * 2
    return np.concatenate(found)[:m] if found else np.zeros(0, np.int64)


def segments(ws: Workspace, nodes: DataFrame, edges: DataFrame, index: DataFrame, asked: DataFrame, names: DataFrame, seeds: DataFrame, hops: int, attrs: list[bool], shown: str, pagerank: DataFrame | None, weight: float, first: int, first_cost: int) -> DataFrame:
    """(v, q, rank, text, source, score, cost, running_tokens): packed segments of all questions for each place v of ``attrs``.

    names (query_id, budget, n), seeds (id, n), bags of ``query_id`` and ``key``;
    ``shown`` is the SQL of the text of the attributes.
    """
    ids = numbered(ws, nodes)
    x = nodes.join(ids, "id")
    if pagerank is not None:
        x = x.join(pagerank, "id", "left")
    base = F.lit(0.0) if pagerank is None else F.lit(weight) * F.coalesce("pr", F.lit(0.0))
    factor, ranked = 1.0 if pagerank is None else 1 - weight, pagerank is not None
    more = F.expr(shown) if any(attrs) else F.lit(None).cast("string")
    node = x.select("n", "id", "label", more.alias("attrs"), base.alias("base"))
    end = lambda c: ids.select(F.col("id").alias(c), F.col("n").alias(f"{c}_n"))
    edge = edges.select("src", "dst", "type", "ord").join(end("src"), "src").join(end("dst"), "dst").select(F.col("src_n").cast("int").alias("src_n"), F.col("dst_n").cast("int").alias("dst_n"), "ord", "type")
    whole = lambda df, *cols: df.select(*[F.col(c).cast("bigint").alias(c) for c in cols])
    posting = whole(index.join(ids.withColumnRenamed("id", "key"), "key"), "n", "bucket", "c", "norm")
    number = names.select("query_id", F.col("n").alias("q"))
    bag = ws.write(whole(asked.join(F.broadcast(number), "query_id"), "q", "bucket", "c", "norm"))[1]
    question = whole(names.withColumnRenamed("n", "q"), "q", "budget")
    root = ws.write(whole(seeds.select("id", F.col("n").alias("q")).join(ids, "id"), "q", "n"))[1]

    def run(parts: Iterator):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        got = _opened(parts)
        if "question" not in got or "node" not in got:
            return
        t = got["node"].take(pa.array(np.argsort(got["node"].column("n").to_numpy()))).combine_chunks()
        n, text = t.num_rows, lambda c: pc.cast(t.column(c), pa.string()).combine_chunks()
        source, label, attr, base_of = text("id"), text("label"), text("attrs"), t.column("base").to_numpy()
        length = lambda a: pc.fill_null(pc.utf8_length(a), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        to_text, has, own_len, attr_len = pc.coalesce(label, source), pc.is_valid(label).to_numpy(zero_copy_only=False), length(label), length(attr)
        src, dst, ord_ = _columns(got["edge"].to_batches() if "edge" in got else [], ["src_n", "dst_n", "ord"])
        place = np.lexsort((dst, ord_, src))
        src, dst = src[place].astype(np.int32), dst[place].astype(np.int32)
        kinds = pc.dictionary_encode(got["edge"].column("type").combine_chunks()) if len(src) else None
        kinds = kinds.chunk(0) if isinstance(kinds, pa.ChunkedArray) else kinds
        code = kinds.indices.to_numpy()[place] if len(src) else dst
        kind = pc.cast(kinds.dictionary, pa.string()) if len(src) else pa.array([], pa.string())
        rel_len = length(kind)[code] + 1 + length(to_text)[dst] if len(src) else dst
        begin = np.concatenate([[0], np.cumsum(np.bincount(src, minlength=n))])
        row, to = np.concatenate([src, dst]), np.concatenate([dst, src])
        around = np.argsort(row, kind="stable")
        row, to = row[around], to[around]
        del around, place, ord_, kinds, got["edge" if len(src) else "node"]
        order = np.lexsort((np.arange(n), -base_of)) if ranked else None
        postings = _Postings(got, n)
        qs, budgets = _columns(got["question"].to_batches(), ["q", "budget"])
        roots: dict = {}
        for q, v in zip(*(c.tolist() for c in _columns(got["root"].to_batches() if "root" in got else [], ["q", "n"]))):
            roots.setdefault(q, []).append(v)
        many = 64 * max(1, min(16, BITS // (8 * n)))
        for lo in range(0, len(qs), many):
            block, out = qs[lo : lo + many].tolist(), []
            near = np.zeros((n, -(-len(block) // 64)), np.uint64)
            for i, q in enumerate(block):
                near[roots.get(q, []), i // 64] |= np.uint64(1 << i % 64)
            for _ in range(hops):
                near = _spread(near, row, to)
            for i, q in enumerate(block):
                if i % 64 == 0:
                    column = near[:, i // 64].copy()
                budget, mask = int(budgets[lo + i]), np.uint64(1 << i % 64)
                bit = lambda v: (column[v] & mask) != 0  # noqa: B023, E731
                own = np.array(roots.get(q, []), np.int64)
                alike, score = postings.scores(q, bit)
                score = factor * score + base_of[alike]
                score[np.isin(alike, own)] = 1.0
                m = first + budget // first_cost
                while True:
                    some = np.flatnonzero(score >= np.partition(score, len(score) - m)[len(score) - m]) if len(score) > m else slice(None)
                    begun = _first(order, bit, n, m)
                    v, s = np.concatenate([own, alike[some], begun]), np.concatenate([np.ones(len(own)), score[some], base_of[begun]])
                    best = np.lexsort((v, -s))
                    best = best[np.sort(np.unique(v[best], return_index=True)[1])][:m]
                    v, s = v[best], s[best]
                    each = begin[v + 1] - begin[v]
                    arcs = np.repeat(begin[v] - np.cumsum(each) + each, each) + np.arange(each.sum())
                    kept = bit(dst[arcs])
                    arcs, at = arcs[kept], np.repeat(np.arange(len(v)), each)[kept]
                    rels = np.bincount(at, minlength=len(v))
                    rel = np.bincount(at, weights=rel_len[arcs], minlength=len(v)).astype(np.int64) + 2 * np.maximum(rels - 1, 0)
                    fits = []
                    for a in attrs:
                        x = attr_len[v] if a else 0
                        cost = (own_len[v] + rel + x + 3 * np.maximum(has[v].astype(int) + (rel > 0) + (x > 0) - 1, 0) + 3) // 4
                        fits.append((cost, np.cumsum(cost)))
                    if len(v) < m or all(total[-1] > budget for _, total in fits):
                        break
                    m *= 4
                for which, (cost, total) in enumerate(fits):
                    keep = min(len(v), max(1, int(np.searchsorted(total, budget, "right"))))
                    out.append((which, q, v[:keep], s[:keep], cost[:keep], total[:keep], rels[:keep], arcs[: int(rels[:keep].sum())]))
                if sum(len(o[2]) for o in out) > 50_000 or i + 1 == len(block):
                    sizes = [len(o[2]) for o in out]
                    v, s, cost, total, rels, arcs = (np.concatenate(c) for c in list(zip(*out))[2:])
                    which, asks = np.repeat([o[0] for o in out], sizes), np.repeat([o[1] for o in out], sizes)
                    rank = np.concatenate([np.arange(1, c + 1) for c in sizes])
                    rel = pc.binary_join_element_wise(kind.take(pa.array(code[arcs])), to_text.take(pa.array(dst[arcs])), " ") if len(arcs) else pa.array([], pa.string())
                    offsets = pa.array(np.concatenate([[0], np.cumsum(rels)]).astype(np.int32))
                    joined = pc.binary_join(pa.ListArray.from_arrays(offsets, rel), "; ")
                    more = pc.if_else(pa.array(np.array(attrs)[which]), attr.take(pa.array(v)), pa.scalar(None, pa.string()))
                    blank = lambda a: pc.if_else(pc.equal(a, ""), pa.scalar(None, pa.string()), a)
                    full = pc.binary_join_element_wise(label.take(pa.array(v)), blank(joined), blank(more), " — ", null_handling="skip")
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(which, pa.int32()), pa.array(asks, pa.int64()), pa.array(rank, pa.int32()), full, source.take(pa.array(v)), pa.array(s), pa.array(cost, pa.int64()), pa.array(total, pa.int64())],
                        names=["v", "q", "rank", "text", "source", "score", "cost", "running_tokens"],
                    )
                    out = []

    rows = _shared(ws, [(node, "node"), (edge, "edge"), (posting, "posting")], [(bag, "bag"), (question, "question"), (root, "root")], names.count())
    return rows.mapInArrow(run, "v int, q bigint, rank int, text string, source string, score double, cost bigint, running_tokens bigint")
