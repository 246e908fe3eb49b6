"""Registered queries of the graph engine, with the same results in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.model import OVERLAY_EDGES, OVERLAY_NODES
from tessera.operators import chunks as ch
from tessera.operators import code as cd
from tessera.operators import community as co
from tessera.operators import evaluation as ev
from tessera.operators import extraction as ex
from tessera.operators import retrieval as rt
from tessera.operators.similarity import DIMENSIONS, vector_top_k
from tessera.operators.store import GraphStore, first_seen, last_wins
from tessera.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
BUDGET = 1000
HOPS = 2
PR_ROUNDS = 20


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


# -- the graph of the test tables ----------------------------------------------------------


def store(spark: SparkSession, d: str) -> GraphStore:
    cols = ["id", "type", "label", "attrs", "ord", "deleted_at"]
    nodes = table(spark, d, "nodes").select(*cols).unionByName(table(spark, d, "core_nodes").select(*cols))
    return GraphStore.from_arrivals(nodes, table(spark, d, "edges"))


_G = """
    all_nodes AS (SELECT id, type, label, attrs, ord, deleted_at FROM nodes UNION ALL SELECT id, type, label, attrs, ord, deleted_at FROM core_nodes),
    n AS MATERIALIZED (SELECT id, type, label, attrs, ord FROM (
      SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord DESC) AS rn FROM all_nodes WHERE id IS NOT NULL) WHERE rn = 1 AND deleted_at IS NULL),
    e AS MATERIALIZED (SELECT src, dst, type, attrs, ord FROM (
      SELECT *, row_number() OVER (PARTITION BY src, dst, type ORDER BY ord DESC) AS rn FROM edges WHERE src IS NOT NULL AND dst IS NOT NULL AND type IS NOT NULL)
      WHERE rn = 1 AND src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)),
    pn AS MATERIALIZED (SELECT * FROM n WHERE type <> 'community'),
    pe AS MATERIALIZED (SELECT * FROM e WHERE type <> 'contains' AND src IN (SELECT id FROM pn) AND dst IN (SELECT id FROM pn))"""


def _khop(seeds: str, hops: int, nodes: str, edges: str) -> str:
    """Unrolled expansion: seeds (query_id, id) to reach (query_id, id, hop)."""
    s = f"adj AS MATERIALIZED (SELECT DISTINCT src AS id, dst AS t FROM {edges} UNION SELECT DISTINCT dst, src FROM {edges}), "
    s += f"r0 AS MATERIALIZED (SELECT DISTINCT query_id, id, 0 AS hop FROM {seeds} WHERE id IN (SELECT id FROM {nodes}))"
    for h in range(1, hops + 1):
        s += f""", r{h} AS MATERIALIZED (SELECT query_id, id, min(hop) AS hop FROM (SELECT * FROM r{h - 1}
            UNION ALL SELECT r.query_id, adj.t, {h} FROM r{h - 1} r JOIN adj ON adj.id = r.id WHERE r.hop = {h - 1}) GROUP BY query_id, id)"""
    return s + f", reach AS MATERIALIZED (SELECT * FROM r{hops})"


def _one(spark: SparkSession, node: str) -> DataFrame:
    return spark.range(1).select(F.lit("q").alias("query_id"), F.lit(node).alias("id"))


# -- store ---------------------------------------------------------------------------------


@query("""SELECT id, type, label, ord FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord DESC) AS rn FROM nodes WHERE id IS NOT NULL) WHERE rn = 1""")
def upsert_nodes_last_wins(spark, d):
    return last_wins(table(spark, d, "nodes").where("id is not null"), ["id"]).select("id", "type", "label", "ord")


@query("""SELECT src, dst, type, ord, coalesce(attrs['confidence'], '') AS confidence
    FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, type ORDER BY ord DESC) AS rn FROM edges) WHERE rn = 1""")
def upsert_edges_last_wins(spark, d):
    e = last_wins(table(spark, d, "edges"), ["src", "dst", "type"])
    return e.select("src", "dst", "type", "ord", F.coalesce(F.try_element_at("attrs", F.lit("confidence")), F.lit("")).alias("confidence"))


@query("""SELECT src, dst, type, min(ord) AS ord FROM edges GROUP BY src, dst, type""")
def dedupe_edges_first(spark, d):
    return first_seen(table(spark, d, "edges").select("src", "dst", "type", "ord"), ["src", "dst", "type"])


@query(f"""WITH {_G} SELECT 'node' AS what, type, count(*) AS n FROM n GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM e GROUP BY type""")
def kind_counts(spark, d):
    g = store(spark, d)
    count = F.count(F.lit(1)).alias("n")
    n = g.nodes.groupBy("type").agg(count).select(F.lit("node").alias("what"), "type", "n")
    return n.unionByName(g.edges.groupBy("type").agg(count).select(F.lit("edge").alias("what"), "type", "n"))


_SEED = "seeds AS (SELECT 'q' AS query_id, 'fogo' AS id)"


@query(f"WITH {_G}, {_SEED}, {_khop('seeds', 2, 'n', 'e')} SELECT query_id, id, hop FROM reach")
def khop_subgraph(spark, d):
    return store(spark, d).stored().subgraph(_one(spark, "fogo"), 2).nodes.select("query_id", "id", "hop")


@query(f"WITH {_G}, seeds AS (SELECT id AS query_id, id FROM pn WHERE ord % 50 = 0), {_khop('seeds', 1, 'pn', 'pe')} SELECT query_id, id, hop FROM reach")
def khop_subgraph_excluding(spark, d):
    g = store(spark, d).pruned(OVERLAY_NODES, OVERLAY_EDGES)
    return g.reach(g.nodes.where("ord % 50 = 0").select(F.col("id").alias("query_id"), "id"), 1)


@query(f"""WITH {_G}, {_SEED}, {_khop('seeds', 1, 'n', 'e')}
    SELECT src, dst, type FROM e WHERE src IN (SELECT id FROM reach) AND dst IN (SELECT id FROM reach)""")
def neighbors_induced_edges(spark, d):
    return store(spark, d).neighbors("fogo", 1).edges.select("src", "dst", "type")


@query(f"WITH {_G}, seeds AS (SELECT 'q' AS query_id, id FROM core_nodes), {_khop('seeds', 1, 'n', 'e')} SELECT id, hop FROM reach")
def multi_seed_union(spark, d):
    seeds = table(spark, d, "core_nodes").select(F.lit("q").alias("query_id"), "id")
    return store(spark, d).reach(seeds, 1).select("id", "hop")


def _paths_sql(pairs: str, nodes: str, edges: str) -> str:
    """Backwards from each goal, level by level, until nothing new is met; needs WITH RECURSIVE."""
    return f"""arcs AS MATERIALIZED (SELECT DISTINCT src, dst FROM {edges}), ends AS MATERIALIZED (SELECT * FROM {pairs} WHERE src IN (SELECT id FROM {nodes}) AND dst IN (SELECT id FROM {nodes})),
      back(goal, id, path) USING KEY (goal, id) AS (SELECT DISTINCT dst, dst, [dst] FROM ends
        UNION SELECT b.goal, arcs.src, min(list_prepend(arcs.src, b.path)) FROM back b JOIN arcs ON arcs.dst = b.id
          WHERE NOT EXISTS (SELECT 1 FROM recurring.back k WHERE k.goal = b.goal AND k.id = arcs.src) GROUP BY b.goal, arcs.src),
      paths AS MATERIALIZED (SELECT e.query_id, b.path FROM ends e JOIN back b ON b.goal = e.dst AND b.id = e.src)"""


@query(f"""WITH RECURSIVE {_G}, pairs AS (SELECT id AS query_id, id AS src, 'fogo' AS dst FROM n WHERE ord % 50 = 0), {_paths_sql('pairs', 'n', 'e')}
    SELECT query_id, array_to_string(path, ' > ') AS path FROM paths""")
def shortest_path(spark, d):
    g = store(spark, d).stored()
    pairs = g.nodes.where("ord % 50 = 0").select(F.col("id").alias("query_id"), F.col("id").alias("src"), F.lit("fogo").alias("dst"))
    return g.shortest_paths(pairs).select("query_id", F.array_join("path", " > ").alias("path"))


def _pagerank_sql(rounds: int) -> str:
    s = """typed AS (SELECT src AS u, dst AS v, type FROM e UNION SELECT dst, src, type FROM e),
      wts AS (SELECT u, v, count(*)::DOUBLE AS w FROM typed GROUP BY u, v),
      share AS MATERIALIZED (SELECT u, v, w / sum(w) OVER (PARTITION BY u) AS s FROM wts),
      nn AS MATERIALIZED (SELECT count(*)::DOUBLE AS c FROM n),
      p0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / c AS p, id IN (SELECT u FROM share) AS linked FROM n, nn)"""
    for i in range(1, rounds + 1):
        s += f""", p{i} AS MATERIALIZED (SELECT a.id, 0.15 / c + 0.85 * (coalesce(g, 0) + (SELECT coalesce(sum(p), 0) FROM p{i - 1} WHERE NOT linked) / c) AS p, a.linked
          FROM p{i - 1} a CROSS JOIN nn LEFT JOIN (SELECT v, sum(p * s) AS g FROM share JOIN p{i - 1} ON p{i - 1}.id = share.u GROUP BY v) x ON x.v = a.id)"""
    return s + f", pr AS MATERIALIZED (SELECT id, p AS score FROM p{rounds})"


@query(f"WITH {_G}, {_pagerank_sql(PR_ROUNDS)} SELECT id, round(score, 9) AS score, round(score / (SELECT max(score) FROM pr), 6) AS share_of_max FROM pr")
def pagerank_full(spark, d):
    pr = store(spark, d).stored().pagerank(PR_ROUNDS, tolerance=None)
    best = pr.agg(F.max("score").alias("m")).scalar()
    return pr.select("id", F.round("score", 9).alias("score"), F.round(F.col("score") / best, 6).alias("share_of_max"))


_RELS = """rels AS (SELECT q.query_id, e.src AS id, string_agg(e.type || ' ' || coalesce(t.label, e.dst), '; ' ORDER BY e.ord) AS rels
      FROM {edges} e JOIN reach q ON q.id = e.src JOIN reach o ON o.id = e.dst AND o.query_id = q.query_id LEFT JOIN n t ON t.id = e.dst GROUP BY q.query_id, e.src)"""


@query(f"WITH {_G}, seeds AS (SELECT 'q' AS query_id, id FROM core_nodes), {_khop('seeds', 1, 'pn', 'pe')}, {_RELS.format(edges='pe')} SELECT id, rels FROM rels")
def relation_text(spark, d):
    seeds = table(spark, d, "core_nodes").select(F.lit("q").alias("query_id"), "id")
    return rt.relation_text(store(spark, d).stored().subgraph(seeds, 1, OVERLAY_NODES, OVERLAY_EDGES)).select("id", "rels")


# -- vectors -------------------------------------------------------------------------------

_COS = """scored AS (SELECT q.vec_id AS query_id, i.vec_id AS key,
      list_sum(list_transform(range(1, 65), lambda j: q.embedding[j]::DOUBLE * i.embedding[j]::DOUBLE))
        / (sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(i.embedding, lambda x: x::DOUBLE * x::DOUBLE)))) AS score, i.label, q.label AS ql
      FROM embeddings q, embeddings i WHERE q.vec_id % 50 = 0 AND q.vec_id <> i.vec_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, key) AS rank FROM scored)"""


def _vectors(spark: SparkSession, d: str, k: int) -> DataFrame:
    emb = table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector"), "label")
    q = emb.where("key % 50 = 0").select(F.col("key").alias("query_id"), "vector")
    best = vector_top_k(q, emb, k + 1).where("query_id <> key")
    from tessera.operators.similarity import top

    return top(best.drop("rank").withColumn("score", F.round("score", 9)), k, "key")


@query(f"WITH {_COS} SELECT query_id, key, rank, round(score, 6) AS score FROM ranked WHERE rank <= 5")
def vector_topk_batch(spark, d):
    return _vectors(spark, d, 5).select("query_id", "key", "rank", F.round("score", 6).alias("score"))


@query(f"WITH {_COS} SELECT query_id, round(avg((label = ql)::INT), 6) AS precision_at_10 FROM ranked WHERE rank <= 10 GROUP BY query_id")
def vector_label_precision(spark, d):
    labels = table(spark, d, "embeddings").select("vec_id", "label")
    x = _vectors(spark, d, 10).join(labels.select(F.col("vec_id").alias("key"), "label"), "key").join(labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id")
    return x.groupBy("query_id").agg(F.round(F.avg((F.col("label") == F.col("ql")).cast("int")), 6).alias("precision_at_10"))


# -- retrieval -----------------------------------------------------------------------------


def _asked(spark: SparkSession, d: str, budget: int = BUDGET, every: int = 1) -> DataFrame:
    """All questions, or every so many of them."""
    q = table(spark, d, "eval_queries")
    if every > 1:
        q = q.where(F.regexp_extract("id", r"(\d+)$", 1).cast("bigint") % every == 0)
    return q.select(F.col("id").alias("query_id"), F.col("question").alias("query"), F.lit(budget).alias("budget"))


def _retriever(spark: SparkSession, d: str) -> rt.Retriever:
    docs = table(spark, d, "documents").where("text is not null").select(
        F.concat_ws("#", F.coalesce("title", F.lit("untitled")), "doc_id").alias("label"), "text", F.col("doc_id").alias("ord")
    )
    return rt.Retriever(store(spark, d).bare().stored(), docs, hops=HOPS)


_TERMS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}]+')"
_BUCKET = f"(('0x' || substr(md5(w), 1, 8))::BIGINT % {DIMENSIONS})"


def _bag(name: str, source: str, key: str, text: str) -> str:
    return f"""{name}_c AS MATERIALIZED (SELECT key, {_BUCKET} AS b, count(*) AS c FROM (SELECT {key} AS key, unnest({_TERMS.format(text)}) AS w FROM {source}) GROUP BY ALL),
      {name} AS MATERIALIZED (SELECT *, sum(c * c) OVER (PARTITION BY key) AS norm FROM {name}_c)"""


def _sims(name: str, q: str, i: str) -> str:
    return f"""{name} AS MATERIALIZED (SELECT q.key AS query_id, i.key AS id, sum(q.c * i.c)::BIGINT / sqrt((q.norm::BIGINT * i.norm::BIGINT)::DOUBLE) AS score
      FROM {q} q JOIN {i} i ON i.b = q.b GROUP BY q.key, i.key, q.norm, i.norm)"""


def _ask(which: str) -> str:
    return f"""asked AS MATERIALIZED (SELECT id AS query_id, question AS query, {BUDGET} AS budget FROM eval_queries{which}),
    {_bag('qb', 'asked', 'query_id', 'query')}, {_bag('nb', 'n', 'id', 'label')}, {_sims('sim', 'qb', 'nb')}"""


_ASK, _ASK_SOME = _ask(""), _ask(" WHERE regexp_extract(id, '(\\d+)$', 1)::BIGINT % 50 = 0")
_ANCHORS = """seeds AS MATERIALIZED (SELECT query_id, id FROM (
      SELECT sim.query_id, sim.id, row_number() OVER (PARTITION BY sim.query_id ORDER BY sim.score DESC, n.ord) AS rn FROM sim JOIN n ON n.id = sim.id) WHERE rn <= 3)"""
_PACK = """packed AS MATERIALIZED (SELECT *, row_number() OVER w AS rank, sum(cost) OVER (w ROWS UNBOUNDED PRECEDING) AS running_tokens
      FROM (SELECT *, (length(text) + 3) // 4 AS cost FROM segments) WINDOW w AS (PARTITION BY query_id ORDER BY {order})),
    {name} AS MATERIALIZED (SELECT query_id, rank, text, source, score, cost, running_tokens FROM packed WHERE rank = 1 OR running_tokens <= {budget})"""


def _segments(score: str, attrs: bool, extra: str = "") -> str:
    shown = "CASE WHEN n.attrs IS NULL OR cardinality(n.attrs) = 0 THEN NULL ELSE array_to_string(list_sort(list_transform(map_entries(n.attrs), lambda x: x.key || ': ' || x.value)), '; ') END"
    return f"""segments AS MATERIALIZED (SELECT reach.query_id, concat_ws(' — ', n.label, rels{', ' + shown if attrs else ''}) AS text, n.id AS source, n.id,
      CASE WHEN s.id IS NOT NULL THEN 1.0 ELSE {score} END AS score
      FROM reach JOIN n ON n.id = reach.id LEFT JOIN rels ON rels.query_id = reach.query_id AND rels.id = reach.id
      LEFT JOIN sim ON sim.query_id = reach.query_id AND sim.id = reach.id LEFT JOIN seeds s ON s.query_id = reach.query_id AND s.id = reach.id {extra})"""


def _graph_sql(seeds: str, score: str = "coalesce(sim.score, 0)", attrs: bool = False, extra: str = "", before: str = "") -> str:
    return f"""WITH {_G}, {_ASK}, {seeds}, {before}{_khop('seeds', HOPS, 'pn', 'pe')}, {_RELS.format(edges='pe')}, {_segments(score, attrs, extra)},
      {_PACK.format(order='score DESC, source, id', name='out', budget=BUDGET)}"""


_SHOW = "SELECT query_id, rank, text, source, round(score, 6) AS score, cost, running_tokens::BIGINT AS running_tokens FROM {0}"


def _show(segments: DataFrame) -> DataFrame:
    return segments.select("query_id", "rank", "text", "source", F.round("score", 6).alias("score"), "cost", "running_tokens")


@query(f"{_graph_sql(_ANCHORS)} {_SHOW.format('out')}")
def graph_retrieve(spark, d):
    return _show(_retriever(spark, d).graph(_asked(spark, d)))


@query(f"{_graph_sql(_ANCHORS, attrs=True)} {_SHOW.format('out')}")
def graph_attrs_retrieve(spark, d):
    return _show(_retriever(spark, d).graph(_asked(spark, d), attrs=True))


@query(
    f"""{_graph_sql(_ANCHORS, "0.5 * coalesce(sim.score, 0) + 0.5 * coalesce(prn.pr, 0)", extra="LEFT JOIN prn ON prn.id = reach.id",
    before=_pagerank_sql(PR_ROUNDS) + ", prn AS MATERIALIZED (SELECT id, round(score / (SELECT max(score) FROM pr), 9) AS pr FROM pr), ")} {_SHOW.format('out')}"""
)
def graph_pagerank_retrieve(spark, d):
    r = _retriever(spark, d)
    return _show(r.graph(_asked(spark, d), pagerank=r.store.pagerank(PR_ROUNDS, tolerance=None)))


_DOCS = """docs AS MATERIALIZED (SELECT doc_id AS id, coalesce(title, 'untitled') || '#' || doc_id AS label, text FROM documents WHERE text IS NOT NULL)"""
_VECTOR = f"""{_DOCS}, {_bag('db', 'docs', 'id', 'text')}, {_sims('dsim', 'qb', 'db')},
    vbest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS found FROM dsim) WHERE found <= 5),
    vseg AS (SELECT v.query_id, d.text, d.label AS source, v.score, v.found, (length(d.text) + 3) // 4 AS cost FROM vbest v JOIN docs d ON d.id = v.id),
    vpack AS (SELECT *, sum(cost) OVER (PARTITION BY query_id ORDER BY found ROWS UNBOUNDED PRECEDING) AS running_tokens FROM vseg),
    vout AS MATERIALIZED (SELECT query_id, found AS rank, text, source, score, cost, running_tokens FROM vpack WHERE found = 1 OR running_tokens <= {BUDGET})"""


@query(f"WITH {_ASK_SOME.split(', ' + _bag('nb', 'n', 'id', 'label'))[0]}, {_VECTOR} {_SHOW.format('vout')}")
def vector_retrieve(spark, d):
    return _show(_retriever(spark, d).vector(_asked(spark, d, every=50)))


@query(
    f"""{_graph_sql(_ANCHORS)}, {_VECTOR},
    arms AS (SELECT query_id, 0 AS arm, rank, text, source FROM out UNION ALL SELECT query_id, 1, rank, text, source FROM vout),
    fused AS (SELECT query_id, lower(source) AS k, round(sum(1.0::DOUBLE / (60 + rank)), 12) AS score, first(text ORDER BY arm, rank) AS text, first(source ORDER BY arm, rank) AS source FROM arms GROUP BY ALL),
    fpack AS (SELECT *, row_number() OVER w AS rank, sum(cost) OVER (w ROWS UNBOUNDED PRECEDING) AS running_tokens FROM (SELECT *, (length(text) + 3) // 4 AS cost FROM fused)
      WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, source)),
    fout AS (SELECT * FROM fpack WHERE rank = 1 OR running_tokens <= {BUDGET}) {_SHOW.format('fout')}"""
)
def hybrid_rrf(spark, d):
    return _show(_retriever(spark, d).hybrid(_asked(spark, d)))


_ENTITIES = """ents AS MATERIALIZED (SELECT query_id, entity, min(pos) AS pos FROM (
      SELECT query_id, entity, pos FROM (SELECT query_id, unnest(l) AS entity, unnest(range(len(l))) AS pos
        FROM (SELECT query_id, regexp_extract_all(query, '(?i)(?:dec|adr)-[\\p{L}\\p{N}_-]+') || regexp_extract_all(query, '(?:^|[^\\p{L}\\p{N}_])([A-Z][\\p{L}\\p{N}_]{3,})', 1) AS l FROM asked)))
      GROUP BY query_id, entity)"""
_MULTI = f"""{_ENTITIES}, {_bag('eb', 'ents', "query_id || '#' || entity", 'entity')}, {_sims('esim', 'eb', 'nb')},
    ebest AS (SELECT ents.query_id, x.id FROM ents JOIN (SELECT esim.query_id, esim.id, row_number() OVER (PARTITION BY esim.query_id ORDER BY esim.score DESC, pn.ord) AS rn
      FROM esim JOIN pn ON pn.id = esim.id) x ON x.query_id = ents.query_id || '#' || ents.entity AND rn = 1),
    eone AS MATERIALIZED (SELECT DISTINCT query_id, id FROM ebest),
    efill AS (SELECT query_id, id FROM (SELECT sim.query_id, sim.id, row_number() OVER (PARTITION BY sim.query_id ORDER BY sim.score DESC, pn.ord) AS rn FROM sim JOIN pn ON pn.id = sim.id
      WHERE sim.query_id NOT IN (SELECT query_id FROM eone GROUP BY query_id HAVING count(*) >= 3)) WHERE rn <= 3),
    seeds AS MATERIALIZED (SELECT * FROM eone UNION SELECT * FROM efill)"""


@query(f"WITH {_G}, {_ASK_SOME}, {_MULTI} SELECT query_id, id FROM seeds")
def multi_anchor_seeds(spark, d):
    return _retriever(spark, d).entity_seeds(_asked(spark, d, every=50))


@query(f"{_graph_sql(_MULTI)} {_SHOW.format('out')}")
def multi_anchor_retrieve(spark, d):
    return _show(_retriever(spark, d).multi_anchor(_asked(spark, d)))


@query(
    f"""WITH RECURSIVE {_G}, {_ASK}, two AS (SELECT * FROM (SELECT sim.query_id, sim.id, row_number() OVER (PARTITION BY sim.query_id ORDER BY sim.score DESC, pn.ord) AS rn
      FROM sim JOIN pn ON pn.id = sim.id) WHERE rn <= 2),
    pairs AS MATERIALIZED (SELECT query_id, min_by(id, rn) AS src, max_by(id, rn) AS dst FROM two GROUP BY query_id), {_paths_sql('pairs', 'pn', 'pe')},
    walk AS (SELECT p.query_id, x.path IS NOT NULL AS linked, coalesce(x.path, CASE WHEN p.src = p.dst THEN [p.src] ELSE [p.src, p.dst] END) AS path FROM pairs p LEFT JOIN paths x USING (query_id)),
    steps AS (SELECT query_id, linked, len(path) AS len, path[i] AS id, CASE WHEN linked THEN path[i + 1] END AS nxt, i FROM (SELECT *, unnest(range(1, len(path) + 1)) AS i FROM walk)),
    rel AS (SELECT src, dst, max_by(type, ord) AS rel FROM pe GROUP BY src, dst),
    segments AS MATERIALIZED (SELECT s.query_id, n.label || CASE WHEN nxt IS NULL THEN '' ELSE ' —[' || coalesce(rel, '→') || ']→' END AS text, n.id AS source,
      (CASE WHEN i = 1 OR i = len THEN 1.0 ELSE 0.7 END)::DOUBLE AS score, i FROM steps s JOIN n ON n.id = s.id LEFT JOIN rel ON rel.src = s.id AND rel.dst = s.nxt),
    {_PACK.format(order='i', name='out', budget=BUDGET)} {_SHOW.format('out')}"""
)
def path_retrieve(spark, d):
    return _show(_retriever(spark, d).path(_asked(spark, d)))


@query(
    f"""{_graph_sql(_ANCHORS).replace(f"running_tokens <= {BUDGET}", f"running_tokens <= {rt.POOL_BUDGET}")},
    words AS (SELECT o.query_id, o.rank, o.text, o.source, list_distinct({_TERMS.format('a.query')}) AS qa, list_distinct({_TERMS.format('o.text')}) AS ta FROM out o JOIN asked a USING (query_id)),
    rscored AS (SELECT *, len(list_intersect(qa, ta))::DOUBLE / len(list_distinct(qa || ta)) AS score FROM words),
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS place FROM rscored) WHERE place <= 5),
    rp AS (SELECT query_id, place AS rank, text, source, score, (length(text) + 3) // 4 AS cost, sum((length(text) + 3) // 4) OVER (PARTITION BY query_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS running_tokens FROM best),
    rout AS (SELECT * FROM rp WHERE rank = 1 OR running_tokens <= {BUDGET}) {_SHOW.format('rout')}"""
)
def rerank_topk(spark, d):
    pool = _retriever(spark, d).graph(_asked(spark, d, rt.POOL_BUDGET))
    return _show(rt.rerank(pool, _asked(spark, d), 5))


@query(
    f"""WITH s AS (SELECT doc_id AS query_id, regexp_replace(l.x, '^ +| +$', '', 'g') AS text, l.i AS source FROM (SELECT doc_id, unnest(list_zip(string_split(text, chr(10)), range(len(string_split(text, chr(10)))))) AS z FROM documents WHERE text IS NOT NULL),
      LATERAL (SELECT z[1] AS x, z[2] AS i) l), f AS (SELECT *, (length(text) + 3) // 4 AS cost FROM s WHERE text <> ''),
    p AS (SELECT *, row_number() OVER w AS rank, sum(cost) OVER (w ROWS UNBOUNDED PRECEDING) AS running_tokens FROM f WINDOW w AS (PARTITION BY query_id ORDER BY source))
    SELECT query_id, count(*) AS n_segments, max(running_tokens)::BIGINT AS tokens FROM p WHERE rank = 1 OR running_tokens <= 120 GROUP BY query_id"""
)
def budget_pack(spark, d):
    """Lines of every document in order, packed into 120 tokens."""
    lines = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("query_id"), F.posexplode(F.split("text", "\n")).alias("source", "text"))
    segs = lines.withColumn("text", F.trim("text")).where("text <> ''").withColumn("score", F.lit(0.0)).withColumn("budget", F.lit(120))
    out = rt.pack(segs, "vector", order=[F.col("source")])
    return out.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_segments"), F.max("running_tokens").alias("tokens"))


# -- communities ---------------------------------------------------------------------------

_STRUCT = "'defines', 'imports', 'calls', 'inherits', 'references'"
_COMP = f"""links AS MATERIALIZED (SELECT DISTINCT src AS a, dst AS b FROM e WHERE type IN ({_STRUCT}) AND src <> dst AND src IN (SELECT id FROM pn) AND dst IN (SELECT id FROM pn)),
    both_ways AS MATERIALIZED (SELECT a, b FROM links UNION SELECT b, a FROM links),
    cc AS (SELECT id, id AS c FROM pn UNION SELECT cc.id, both_ways.b FROM cc JOIN both_ways ON both_ways.a = cc.c),
    comp AS MATERIALIZED (SELECT id, min(c) AS community FROM cc GROUP BY id),
    named AS MATERIALIZED (SELECT 'community:' || substr(sha1(array_to_string(list_sort(list(id)), chr(10))), 1, 12) AS community_id, list_sort(list(id)) AS members FROM comp GROUP BY community)"""


def _named(spark: SparkSession, d: str) -> DataFrame:
    return co.named(co.components(store(spark, d).stored()))


@query(f"WITH RECURSIVE {_G}, {_COMP} SELECT community_id, len(members) AS members FROM named")
def community_ids(spark, d):
    return _named(spark, d).select("community_id", F.size("members").alias("members"))


@query(f"WITH RECURSIVE {_G}, {_COMP} SELECT community_id AS src, unnest(members) AS dst, 'contains' AS type FROM named")
def community_contains(spark, d):
    return co.overlay(_named(spark, d))[1].select("src", "dst", "type")


@query()
def community_louvain(spark, d):
    return co.named(co.louvain(store(spark, d).stored())).select("community_id", F.size("members").alias("members"))


@query()
def community_modularity(spark, d):
    g = store(spark, d).stored()
    return co.modularity(co.louvain(g), g).select(F.round("modularity", 3).alias("modularity"))


@query(f"WITH RECURSIVE {_G}, {_COMP} SELECT len(members) AS size, count(*) AS n_communities FROM named GROUP BY ALL")
def community_histogram(spark, d):
    return co.histogram(_named(spark, d))


@query(
    f"""WITH RECURSIVE {_G}, {_ASK_SOME}, {_COMP},
    summ AS MATERIALIZED (SELECT community_id AS id, array_to_string(list(coalesce(n.label, m) ORDER BY i), '; ') || ' (' || any_value(size) || ')' AS text, first(coalesce(n.label, m) ORDER BY i) AS title
      FROM (SELECT community_id, len(members) AS size, unnest(members[1:5]) AS m, unnest(range(least(len(members), 5))) AS i FROM named) x LEFT JOIN n ON n.id = x.m GROUP BY community_id),
    {_bag('sb', 'summ', 'id', 'text')}, {_sims('ssim', 'qb', 'sb')},
    best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM ssim) WHERE rn <= 5),
    segments AS MATERIALIZED (SELECT b.query_id, s.text, s.id AS source, b.score FROM best b JOIN summ s ON s.id = b.id),
    {_PACK.format(order='score DESC, source', name='out', budget=BUDGET)} {_SHOW.format('out')}"""
)
def community_retrieve(spark, d):
    g = store(spark, d).stored()
    s = co.extractive_summaries(co.named(co.components(g)), g.nodes.select("id", F.col("label").alias("text")))
    r = rt.Retriever(g)
    return _show(r.community(_asked(spark, d, every=50), s.select(F.col("community_id").alias("id"), "summary", F.col("community_id").alias("ord"))))


# -- chunks and text -----------------------------------------------------------------------


@query("""WITH l AS (SELECT book, unnest(line_sizes) AS size FROM book_pages), c AS (SELECT book, size, count(*) AS n FROM l WHERE size IS NOT NULL GROUP BY ALL)
    SELECT book, first(size ORDER BY n DESC, size) AS body FROM c GROUP BY book""")
def body_font_mode(spark, d):
    return ch.body_size(ch.page_lines(table(spark, d, "book_pages")))


_CAPS = """WITH z AS (SELECT book, page_id AS page, unnest(lines) AS line, unnest(line_sizes) AS size, unnest(range(1, len(lines) + 1)) AS line_no FROM book_pages),
    c AS (SELECT book, size, count(*) AS n FROM z WHERE size IS NOT NULL GROUP BY ALL), b AS (SELECT book, first(size ORDER BY n DESC, size) AS body FROM c GROUP BY book),
    h AS (SELECT z.*, coalesce(length(regexp_replace(line, '[^\\p{L}]', '', 'g')) >= 2 AND line = upper(line) AND len(regexp_split_to_array(trim(line), '\\s+')) <= 6 AND size >= 1.3 * body, false) AS is_head FROM z LEFT JOIN b USING (book)),
    w AS (SELECT *, coalesce(lag(is_head) OVER (PARTITION BY book ORDER BY page, line_no), false) AS was FROM h),
    k AS (SELECT *, sum(is_head::INT) OVER (PARTITION BY book ORDER BY page, line_no) AS chunk_no FROM w WHERE NOT (is_head AND was))
    SELECT book, chunk_no::BIGINT AS chunk_no, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY page, line_no) AS text,
      array_to_string(list_transform(list_sort(list(DISTINCT page)), lambda x: x::VARCHAR), ',') AS pages FROM k GROUP BY book, chunk_no"""


def _caps(spark: SparkSession, d: str) -> DataFrame:
    # scans of the same page differ, so the arrival id orders the lines
    return ch.by_caps(ch.page_lines(table(spark, d, "book_pages")).withColumn("page", F.col("page_id")))


@query(_CAPS)
def caps_chunks(spark, d):
    c = _caps(spark, d)
    return c.select("book", "chunk_no", F.size(F.split("text", "\n")).cast("bigint").alias("n_lines"), "text", F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


_CAPS_LABEL = """CASE WHEN first(is_head ORDER BY page, line_no) THEN array_to_string(list_transform(
    regexp_extract_all(lower(trim(first(line ORDER BY page, line_no))), '[\\p{L}\\p{M}]+|[^\\p{L}\\p{M}]+'), lambda r: upper(r[1]) || r[2:]), '') ELSE 'p.' || first(page ORDER BY page, line_no) END AS label"""


@query(_CAPS.split("SELECT book, chunk_no::BIGINT AS chunk_no, count(*)")[0] + f"SELECT book, chunk_no::BIGINT AS chunk_no, {_CAPS_LABEL} FROM k GROUP BY book, chunk_no")
def caps_labels(spark, d):
    return _caps(spark, d).select("book", "chunk_no", "label")


@query(f"""WITH k AS ({_CAPS}) SELECT book, chunk_no FROM k
    WHERE len(list_intersect(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), ['FOR', 'DES', 'CON', 'INT', 'SAB', 'CAR'])) >= 4""")
def stat_filter(spark, d):
    return _caps(spark, d).where(ch.has_stat_block(F.col("text"))).select("book", "chunk_no")


_FM = "'^---\\n([\\s\\S]*?)\\n---\\n?'"
_LINE_END = "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]"


def _lines(text: str) -> str:
    return f"regexp_split_to_array(regexp_replace({text}, '(?:{_LINE_END})$', ''), '{_LINE_END}')"


@query(f"""WITH b0 AS (SELECT doc_id::VARCHAR AS book, {_lines("regexp_replace(text, '^\\s*---\\s*\\n[\\s\\S]*?\\n---[^\\S\\n]*\\n', '')")} AS l FROM documents WHERE text IS NOT NULL),
    b AS (SELECT book, l[1:list_max(list_transform(l, lambda x, i: CASE WHEN regexp_matches(x, '[^\\s\\p{{Z}}\\x1c-\\x1f\\x{{85}}]') THEN i ELSE 0 END))] AS l FROM b0),
    x AS (SELECT book, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS no FROM b), h AS (SELECT *, regexp_matches(line, '^#{{1,6}}\\s') AS head FROM x),
    k AS (SELECT *, sum(head::INT) OVER (PARTITION BY book ORDER BY no) AS chunk_no FROM h)
    SELECT book, chunk_no::BIGINT AS chunk_no, CASE WHEN first(head ORDER BY no) THEN trim(regexp_replace(first(line ORDER BY no), '^#+', '')) ELSE 'p.1' END AS label,
      string_agg(line, chr(10) ORDER BY no) AS text FROM k GROUP BY book, chunk_no""")
def heading_chunks(spark, d):
    return ch.by_heading(ch.markdown_lines(table(spark, d, "documents"))).select("book", "chunk_no", "label", "text")


_NID = "lower(trim(regexp_replace({0}, '[\\s\\p{{Z}}\\x1c-\\x1f\\x85]+', ' ', 'g')))"


@query(f"SELECT rel_id, {_NID.format('subject')} AS subject_id, {_NID.format('object')} AS object_id FROM extracted_relations")
def normalize_ids(spark, d):
    return table(spark, d, "extracted_relations").select("rel_id", tx.node_id("subject").alias("subject_id"), tx.node_id("object").alias("object_id"))


def _merged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return ex.merge_relations(table(spark, d, "extracted_relations").select(F.col("rel_id").alias("ord"), "subject", "predicate", "object"))


_PRED = """CASE upper(predicate) WHEN 'RESISTS' THEN 'resists' WHEN 'IMMUNE_TO' THEN 'immune_to' WHEN 'VULNERABLE_TO' THEN 'vulnerable_to' WHEN 'INHABITS' THEN 'inhabits' WHEN 'SUMMONS' THEN 'summons'
      WHEN 'RELATES_TO' THEN 'relates_to' WHEN 'MENTIONS' THEN 'mentions' WHEN 'PART_OF' THEN 'requires' WHEN 'DEPENDS_ON' THEN 'requires' WHEN 'AUTHORED_BY' THEN 'mentions' END"""
_MERGE = f"""r AS (SELECT rel_id AS ord, subject, object, {_NID.format('subject')} AS s, {_NID.format('object')} AS o, {_PRED} AS type FROM extracted_relations),
    ok AS (SELECT * FROM r WHERE type IS NOT NULL AND s <> '' AND o <> ''),
    m AS (SELECT ord * 2 AS ord, s AS id, subject AS surface FROM ok UNION ALL SELECT ord * 2 + 1, o, object FROM ok)"""


@query(f"""WITH {_MERGE}, f AS (SELECT id, surface, count(*) AS c, min(ord) AS o FROM m GROUP BY ALL)
    SELECT id, trim(first(surface ORDER BY c DESC, o)) AS label, 'concept' AS type FROM f GROUP BY id""")
def majority_label(spark, d):
    return _merged(spark, d)[0].select("id", "label", "type")


@query(f"WITH {_MERGE} SELECT s AS src, o AS dst, type, min(ord) AS ord FROM ok GROUP BY ALL")
def merge_mentions(spark, d):
    return _merged(spark, d)[1].select("src", "dst", "type", "ord")


@query("""WITH h AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\[[^\\]]*\\]\\(([^)]+)\\)', 1)) AS href FROM documents),
    s AS (SELECT doc_id, regexp_extract(regexp_extract(href, '^([^#?]*)', 1), '([^/]*)/*$', 1) AS name FROM h WHERE NOT regexp_matches(href, '^(?:https?://|#|mailto:)'))
    SELECT DISTINCT doc_id, CASE WHEN regexp_matches(name, '^.+\\.[^.]+$') THEN regexp_replace(name, '\\.[^.]*$', '') ELSE name END AS stem FROM s WHERE name <> ''""")
def link_refs(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(tx.link_stems("text")).alias("stem"))


def _header_sql(docs: str) -> str:
    """Relation fields of headers as h (key, ord, field, target); the fields are written out by hand."""
    strip = "regexp_replace({0}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
    return f"""fm AS (SELECT key, {_lines(f"regexp_extract(text, {_FM}, 1)")} AS l FROM ({docs}) WHERE regexp_matches(text, {_FM})),
    fl AS (SELECT key, unnest(l) AS line, unnest(range(len(l))) AS n FROM fm),
    ff AS (SELECT *, {strip.format("line")} AS bare, lower({strip.format("regexp_extract(line, '^([^:]*):', 1)")}) AS field, {strip.format("regexp_extract(line, '^[^:]*:(.*)$', 1)")} AS value,
      field IN ('relates_to', 'requires', 'supersedes', 'implements', 'extends', 'replaces') AS known FROM fl),
    fo AS (SELECT *, starts_with(bare, '- ') AS item, last_value(CASE WHEN starts_with(bare, '- ') THEN NULL WHEN known AND value = '' AND contains(line, ':') THEN field ELSE '' END IGNORE NULLS)
      OVER (PARTITION BY key ORDER BY n ROWS UNBOUNDED PRECEDING) AS block FROM ff),
    fi AS (SELECT key, n, CASE WHEN item THEN block ELSE field END AS field,
      CASE WHEN item AND block <> '' THEN [bare[3:]] WHEN NOT item AND known AND value <> '' THEN string_split(regexp_replace(value, '^[\\[\\]]+|[\\[\\]]+$', '', 'g'), ',') ELSE [] END AS parts FROM fo),
    fu AS (SELECT key, n, field, unnest(parts) AS raw, unnest(range(len(parts))) AS i FROM fi),
    h AS (SELECT key, n * 1000000 + i AS ord, field, regexp_replace({strip.format("raw")}, '^[''"]+|[''"]+$', '', 'g') AS target FROM fu WHERE target <> '')"""


@query(f"WITH {_header_sql('SELECT doc_id AS key, text FROM documents')} SELECT key AS doc_id, field, target FROM h")
def frontmatter_relations(spark, d):
    return ex.header_relations(table(spark, d, "documents"), "doc_id").select("doc_id", "field", "target")


@query(f"""WITH d AS (SELECT 'doc-' || doc_id AS src, text FROM documents WHERE doc_kind IN ('note', 'decision') AND text IS NOT NULL), {_header_sql('SELECT src AS key, text FROM d')},
    hr AS (SELECT src, list_filter(regexp_extract_all(regexp_replace(text, {_FM}, ''), '\\[[^\\]]*\\]\\(([^)]+)\\)', 1), lambda u: NOT regexp_matches(u, '^(?:https?://|#|mailto:)')) AS hs FROM d),
    nm AS (SELECT src, list_filter(list_transform(hs, lambda u: regexp_replace(regexp_extract(regexp_extract(u, '^([^#?]*)', 1), '([^/]*)/*$', 1), '^(.+)\\.[^.]*$', '\\1')), lambda u: u <> '') AS ns FROM hr),
    un AS (SELECT src, list_filter(ns, lambda u, i: list_position(ns, u) = i) AS us FROM nm),
    r AS (SELECT src, unnest(us) AS dst, unnest(range(len(us))) + 1000000000000000 AS ord FROM un)
    SELECT * FROM (SELECT key AS src, target AS dst, CASE WHEN field IN ('requires', 'implements') THEN 'requires' ELSE 'relates_to' END AS type, ord FROM h
      UNION ALL SELECT src, dst, 'references', ord FROM r) WHERE src <> dst""")
def note_graph_edges(spark, d):
    docs = table(spark, d, "documents").where("doc_kind in ('note', 'decision')").withColumn("key", F.concat(F.lit("doc-"), "doc_id"))
    return ex.note_graph(docs, "key")[1].select("src", "dst", "type", "ord")


def _facts(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("doc_kind = 'code'")
    return cd.code_facts(docs.select(F.concat_ws("/", F.col("doc_id").cast("string"), F.coalesce("title", F.lit("untitled.py"))).alias("path"), "text"))


@query()
def code_graph_edges(spark, d):
    return cd.code_graph(_facts(spark, d))[1].select("src", "dst", "type")


@query()
def code_kind_counts(spark, d):
    n, e = cd.code_graph(_facts(spark, d))
    count = F.count(F.lit(1)).alias("n")
    return n.groupBy("type").agg(count).unionByName(e.groupBy("type").agg(count))


@query(f"""WITH {_G}, defs AS (SELECT label AS name, count(*) AS c, min(id) AS dst FROM n WHERE type <> 'section' GROUP BY label),
    uses AS (SELECT DISTINCT id, unnest(relevant_labels) AS name FROM eval_queries)
    SELECT uses.id, dst FROM uses JOIN defs USING (name) WHERE c = 1""")
def unique_name_resolution(spark, d):
    """Labels of the query set that name exactly one node; what a label names stands in for a definition."""
    none = F.lit(None).cast("string")
    defs = store(spark, d).nodes.where("type <> 'section'").select(F.lit("function").alias("kind"), none.alias("src"), F.col("id").alias("dst"), F.col("label").alias("name"))
    uses = table(spark, d, "eval_queries").select(F.lit("call").alias("kind"), F.col("id").alias("src"), none.alias("dst"), F.explode("relevant_labels").alias("name"))
    return cd.resolve_names(defs.unionByName(uses)).select(F.col("src").alias("id"), "dst")


@query("SELECT doc_id, (length(text) + 3) // 4 AS tokens FROM documents WHERE text IS NOT NULL")
def token_estimate(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", tx.token_estimate("text").alias("tokens"))


@query("SELECT doc_id, lower(regexp_replace(regexp_replace(title, '[^a-zA-Z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug FROM documents WHERE title IS NOT NULL")
def slug(spark, d):
    return table(spark, d, "documents").where("title is not null").select("doc_id", tx.slug("title").alias("slug"))


@query("""SELECT id, array_to_string(list_transform(relevant_labels, lambda x: x), ', ') AS labels, coalesce(
      CASE WHEN answer_key LIKE '[%' THEN nullif(array_to_string(from_json(answer_key, '["VARCHAR"]'), '; '), '') END, nullif(trim(CASE WHEN answer_key LIKE '[%' THEN NULL ELSE answer_key END), ''),
      array_to_string(relevant_labels, '; ')) AS answer FROM eval_queries""")
def expected_answer(spark, d):
    return table(spark, d, "eval_queries").select("id", F.array_join("relevant_labels", ", ").alias("labels"), ev.expected_answer().alias("answer"))


@query("""WITH x AS (SELECT doc_id, unnest({LINES}) AS line, unnest(range(len({LINES}))) AS n FROM documents WHERE text IS NOT NULL),
    r AS (SELECT doc_id, n, trim(regexp_extract(line, '^(?:#{2,3}|\\s*[-*+])\\s+(.+)$', 1)) AS requirement FROM x),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS no FROM r WHERE regexp_matches(requirement, '(?i)\\b(must|should|shall|when|given)\\b'))
    SELECT doc_id, 'S-' || lpad(no::VARCHAR, greatest(2, length(no::VARCHAR))::INT, '0') AS id, requirement FROM k""".replace("{LINES}", _lines("text")))
def story_numbering(spark, d):
    return ev.stories(table(spark, d, "documents"))


@query("""SELECT response_id, array_to_string(list_transform(contexts, lambda x, i: '[' || i || '] ' || x), chr(10)) AS prompt,
    sha256(concat_ws(chr(31), arm, case_id, array_to_string(contexts, chr(10)))) AS fingerprint FROM responses WHERE contexts IS NOT NULL""")
def prompt_context(spark, d):
    r = table(spark, d, "responses").where("contexts is not null")
    return r.select("response_id", ev.prompt_context().alias("prompt"), ev.fingerprint(F.col("arm"), F.col("case_id"), F.array_join("contexts", "\n")).alias("fingerprint"))


@query("""SELECT id, array_to_string(list_distinct_in_order, ',') AS entities FROM (SELECT id, list_filter(l, lambda x, i: list_position(l, x) = i) AS list_distinct_in_order FROM (
    SELECT id, regexp_extract_all(question, '(?i)(?:dec|adr)-[\\p{L}\\p{N}_-]+') || regexp_extract_all(question, '(?:^|[^\\p{L}\\p{N}_])([A-Z][\\p{L}\\p{N}_]{3,})', 1) AS l FROM eval_queries))""")
def named_entities(spark, d):
    return table(spark, d, "eval_queries").select("id", F.array_join(tx.named_entities("question"), ",").alias("entities"))


# -- evaluation ----------------------------------------------------------------------------


@query("""SELECT arm, count(*) AS n, (sum(coalesce(input_tokens, 0)) + sum(coalesce(output_tokens, 0)))::BIGINT AS total_tokens, round(coalesce(avg(latency_ms), 0), 2) AS mean_latency_ms,
    round(sum(coalesce(input_tokens, 0))::BIGINT / 1e6 * 1.0 + sum(coalesce(output_tokens, 0))::BIGINT / 1e6 * 5.0, 6) AS cost_usd FROM responses GROUP BY arm""")
def arm_cost(spark, d):
    return ev.arm_totals(table(spark, d, "responses"))


_RECALL = """want AS (SELECT DISTINCT id AS query_id, unnest(relevant_sources) AS source FROM eval_queries{1}), asked_want AS (SELECT want.* FROM want JOIN asked USING (query_id)),
    got AS (SELECT DISTINCT query_id, source FROM {0}), rec AS (SELECT w.query_id, count(g.source) / count(*)::DOUBLE AS recall FROM asked_want w LEFT JOIN got g USING (query_id, source) GROUP BY w.query_id)"""


def _recall(spark: SparkSession, d: str, segments: DataFrame, favored: bool = False) -> DataFrame:
    q = table(spark, d, "eval_queries").where("graph_favored") if favored else table(spark, d, "eval_queries")
    return ev.recall(segments, q.where("id is not null").select(F.col("id").alias("query_id"), "relevant_sources"))


@query(f"{_graph_sql(_ANCHORS)}, {_RECALL.format('out', '')} SELECT query_id, round(recall, 6) AS recall FROM rec")
def recall_at_budget(spark, d):
    return _recall(spark, d, _retriever(spark, d).graph(_asked(spark, d))).select("query_id", F.round("recall", 6).alias("recall"))


def _mean_recall(name: str, attrs: bool) -> str:
    return f"(SELECT round(avg(recall), 6) AS {name} FROM ({_graph_sql(_ANCHORS, attrs=attrs)}, {_RECALL.format('out', ' WHERE graph_favored')} SELECT recall FROM rec))"


@query(f"""SELECT base, variant, round(variant - base, 6) AS delta, CASE WHEN round(variant - base, 6) >= 0.02 THEN 'KEEP' ELSE 'REVERT' END AS verdict
    FROM {_mean_recall('base', False)}, {_mean_recall('variant', True)}""")
def attrs_delta(spark, d):
    """Over the questions that a graph should answer best."""
    base, variant = _retriever(spark, d).graph_attrs(_asked(spark, d))
    return ev.verdict(_recall(spark, d, base, True), _recall(spark, d, variant, True))


@query("""SELECT count(*) AS n, count(*) FILTER (attack_vs_resistance_confusion) AS confusions, round(coalesce(count(*) FILTER (attack_vs_resistance_confusion) / nullif(count(*), 0), 0), 6) AS rate,
    coalesce(string_agg(CASE WHEN attack_vs_resistance_confusion THEN id END, ',' ORDER BY id), '') AS ids FROM eval_queries WHERE attack_vs_resistance_confusion IS NOT NULL""")
def confusion_rate(spark, d):
    return ev.confusion(table(spark, d, "eval_queries"))


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = table(spark, d, "responses").select("arm", F.lit("output_tokens").alias("metric"), "output_tokens", "response_id")
    mean = F.round(F.avg("output_tokens"), 6).alias("mean")
    return r.where("response_id % 2 = 0").groupBy("arm", "metric").agg(mean), r.where("response_id % 2 = 1").groupBy("arm", "metric").agg(mean)


@query("""WITH o AS (SELECT arm, round(avg(output_tokens), 6) AS old FROM responses WHERE response_id % 2 = 0 GROUP BY arm), f AS (SELECT arm, round(avg(output_tokens), 6) AS new FROM responses WHERE response_id % 2 = 1 GROUP BY arm)
    SELECT arm, 'output_tokens' AS metric, old, new, CASE WHEN new IS NULL THEN 'missing' ELSE 'drift' END AS status FROM o LEFT JOIN f USING (arm) WHERE new IS NULL OR abs(new - old) > 0.05""")
def regression_check(spark, d):
    return ev.regressions(*_halves(spark, d))


_BOOT = """w AS (SELECT arm AS g, latency_ms AS x, row_number() OVER (PARTITION BY arm ORDER BY response_id) - 1 AS i FROM responses WHERE latency_ms IS NOT NULL),
    c AS (SELECT g, count(*) AS n, avg(x) AS mean FROM w GROUP BY g HAVING count(*) > 1),
    sl AS (SELECT w.g, c.n, w.i AS j, b, ('0x' || substr(md5('0:' || w.g || ':' || b || ':' || w.i), 1, 8))::BIGINT % c.n AS i FROM w JOIN c USING (g), range(2000) t(b)),
    mm AS (SELECT sl.g, b, avg(w.x) AS m FROM sl JOIN w ON w.g = sl.g AND w.i = sl.i GROUP BY sl.g, b),
    ci AS (SELECT g, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM mm GROUP BY g),
    boot AS (SELECT c.g AS arm, round(mean, 4) AS mean, round(lo, 4) AS ci_low, round(hi, 4) AS ci_high, n FROM c JOIN ci USING (g))"""


def _boot(spark: SparkSession, d: str) -> DataFrame:
    return ev.bootstrap(table(spark, d, "responses"), "arm", "latency_ms", order="response_id")


@query(f"WITH {_BOOT} SELECT arm, mean, ci_low, ci_high, n FROM boot")
def bootstrap_ci(spark, d):
    return _boot(spark, d)


_ARMS = ("graph", "graph_pagerank", "hybrid", "multi_anchor", "path", "vector")


def _cell(arm: str) -> str:
    return f"coalesce(max(CASE WHEN arm = '{arm}' THEN format('{{:,.3f}} [{{:,.3f}}, {{:,.3f}}]', mean, ci_low, ci_high) END), '—') AS {arm}"


@query(f"WITH {_BOOT} SELECT 'latency_ms' AS metric, {', '.join(map(_cell, _ARMS))} FROM boot")
def report_pivot(spark, d):
    return ev.report(_boot(spark, d).withColumn("metric", F.lit("latency_ms")), list(_ARMS))


# -- query sets ----------------------------------------------------------------------------


@query(f"WITH {_G} SELECT DISTINCT src FROM e WHERE type = 'resists' AND dst IN ('fogo', 'veneno')")
def sources_with(spark, d):
    return ev.sources_with(store(spark, d).edges, "resists", ["fogo", "veneno"])


@query(f"WITH {_G} SELECT src FROM e WHERE type = 'resists' AND dst = 'fogo' INTERSECT SELECT src FROM e WHERE type = 'immune_to' AND dst = 'veneno'")
def conjunction_sources(spark, d):
    e = store(spark, d).edges
    return ev.conjunction(ev.sources_with(e, "resists", ["fogo"]), ev.sources_with(e, "immune_to", ["veneno"]))


@query(f"WITH {_G} SELECT e.src, string_agg(n.label, ', ' ORDER BY e.ord) AS targets FROM e JOIN n ON n.id = e.dst WHERE e.type = 'inhabits' GROUP BY e.src")
def targets_of(spark, d):
    g = store(spark, d)
    return ev.targets_of(g.edges, g.nodes, "inhabits").select("src", F.array_join("labels", ", ").alias("targets"))


@query(f"""WITH {_G} SELECT dst, count(*) AS callers FROM e WHERE type = 'calls' AND dst IN (SELECT id FROM n WHERE type = 'function')
    GROUP BY dst HAVING count(*) BETWEEN 5 AND 25 ORDER BY callers DESC, dst LIMIT 6""")
def callers_topk(spark, d):
    g = store(spark, d)
    return ev.call_targets(g.edges, g.nodes)


@query(f"WITH {_G} SELECT dst, count(*) AS heirs FROM e WHERE type = 'inherits' GROUP BY dst")
def inherit_counts(spark, d):
    return store(spark, d).edges.where("type = 'inherits'").groupBy("dst").agg(F.count(F.lit(1)).alias("heirs"))


@query("""SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def event_windows(spark, d):
    from tessera.streaming.upserts import windowed_counts

    return windowed_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
