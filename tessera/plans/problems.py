"""Registered queries p1_, p3_ and p5_, with their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import node_id
from tessera.operators.hierarchy import descendants, hierarchy, states
from tessera.operators.hotkeys import heavy_share, key_totals
from tessera.operators.orphans import dated_orphans, orphans
from tessera.sources.tables import table

_STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


# -- 1: a few keys holding most records ----------------------------------------------------


def _edge_totals(spark: SparkSession, d: str, keys: list[str]) -> DataFrame:
    return key_totals(table(spark, d, "edges"), keys, "src", "ingested_at")


def _shown(totals: DataFrame, keys: list[str]) -> DataFrame:
    return totals.select(
        *keys, "n_rows", F.col("n_values").alias("n_src"), F.date_format("first_at", _STAMP).alias("first_at"), F.date_format("last_at", _STAMP).alias("last_at")
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_share(_edge_totals(spark, d, ["dst", "type"]), 1, table(spark, d, "edges")).select("dst", "type")


def p1_totals_dst(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_edge_totals(spark, d, ["dst"]), ["dst"])


def p1_totals_type(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_edge_totals(spark, d, ["type"]), ["type"])


def p1_totals_pair(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_edge_totals(spark, d, ["dst", "type"]), ["dst", "type"])


def _totals_sql(keys: str) -> str:
    return f"""
    SELECT {keys}, count(*) AS n_rows, count(DISTINCT src) AS n_src,
           strftime(min(ingested_at), '%Y-%m-%d %H:%M:%S.%f') AS first_at, strftime(max(ingested_at), '%Y-%m-%d %H:%M:%S.%f') AS last_at
    FROM edges GROUP BY {keys}"""


# -- 3: references to records that do not exist --------------------------------------------


def _references(spark: SparkSession, d: str) -> DataFrame:
    e, r = table(spark, d, "edges"), table(spark, d, "extracted_relations")

    def of(df: DataFrame, name: str, rec: str, field: str, key, at: str) -> DataFrame:
        return df.select(
            F.lit(name).alias("ref_table"), F.col(rec).alias("rec_id"), F.lit(field).alias("field"), F.nullif(key, F.lit("")).alias("id"), F.col(at).alias("at")
        )

    plain = F.when(F.trim("dst") != "", F.col("dst"))
    return (
        of(e, "edges", "ord", "dst", plain, "ingested_at")
        .unionByName(of(r, "extracted_relations", "rel_id", "subject", node_id("subject"), "extracted_at"))
        .unionByName(of(r, "extracted_relations", "rel_id", "object", node_id("object"), "extracted_at"))
    )


def _all_nodes(spark: SparkSession, d: str) -> DataFrame:
    cols = ["id", "ord", "ingested_at", "deleted_at"]
    return table(spark, d, "nodes").select(*cols).unionByName(table(spark, d, "core_nodes").select(*cols))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = dated_orphans(_references(spark, d), "id", "at", _all_nodes(spark, d))
    return found.select("ref_table", "rec_id", "field", "reason", F.date_format("at", "yyyy-MM").alias("period"))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return p3_found(spark, d).groupBy("ref_table", "period", "field", "reason").agg(F.count(F.lit(1)).alias("n_orphans"))


def p3_triples(spark: SparkSession, d: str) -> DataFrame:
    """Extracted triples that no edge states: null subject or object means any (partial match)."""
    rel = table(spark, d, "extracted_relations").select(
        "rel_id", F.nullif(node_id("subject"), F.lit("")).alias("src"), F.lower("predicate").alias("type"), F.nullif(node_id("object"), F.lit("")).alias("dst")
    )
    return orphans(rel, ["src", "type", "dst"], table(spark, d, "edges"), match="partial").select("rel_id", "src", "type", "dst")


_NID = "lower(trim(regexp_replace({0}, '[\\s\\p{{Z}}\\x1c-\\x1f\\x85]+', ' ', 'g')))"
_P3 = f"""
    WITH refs AS (
      SELECT 'edges' AS ref_table, ord AS rec_id, 'dst' AS field, CASE WHEN trim(dst) <> '' THEN dst END AS id, ingested_at AS t FROM edges
      UNION ALL SELECT 'extracted_relations', rel_id, 'subject', nullif({_NID.format("subject")}, ''), extracted_at FROM extracted_relations
      UNION ALL SELECT 'extracted_relations', rel_id, 'object', nullif({_NID.format("object")}, ''), extracted_at FROM extracted_relations),
    known AS (
      SELECT id, min(ingested_at) AS first_at, arg_max(struct_pack(d := deleted_at), ord).d AS gone_at
      FROM (SELECT id, ord, ingested_at, deleted_at FROM nodes UNION ALL SELECT id, ord, ingested_at, deleted_at FROM core_nodes) WHERE id IS NOT NULL GROUP BY id),
    judged AS (
      SELECT ref_table, rec_id, field, strftime(t, '%Y-%m') AS period,
             CASE WHEN known.id IS NULL THEN 'missing' WHEN first_at > t THEN 'late' WHEN gone_at <= t THEN 'deleted' END AS reason
      FROM refs LEFT JOIN known ON refs.id = known.id WHERE refs.id IS NOT NULL)"""
_P3_TRIPLES = f"""
    WITH rel AS (
      SELECT rel_id, nullif({_NID.format("subject")}, '') AS src, lower(predicate) AS type, nullif({_NID.format("object")}, '') AS dst FROM extracted_relations)
    SELECT rel_id, src, type, dst FROM rel
    WHERE (src IS NOT NULL OR type IS NOT NULL OR dst IS NOT NULL) AND NOT CASE
      WHEN src IS NOT NULL AND type IS NOT NULL AND dst IS NOT NULL THEN (src, type, dst) IN (SELECT (src, type, dst) FROM edges)
      WHEN src IS NOT NULL AND type IS NOT NULL THEN (src, type) IN (SELECT (src, type) FROM edges)
      WHEN type IS NOT NULL AND dst IS NOT NULL THEN (type, dst) IN (SELECT (type, dst) FROM edges)
      WHEN src IS NOT NULL AND dst IS NOT NULL THEN (src, dst) IN (SELECT (src, dst) FROM edges)
      WHEN src IS NOT NULL THEN src IN (SELECT src FROM edges)
      WHEN type IS NOT NULL THEN type IN (SELECT type FROM edges)
      ELSE dst IN (SELECT dst FROM edges) END"""


# -- 5: parent-child links to full hierarchies ---------------------------------------------


def _trees(spark: SparkSession, d: str, paths: bool = True) -> DataFrame:
    return hierarchy(table(spark, d, "edges").where(F.col("type").isin("contains", "defines")), paths=paths)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return states(table(spark, d, "edges").where(F.col("type").isin("contains", "defines"))).where("state <> 'tree'")


def p5_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _trees(spark, d).select("type", "id", "root", "depth", F.array_join("path", "\n").alias("path"), "n_descendants", "state", "n_parents")


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(_trees(spark, d))


_P5 = """
    WITH RECURSIVE rows AS (SELECT DISTINCT type, src, dst FROM edges WHERE type IN ('contains', 'defines') AND src IS NOT NULL AND dst IS NOT NULL),
    par AS (SELECT type, dst AS id, min(src) AS p, count(*) AS n_parents FROM rows GROUP BY type, dst),
    ids AS (SELECT type, src AS id FROM rows UNION SELECT type, dst FROM rows),
    down AS (
      SELECT type, id, id AS root, 0::BIGINT AS depth, [id] AS path FROM ids WHERE (type, id) NOT IN (SELECT (type, id) FROM par)
      UNION ALL SELECT par.type, par.id, down.root, down.depth + 1, list_append(down.path, par.id) FROM down JOIN par ON par.type = down.type AND par.p = down.id),
    stuck AS (SELECT type, id, p FROM par WHERE (type, id) NOT IN (SELECT (type, id) FROM down)),
    up AS (SELECT type, id, p AS a FROM stuck UNION SELECT up.type, up.id, par.p FROM up JOIN par ON par.type = up.type AND par.id = up.a),
    states AS (SELECT type, id, CASE WHEN bool_or(a = id) THEN 'on_cycle' ELSE 'below_cycle' END AS state FROM up GROUP BY type, id)"""
_P5_NODES = f"""{_P5},
    below AS (
      SELECT type, id, count(*) AS n FROM (
        SELECT type, unnest(path) AS id, path[-1] AS d FROM down UNION SELECT type, a, id FROM up) WHERE id <> d GROUP BY type, id)
    SELECT ids.type, ids.id, root, depth, array_to_string(path, chr(10)) AS path,
           CASE WHEN coalesce(state, '') <> 'on_cycle' THEN coalesce(n, 0) END AS n_descendants, coalesce(state, 'tree') AS state, coalesce(n_parents, 0) AS n_parents
    FROM ids LEFT JOIN par USING (type, id) LEFT JOIN down USING (type, id) LEFT JOIN states USING (type, id) LEFT JOIN below USING (type, id)"""
_P5_DESCENDANTS = f"""{_P5}
    SELECT type, path[i] AS id, path[-1] AS descendant, depth + 1 - i AS distance
    FROM (SELECT type, path, depth, unnest(range(1, depth + 1)) AS i FROM down)"""


#: Over all parents: above holds every ancestor that a chain of links within one walk of cycles can give.
_P5_FOUND = """
    WITH RECURSIVE rows AS (SELECT DISTINCT type, src, dst FROM edges WHERE type IN ('contains', 'defines') AND src IS NOT NULL AND dst IS NOT NULL),
    gone(type, id) USING KEY (type, id) AS (SELECT DISTINCT type, src FROM rows WHERE (type, src) NOT IN (SELECT (type, dst) FROM rows)
      UNION SELECT r.type, r.dst FROM gone g JOIN rows r ON r.type = g.type AND r.src = g.id
        WHERE NOT EXISTS (SELECT 1 FROM rows o WHERE o.type = r.type AND o.dst = r.dst AND NOT EXISTS (SELECT 1 FROM recurring.gone k WHERE k.type = o.type AND k.id = o.src))),
    left_ AS MATERIALIZED (SELECT * FROM rows WHERE (type, src) NOT IN (SELECT (type, id) FROM gone)),
    up AS (SELECT type, dst AS id, src AS a FROM left_ UNION SELECT up.type, up.id, l.src FROM up JOIN left_ l ON l.type = up.type AND l.dst = up.a)
    SELECT type, id, CASE WHEN bool_or(a = id) THEN 'on_cycle' ELSE 'below_cycle' END AS state FROM up GROUP BY type, id"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (p1_found, p1_totals_dst, p1_totals_type, p1_totals_pair, p3_found, p3_counts, p3_triples, p5_found, p5_nodes, p5_descendants)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": "SELECT dst, type FROM edges GROUP BY dst, type HAVING count(*) * 100 >= (SELECT count(*) FROM edges)",
        "p1_totals_dst": _totals_sql("dst"),
        "p1_totals_type": _totals_sql("type"),
        "p1_totals_pair": _totals_sql("dst, type"),
        "p3_found": f"{_P3} SELECT ref_table, rec_id, field, reason, period FROM judged WHERE reason IS NOT NULL",
        "p3_counts": f"""{_P3} SELECT ref_table, period, field, reason, count(*) AS n_orphans FROM judged WHERE reason IS NOT NULL
            GROUP BY ref_table, period, field, reason""",
        "p3_triples": _P3_TRIPLES,
        "p5_found": _P5_FOUND,
        "p5_nodes": _P5_NODES,
        "p5_descendants": _P5_DESCENDANTS,
    }
