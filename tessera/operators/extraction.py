"""Extraction: merged mentions and Markdown relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import frontmatter, link_stems, node_id, stripped, text_lines, without_frontmatter
from tessera.operators.store import first_seen

# Fields of note headers that state a relation, with the edge type and, where the field says more, the verb.
RELATION_FIELDS = {
    "relates_to": ("relates_to", None),
    "requires": ("requires", None),
    "supersedes": ("relates_to", "supersedes"),
    "implements": ("requires", None),
    "extends": ("relates_to", None),
    "replaces": ("relates_to", "replaces"),
}
# What extracted predicates become.
PREDICATES = {
    "RESISTS": "resists", "IMMUNE_TO": "immune_to", "VULNERABLE_TO": "vulnerable_to", "INHABITS": "inhabits", "SUMMONS": "summons",
    "RELATES_TO": "relates_to", "MENTIONS": "mentions", "REQUIRES": "requires", "PART_OF": "requires", "DEPENDS_ON": "requires", "AUTHORED_BY": "mentions",
}


def merge_mentions(mentions: DataFrame) -> DataFrame:
    """One node per normalised name: commonest surface form (first seen on ties), first type and attrs.

    ``mentions`` is (ord, surface, type, attrs); null and blank names refer to nothing.
    """
    m = mentions.withColumn("id", node_id("surface")).where("id <> ''")
    forms = m.groupBy("id", "surface").agg(F.count(F.lit(1)).alias("c"), F.min("ord").alias("o"))
    labels = forms.groupBy("id").agg(F.max_by("surface", F.struct("c", -F.col("o"))).alias("label"))
    firsts = m.groupBy("id").agg(F.min_by(F.struct("type", "attrs"), "ord").alias("f"), F.min("ord").alias("ord"))
    return firsts.join(labels, "id").select("id", "f.type", F.trim("label").alias("label"), "f.attrs", "ord")


def merge_relations(relations: DataFrame, entities: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of extracted triples (ord, subject, predicate, object).

    Ends that no entity lists become concepts; endpoints vote for labels too.
    Edges are deduplicated on the mapped type, first seen; unknown predicates go.
    """
    mapping = F.create_map(*[F.lit(x) for kv in PREDICATES.items() for x in kv])
    none = F.lit(None).cast("map<string,string>")
    r = relations.select("ord", "subject", "object", mapping[F.upper("predicate")].alias("type")).where("type is not null")
    r = r.where((node_id("subject") != "") & (node_id("object") != ""))
    ends = r.select((F.col("ord") * 2).alias("ord"), F.col("subject").alias("surface")).unionByName(r.select((F.col("ord") * 2 + 1).alias("ord"), F.col("object").alias("surface")))
    mentions = ends.select("ord", "surface", F.lit("concept").alias("type"), none.alias("attrs"))
    if entities is not None:
        first = entities.select((F.col("ord") - F.lit(2**40)).alias("ord"), "surface", "type", "attrs")
        mentions = first.unionByName(mentions)
    edges = r.select(node_id("subject").alias("src"), node_id("object").alias("dst"), "type", none.alias("attrs"), "ord")
    return merge_mentions(mentions), first_seen(edges, ["src", "dst", "type"])


def header_relations(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, ord, field, target) of the relation fields in note headers.

    Inline lists, block lists and single values; quotes go; a block item belongs
    to the field that opened the block, and any line that is no item, a blank one
    too, closes it.
    """
    lines = docs.select(key, frontmatter(F.col(text)).alias("front")).where("front <> ''").select(key, F.posexplode(text_lines("front")).alias("n", "line"))
    bare = stripped("line")
    item = bare.startswith("- ")
    field = F.lower(stripped(F.regexp_extract("line", r"^([^:]*):", 1)))
    value = stripped(F.regexp_extract("line", r"^[^:]*:(.*)$", 1))
    w = Window.partitionBy(key).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.when(~item, F.when(F.col("line").contains(":") & (value == "") & field.isin(*RELATION_FIELDS), field).otherwise(F.lit("")))
    x = lines.withColumn("block", F.last(opens, ignorenulls=True).over(w))
    strip = lambda c: F.regexp_replace(stripped(c), r"^['\"]+|['\"]+$", "")
    parts = F.when(item & (F.col("block") != ""), F.array(F.substring(bare, 3, 2_000_000_000))).when(
        ~item & field.isin(*RELATION_FIELDS) & (value != ""), F.split(F.regexp_replace(value, r"^[\[\]]+|[\[\]]+$", ""), ",")
    )
    owner = F.when(item, F.col("block")).otherwise(field)
    y = x.select(key, "n", owner.alias("field"), F.posexplode(parts).alias("i", "raw")).withColumn("target", strip(F.col("raw"))).where("target <> ''")
    return y.select(key, (F.col("n").cast("bigint") * 1_000_000 + F.col("i")).alias("ord"), "field", "target")


def note_graph(docs: DataFrame, key: str, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that note headers and local links state; a target equal to the note itself is dropped."""
    kinds = F.create_map(*[F.lit(x) for k, (t, _) in RELATION_FIELDS.items() for x in (k, t)])
    verbs = F.when(F.col("field").isin(*[k for k, (_, v) in RELATION_FIELDS.items() if v]), F.col("field"))
    rel = header_relations(docs, key, text).select(F.col(key).alias("src"), F.col("target").alias("dst"), kinds[F.col("field")].alias("type"), verbs.alias("verb"), "ord")
    refs = docs.select(F.col(key).alias("src"), F.posexplode(link_stems(without_frontmatter(F.col(text)))).alias("i", "dst"))
    refs = refs.select("src", "dst", F.lit("references").alias("type"), F.lit(None).cast("string").alias("verb"), (F.col("i") + F.lit(10**15)).cast("bigint").alias("ord"))
    edges = rel.unionByName(refs).where("src <> dst")
    attrs = F.when(F.col("verb").isNotNull(), F.create_map(F.lit("verb"), F.col("verb"))).otherwise(F.create_map().cast("map<string,string>"))
    ids = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    nodes = ids.select("id", F.lit("entity").alias("type"), F.col("id").alias("label"), F.create_map().cast("map<string,string>").alias("attrs"), F.lit(0).cast("bigint").alias("ord"))
    return nodes, edges.select("src", "dst", "type", attrs.alias("attrs"), "ord")
