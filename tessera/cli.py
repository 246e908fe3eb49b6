"""python -m tessera.cli COMMAND …: thin entry points over the operators.

vault FOLDER OUT       graph of a folder of Markdown notes
code FOLDER OUT        graph of Python and Java sources, and counts by kind
communities GRAPH OUT  graph with its community overlay
ask GRAPH QUESTION     segments for a question
stories FILE           requirements of a specification
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main(args: list[str]) -> int:
    from tessera.operators import pipeline
    from tessera.operators.evaluation import markdown_table, stories
    from tessera.operators.store import GraphStore

    need = {"vault": 3, "code": 3, "communities": 3, "ask": 3, "stories": 2}
    if not args or need.get(args[0]) != len(args):
        print(__doc__)
        return 2
    spark = SparkSession.builder.appName("tessera").getOrCreate()
    if args[0] == "vault":
        pipeline.build_vault(spark, args[1]).save(args[2])
    elif args[0] == "code":
        store = pipeline.build_code(spark, args[1])
        store.save(args[2])
        store.nodes.groupBy("type").count().unionByName(store.edges.groupBy("type").count()).show()
    elif args[0] == "communities":
        pipeline.add_communities(GraphStore.load(spark, args[1])).save(args[2])
    elif args[0] == "ask":
        pipeline.GraphContext.load(spark, args[1]).retrieve(args[2]).orderBy("rank").select("rank", "score", "text").show(truncate=False)
    else:
        docs = spark.read.text(args[1], wholetext=True).select(F.lit(0).alias("doc_id"), F.col("value").alias("text"))
        print(markdown_table(stories(docs).select("id", "requirement")))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
