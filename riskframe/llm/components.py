"""Connected components of links by alternating stars, in joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskframe.llm.stage import staged


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node; root is the least node of its component.

    links has columns a and b of any ordered type. Each round writes its narrow edge
    table to the shared folder; no neighbour list is ever gathered.
    """
    edges = (links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
             .where("u <> v").distinct())
    edges = staged(edges, "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = (both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        edges = staged(small, "edges")
        seen = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == state:
            return (edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
                    .unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()))
        state = seen
