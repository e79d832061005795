"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallywork.session import cut_lineage


def _least(pairs: DataFrame) -> DataFrame:
    """u, v -> u and the smallest of u and its v."""
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "_u")


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) of whole numbers -> node, root: the smallest node reachable, for every linked node.

    Links of a node are never gathered: a round takes minima per node and joins them back, so a hub with
    very many links is a skewed join, which Spark splits. Rounds grow with the logarithm of the longest path.
    """
    both = F.explode(F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, before = cut_lineage(edges), None
    while True:
        sides = edges.select(both.alias("e")).select("e.u", "e.v")
        large = sides.join(_least(sides), F.col("u") == F.col("_u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        small = large.join(_least(large), F.col("u") == F.col("_u"))
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = cut_lineage(small.select("e.u", "e.v").where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
