"""Connected components of a graph given as pairs of whole numbers, by alternating star contractions.

Each round hangs every node's larger neighbours on its smallest one, then its smaller neighbours and itself; the graph ends
as stars around the smallest node of each component after a logarithmic number of rounds. Only aggregations and joins, which
adaptive execution splits where a node has very many neighbours; no component is gathered anywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.scratch import kept


def components(pairs: DataFrame) -> DataFrame:
    """Columns node, root for every node of `pairs` (columns a, b) that is not itself the smallest of its component.

    Pairs may repeat and go either way; a pair of equal nodes or with a null says nothing.
    """
    stars = kept(pairs.filter("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct(), "edges", 16)
    while not _done(stars):
        both = stars.unionByName(stars.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.min("root").alias("m")).withColumn("m", F.least("node", "m"))
        larger = both.filter("root > node").join(least, "node").select(F.col("root").alias("node"), F.col("m").alias("root"))
        larger = larger.filter("node <> root").distinct()
        least = larger.groupBy("node").agg(F.min("root").alias("m"))
        rest = larger.join(least, "node").filter("root <> m").select(F.col("root").alias("node"), F.col("m").alias("root"))
        stars = kept(rest.unionByName(least.withColumnRenamed("m", "root")).distinct(), "edges", 16)
    return stars


def _done(stars: DataFrame) -> bool:
    """Every node has one root, and no root has a root."""
    several = stars.groupBy("node").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y")
    chained = stars.join(stars.select(F.col("node").alias("root")), "root", "left_semi")
    return several.isEmpty() and chained.isEmpty()
