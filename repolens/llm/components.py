"""Connected components by alternating large and small stars (Kiveris et al., 2014), as joins and aggregates.

Links with a null end, and links of a node with itself, are no links. Repeated links count once. Without links there are no rows. Columns besides the
two ends aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolens.llm.common import apart, cut


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step. ``edges`` has u > v. Minima are combined before the exchange; a hub's edges are joined by a splittable join."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    joined = both.join(apart(least), F.col("u") == F.col("k"))
    if large:
        out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return out.where(F.col("u") > F.col("v")).dropDuplicates()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) for every node that has a link; the label is the component's smallest node. The number of rounds grows with the
    logarithm of the largest component."""
    x, y = F.col(a), F.col(b)
    edges = cut(links.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).dropDuplicates())
    last = None
    while (now := _mark(edges)) != last:
        last = now
        edges = cut(_star(_star(edges, True), False))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).dropDuplicates())
