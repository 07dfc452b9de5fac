"""Connected components of a link table by alternating stars, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node with a smaller neighbour has one such and is nobody's smaller neighbour."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("centre")).unionAll(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("centre").alias("centre")).where("up + centre > 1").where("up > 0").isEmpty()


def _with_least(links: DataFrame, key: str, other: str) -> DataFrame:
    """links with m, the smallest of a node's others (not above the node itself).

    The smallest is combined in the map tasks first. The join back is by the
    negated node, so that it gets shuffles of its own: Spark splits a hub's
    partition there, which it can't in a stage that also ends an aggregation.
    """
    least = links.groupBy(F.bitwise_not(key).alias("__k")).agg(F.least(F.min(other), F.first(key)).alias("m")).select(F.bitwise_not("__k").alias("__n"), "m")
    return links.join(least, F.col(key) == F.col("__n")).drop("__n")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b); root is the smallest node of its component.

    Each round joins every node's neighbours to the smallest one among them
    (first the larger neighbours, then the smaller), and is written to the
    shared folder; links that are stars already end the search. Only a row
    reaches the driver. Self links and nulls are ignored.
    """
    edges = cut(links.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _are_stars(edges):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _with_least(both, "u", "v").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = _with_least(large, "a", "b").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        edges = cut(small)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
