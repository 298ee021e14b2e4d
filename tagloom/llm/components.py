"""Connected components of an undirected graph, by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm import skew
from tagloom.session import written


def _beside_least(edges: DataFrame, name: str) -> DataFrame:
    """The edges ``u, v`` with the least neighbour ``m`` of ``u``; a node of very many edges stays spread."""
    least = written(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), name)
    total, largest = least.agg(F.sum("n"), F.max("n")).first()
    return skew.joined(edges, least, "u", "n", total or 0, largest or 0).select("u", "v", F.least("u", "m").alias("m"))


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` of every node of ``pairs``: the root is the smallest node its component has.

    Each round moves every node to the least node two steps off at most, so rounds follow the logarithm of a chain's
    length; each is a written table, and no component is gathered anywhere. Pairs with a null, loops and repeats are ignored.
    """
    edges = pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
    edges = written(edges.distinct(), "edges")
    before = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        before = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(_beside_least(both, "large").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        near = _beside_least(large, "small")
        star = near.select("u", F.col("m").alias("v")).unionByName(near.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        edges = written(star.distinct(), "edges")
