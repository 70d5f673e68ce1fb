"""Connected components of an edge table by alternating large-star and small-star steps.

Both steps join each vertex with its least neighbour, a grouped minimum that combines before
the shuffle; edges never meet in one task or on the driver. Rounds grow with the logarithm of
the longest chain. Each round's edges are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import kept


def stars(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Connect each vertex's neighbours to its least one.

    ``both_ways`` (large star): larger neighbours, whichever way the edge was given; else
    (small star) the smaller neighbours and the vertex itself.
    """
    if both_ways:
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(least, "u")
    if both_ways:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
    return out.filter("u != v").distinct()


def digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(id, component) for every vertex but the least of each component, from edges (u, v)."""
    edges = kept(edges.filter("u != v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    before = digest(edges)
    while before[0]:
        edges = kept(stars(stars(edges, True), False), name)
        now = digest(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
