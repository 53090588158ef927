"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rostrum.llm import folder


def _stars(edges: DataFrame, larger: bool) -> DataFrame:
    """Link every neighbour of a node to the least node around it.

    ``larger`` links the neighbours above the node, otherwise the node and those below it.
    The least node is an aggregate that is combined before the shuffle; the join back is an
    ordinary one, whose large keys adaptive execution splits.
    """
    if larger:
        sides = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = sides.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = sides.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        below = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = below.union(least.select("u", F.col("m").alias("v")))
    return out.filter("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``(id, component)`` for all nodes of ``links(a, b)``; a component is named by its least node.

    Alternating large-star and small-star steps: each keeps the components and shortens the
    paths, until all links are stars. Every step is written to the shared folder, so a lost
    executor costs one step at most. Links of a node to itself and null ends are left out.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges = folder.written(edges.filter("a is not null and b is not null and u > v").distinct(), "links")
    before = None
    while True:
        edges = folder.written(_stars(_stars(edges, True), False), "links")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first()
        if now == before or not now[0]:
            break
        before = now
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
