"""Connected components of a table of links by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starcellar.llm.tables import stored


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root) for the nodes of ``links`` (a long, b long): ``root`` is the smallest node reachable.

    Each round first points a node's larger neighbours at its smallest neighbour, then its smaller ones; the links
    stay as many as nodes and become stars within a number of rounds that grows with the logarithm of the longest
    path.  A round is groupings and joins, so a node with very many links is summed before the shuffle and its join
    partition can be split.  Every round is written to the shared folder.  Links of a node to itself are left out, so
    a node without others does not come back; repeated links count once, links with a missing end not at all.
    """
    edges = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    edges = stored(edges, "components")
    state = _state(edges)
    while True:
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(edges.select("lo", "hi"))
        nearest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(nearest, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (
            large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .union(least.select("hi", F.col("m").alias("lo"))).distinct()
        )
        edges = stored(small, "components")
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select("lo").distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(roots.select("lo", "lo"))


def _state(edges: DataFrame) -> tuple:
    """Number of links and a sum over them that changes when they do."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
