"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.shared import discard, settle


def components(edges: DataFrame) -> DataFrame:
    """``edges``: columns ``a``, ``b`` of one orderable type. Returns ``node``, ``root``: the smallest node it reaches.

    Each round is a minimum by node, joined back to the node's edges: no group is
    ever gathered, so a star of any size is only a skewed join, which adaptive
    execution splits. Every round is a written table. Few rounds are needed if edges
    point to the smallest node that is known to be in reach. Loops and repeated edges
    do no harm; nodes without an edge to another node are not returned.
    """
    edges = settle(edges.select("a", "b").where("a <> b"), "links")
    while True:
        edges = starred(starred(edges, large=True), large=False)
        if settled_down(edges):
            break
    # every edge now points from a node to its root
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def settled_down(edges: DataFrame) -> bool:
    """Whether every node points to one other at most and none that is pointed to points on."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("ways"), F.lit(0).alias("asked")), F.struct(F.col("b").alias("node"), F.lit(0).alias("ways"), F.lit(1).alias("asked")))).alias("end"))
    nodes = ends.groupBy("end.node").agg(F.sum("end.ways").alias("ways"), F.max("end.asked").alias("asked"))
    return not nodes.where("ways > 1 OR (ways = 1 AND asked = 1)").agg(F.count(F.lit(1))).first()[0]


def starred(edges: DataFrame, large: bool) -> DataFrame:
    """The settled ``edges`` after one half of a round; they and what the half has written go."""
    out, least = star(edges, large)
    after = settle(out, "links")
    discard(edges, least)
    return after


def star(edges: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b) with a > b afterwards; large: to larger neighbours, else to smaller ones and the node itself. Also the settled minima that they are made from."""
    if large:
        ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        ways = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # written, so that the join deals both sides itself and a node with very many edges can be split
    least = settle(ways.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), F.least("a", "m").alias("m")), "least")
    met = ways.join(least, ways.a == least.of)
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("of").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct(), least
