"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talkgrain.llm.common import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (large-star) or the smaller (small-star) neighbours of every node on its least neighbour.

    The least neighbour comes from a partially aggregated groupBy and is joined back, so a node with very many
    neighbours is spread by the skew join and its neighbours are never gathered in one place.
    """
    if large:
        arcs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        arcs = edges
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = arcs.join(least, "u")
    out = hung.where(F.col("v") > F.col("u")) if large else hung
    pairs = out.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        pairs = pairs.unionByName(least.select("u", F.col("m").alias("v")))
    return pairs.where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the least node that is reachable, for every node with an edge.

    `edges` may repeat pairs, in either direction; self loops and nulls are ignored; no edges give an empty result.
    """
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = materialize(now, "edges")
    while True:
        after = materialize(_star(_star(now, True), False), "edges")
        # a forest of stars has one edge a node and no node that is both centre and leaf
        moved = after.select("v").distinct().join(after.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        repeated = moved or after.groupBy("u").count().where("count > 1").limit(1).count()
        discard(now)
        now = after
        if not repeated:
            break
    centres = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(centres)
