"""Connected components by alternating large and small stars.

Each round is two aggregations and two joins over the edges that are left, and
ends in a written table, so lineage stays short and a lost executor costs one
step. A hub with very many neighbours is only aggregated (combined before the
shuffle) and joined back, never collected.
"""

from pyspark.sql import functions as F

from ..operators.storage import settle


def _least_neighbour(arcs):
    return arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges):
    """Link every larger neighbour of a node to the least node around it."""
    arcs = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (arcs.join(_least_neighbour(arcs), "u").where("v > u and v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(edges):
    """Link a node and its smaller neighbours to the least of them (u > v in every edge)."""
    least = _least_neighbour(edges)
    return (edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .where("u <> v").distinct())


def connected_components(edges, u="u", v="v", name="components"):
    """(node, component) of every node that has an edge to another one.

    ``component`` is the smallest node reachable. Nodes are integers; edges
    with a null end are ignored, loops and repeated edges do no harm. No edges
    give an empty table.
    """
    edges = edges.select(F.col(u).cast("long").alias("a"), F.col(v).cast("long").alias("b"))
    edges = edges.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = settle(edges, name)
    state = _state(edges)
    while True:
        edges = settle(_small_star(_large_star(edges)), name)
        now = _state(edges)
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now


def _state(edges):
    """Number of edges and two sums over them; equal before and after the last round."""
    row = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long")),
                    F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)
