"""Connected components of a graph that stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paylattice.llm.common import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of the edges (a, b; longs).

    Alternating large-star and small-star rounds: every round hangs neighbours on the smallest node they
    know, until each component is a star. Rounds grow with the logarithm of its size; what a node sends on
    is one row per neighbour, and smallest neighbours are found by pre-aggregation, so a hub does not
    gather its neighbours anywhere. Loops and repeated edges are fine; no edges give no rows.
    """
    state = cut(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges"
    )
    seen = None
    while True:
        print_of = state.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (print_of["n"], print_of["x"]) == seen:
            break
        seen = (print_of["n"], print_of["x"])
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(down.select("a", F.col("m").alias("b")))
            .filter("a <> b").distinct()
        )
        state = cut(small, "edges")
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        state.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
