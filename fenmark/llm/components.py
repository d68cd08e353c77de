"""Connected components by alternating large-star and small-star contraction.

Each round replaces edges by edges to least neighbours.  The aggregates are minima, and they are written before
edges are joined with them, so that AQE may split the edges of a vertex with very many neighbours: it is no single
task's work.  A round's edges are written to the shared folder, which cuts the lineage.  The number
of rounds grows with the logarithm of the longest chain.  Nothing but two sums is
brought to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenmark.llm.runtime import discard, written


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, root): each node of an edge with the least node it is linked to."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(now)
    while True:
        large, least = _large_star(now)
        small, lesser = _small_star(large)
        after = written(small, "links")
        reached = _state(after)
        discard(now, least, lesser)
        if reached == state:
            break
        now, state = after, reached
    stars = after.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def _state(edges: DataFrame) -> tuple:
    h = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count("*"), F.sum(h)).first())


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links each larger neighbour of a node to the least of the node and its neighbours; and the table that this reads."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = written(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")), "least")
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links each smaller neighbour of a node, and the node, to the least of them; edges are (larger, smaller).  And the table that this reads."""
    least = written(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), least
