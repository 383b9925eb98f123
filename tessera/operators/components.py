"""Connected components by alternating large-star and small-star steps.

Each step joins edges with their ends' least neighbours and is written to the shared folder. No node's neighbours are gathered
in one place: minima are pre-aggregated, and joins on a node with many edges can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import discard, written


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns node, component (the least node that it is linked to); nodes without edges are not listed.

    Loops and repeated edges change nothing. Null ends are left out. No edges: no rows.
    """
    spark = edges.sparkSession
    now, path = written(_ordered(edges), "components")
    state = _state(now)
    while True:
        stars = _ordered(_small_star(_large_star(now)))
        new, new_path = written(stars, "components")
        new_state = _state(new)
        discard(spark, path)
        now, path = new, new_path
        if new_state == state:
            break
        state = new_state
    least = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return least.unionByName(roots)


def _ordered(edges: DataFrame) -> DataFrame:
    """Each edge once, the larger end first."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours are linked to the least of the neighbours and the node."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours and the node are linked to the least neighbour. Edges have the larger end first."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    others = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b")))
