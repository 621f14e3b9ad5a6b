"""Connected components by alternating large-star and small-star steps; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajecta.llm.common import discard, written


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (its smallest node) for every node of edges (a, b); loops and repeated edges do no harm.

    Each step links nodes to smaller ones: large-star a node's larger neighbours, small-star its smaller ones, to the
    smallest of all. They end as stars. Minima add up partial ones, so a hub needs no large task.
    """
    state = written(_down(edges.select("a", "b")))
    before = None
    while True:
        ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
        both = state.select(F.explode(ends).alias("e")).select("e.a", "e.b")
        smallest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = _down(both.where("b > a").join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        old, state = state, written(_down(small))
        discard(old)
        mark = tuple(state.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        if mark == before:
            break
        before = mark
    stars = state.groupBy("a").agg(F.min("b").alias("b"))
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _down(edges: DataFrame) -> DataFrame:
    """Distinct edges from the larger to the smaller node."""
    return edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
