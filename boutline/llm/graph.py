"""Connected components by alternating star contractions, as joins and aggregations; every step is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def merged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join that is never broadcast: a broadcast is built in the driver's memory, and a loop of small joins leaves many of them there."""
    return left.join(right.hint("merge"), on, how)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; ``edges`` has columns u and v of one orderable type. The root is the smallest node of
    the component. Each round points nodes at their smallest neighbour; the rounds grow with the logarithm of the longest chain."""
    state = edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    before = None
    while True:
        # large star: larger neighbours hang on the smallest one around; both ways of an edge, pre-aggregated per node
        both = state.unionAll(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = merged(both.filter(F.col("v") > F.col("u")), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.unionAll(least.filter(F.col("m") < F.col("u")).select("u", F.col("m").alias("v"))))
        # small star: smaller neighbours of a node hang on the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = merged(large, low, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = materialize(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct())
        # settled when a round leaves the edges as they were
        count = state.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(count) == before:
            break
        before = tuple(count)
    roots = state.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
