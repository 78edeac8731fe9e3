"""Connected components of an edge table by alternating large-star and small-star steps.

Each step is a grouped minimum (pre-aggregated before its shuffle) and an equi-join that adaptive
execution may split, so a node that a third of all edges touch stays spread out. Edges live in the
shared folder between steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discarded, stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node with an edge, component being the smallest node reachable."""
    ends = F.least(a, b), F.greatest(a, b)
    now = stored(edges.select(ends[0].alias("b"), ends[1].alias("a")).where("a <> b").distinct(), "edges")
    state = _state(now)
    while True:
        # large star: each node ties its larger neighbours to the least node of its neighbourhood
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: each node ties itself and its smaller neighbours to the least of them
        large = stored(large, "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, now = now, stored(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        discarded(last, large)
        before, state = state, _state(now)
        if state == before:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
