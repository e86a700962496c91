"""Connected components of links, by alternating large and small stars.

Every node ends up linked to the smallest id of its component.  Links stay in
Spark all the time; each round is written to the shared folder, so a lost
executor costs a round at most.  A node with very many links costs one row for
each task in the aggregations, and its join is one that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, materialise


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links(a, b) with a > b; the nodes' neighbours move to their smallest one."""
    if large:
        both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        moved = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = links.groupBy("a").agg(F.min("b").alias("m"))
        joined = links.join(least, "a")
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return moved.where("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of links(a, b); nodes without links aren't in it."""
    now = materialise(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())

    seen = state(now)
    while seen[0]:
        then, now = now, materialise(_star(_star(now, True), False), "links")
        drop_scratch(then)
        if (new := state(now)) == seen:
            break
        seen = new
    return materialise(now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct(), "components")
