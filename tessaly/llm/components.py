"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, stored


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Links of columns u and v: each node's larger (or, of the small star, smaller) neighbours go to its smallest one."""
    ends = edges.select("u", "v").union(edges.select("v", "u")) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # Stored, so that the join deals both sides anew and may split a node with many links.
    low = stored(ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least-neighbours")
    both = ends.join(low, "u")
    if large:
        return both.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    return both.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) for every node that is not a root. edges: columns u, v of one type.

    Goes on until nothing changes, which takes some log(nodes) squared rounds at most; each round's table goes when the
    next one is written."""
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while True:
        large = stored(_stars(now, True), "links")
        after = stored(_stars(large, False), "links")
        discard(now, large)
        now = after
        # Done when every node has one root, and no root has one.
        roots = now.select(F.col("v").alias("u")).distinct()
        if now.groupBy("u").count().where("count > 1").isEmpty() and now.join(roots, "u", "left_semi").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
