"""Connected components by alternating large-star and small-star steps.

Edges are rewritten until every component is a star around its smallest node.
Large-star moves a node's larger neighbours to its smallest one, small-star
its smaller neighbours and itself; both are a partial ``min`` aggregation and
one join, whatever the degree of a node.  Paths shrink to a half in each
round, so a chain of n nodes takes about log n rounds, and the loop runs until
nothing changes.  Every step is written to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import stored


def _least(edges: DataFrame) -> DataFrame:
    return stored(edges.groupBy("u").agg(F.min("v").alias("m")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _least(both)
    return (both.where("v > u").join(low, "u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    low = _least(edges)  # every edge runs from the larger to the smaller node
    moved = edges.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) of every node that has an edge to another node; the
    component is its smallest node.  Null ends and loops are ignored."""
    l, r = F.col(left), F.col(right)
    now = stored(edges.where(l.isNotNull() & r.isNotNull() & (l != r))
                 .select(F.greatest(l, r).alias("u"), F.least(l, r).alias("v")).distinct())

    def mark(df: DataFrame):
        return df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    seen = mark(now)
    while seen[0]:
        now = stored(_small_star(stored(_large_star(now))))
        after = mark(now)
        if after == seen:
            break
        seen = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
