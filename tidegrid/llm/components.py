"""Connected components of an edge table by alternating large-star and small-star steps.

Both steps are group-wise minima and joins, so no component is ever gathered in one place; each round is
written to the shared folder, and the number of rounds grows with the logarithm of the longest path. They end
when every component is a star around its least node, which one count over the nodes tells; no round is made
to see that nothing changes, and edges that are stars already need none.

Defined cases: edges with a null end and loops are ignored; repeated edges count once; no edges give an
empty result. Ids may have any type that has an order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.shared import discard, saved


def _large_star(edges: DataFrame) -> DataFrame:
    """Link the larger neighbours of each node to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Link the smaller neighbours of each node, and the node, to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _done(edges: DataFrame) -> bool:
    """Whether every larger end (u) has one smaller end (v), and none of these is a larger end itself."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up")).union(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    of_node = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return of_node.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("least") == 0))).agg(F.count("*")).first()[0] == 0


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (its first two columns); a component is named by its least node."""
    u, v = edges.columns[:2]
    now = saved(edges.where(F.col(u) != F.col(v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    while not _done(now):
        following = saved(_small_star(_large_star(now)))
        discard(now)
        now = following
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
