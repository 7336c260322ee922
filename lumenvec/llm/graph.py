"""Connected components of a link table, by alternating large and small stars.

Each round rewires every link towards the smallest neighbour: a large star
hangs the larger neighbours of a node on its smallest one, a small star does
so with the smaller ones. When a round changes nothing, every link is
(node, root). Rounds grow with the logarithm of the graph, not its diameter.
Every round is written to the shared folder, so its lineage is one read, and
minima are combined before the shuffle, so a node with many links is no hot
group. Only two numbers a round go to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenvec.plans.strategy import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node
    of the component. Links from a node to itself are ignored."""
    edges = materialize(
        links.select(F.greatest(a, b).alias("big"), F.least(a, b).alias("small")).where("big <> small").distinct(), "links"
    )
    seen = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("big", "small").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            # The smallest node of a component hangs on itself.
            roots = edges.select(F.col("small").alias("node"), F.col("small").alias("root")).distinct()
            return edges.select(F.col("big").alias("node"), F.col("small").alias("root")).unionByName(roots)
        seen = tuple(state)
        edges = materialize(_small_star(_large_star(edges)), "links")


def _large_star(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("big").alias("u"), F.col("small").alias("v")).unionByName(
        edges.select(F.col("small").alias("u"), F.col("big").alias("v"))
    )
    least = ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
    return (
        edges.join(least, F.col("small") == F.col("u"))
        .select("big", F.col("least").alias("small"))
        .where("big <> small")
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy(F.col("big").alias("u")).agg(F.min("small").alias("least"))
    moved = edges.join(least, F.col("big") == F.col("u")).select(F.col("small").alias("big"), F.col("least").alias("small"))
    own = least.select(F.col("u").alias("big"), F.col("least").alias("small"))
    return moved.unionByName(own).where("big <> small").distinct()
