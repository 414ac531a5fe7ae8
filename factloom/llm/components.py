"""Connected components of links, by alternating large and small stars over joins.

Every step keeps for each node the least of its neighbours and links the others to it, which halves distances while no
row count grows; a node's least neighbour is an aggregate that combines before the shuffle. The least values are written
to the shared folder before they are joined back, so that both sides of the join are plain exchanges and a node that
holds a large share of all links is split among tasks. Ids are long and not null; a link to itself is ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def _are_stars(edges: DataFrame) -> bool:
    """Whether every id has one link to a lower id that itself has none."""
    n, ids = edges.agg(F.count("*"), F.count_distinct("a")).first()
    return n == ids and edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """id and component (the least id reachable) of every id in links (a, b)."""
    edges = store.materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc-edges")
    if edges.isEmpty():
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = store.materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "cc-least")
        large = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = store.materialize(large, "cc-large")
        least = store.materialize(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u"), "cc-least")
        small = large.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = store.materialize(small.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "cc-edges")
        if _are_stars(edges):
            roots = edges.select(F.col("b").alias("id")).distinct()
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))
    raise RuntimeError("the components did not settle")
