"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage_table


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every end of ``edges`` (two long columns u, v), root the smallest reachable.

    Each round sends a node to the smallest of itself and its neighbours, then carries the edges
    over to those. Only a minimum per node is grouped, so a hub costs one row per task before the
    shuffle; its edges in the joins are dealt anew by adaptive execution. Edges that meet in one node
    vanish, so rounds stay few. Every round is a written table, so a lost executor repeats one round.
    """
    edges = stage_table(
        edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        .filter("u < v")
        .distinct(),
        "edges",
    )
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        near = edges.select(F.col("u").alias("node"), F.col("u").alias("other")).union(
            edges.select(F.col("v").alias("node"), F.col("u").alias("other"))
        )
        parent = stage_table(near.groupBy("node").agg(F.min("other").alias("parent")), "parents")
        maps.append(parent)
        up = lambda side: parent.select(F.col("node").alias(side), F.col("parent").alias(f"p{side}"))  # noqa: E731, B023
        moved = edges.join(up("u"), "u").join(up("v"), "v")
        edges = stage_table(
            moved.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v"))
            .filter("u < v")
            .distinct(),
            "edges",
        )
    if not maps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))

    def follow(found: DataFrame, step: DataFrame) -> DataFrame:
        onward = step.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        return found.join(onward, "parent", "left").select(
            "node", F.coalesce("next", "parent").alias("parent")
        )

    return reduce(follow, maps).withColumnRenamed("parent", "root")
