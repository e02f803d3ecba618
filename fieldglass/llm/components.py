"""Connected components of any number of links, without a hot node in one task or links on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.tables import discard, keep_once


def connected_components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node that has a link.

    Each round sends a node to the first of its closed neighbourhood in a random order and contracts
    the links, which shrinks the nodes by a constant factor. The minimum is an aggregate combined on
    the map side, so a node with very many links is no hot spot; the joins back are plain equality
    joins, which adaptive execution splits when skewed. Loops and nulls are ignored.
    """
    spark = links.sparkSession
    edges = keep_once(links.select(F.col(left).cast("long").alias("a"), F.col(right).cast("long").alias("b"))
                      .where("a is not null and b is not null").distinct(), "links")
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    edges_now, maps, step = edges.where("a <> b"), [], 0
    while not edges_now.isEmpty():
        both = edges_now.union(edges_now.select("b", "a"))
        first = both.groupBy("a").agg(
            F.min(F.xxhash64("b", F.lit(step))).alias("h"),
            F.min_by("b", F.xxhash64("b", F.lit(step))).alias("other"),
        )
        own = F.xxhash64("a", F.lit(step))
        parents = keep_once(first.select(
            F.col("a").alias("node"), F.when(own <= F.col("h"), F.col("a")).otherwise(F.col("other")).alias("parent"),
        ), f"parents-{step}")
        maps.append(parents)
        contracted = (
            edges_now.join(parents.select(F.col("node").alias("a"), F.col("parent").alias("pa")), "a")
            .join(parents.select(F.col("node").alias("b"), F.col("parent").alias("pb")), "b")
            .where("pa <> pb")
            .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        )
        following = keep_once(contracted, f"links-{step}")
        if step:
            discard(edges_now)
        edges_now, step = following, step + 1
    if not maps:
        return nodes.select("node", F.col("node").alias("component"))
    roots = maps[-1].select("node", F.col("parent").alias("root"))
    for parents in reversed(maps[:-1]):
        roots = parents.join(roots.select(F.col("node").alias("parent"), "root"), "parent", "left").select(
            "node", F.coalesce("root", "parent").alias("root"))
    roots = keep_once(nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "roots")
    least = roots.groupBy("root").agg(F.min("node").alias("component"))
    for table in [*maps, edges]:
        discard(table)
    return roots.join(least, "root").select("node", "component")
