"""Connected components as a loop of joins and grouped minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecall.operators.joins import join_hot
from rolecall.staging import stage_table


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, component)``: the smallest node reachable over undirected ``edges``.

    Alternates big-star and small-star steps (Kiveris et al., 2014): every round
    links neighbours to the smallest node they see, until the edges form stars.
    Stars need O(log^2 n) rounds; a hub's minimum is pre-aggregated before the
    shuffle and its rows are joined by ``join_hot``, so no task holds a whole
    neighbourhood. Rows with a null end are ignored, a loop gives a single node.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("node"))
    links = stage_table(_down(pairs).distinct())
    state = _sum(links)
    while state[0]:
        links = stage_table(_star(links, big=True))
        links = stage_table(_star(links, big=False))
        if (now := _sum(links)) == state:
            break
        state = now
    return (
        links.select(F.col("u").alias("node"), F.col("v").alias("component"))
        .unionByName(nodes.select("node", F.col("node").alias("component")))
        .groupBy("node").agg(F.min("component").alias("component"))
    )


def _down(pairs: DataFrame) -> DataFrame:
    """Edges from the larger to the smaller end, without loops."""
    return pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def _sum(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(links: DataFrame, big: bool) -> DataFrame:
    """Links each neighbour to the node's smallest: the larger ones (big) or the smaller ones (small)."""
    around = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))) if big else links
    least = stage_table(around.groupBy("u").agg(F.min("v").alias("least"), F.count("*").alias("n_rows")).withColumn("least", F.least("u", "least")))
    found = join_hot(around, least, "u")
    if big:
        return found.where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()
    return (
        found.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
        .unionByName(least.select("u", F.col("least").alias("v")))
        .where("u <> v").distinct()
    )
