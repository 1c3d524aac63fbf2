"""Groups of any size, cut into blocks of bounded size that meet two at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolecall.operators.joins import join_hot
from rolecall.staging import stage_table


def blocks_by_size(rows: DataFrame, group: str, item: str, weight: Column, room: int) -> DataFrame:
    """``rows`` with ``block``: each group's in blocks of about ``room`` in weight, in order of their column ``size``.

    ``item`` tells a group's rows apart. A row's place comes from the counts of its
    group's sizes, so no task sorts or holds a whole group. ``rows`` is a staged table
    without columns ``at``, ``n``, ``before`` and ``weight``.
    """
    rows = rows.withColumn("at", F.concat_ws(":", group, "size"))
    sizes = rows.groupBy("at", group, "size").agg(F.count("*").alias("n_rows"), F.max(weight).alias("weight"))
    before = F.sum(F.col("n_rows") * F.col("weight")).over(Window.partitionBy(group).orderBy("size").rowsBetween(Window.unboundedPreceding, -1))
    sizes = stage_table(sizes.select("at", F.coalesce(before, F.lit(0)).alias("before"), F.col("n_rows").alias("n"), "weight", "n_rows"))
    place = F.col("before") + F.pmod(F.xxhash64(item), "n") * F.col("weight")
    return join_hot(rows, sizes, "at").withColumn("block", F.floor(place / room).cast("long")).drop("at", "n", "before", "weight")


def meetings(heads: DataFrame, group: str, where: str) -> DataFrame:
    """``group, own, other``: the pairs of blocks of a group for which ``where`` holds, in terms of ``l`` and ``r``. ``heads`` has a row a block."""
    return heads.alias("l").join(heads.alias("r"), F.expr(f"l.{group} = r.{group} and l.block <= r.block and ({where})")).select(
        F.col(f"l.{group}").alias(group), F.col("l.block").alias("own"), F.col("r.block").alias("other")
    )


def attend(rows: DataFrame, meetings: DataFrame, group: str) -> DataFrame:
    """``rows`` once for each meeting of their block, with ``own`` and ``other``: what a task needs is then one group of rows."""
    sides = meetings.select(group, "own", "other", F.explode(F.array_distinct(F.array("own", "other"))).alias("block"))
    return rows.join(sides, [group, "block"])
