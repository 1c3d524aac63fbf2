"""Source health from the run history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COLLAPSE, FAILED_SHARE = 0.4, 0.34


def latest_runs(runs: DataFrame) -> DataFrame:
    """The newest run of each connector."""
    return runs.groupBy("connector").agg(F.max_by(F.struct(*(c for c in runs.columns if c != "connector")), "started_at").alias("r")).select("connector", "r.*")


def run_history(runs: DataFrame, per_connector: int = 9) -> DataFrame:
    """At most so many runs of each connector, the newest first."""
    newest = W.partitionBy("connector").orderBy(F.desc("started_at"))
    return runs.withColumn("k", F.row_number().over(newest)).where(F.col("k") <= per_connector)


def trends(runs: DataFrame, per_connector: int = 9) -> DataFrame:
    """``connector, last_run, median_run``: the upper median of the earlier positive counts, if there are three."""
    seen = run_history(runs, per_connector)
    before = F.array_sort(F.collect_list(F.when((F.col("k") > 1) & (F.col("found") > 0), F.col("found"))))
    return seen.groupBy("connector").agg(F.max(F.when(F.col("k") == 1, F.col("found"))).alias("last_run"), before.alias("b")).select(
        "connector", "last_run", F.when(F.size("b") >= 3, F.element_at("b", F.floor(F.size("b") / 2).cast("int") + 1)).alias("median_run")
    )


def collapsed(last: Column, median: Column) -> Column:
    return F.coalesce(median.isNotNull() & (last < F.greatest(F.lit(1.0), COLLAPSE * median)), F.lit(False))


def severity(error: Column, found: Column, collapsed_: Column, failed: Column, checked: Column) -> Column:
    """broken (an error, or nothing found), degraded (collapsed, or a third of the boards failed), ok."""
    share = F.when(checked > 0, failed / checked).otherwise(0.0)
    return F.when(error.isNotNull() | (found == 0), "broken").when(collapsed_ | (share >= FAILED_SHARE), "degraded").otherwise("ok")


def prune(runs: DataFrame, as_of: str, days: int = 14) -> DataFrame:
    return runs.where(F.col("started_at") >= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)))


def unhealthy(runs: DataFrame) -> DataFrame:
    """``connector, error`` of those whose newest run failed or found nothing."""
    return latest_runs(runs).where(F.col("error").isNotNull() | (F.coalesce("found", F.lit(0)) == 0)).select("connector", "error")


def totals(runs: DataFrame) -> DataFrame:
    """``found, new, updated, closed`` of all runs; zeros without any."""
    return runs.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("found", "new", "updated", "closed")))


def report(checks: DataFrame) -> DataFrame:
    """``place, line``: the report on ``connector, severity, said``, the counts first, then broken, degraded and ok connectors by name; as small as the list of connectors."""
    rank = F.when(F.col("severity") == "broken", 1).when(F.col("severity") == "degraded", 2).otherwise(3)
    counts = checks.agg(*(F.count_if(F.col("severity") == s).alias(s) for s in ("ok", "degraded", "broken")))
    head = counts.select(F.lit(0).alias("place"), F.format_string("%d ok, %d degraded, %d broken", "ok", "degraded", "broken").alias("line"))
    lines = checks.select(F.row_number().over(W.orderBy(rank, "connector")).alias("place"), F.format_string("| %s | %s | %s |", "connector", "severity", F.coalesce("said", F.lit(""))).alias("line"))
    return head.unionByName(lines)
