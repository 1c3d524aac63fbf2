"""Rewrites of stored tables: each returns the new table, to be written in place of the old."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KEY = ["source", "source_job_id"]


def update_scored(stored: DataFrame, scored: DataFrame) -> DataFrame:
    """``stored`` with the scores and reasons of the keys in ``scored``; all other rows as they were."""
    new = scored.select(*_KEY, F.struct(F.round("match_score", 2).alias("score"), F.col("match_reasons").alias("reasons")).alias("new"))
    found = F.col("new").isNotNull()
    return stored.join(new, _KEY, "left").withColumns({
        "match_score": F.when(found, F.col("new.score")).otherwise(F.col("match_score")), "match_reasons": F.when(found, F.col("new.reasons")).otherwise(F.col("match_reasons")),
    }).select(*stored.columns)


def store_extractions(cache: DataFrame, new: DataFrame, as_of: str) -> DataFrame:
    """``description_hash, payload, model, created_at`` after an upsert; a known text keeps its first time."""
    fresh = new.select("description_hash", F.struct("payload", "model").alias("n"))
    both = cache.select("description_hash", F.struct("payload", "model", "created_at").alias("o")).join(fresh, "description_hash", "full_outer")
    return both.select(
        "description_hash", F.coalesce("n", F.struct("o.payload", "o.model")).alias("c"), F.coalesce("o.created_at", F.lit(as_of).cast("timestamp_ntz")).alias("created_at")
    ).select("description_hash", "c.payload", "c.model", "created_at")


def prune(table: DataFrame, at: str, as_of: str, days: int) -> DataFrame:
    """Rows no older than ``days`` days; the cache keeps 60, the run history 14."""
    return table.where(F.col(at) >= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days)))
