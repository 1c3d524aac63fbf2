"""Keyed snapshot sync: a failed fetch closes nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.staging import stage_table

_KEY = ("source", "source_job_id")


def fingerprint(*columns: str) -> Column:
    """A digest of the values that count as a change."""
    return F.sha1(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}))


def _scopes(scopes: DataFrame | list[str] | None, like: DataFrame, name: str) -> DataFrame:
    """``scope`` and a column ``name`` that is true; scopes may be many, so they are a table. It is staged: Spark then knows its size and
    broadcasts it if it is small, where an estimate by what it was read from would shuffle all jobs by their few scopes."""
    table = scopes if isinstance(scopes, DataFrame) else like.sparkSession.createDataFrame([(s,) for s in scopes or ()], "scope string")
    return stage_table(table.select(F.col("scope").alias("at_scope")).where("at_scope is not null").distinct().withColumn(name, F.lit(True)))


def sync_actions(stored: DataFrame, wanted: DataFrame, covered: DataFrame | list[str] | None, known: DataFrame | list[str] | None, full: bool) -> DataFrame:
    """``source, source_job_id, action, missed_runs`` of every stored or wanted key.

    stored: key, scope, fingerprint, missed_runs; wanted: key, scope, fingerprint,
    ordinal (of equal keys the last counts). Actions: insert; update (the
    fingerprint differs or runs were missed); skip; retired (a scope no longer
    known); uncovered (its scope wasn't proven checked); close (missed once if the
    listing is full, twice if searched); miss. With nothing covered, nothing closes
    or misses. An empty scope is judged whenever anything was covered. ``covered`` and
    ``known`` are tables with a column ``scope``, or lists.
    """
    few = stored.select(*_KEY, "scope", "fingerprint", "missed_runs"), wanted.select(*_KEY, "scope", "fingerprint", "ordinal")
    return judged(*few, covered, known, full).select(*_KEY, "action", "missed_runs")


def judged(stored: DataFrame, wanted: DataFrame, covered: DataFrame | list[str] | None, known: DataFrame | list[str] | None, full: bool) -> DataFrame:
    """``sync_actions`` with ``old`` and ``new``: the other columns of each key's stored and last wanted row, so that ``applied`` needs no join."""
    last = wanted.groupBy(*_KEY).agg(F.max_by(F.struct(*(c for c in wanted.columns if c not in _KEY)), "ordinal").alias("new"))
    both = stored.select(*_KEY, F.struct(*(c for c in stored.columns if c not in _KEY)).alias("old")).join(last, list(_KEY), "full_outer")
    old, new = F.col("old"), F.col("new")
    scope = F.coalesce(old["scope"], F.lit(""))
    missed = F.coalesce(old["missed_runs"], F.lit(0))
    is_covered = _scopes(covered, stored, "covered")
    some = not is_covered.isEmpty()
    both = both.withColumn("at_scope", scope).join(is_covered, "at_scope", "left")
    if known is not None:
        both = both.join(_scopes(known, stored, "known"), "at_scope", "left")
    retired = (scope != "") & F.col("known").isNull() if known is not None else F.lit(False)
    judged = ((scope == "") | F.col("covered").isNotNull()) if some else F.lit(False)
    action = (
        F.when(old.isNull(), "insert")
        .when(new.isNotNull(), F.when((old["fingerprint"] != new["fingerprint"]) | (missed > 0), "update").otherwise("skip"))
        .when(retired, "retired").when(~judged, "uncovered").when(missed + 1 >= (1 if full else 2), "close").otherwise("miss")
    )
    found = both.select(*_KEY, action.alias("action"), missed.alias("before"), "old", "new")
    after = F.when(F.col("action").isin("insert", "update"), 0).when(F.col("action") == "miss", F.col("before") + 1).otherwise(F.col("before"))
    return found.select(*_KEY, "action", after.cast("int").alias("missed_runs"), "old", "new")


def applied(marked: DataFrame, columns: list[str], as_of: str) -> DataFrame:
    """The table after the sync, as by ``apply_sync``, out of what ``judged`` gave: rows already hold both sides."""
    now, fresh = F.lit(as_of).cast("timestamp_ntz"), F.col("action").isin("insert", "update")
    told = {
        "missed_runs": F.col("missed_runs"), "first_seen_at": F.when(fresh, F.coalesce("old.first_seen_at", now)).otherwise(F.col("old.first_seen_at")),
        "last_seen_at": F.when(fresh, now).otherwise(F.col("old.last_seen_at")), **{c: F.when(~fresh, F.col(f"old.{c}")) for c in ("link_status", "link_checked_at")},
    }
    kept = marked.where(f"action not in ('close', 'retired') and {' and '.join(f'{c} is not null' for c in _KEY)}")
    return kept.select(*((F.col(c) if c in _KEY else told.get(c, F.when(fresh, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")))).alias(c) for c in columns))


def apply_sync(stored: DataFrame, wanted: DataFrame, actions: DataFrame, as_of: str) -> DataFrame:
    """The table after the sync. First sight stays, a changed row's link check is forgotten, unchanged rows keep their last sight.

    Both tables hold the same columns, among them the key, fingerprint, ordinal,
    first_seen_at, last_seen_at, missed_runs, link_status and link_checked_at.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    last = wanted.groupBy(*_KEY).agg(F.max_by(F.struct(*(c for c in wanted.columns if c not in _KEY)), "ordinal").alias("w")).select(*_KEY, "w.*")
    fresh = last.join(actions.where("action in ('insert', 'update')").select(*_KEY), list(_KEY)).join(
        stored.select(*_KEY, F.col("first_seen_at").alias("seen_before")), list(_KEY), "left"
    ).withColumns({
        "first_seen_at": F.coalesce("seen_before", now), "last_seen_at": now, "missed_runs": F.lit(0),
        "link_status": F.lit(None).cast("string"), "link_checked_at": F.lit(None).cast("timestamp_ntz"),
    })
    stay = stored.drop("missed_runs").join(actions.where("action in ('skip', 'uncovered', 'miss')").select(*_KEY, "missed_runs"), list(_KEY))
    return fresh.select(*stored.columns).unionByName(stay.select(*stored.columns))


def record_link_results(stored: DataFrame, results: DataFrame, as_of: str) -> DataFrame:
    """Sets link_status by key and drops dead links; unknown results never delete."""
    joined = stored.join(results.select(*_KEY, F.col("status").alias("found")), list(_KEY), "left")
    return joined.where("found is null or found <> 'dead'").withColumns({
        "link_status": F.coalesce("found", "link_status"),
        "link_checked_at": F.when(F.col("found").isNotNull(), F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("link_checked_at")),
    }).select(*stored.columns)
