"""Stored tables on disk: whole runs or none, source by source."""

import pytest
from pyspark.sql import functions as F

from rolecall.operators import sync, tables
from rolecall.streaming.sync import TABLE

NOW = "2026-11-0{} 00:00:00"
AT = "source string, source_job_id string, scope string, fingerprint string, ordinal long, missed_runs int, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, link_status string, link_checked_at timestamp_ntz"


def _wanted(spark, *rows):
    return spark.createDataFrame([(*r, 0, None, None, None, None) for r in rows], TABLE)


def _held(spark, path):
    return {(r["source"], r["source_job_id"]): (r["fingerprint"], r["missed_runs"], str(r["first_seen_at"])[:10]) for r in tables.load(spark, path, AT).collect()}


def _sync(spark, path, day, rows, covered, full=True, known=None):
    return {r["source"]: tuple(r)[1:] for r in tables.sync_sources(spark, path, AT, _wanted(spark, *rows), covered, known, full, NOW.format(day)).collect()}


def test_runs_write_what_they_change(spark, tmp_path):
    path = f"file://{tmp_path}/jobs"
    assert tables.load(spark, path, AT).count() == 0 and tables.vacuum(spark, path) == []
    one = [("a", "1", "a:x", "f", 1), ("a", "2", "a:y", "f", 2), ("b", "1", "b:x", "f", 3)]
    assert _sync(spark, path, 1, one, ["a:x", "a:y", "b:x"]) == {"a": (2, 0, 0), "b": (1, 0, 0)}
    two = [("a", "1", "a:x", "g", 1), ("b", "1", "b:x", "f", 3)]
    assert _sync(spark, path, 2, two, ["a:x", "b:x"]) == {"a": (0, 1, 0), "b": (0, 0, 0)}, "the failed scope a:y closes nothing, and b isn't written"
    assert _held(spark, path) == {("a", "1"): ("g", 0, "2026-11-01"), ("a", "2"): ("f", 0, "2026-11-01"), ("b", "1"): ("f", 0, "2026-11-01")}
    assert [(r["source"], r["n_rows"]) for r in tables.commits(spark, path).where("run = 1").collect()] == [("a", 2)]
    assert _sync(spark, path, 3, [("b", None, None, None, None)], ["b:x"]) == {"b": (0, 0, 1)}, "a source that found nothing"
    assert set(_held(spark, path)) == {("a", "1"), ("a", "2")}
    assert tables.vacuum(spark, path) == [0] and set(_held(spark, path)) == {("a", "1"), ("a", "2")}


def test_misses_are_stored(spark, tmp_path):
    path = f"file://{tmp_path}/jobs"
    _sync(spark, path, 1, [("a", "1", "", "f", 1), ("a", "2", "", "f", 2)], [""], full=False)
    assert _sync(spark, path, 2, [("a", "2", "", "f", 2)], ["a:x"], full=False) == {"a": (0, 0, 0)} and _held(spark, path)["a", "1"][1] == 1
    assert _sync(spark, path, 3, [("a", "2", "", "f", 2)], ["a:x"], full=False) == {"a": (0, 0, 1)} and set(_held(spark, path)) == {("a", "2")}


def test_a_failed_write_leaves_the_old_table(spark, tmp_path):
    path = f"file://{tmp_path}/jobs"
    _sync(spark, path, 1, [("a", "1", "", "f", 1)], [""])
    before = _held(spark, path)
    bad = _wanted(spark, ("a", "2", "", "f", 2)).withColumn("fingerprint", F.raise_error(F.lit("dies")).cast("string"))
    counts = spark.createDataFrame([("a", 1, 0, 0)], "source string, new long, updated long, deleted long")
    with pytest.raises(Exception, match="dies"):
        tables.commit_run(bad, counts, path)
    assert _held(spark, path) == before
    (tmp_path / "jobs/000000007/data/source=a").mkdir(parents=True)  # data without a commit: a run killed between the two
    (tmp_path / "jobs/000000007/data/source=a/x.parquet").write_bytes(b"half")
    assert _held(spark, path) == before
    assert _sync(spark, path, 2, [("a", "3", "", "f", 3)], [""]) == {"a": (1, 0, 1)} and set(_held(spark, path)) == {("a", "3")}
    assert 7 in tables.vacuum(spark, path) and set(_held(spark, path)) == {("a", "3")}


def test_reset_and_history(spark, tmp_path):
    path, history = f"file://{tmp_path}/jobs", f"file://{tmp_path}/runs"
    _sync(spark, path, 1, [("a", "1", "", "f", 1), ("b", "1", "", "f", 1)], [""])
    runs = spark.createDataFrame([("a", "2026-10-20 00:00:00"), ("a", "2026-10-30 00:00:00")], "connector string, at string").select("connector", F.col("at").cast("timestamp_ntz").alias("started_at"))
    tables.record_run(runs.limit(1), history)
    tables.record_run(runs.subtract(runs.limit(1)), history)
    cache = spark.createDataFrame([("h", "2026-09-01 00:00:00"), ("k", "2026-10-31 00:00:00")], "description_hash string, at string").withColumn("created_at", F.col("at").cast("timestamp_ntz"))
    told = tables.reset(spark, path, tables.load(spark, path, AT), cache, spark.read.parquet(history), NOW.format(1))
    assert told == {"jobs_deleted": 2, "cache_pruned": 1, "runs_pruned": 1} and _held(spark, path) == {}


def test_link_results_meet_the_table(spark, tmp_path):
    """Dead links go, found ones are noted, unknown ones change nothing."""
    path = f"file://{tmp_path}/jobs"
    _sync(spark, path, 1, [("a", str(k), "", "f", k) for k in range(4)], [""])
    results = spark.createDataFrame([("a", "0", "ok"), ("a", "1", "dead"), ("a", "2", None), ("b", "9", "dead")], "source string, source_job_id string, status string")
    kept = sync.record_link_results(tables.load(spark, path, AT), results, NOW.format(2)).collect()
    assert {r["source_job_id"]: (r["link_status"], str(r["link_checked_at"])[:10]) for r in kept} == {"0": ("ok", "2026-11-02"), "2": (None, "None"), "3": (None, "None")}
