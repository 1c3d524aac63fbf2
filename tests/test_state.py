"""The sync in the state store: the same table as the rewritten one, and no more written than changes."""

import random

import pytest

from rolecall.streaming import state
from rolecall.streaming import sync as rewritten

NOW = "2026-11-01 0{}:00:00"


def _runs(seed=5, runs=5):
    """Postings that come, change, move and go, in scopes that are covered or not, with repeated ids; one run covers nothing."""
    rng = random.Random(seed)
    for run in range(runs):
        rows = [("s", str(k), rng.choice(("a", "b", "c", "", None)) if rng.random() < 0.05 else ("a", "b", "c", "", None)[k % 5], f"f{rng.choice((0, 0, 0, run))}", 2 * k) for k in range(60) if rng.random() < 0.75]
        rows += [(s, i, sc, "last", n + 1) for s, i, sc, _, n in rows[:3]]
        yield rows + [(None, None, scope, None, None) for scope in (() if run == 2 else rng.sample(("a", "b", "c"), 2))]


@pytest.mark.parametrize("full", [True, False])
def test_equals_the_rewritten_table(spark, tmp_path, full):
    landed, written, known = f"{tmp_path}/landed", 0, None
    for run, rows in enumerate(_runs()):
        if run == 4:
            known, rows = ["a", "b"], [*rows, (None, None, None, None, None)]
        spark.createDataFrame(rows, rewritten.RUN).coalesce(1).write.mode("append").parquet(landed)
        scopes = None if known is None else spark.createDataFrame([(s,) for s in known], "scope string")
        want = rewritten.sync_available(spark, landed, f"{tmp_path}/table", f"{tmp_path}/one", NOW.format(run), full, scopes)
        got = state.sync_state(spark, landed, f"{tmp_path}/changes", f"{tmp_path}/two", NOW.format(run), full, known, buckets=3)
        columns = got.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*columns).collect())), f"run {run}"
        made = state.changes_of(spark, f"{tmp_path}/changes").where(f"batch = {run}")
        assert made.count() == made.select("source", "source_job_id").distinct().count() < 60
        written += made.count()
    assert state.changes_of(spark, f"{tmp_path}/changes").count() == written


def test_nothing_new_and_a_repeated_run_change_nothing(spark, tmp_path):
    where = (f"{tmp_path}/landed", f"{tmp_path}/changes", f"{tmp_path}/progress")
    rows = spark.createDataFrame([("s", str(k), "a", "f", k) for k in range(9)] + [(None, None, "a", None, None)], rewritten.RUN)
    rows.write.parquet(where[0])
    first = state.sync_state(spark, *where, NOW.format(0), True, buckets=2).collect()
    assert sorted(map(str, state.sync_state(spark, *where, NOW.format(1), True, buckets=2).collect())) == sorted(map(str, first)) and len(first) == 9
    rows.write.mode("append").parquet(where[0])
    assert sorted(map(str, state.sync_state(spark, *where, NOW.format(2), True, buckets=2).collect())) == sorted(map(str, first))
    assert [r["batch"] for r in state.changes_of(spark, where[1]).select("batch").distinct().collect()] == [0], "the second run wrote no row"


def test_forgotten_after_its_time(spark, tmp_path):
    """A key that wasn't written within its time to live is new when it comes back."""
    where = (f"{tmp_path}/landed", f"{tmp_path}/changes", f"{tmp_path}/progress")
    rows = spark.createDataFrame([("s", "1", "a", "f", 1)], rewritten.RUN)
    for run in range(2):
        rows.write.mode("append").parquet(where[0])
        state.sync_state(spark, *where, NOW.format(run), True, buckets=1, ttl_ms=1)
    assert [(r["action"], r["batch"]) for r in state.changes_of(spark, where[1]).orderBy("batch").collect()] == [("insert", 0), ("insert", 1)]
