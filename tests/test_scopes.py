"""Scopes that a run covers, found in a table far larger than they are."""

from rolecall.operators import sync


def test_jobs_are_not_shuffled_by_scope(spark):
    """Few scopes out of many rows are broadcast, as a shuffle would put all jobs of a scope into one task."""
    stored = spark.range(9).selectExpr("'s' as source", "string(id) as source_job_id", "concat('board-', id % 3) as scope", "'f' as fingerprint", "0 as missed_runs", "id as ordinal")
    covered = spark.range(10_000_000).where("id < 2").selectExpr("concat('board-', id) as scope")
    actions = sync.sync_actions(stored, stored.where("false"), covered, covered, full=True)
    plan = actions._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "at_scope" in line]
    assert joins and all("BroadcastHashJoin" in line for line in joins)
    assert {(r["source_job_id"], r["action"]) for r in actions.collect()} == {(str(i), "retired" if i % 3 == 2 else "close") for i in range(9)}
