"""The index of startups' names."""

from rolecall import staging
from rolecall.plans import catalog, ventures
from tests.conftest import SMALL, rows


def test_startups_are_dealt_before_their_names(spark, monkeypatch):
    """A company makes three names, which no task sorts for the whole list."""
    before = rows(catalog.queries()["startup_index"](spark, SMALL))
    monkeypatch.setattr(staging, "ROWS_A_TASK", 5)
    index = ventures.startup_index(spark, SMALL)
    listed = ventures._listed(spark, SMALL).count()
    assert "REPARTITION_BY_NUM, [plan_id" in index._jdf.queryExecution().executedPlan().toString() and f", {-(-listed // 5)})" in index._jdf.queryExecution().executedPlan().toString()
    assert rows(index) == before
