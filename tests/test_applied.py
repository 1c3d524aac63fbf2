"""The table after a sync, without a join."""

import pytest

from rolecall.operators import sync
from tests.conftest import rows


@pytest.mark.parametrize("full", (True, False))
def test_applied_needs_no_join(spark, full):
    """The table after a sync comes out of what was judged, and is that of ``apply_sync``."""
    kinds = "source string, source_job_id string, scope string, fingerprint string, ordinal long, missed_runs int, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, link_status string, link_checked_at timestamp_ntz"
    at = "cast('2026-01-0%s' as timestamp_ntz)"
    stored = spark.range(40).selectExpr(
        "'s' as source", "string(id) as source_job_id", "case when id % 11 = 0 then null else concat('b', id % 4) end as scope", "string(id % 3) as fingerprint", "id as ordinal", "int(id % 2) as missed_runs",
        f"case when id % 5 > 0 then {at % 1} end as first_seen_at", f"{at % 2} as last_seen_at", "case when id % 2 = 0 then 'alive' end as link_status", f"{at % 3} as link_checked_at",
    )
    wanted = spark.range(20, 60).selectExpr("case when id < 59 then 's' end as source", "string(id % 50) as source_job_id", "concat('b', id % 4) as scope", "string(id % 4) as fingerprint", "id as ordinal", *(f"cast(null as {k.split()[1]}) as {k.split()[0]}" for k in kinds.split(", ")[5:]))
    given = stored, wanted, ["b0", "b1"], ["b0", "b1", "b2"], full
    actions, marked = sync.sync_actions(*given), sync.judged(*given)
    found = sync.applied(marked, stored.columns, "2026-02-01 00:00:00")
    assert rows(marked.select(*actions.columns)) == rows(actions)
    assert rows(found) == rows(sync.apply_sync(stored, wanted, actions, "2026-02-01 00:00:00"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join FullOuter") == 1
