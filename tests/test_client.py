"""The reader's choices, the row codec, the health report, and near vectors against all pairs."""

import numpy as np
import pytest

from rolecall.operators import client, health, vectors
from rolecall.operators.client import ClientFilter
from rolecall.plans import catalog
from tests.conftest import SMALL, rows

NEW = ("client_new_grads", "client_paid_saved", "client_newest", "client_summary", "job_summaries", "stored_rows", "unhealthy_connectors", "pipeline_totals", "vector_duplicates")


def test_choices_are_counted():
    assert client.count_active(ClientFilter()) == 0
    assert client.count_active(ClientFilter(query="go", tech=("go",), max_min_yoe=None, hide_applied=True)) == 4


def test_keys_toggle(spark):
    keys = spark.createDataFrame([("a", "1"), ("a", "2"), ("a", "2")], "source string, source_job_id string")
    pressed = spark.createDataFrame([("a", "1"), ("b", "9"), ("c", "3"), ("c", "3")], keys.schema)
    assert rows(client.toggled(keys, pressed)) == [("a", "2"), ("b", "9")]


def test_row_codec(spark):
    schema = "source string, source_job_id string, tech_stack array<string>, hiring_regions array<string>, match_reasons array<string>, payload map<string,string>, scope string, link_status string, last_seen_at string"
    jobs = spark.createDataFrame([
        ("a", "1", ["go", 'c"x'], [], None, {"vc": '"Fund"', "pay": '""', "html": '"x"', "team_size": "0", "yc_batch": None}, None, None, "monday"),
        ("a", "2", None, ["india"], ["r"], None, "board", "dead", None),
    ], schema)
    stored = client.to_row(jobs)
    one, two = (r.asDict() for r in client.from_row(stored).orderBy("source_job_id").collect())
    assert one["tech_stack"] == ["go", 'c"x'] and one["match_reasons"] == [] and one["payload"] == {"team_size": "0", "vc": '"Fund"'} and (one["scope"], one["link_status"]) == ("a", "")
    assert two["tech_stack"] == [] and two["payload"] == {} and (two["scope"], two["link_status"]) == ("board", "dead")
    prints = lambda df: [r[0] for r in client.to_row(df).orderBy("source_job_id").select("fingerprint").collect()]
    assert prints(jobs) == prints(jobs.selectExpr(*(c for c in jobs.columns if c != "last_seen_at"), "'later' as last_seen_at"))
    assert prints(jobs)[0] != prints(jobs.selectExpr(*(c for c in jobs.columns if c != "tech_stack"), "array('rust') as tech_stack"))[0]


def test_health_report(spark):
    checks = spark.createDataFrame([("b", "ok", None), ("a", "ok", "9 jobs"), ("z", "broken", "HTTP 500"), ("m", "degraded", "few")], "connector string, severity string, said string")
    assert [r["line"] for r in health.report(checks).orderBy("place").collect()] == ["2 ok, 1 degraded, 1 broken", "| z | broken | HTTP 500 |", "| m | degraded | few |", "| a | ok | 9 jobs |", "| b | ok |  |"]


def test_vectors_with_holes(spark):
    given = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [1.0, float("nan")]), (7, [0.9, 0.1]), (8, [1.0, 0.0, 0.0]), (9, [-1.0, 0.0]), (None, [1.0, 0.0]), (10, [1.0, None]), (2, [1.0, 0.0])]
    found = vectors.vector_groups(spark.createDataFrame(given, "id long, v array<double>"), "id", "v")
    assert {r["id"]: (r["class_id"], r["n_links"], r["component_id"]) for r in found.collect()} == {1: (1, 1, 1), 2: (1, 1, 1), 7: (7, 1, 1)} | {k: (k, 0, k) for k in (3, 4, 5, 6, 8, 9, 10)}
    assert vectors.vector_groups(spark.createDataFrame([], "id long, v array<double>"), "id", "v").count() == 0


@pytest.mark.parametrize("room", [4 << 20, 1 << 14])
def test_recall_where_cosines_are_low(spark, room):
    planes = vectors.Planes(similarity=0.4, bits=6, bands=80, room=room)
    given = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    held = np.array([r[0] for r in given.orderBy("vec_id").select("embedding").collect()], float)
    unit = held / np.linalg.norm(held, axis=1, keepdims=True)
    want = int((np.triu(unit @ unit.T, 1) >= 0.4).sum())
    got = sum(r["n_links"] for r in vectors.vector_groups(given, "vec_id", "embedding", planes).collect()) / 2
    assert want and 0.9 * want <= got <= want and planes.miss() < 0.01


@pytest.mark.parametrize("name", NEW)
def test_new_queries_find_rows(spark, duck, name):
    got = rows(catalog.queries()[name](spark, SMALL))
    assert got and got == rows(duck.sql(catalog.oracle_sql()[name]))
