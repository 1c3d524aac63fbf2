"""Startup pages and venture boards: what can be taken up from where, and pages of odd shapes."""

import pytest
from pyspark.sql import functions as F

from rolecall.sources import boards, ventures

NOW = "2026-11-01 00:00:00"


@pytest.mark.parametrize(("place", "visa", "taken"), [
    ("Remote", None, True), ("Remote", "US citizen/visa only", False), ("REMOTE ( us ; ca )", None, False), ("Remote (US, India)", "us citizen", True), ("Hybrid remote", None, False), ("Tokyo /  remote (Global)", None, True), ("Remote (EU) Remote (APAC)", None, False),
    ("Remote (unclosed", None, True), ("Kanpur, IN", None, True), ("Kanpur, INR", None, False), ("", None, False), (None, None, False), ("/", None, False),
])
def test_takeable(spark, place, visa, taken):
    df = spark.createDataFrame([(place, visa)], "p string, v string")
    assert df.select(ventures.takeable(F.col("p"), F.col("v"))).first()[0] is taken


@pytest.mark.parametrize(("connector", "bodies", "told"), [
    ("yc_jobs", ('<div data-page="{&quot;props&quot;:{&quot;jobPostings&quot;:[{&quot;id&quot;:1,&quot;location&quot;:&quot;Remote&quot;}]}}">', '<div data-page="{&quot;props&quot;:{}}">', '<div data-page="{&quot;x&quot;:1}">', '<div data-page="{">', "<html>", None), ["ok", "empty", "failed", "failed", "failed", "failed"]),
    ("vc_consider", ('{"jobs": [{"url": "u", "title": "t"}]}', '{"jobs": [{"url": "u"}]}', '{"jobs": null}', "[]", None), ["ok", "empty", "failed", "failed", "failed"]),
    ("vc_getro", ('{"results": {"jobs": [{"id": 1, "url": "u"}]}}', '{"results": {"jobs": []}}', '{"results": null}', None), ["ok", "empty", "failed", "failed"]),
    ("instahyre", ('{"objects": [{"id": 1}]}', '{"objects": []}', "{}", None), ["ok", "empty", "failed", "failed"]),
])
def test_statuses_and_bare_items(spark, connector, bodies, told):
    rows = [(connector, f"{connector}:s{i}", f"s{i}", 200, b, None, None, None, 0, "years=1") for i, b in enumerate(bodies)]
    answers = spark.createDataFrame(rows, f"{boards.RESPONSE}, one_liner string, ordinal long, term string")
    assert [r["status"] for r in ventures.status(answers, connector).orderBy("slug").collect()] == told
    [row] = ventures.read(answers, connector, NOW).collect()
    assert set(row.asDict()) == set(boards.POSTING) and row["hiring_regions_hint"] and row["employment_type_hint"] == "unknown"
