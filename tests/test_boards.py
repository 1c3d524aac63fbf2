"""Board payloads with gaps and of unknown shapes."""

import pytest
from pyspark.sql import functions as F

from rolecall.functions import parsing as p
from rolecall.sources import boards

NOW = "2026-11-01 00:00:00"


def _answers(spark, connector, *bodies):
    return spark.createDataFrame([(connector, f"{connector}:s{i}", f"s{i}", 200, b, None, None) for i, b in enumerate(bodies)], boards.RESPONSE)


@pytest.mark.parametrize(("connector", "bodies", "told"), [
    ("greenhouse", ('{"jobs": [{"id": "1"}]}', '{"jobs": []}', '{"jobs": [{"title": "x"}]}', '{"error": "x"}', "[]", "{", None), ["ok", "empty", "empty", "failed", "failed", "failed", "failed"]),
    ("gem", ('[{"id": "1"}]', "[]", '{"jobs": []}'), ["ok", "empty", "failed"]),
    ("weworkremotely", ("<rss><channel><item><link>x</link></item></channel></rss>", "<rss><channel></channel></rss>", "<html></html>", "{}"), ["ok", "empty", "failed", "failed"]),
])
def test_statuses(spark, connector, bodies, told):
    found = boards.status(_answers(spark, connector, *bodies), connector)
    assert [r["status"] for r in found.orderBy(F.substring("slug", 2, 9).cast("int")).collect()] == told


@pytest.mark.parametrize("connector", sorted(boards.SOURCES))
def test_bare_items_are_read(spark, connector):
    """An item with nothing but what it has to have: nulls where the source says nothing, never a crash."""
    least = {
        "workable_boards": '{"shortcode": "1"}', "workday": '{"externalPath": "/1", "title": "t"}', "oracle": '{"Id": "1", "Title": "t"}', "ibm": '{"_source": {"url": "u", "field_keyword_05": "India"}}', "amazon": '{"id_icims": "1"}',
        "microsoft": '{"id": "1", "name": "t"}', "eightfold": '{"id": "1", "location": "India"}', "atlassian": '{"id": "1", "locations": ["India"]}', "goldman": '{"roleId": "1", "externalSource": {"sourceId": "2"}}', "simplify": '{"url": "u", "title": "t", "active": true}',
        "himalayas": '{"guid": "1"}', "remoteok": '{"id": "1", "position": "t"}', "jobicy": '{"id": "1", "jobTitle": "t"}', "arbeitnow": '{"slug": "1"}',
    }.get(connector, '{"id": "1"}')
    wrap = {"smartrecruiters": '{"content": [%s]}', "recruitee": '{"offers": [%s]}', "rippling": '{"items": [%s]}', "workday": '{"jobPostings": [%s]}', "oracle": '{"items": [{"requisitionList": [%s]}]}', "ibm": '{"hits": {"hits": [%s]}}', "microsoft": '{"data": {"positions": [%s]}}',
            "eightfold": '{"positions": [%s]}', "goldman": '{"data": {"roleSearch": {"items": [%s]}}}', "arbeitnow": '{"data": [%s]}'}.get(connector, "[%s]" if boards.SOURCES[connector].payload == "%" else '{"jobs": [%s]}')
    body = "<rss><channel><item><link>1</link></item></channel></rss>" if connector in boards.RSS else wrap % least
    got = boards.read(_answers(spark, connector, body), connector, NOW)
    row = got.first()
    assert tuple(got.columns) == boards.POSTING and row["source"] == connector and row["hiring_regions_hint"] and row["employment_type_hint"]


@pytest.mark.parametrize(("html", "text"), [(None, None), ("", None), ("<p>a</p>b", "a\nb"), ("&lt;b&gt;x&lt;/b&gt; &amp;amp; y", "x\n& y"), ("<style>p{}</style><!-- c -->  z ", "z"), ("a<br>\n\n\n\nb", "a\nb")])
def test_html_to_text(spark, html, text):
    assert spark.createDataFrame([(html,)], "h string").select(p.html_to_text(F.col("h"))).first()[0] == text
