"""Page readers: elements by selectors, character references, times in any zone, and pages of odd shapes."""

import html
import json
import random
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from rolecall.functions import parsing as p
from rolecall.functions.markup import Pick, pick
from rolecall.sources import boards, pages

NOW = "2026-11-01 00:00:00"


def _one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


def test_references_equal_the_standard_library(spark):
    """By number, by name and without a semicolon, broken ones and ones that follow each other."""
    rng = random.Random(3)
    names = rng.sample(sorted(html5), 300)
    numbers = [0, 9, 11, 13, 31, 38, 127, 128, 129, 150, 159, 160, 8217, 0xD800, 0xFDD0, 0xFFFE, 0xFFFF, 0x1F600, 0x10FFFF, 0x110000, 10**12, 10**40]
    given = [f"a &{n} b" for n in names] + [f"&{n.rstrip(';')}x;" for n in names] + [f"&#{n};" for n in numbers] + [f"&#x{n:X}z" for n in numbers] + ["&amp;lt;", "&&amp;&", "&", "&;", "&#;", "&#x;", "&notit; &notin;", "&no", "&NBSP;", "&ampamp;", "AT&T &copy2026", "100% &lt b"]
    given += ["".join(rng.choice(("&", "#", "x", "amp", "lt", ";", "8217", "é", " ", "notin", "A")) for _ in range(12)) for _ in range(300)]
    df = spark.createDataFrame([(g,) for g in given], "v string")
    assert [tuple(r) for r in df.select("v", p.unescape(F.col("v"))).collect()] == [(g, html.unescape(g)) for g in given]
    assert _one(spark, None, p.unescape) is None


def test_text_resolves_all_references(spark):
    assert _one(spark, "<p>Caf&eacute; &#8211; d&#x27;or</p>&lt;b&gt;R&amp;amp;D&hellip;&lt;/b&gt;", p.html_to_text) == "Café – d'or\nR&D…"


@pytest.mark.parametrize("zone", ["Asia/Kolkata", "America/New_York", "UTC"])
def test_times_are_utc_in_any_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        said = {
            "2026-09-14T10:00:00Z": "2026-09-14 10:00:00", "2026-09-14T10:00:00+05:30": "2026-09-14 04:30:00", "2026-09-14 10:00:00": "2026-09-14 10:00:00", "2026-09-14": "2026-09-14 00:00:00",
            "2026-11-01T05:30:00Z": "2026-11-01 05:30:00", "2026-11-01T06:30:00Z": "2026-11-01 06:30:00", "2026-03-08T02:30:00": "2026-03-08 02:30:00", "2026-09-14T12:45:41.038245042Z": "2026-09-14 12:45:41.038245", "soon": None,
        }
        got = spark.createDataFrame([(k,) for k in said], "v string").select("v", p.parse_iso(F.col("v")).cast("string"), p.seconds(F.lit(1757844000)).cast("string")).collect()
        assert {r[0]: r[1] for r in got} == said and {r[2] for r in got} == {"2025-09-14 10:00:00"}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


TABLE = """<table id=jobs class="wide list"><tr class='row odd'><td class=a>One<td class=b><span title="x &gt; &quot;y&quot;">two</span> 2
<tr class="row"><td class="a"><table><tr><td class=a>inner</td></tr></table> outer</td><td class="b">three</tr><tr class=rows><td class=a>no</table>
<script>var s = "<tr class='row'><td class=a>script</td></tr>";</script><!-- <tr class="row"> --><ul><li class=row>item<br><b class=a>last</ul>"""


def test_pick(spark):
    found = json.loads(_one(spark, TABLE, lambda c: pick(c, ".row", {"a": Pick(".a"), "b": Pick("td.b", pieces=False), "title": Pick(".b span", "title"), "own": Pick("", "class")})))
    assert found == [{"own": "row odd", "a": "One", "b": "two 2\n", "title": 'x > "y"'}, {"own": "row", "a": "innerouter", "b": "three"}, {"own": "row", "a": "last"}]
    assert [x["t"] for x in json.loads(_one(spark, TABLE, lambda c: pick(c, "table#jobs tr", {"t": Pick("td")})))] == ["One", "innerouter", "inner", "no"]
    assert _one(spark, None, lambda c: pick(c, "a", {})) is None and _one(spark, "", lambda c: pick(c, "a", {"x": Pick("b")})) == "[]"
    assert _one(spark, "<" * 5000 + "a href=" + "'" * 999, lambda c: pick(c, "a", {"x": Pick("b")})) == "[]"


def test_deep_pages(spark):
    """Ten thousand open elements, none of them closed."""
    deep = "<div class=x>" * 10_000 + "<article><a class=l href=h>t</a>"
    assert json.loads(_one(spark, deep, lambda c: pick(c, "article", {"t": Pick("a.l"), "h": Pick("a.l", "href")}))) == [{"t": "t", "h": "h"}]


def _answers(spark, connector, *bodies, code=200):
    return spark.createDataFrame([(connector, f"{connector}:s{i}", f"s{i}", code, b, None, None) for i, b in enumerate(bodies)], boards.RESPONSE)


@pytest.mark.parametrize(("connector", "bodies", "told"), [
    ("google", ("AF_initDataCallback({key: 'ds:1', data:[[[\"1\", \"t\", null, null, null, null, null, null, null, []]], 1]})", "AF_initDataCallback({key: 'ds:1', data:[[], 0]})", "AF_initDataCallback({key: 'ds:1', data:[[[\"1\"", "<html>", None), ["ok", "empty", "empty", "empty", "failed"]),
    ("apple", ('window.__staticRouterHydrationData = JSON.parse("{\\"loaderData\\": {\\"search\\": {\\"searchResults\\": [{\\"positionId\\": 5}]}}}");', 'window.__staticRouterHydrationData = JSON.parse("{broken");', "<html>", None), ["ok", "failed", "empty", "failed"]),
    ("juspay", ("<astro-island props='{\"jobData\":[1,[[0,{\"job_id\":[0,\"a\"]}]]]}'>", "<astro-island props='{\"job_id\":1}'>", "<html>", None), ["ok", "empty", "empty", "failed"]),
    ("zoho_recruit", ('<input type="hidden" value="[{&quot;id&quot;: 4}]" id="jobs">', '<input type="hidden" value="[]" id="jobs">', '<input type="hidden" value="[{" id="jobs">', "<html>", None), ["ok", "empty", "failed", "no_board", "failed"]),
    ("keka", ('[{"id": 4}]', "[]", '{"error": 1}', "[{", None), ["ok", "empty", "failed", "failed", "failed"]),
    ("avature", ("<article class=article--result><a class=link_result>t</a></article>", "<html>", None), ["ok", "empty", "failed"]),
    ("successfactors", ("<table><tr class=data-row><td><a class=jobTitle-link>t</a></table>", "<html>", None), ["ok", "empty", "failed"]),
])
def test_statuses_of_pages(spark, connector, bodies, told):
    found = pages.status(_answers(spark, connector, *bodies), connector)
    assert [r["status"] for r in found.orderBy("slug").collect()] == told
    rows = pages.read(_answers(spark, connector, *bodies), connector, NOW).collect()
    assert [r["scope"] for r in rows] == [f"{connector}:s0"] and tuple(rows[0].asDict()) == boards.POSTING
    assert pages.read(_answers(spark, connector, bodies[0], code=503), connector, NOW).count() == 0


def test_plain_and_typed_values(spark):
    """A list that isn't wrapped is no list of jobs; fields may stand without their type."""
    page = "<astro-island props='{\"jobData\":[1,[[0,{\"job_id\":\"bare\",\"job_title\":[0,\"T [0,1] \"],\"experience_year\":3}],[0,null],[0,5]]]}'>"
    row = pages.read(_answers(spark, "juspay", page), "juspay", NOW).first()
    assert (row["source_job_id"], row["title"], row["min_yoe_hint"]) == ("bare", "T [0,1] ", 3)
