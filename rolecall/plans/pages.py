"""Queries of the page readers over planted HTML, and what they have to give, in SQL written by hand."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.plans.boards import _AT, _DATE, _INTERN, _NAME, _OWN, _P, _T, _TEXT, _TITLED, _WORDS, _day, _html, _id, _india, _iso, _list, _place, _register, _rows, _sql, _struct, _title, _away
from rolecall.sources import pages
from rolecall.sources.postings import AS_OF, _pick

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_SLUGS = ("software-engineer-intern", "internal-tools-engineer", "summer-analyst", "co-op-developer", "apprentice", "backend-engineer", "interns-programme", "graduate-trainee", "co-operative-lead")


def _quoted(c: Column) -> Column:
    """As a JSON string; null as null."""
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")


def _array(*parts: Column | str) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *(F.lit(x) if isinstance(x, str) else x for x in parts)), F.lit("]"))


def _escaped(c: Column, quote: str = "&quot;") -> Column:
    """As the value of an attribute."""
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit(quote))


def _or_null(condition: Column, value: Column) -> Column:
    return F.when(condition, value).otherwise("null")


def _google_row(k: Column) -> Column:
    place = _array(_quoted(_place(k)), '["1 Road"]', '"c"', '"z"', '"s"', _or_null(k % 5 == 0, F.lit('"IN"')))
    whole = _array(
        _quoted(_id(k)), _quoted(_title(k)), "null", _or_null(k % 2 == 0, _array("null", _quoted(F.lit('<b>a ]] } "x" b</b>')))), _array("null", '"<li>qual</li>"'), "null", "null",
        _or_null(k % 3 != 1, F.lit('"Google DE"')), "null", _or_null(k % 6 != 5, F.when(k % 4 == 0, _array(place, "5", "null", "[]")).otherwise(_array(place))), _array("null", _quoted(_html(k))), "null",
        _or_null(k % 4 != 3, _array((k * 86400 + 1757841600).cast("string"), "5")), "null", "null", _or_null(k % 7 == 0, F.lit('[null,"Reside &amp;amp; apply &#8211; now"]')), "null", "null", "null",
        F.when(k % 3 == 0, '[null,"<li>min</li>"]').otherwise('[null,""]'),
    )
    return F.when(k % 19 == 0, '[5,"no text as id",2,3,4,5,6,7,8,9,10]').when(k % 23 == 0, '["short"]').when(k % 29 == 0, '"no list"').otherwise(whole)


def _google_page(items: Column) -> Column:
    return F.concat(F.lit("<html><script>AF_initDataCallback({key: 'ds:0', data:[[\"other\"]]});</script><script>AF_initDataCallback({key: 'ds:1', hash: '4', data:["), _array(F.array_join(items, ",")), F.lit(",79,null], sideChannel: {}});</script></html>"))


_NL = "chr(10)"
_register(
    "google", _google_row, _google_page, keep="k % 19 <> 0 AND k % 23 <> 0 AND k % 29 <> 0", read=pages.read, source_job_id="'' || k",
    url=f"'https://www.google.com/about/careers/applications/jobs/results/' || k || '-' || {_sql(_SLUGS)}", company="CASE WHEN k % 3 = 1 THEN 'Google' ELSE 'Google DE' END",
    description=f"""array_to_string(list_filter(['About the job' || {_NL} || {_TEXT}, CASE WHEN k % 2 = 0 THEN 'Responsibilities' || {_NL} || 'a ]] }} "x" b' END,
      'Minimum qualifications' || {_NL} || CASE WHEN k % 3 = 0 THEN 'min' ELSE 'qual' END, CASE WHEN k % 7 = 0 THEN 'Eligibility' || {_NL} || 'Reside & apply ' || chr(8211) || ' now' END], lambda x: x IS NOT NULL), {_NL} || {_NL})""",
    location_raw=f"CASE WHEN k % 6 <> 5 THEN nullif({_P}, '') END", posted_at="CASE WHEN k % 4 <> 3 THEN CAST(epoch_ms((k * 86400 + 1757841600) * 1000) AS TIMESTAMP) END",
    regions=f"CASE WHEN k % 6 = 5 THEN 'unknown' ELSE {_india(_WORDS, 'k % 5 = 0', False)} END", employment_type_hint=_sql(("internship", "unknown", "unknown", "unknown", "internship", "unknown", "unknown", "unknown", "unknown")),
)


def _apple_item(k: Column) -> Column:
    where = lambda city, state, country, name, code: _struct(city=F.lit(city), stateProvince=F.lit(state), countryName=F.lit(country), name=F.lit(name), countryID=F.lit(code))
    pune, site, berlin = where("Pune", "", "India", None, "iso-country-IND"), where(None, None, None, "Remote site", None), where("Berlin", None, "Germany", "x", "iso-country-DEU")
    return _struct(
        positionId=F.when(k % 19 != 0, _id(k)), postingTitle=F.concat(F.lit(" "), _title(k)), transformedPostingTitle=F.when(k % 2 == 0, F.lit("role")), jobSummary=F.lit('Say "hi" \\ to\nall'), postDateInGMT=F.concat(_day(k), F.lit("T08:11:57.123456789Z")),
        team=F.when(k % 3 == 0, _struct(teamName=F.lit("Silicon"))), locations=F.when(k % 4 == 1, F.array(pune)).when(k % 4 == 2, F.array(site)).when(k % 4 == 3, F.array(berlin, pune)),
    )


def _apple_page(items: Column) -> Column:
    found = _struct(loaderData=_struct(search=_struct(searchResults=items, totalRecords=F.lit(3))))
    return F.concat(F.lit("<script>window.__staticRouterHydrationData = JSON.parse("), _quoted(F.to_json(found)), F.lit(");</script><script>f(\"x\");</script>"))


_register(
    "apple", _apple_item, _apple_page, keep="k % 19 <> 0", read=pages.read, source_job_id="'' || k", url="'https://jobs.apple.com/en-in/details/' || k || '/' || CASE WHEN k % 2 = 0 THEN 'role' ELSE '' END", company="'Apple'",
    description=f"'Say \"hi\" \\ to' || {_NL} || 'all'", location_raw="[NULL, 'Pune, India', 'Remote site', 'Berlin, Germany; Pune, India'][CAST(k % 4 + 1 AS INT)]", tags="CASE WHEN k % 3 = 0 THEN 'Silicon' ELSE '' END",
    posted_at="make_timestamp(2026, 9, k % 28 + 1, 8, 11, 57.123456)", regions="CASE WHEN k % 4 IN (1, 3) THEN 'india' ELSE '' END", employment_type_hint=_INTERN,
)


def _juspay_item(k: Column) -> Column:
    value = lambda c: F.concat(F.lit("[0,"), c, F.lit("]"))
    own = {
        "job_id": value(_quoted(F.when(k % 23 != 0, F.concat(F.lit("J"), _id(k))))), "job_title": value(_quoted(_title(k))), "job_type": value(_quoted(_pick(("Intern", "Full-Time", "Contract", "Gig", None), k))), "experience_year": _pick(('[0,2]', '[0,"2"]', "[0,null]", "[0,0]"), k),
        "job_location": value(_quoted(_place(k))), "opening_status": _pick(("[0,true]", "[0,null]", "[0,true]", "[0,false]", "[0,true]"), k), "job_description_career": value(_quoted(F.lit("## **Do** `it`\n\n\n\n> now & \"then\""))),
        "category": value(_quoted(F.lit("Eng"))), "skills": F.lit('[1,[[0,"a"],[0,{"deep":[1,[]]}]]]'),
    }
    return F.concat(F.lit("[0,{"), F.concat_ws(",", *(F.concat(F.lit(f'"{name}":'), c) for name, c in own.items())), F.lit("}]"))


def _juspay_page(items: Column) -> Column:
    props = F.concat(F.lit('{"jobData":[1,'), _array(F.array_join(items, ",")), F.lit("]}"))
    later = F.replace(props, F.lit('"category":[0,"Eng"]'), F.lit('"category":[0,"later"]'))
    island = lambda c: F.concat(F.lit("<astro-island uid='a > b' client=load props=\""), _escaped(c), F.lit('"><b>x</b></astro-island>'))
    return F.concat(island(F.lit('{"menu":[0,"x"]}')), F.lit("<astro-island props='{\"job_id\": broken'></astro-island>"), island(props), island(later))


_register(
    "juspay", _juspay_item, _juspay_page, keep="k % 23 <> 0 AND k % 5 <> 3", read=pages.read, source_job_id="'J' || k", url="'https://juspay.io/careers/J' || k", company="'Juspay'", description=f"'Do it' || {_NL} || {_NL} || ' now & \"then\"'",
    location_raw=f"nullif({_P}, '')", tags=_list("'Eng'", _sql(("Intern", "Full-Time", "Contract", "Gig", None))), regions=_WORDS, employment_type_hint=_sql(("internship", "full_time", "contract", "unknown", "unknown")),
    min_yoe_hint="CAST(CASE k % 4 WHEN 0 THEN 2 WHEN 3 THEN 0 END AS INT)",
)


def _avature_item(k: Column) -> Column:
    title = F.concat(F.lit(" "), F.replace(_title(k), F.lit("-"), F.lit("&#x2d;")), F.lit(" "))
    link = F.concat(F.lit('<h3><a href="https://av.example/JobDetail/'), F.when(k % 3 == 0, F.concat((k + 1000).cast("string"), F.lit("/"))).otherwise(""), F.lit('x?a=1&amp;b=2" class="link link_result">'), title, F.lit("<i> (f/m) </i></a></h3>"))
    part = lambda name, c: F.concat(F.lit(f'<div><span class="list-item list-item-{name}">'), c, F.lit("</span></div>"))
    return F.concat(
        F.lit("<article class='wide article--result'><p>a > b<p>c"), F.when(k % 17 != 0, link).otherwise(""), part("location", F.concat(F.lit("\n  "), _place(k), F.lit(" "))),
        F.when(k % 2 == 0, part("workerType", _pick(("Regular", "Student &amp; Intern"), F.expr("o_orderkey div 2")))).otherwise(""), F.when(k % 3 == 1, part("id", F.concat(F.lit("Ref #"), (k + 5000).cast("string")))).otherwise(""), F.lit("</article>"),
    )


_WORKER = "CASE WHEN k % 2 = 0 THEN CASE WHEN (k // 2) % 2 = 0 THEN 'Regular' ELSE 'Student & Intern' END ELSE '' END"
_AV_INTERN = f"(k % 4 = 2 OR {_sql(tuple(int('intern' in t.lower()) for t, _, _ in _TITLED))} = 1)"
_HREF = "'https://av.example/JobDetail/' || CASE WHEN k % 3 = 0 THEN (k + 1000) || '/' ELSE '' END || 'x?a=1&b=2'"
_page = lambda item="", before="": lambda items: F.concat(F.lit(f"<!doctype html><body>{before}"), F.array_join(items, "\n"), F.lit(f"{item}</body>"))
_register(
    "avature", _avature_item, _page("<article class='article--results'><a class='link_result'>no</a></article>"), keep="k % 17 <> 0", read=pages.read,
    source_job_id=f"slug || ':' || CASE k % 3 WHEN 0 THEN '' || (k + 1000) WHEN 1 THEN '' || (k + 5000) ELSE {_HREF} END", url=_HREF, company=_NAME, title=f"{_T} || '(f/m)'", location_raw=f"nullif({_P}, '')", tags=_WORKER, regions=_WORDS,
    employment_type_hint=f"CASE WHEN {_AV_INTERN} THEN 'internship' ELSE 'unknown' END", min_yoe_hint=f"CAST(CASE WHEN {_AV_INTERN} THEN 0 END AS INT)",
)


def _row_item(k: Column) -> Column:
    day = F.concat_ws("", _pick(("Sep ", "  ", "2026-09-", "on "), k), (k % 28 + 1).cast("string"), _pick((", 2026", " sep 2026 ", "", ""), k))
    return F.concat(
        F.lit("<tr class=data-row><td class='colTitle'><table><tr><td>"), F.when(k % 17 != 0, F.concat(F.lit("<a class='jobTitle-link' HREF='/job/x/"), (k + 10000).cast("string"), F.when(k % 2 == 0, "/'").otherwise("/apply'"), F.lit(">"), _title(k), F.lit("</a>"))).otherwise(""), F.lit("</table>"),
        F.lit("<span class=jobLocation>inner</span><td class=colLocation><div><span class='jobLocation'>\n"), F.replace(_place(k), F.lit(" "), F.lit("&nbsp;\t ")), F.lit("</span></div><td>"), F.when(k % 5 != 4, F.concat(F.lit("<span class=jobDate>"), day, F.lit("</span>"))).otherwise(""),
    )


_register(
    "successfactors", _row_item, lambda items: F.concat(F.lit("<table><tr class=head><td><a class='jobTitle-link'>no</a>"), F.array_join(items, "\n"), F.lit("</table>")), keep="k % 17 <> 0", read=pages.read,
    source_job_id="slug || ':' || CASE WHEN k % 2 = 0 THEN '' || (k + 10000) ELSE '/job/x/' || (k + 10000) || '/apply' END", url="slug || '.example/job/x/' || (k + 10000) || CASE WHEN k % 2 = 0 THEN '/' ELSE '/apply' END", company=_NAME, location_raw=f"nullif({_P}, '')",
    posted_at=f"CASE WHEN k % 5 <> 4 AND k % 4 <> 3 THEN {_DATE} END", regions=_india(_WORDS, f"{_P} = 'Indianapolis, IN'", True), employment_type_hint=_INTERN,
)


def _zoho_item(k: Column) -> Column:
    return _struct(
        id=F.when(k % 23 != 0, _id(k)), Publish=_pick((True, None, True, False), k), City=_pick(("Pune", None), k), State=F.lit(""), Country=_pick(("india", "Germany", None), k), Remote_Job=_pick((True, False, None), k), Posting_Title=F.when(k % 2 == 0, _title(k)), Job_Opening_Name=_title(k),
        Job_Type=_pick(("Full time", "Internship", None), k), Work_Experience=_pick(("2-4 years", "Fresher", None, "0+"), k), Job_Description=_html(k), Industry=F.lit("IT & <b>"), Date_Opened=_pick(("2026-09-04", "04/09/2026", None), k),
    )


_Z_INTERN = f"(k % 3 = 1 OR {_INTERN} = 'internship')"
_Z_PLACE = f"array_to_string(list_filter([{_sql(('Pune', None))}, {_sql(('india', 'Germany', None))}], lambda x: x IS NOT NULL), ', ')"
_register(
    "zoho_recruit", _zoho_item, lambda items: F.concat(F.lit('<form><input type="hidden" value="'), _escaped(F.to_json(items)), F.lit('" id="jobs"></form>')), keep="k % 23 <> 0 AND k % 4 <> 3", read=pages.read, source_job_id=_OWN,
    url="'https://' || slug || '/jobs/Careers/' || k", company=_NAME, description=_TEXT, location_raw=_away(_Z_PLACE, "k % 3 = 0"), tags=_list("'IT & <b>'", _sql(("Full time", "Internship", None))), posted_at="CASE WHEN k % 3 = 0 THEN TIMESTAMP '2026-09-04 00:00:00' END",
    regions=f"CASE WHEN k % 3 = 0 OR k % 2 = 0 AND k % 3 = 2 THEN 'india' WHEN k % 3 = 1 THEN CASE WHEN k % 2 = 0 THEN 'india,europe' ELSE 'europe' END ELSE 'unknown' END", employment_type_hint=f"CASE WHEN {_Z_INTERN} THEN 'internship' ELSE 'unknown' END",
    min_yoe_hint=f"CAST(CASE WHEN {_Z_INTERN} OR k % 4 = 1 THEN 0 WHEN k % 4 = 0 THEN 2 END AS INT)",
)


def _keka_item(k: Column) -> Column:
    where = lambda city, name, country, code: _struct(city=F.lit(city), name=F.lit(name), countryName=F.lit(country), countryCode=F.lit(code))
    return _struct(
        id=F.when(k % 23 != 0, _id(k)), title=_title(k), description=_html(k), departmentName=_pick(("Tech", "", None), k), publishedOn=_iso(k), experience=_pick(("3 – 5 Years", "Fresher", None, "1+ year", "two years"), k), skillNames=F.when(k % 3 == 0, F.array(F.lit("Go"), F.lit(""), F.lit("SQL"))),
        jobLocations=F.when(k % 4 == 0, F.array(where("Pune", "x", "India", "IN"), where("", "HQ", None, None))).when(k % 4 == 1, F.array(where(None, "Plant 4", "", "IN"))).when(k % 4 == 2, F.array(where("Berlin", None, "Germany", "DE"))),
    )


_register(
    "keka", _keka_item, F.to_json, keep="k % 23 <> 0", read=pages.read, source_job_id=_OWN, url="'https://' || slug || '.keka.com/careers/jobdetails/' || k", company=_NAME,
    description=f"CASE WHEN k % 3 = 0 THEN coalesce({_TEXT} || {_NL} || {_NL}, '') || 'Skills: Go, SQL' ELSE {_TEXT} END", location_raw="['Pune, India; HQ', 'Plant 4', 'Berlin, Germany', NULL][CAST(k % 4 + 1 AS INT)]",
    tags="CASE k % 3 WHEN 0 THEN 'Tech,Go,SQL' ELSE '' END", posted_at=_AT, regions="['india', 'india', 'europe', 'unknown'][CAST(k % 4 + 1 AS INT)]", employment_type_hint=_INTERN,
    min_yoe_hint=f"CAST(CASE k % 5 WHEN 0 THEN 3 WHEN 1 THEN 0 WHEN 3 THEN 1 ELSE CASE WHEN {_INTERN} = 'internship' THEN 0 END END AS INT)",
)


def _query(sql: str) -> Callable:
    def put(query: Callable) -> Callable:
        QUERIES[query.__name__], SQL[query.__name__] = query, sql
        return query

    return put


@_query(f"""WITH items AS (SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 7 <> 6 AND o_orderkey % 5 <> 4)
SELECT '' || k AS source_job_id, 'https://www.amazon.jobs/en/jobs/' || k AS url, {_T} || ' & more' AS title, 'Amazon' AS company, CASE WHEN k % 3 > 0 THEN 'Learn "fast"' || chr(8230) END AS description, CASE WHEN k % 5 < 3 THEN 'IND, KA, Bengaluru' ELSE 'ind, Goa' END AS location_raw,
  CASE WHEN k % 2 = 0 THEN 'Dev' ELSE '' END AS tags, CAST(NULL AS VARCHAR) AS salary_raw, CAST(NULL AS TIMESTAMP) AS posted_at, 'india' AS regions, {_INTERN} AS employment_type_hint, CAST(CASE WHEN {_INTERN} = 'internship' THEN 0 END AS INT) AS min_yoe_hint FROM items""")
def src_amazon_campus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per order: some without a place, some abroad."""
    k = F.col("o_orderkey")
    place = F.when(k % 5 == 4, "US, WA, Seattle").when(k % 5 == 3, "ind, Goa").otherwise(" IND, KA, Bengaluru ")
    body = F.concat(
        F.lit('<meta property="og:title" content="'), _title(k), F.lit(' &amp; more" />'), F.when(k % 3 > 0, '<meta property="og:description" content="Learn &quot;fast&quot;&hellip;">').otherwise(""),
        F.when(k % 7 != 6, F.concat(F.lit('<div class="association location-icon">\n<ul class="association-content"><li>'), place, F.lit("</li></ul></div>"))).otherwise(""),
        F.when(k % 2 == 0, '<div class="association job-category-icon x"><ul class="association-content"><li>Dev</li></ul></div>').otherwise(""),
    )
    landed = spark.read.parquet(f"{sf_dir}/orders.parquet").where(k.isNotNull()).select(
        F.lit("amazon_campus").alias("connector"), F.lit("amazon_campus").alias("scope"), _id(k).alias("slug"), F.lit(200).alias("http_code"), body.alias("body"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("name")
    )
    return _rows(pages.read(landed, "amazon_campus", AS_OF))


@_query("""SELECT 'b' || c_custkey AS slug, CASE WHEN c_custkey % 3 > 0 THEN lpad('' || c_custkey, 8, '0') || '-00aF-4000-8000-0123456789ab' END AS portal,
  CASE WHEN c_custkey % 3 > 0 THEN 'https://b' || c_custkey || '.keka.com/careers/api/embedjobs/default/active/' || lpad('' || c_custkey, 8, '0') || '-00aF-4000-8000-0123456789ab' END AS url FROM customer""")
def keka_portals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The portals that planted careers pages name."""
    k = F.col("c_custkey")
    own = F.concat(F.lpad(k.cast("string"), 8, "0"), F.lit("-00aF-4000-8000-0123456789ab"))
    body = F.concat(F.lit("<img src='https://x.example/ats/Documents/"), own, F.when(k % 3 > 0, "/careerportal/logo.png'>").otherwise("/other'>"))
    return pages.keka_portals(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("b"), k.cast("string")).alias("slug"), body.alias("body")))


@_query("""WITH named AS (SELECT '' || (o_orderkey + 1000000) AS job_id FROM orders WHERE o_orderkey % 3 = 0 UNION SELECT '' || (o_orderkey + 2000000) FROM orders WHERE o_orderkey % 3 = 0 UNION SELECT '' || c_custkey * 7 FROM customer)
SELECT job_id FROM named ORDER BY job_id LIMIT 40""")
def campus_wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of campus pages out of planted search results, beside the stored ones; each run reads so many."""
    k = F.col("o_orderkey")
    body = F.when(k % 3 == 0, F.concat(F.lit("<a href='https://www.amazon.jobs/en/jobs/"), (k + 1000000).cast("string"), F.lit("/x'>amazon.jobs/jobs/"), (k + 2000000).cast("string"), F.lit("</a> amazon.jobs/en/teams/1234567"))).otherwise("no amazon.jobs/jobs/12345 here")
    known = spark.read.parquet(f"{sf_dir}/customer.parquet").select((F.col("c_custkey") * 7).cast("string").alias("source_job_id"))
    return pages.campus_wanted(spark.read.parquet(f"{sf_dir}/orders.parquet").select(body.alias("body")), known)
