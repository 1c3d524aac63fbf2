"""Queries of the board readers over planted payloads, and what they have to give, in SQL.

A board is planted per customer, whose payload lists the customer's orders. What a
place or a title means is written beside it by hand, so the SQL doesn't share the
readers' patterns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.plans.landing import _BOARD_SQL
from rolecall.sources import boards
from rolecall.sources.postings import AS_OF, _pick, _sql_pick

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Title; whether it is an internship's; whether one that takes plurals says so.
_TITLED = (
    ("Software Engineer Intern", 1, 1), ("Internal Tools Engineer", 0, 0), ("Summer Analyst", 1, 1), ("Co-op Developer", 1, 1), ("Apprentice", 1, 1),
    ("Backend Engineer", 0, 0), ("Interns Programme", 0, 1), ("Graduate Trainee", 1, 1), ("Co-operative Lead", 0, 0),
)
#: Place; its regions by whole words, by the words of two board kinds; by the words of three feeds.
_PLACED = (
    ("Bengaluru, Karnataka, India", "india", "india", "india", "india", "india", "india"),
    ("Remote - Worldwide", "worldwide", "worldwide", "worldwide", "worldwide", "worldwide", "worldwide"),
    ("Indianapolis, IN", "us", "india", "india", "india", "india", "india"),
    ("London, United Kingdom", "europe", "europe", "europe", "unknown", "europe", "unknown"),
    ("San Francisco, CA", "us", "us", "us", "unknown", "unknown", "unknown"),
    ("Toronto, Canada", "canada", "us,canada", "canada", "canada", "canada", "canada"),
    ("Mexico City", "latam", "unknown", "latam", "unknown", "unknown", "unknown"),
    ("Santa Fe, New Mexico", "us", "unknown", "latam", "unknown", "unknown", "unknown"),
    ("", "unknown", "unknown", "unknown", "worldwide", "worldwide", "unknown"),
    ("Singapore; Berlin", "europe,apac", "europe,apac", "europe,apac", "unknown", "unknown", "unknown"),
    ("Anywhere in India", "india,worldwide", "india,worldwide", "india,worldwide", "worldwide,india", "worldwide,india", "worldwide,india"),
    ("Warsaw, EMEA", "europe", "unknown", "unknown", "emea", "emea", "emea"),
)
#: HTML; its text, and its text if markup can't be escaped.
_MARKED = (
    ("&lt;p&gt;Build &amp;amp; ship&lt;/p&gt;&lt;ul&gt;&lt;li&gt; Python &lt;/li&gt;&lt;/ul&gt;", "Build & ship\nPython", "<p>Build &amp; ship</p><ul><li> Python </li></ul>"),
    ("<div>One<br>Two<script>x = 1</script></div>", "One\nTwo", "One\nTwo"), (None, None, None), ("<p> </p>", None, None),
)
_COLUMNS = ("source_job_id", "url", "title", "company", "description", "location_raw", "tags", "salary_raw", "posted_at", "regions", "employment_type_hint", "min_yoe_hint")


def _column(table: tuple, k: int) -> tuple:
    return tuple(row[k] for row in table)


_TITLE, _PLACE, _HTML = _column(_TITLED, 0), _column(_PLACED, 0), _column(_MARKED, 0)
_key = lambda: F.col("o_orderkey")
_id = lambda k: k.cast("string")
_title, _place, _html = (lambda k, v=v: _pick(v, k) for v in (_TITLE, _PLACE, _HTML))
_day = lambda k: F.concat(F.lit("2026-09-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))
_iso = lambda k: F.concat(_day(k), F.lit("T08:11:57Z"))
_if = lambda condition, value: F.when(condition, value)
_named = lambda value: F.struct(value.alias("name"))


def _struct(**fields: Column) -> Column:
    return F.struct(*(c.alias(name) for name, c in fields.items()))


# The same in SQL, by the order's key k.
_sql = lambda values, by="k": _sql_pick(values, by)
_T, _P, _TEXT = _sql(_TITLE), _sql(_PLACE), _sql(_column(_MARKED, 1))
_PLAIN = _column(_MARKED, 2)
_INTERN, _PLURAL = (f"CASE WHEN {_sql(_column(_TITLED, i))} = 1 THEN 'internship' ELSE 'unknown' END" for i in (1, 2))
_WORDS, _GREENHOUSE, _ASHBY, _REMOTEOK, _JOBICY, _REMOTIVE = (_sql(_column(_PLACED, i)) for i in range(1, 7))
_AT, _DATE = "make_timestamp(2026, 9, k % 28 + 1, 8, 11, 57)", "make_timestamp(2026, 9, k % 28 + 1, 0, 0, 0)"
_OWN, _NAME = "slug || ':' || k", "coalesce(name, slug)"


def _india(regions: str, known: str, alone: bool) -> str:
    instead = "'india'" if alone else f"CASE WHEN {regions} = 'unknown' THEN 'india' ELSE 'india,' || {regions} END"
    return f"CASE WHEN ({known}) AND NOT contains({regions}, 'india') THEN {instead} ELSE {regions} END"


def _away(place: str, remote: str) -> str:
    return f"nullif(coalesce({place}, '') || CASE WHEN {remote} THEN ' · Remote' ELSE '' END, '')"


def _list(*parts: str) -> str:
    return f"coalesce(array_to_string(list_filter([{', '.join(parts)}], lambda x: coalesce(x, '') <> ''), ','), '')"


def _register(connector: str, item: Callable[[Column], Column], wrap: Callable[[Column], Column], keep: str = "true", scope: str = "", read: Callable = boards.read, **sql: str) -> None:
    """A query ``src_<connector>`` of the planted boards, and its SQL by column; a column that isn't named is null, or no tags."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rows(read(planted(spark, sf_dir, connector, item, wrap, scope), connector, AS_OF))

    QUERIES[f"src_{connector}"] = query
    full = {"tags": "''", "title": _T, "company": "slug", "posted_at": "CAST(NULL AS TIMESTAMP)", "min_yoe_hint": "CAST(NULL AS INT)"} | sql
    SQL[f"src_{connector}"] = (
        f"WITH {_BOARD_SQL}, items AS (SELECT o_orderkey AS k, c, 'b' || c AS slug, CASE WHEN c % 5 = 0 THEN 'Named ' || c END AS name FROM orders JOIN boards ON o_custkey = c AND status = 'ok' WHERE o_orderkey IS NOT NULL) "
        "SELECT " + ", ".join(f"{full.get(c, 'CAST(NULL AS VARCHAR)')} AS {c}" for c in _COLUMNS) + f" FROM items WHERE {keep}"
    )


def planted(spark: SparkSession, sf_dir: str, connector: str, item: Callable, wrap: Callable, scope: str = "") -> DataFrame:
    """One response per customer with orders: some not found, some failed, some empty, some of another shape."""
    c = F.col("o_custkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey").where(c.isNotNull())
    found = orders.groupBy("o_custkey").agg(F.collect_list(item(_key())).alias("items"))
    slug = F.concat(F.lit("b"), c.cast("string"))
    return found.select(
        F.lit(connector).alias("connector"), F.concat(F.lit(f"{connector}:"), slug, F.lit(scope)).alias("scope"), slug.alias("slug"),
        F.when(c % 11 == 0, 404).when(c % 13 == 0, 503).otherwise(200).alias("http_code"),
        F.when(c % 7 == 0, wrap(F.slice("items", 1, 0))).when(c % 17 == 0, "oops").otherwise(wrap(F.col("items"))).alias("body"),
        F.concat(slug, F.lit(".example")).alias("host"), F.when(c % 5 == 0, F.concat(F.lit("Named "), c.cast("string"))).alias("name"),
    )


def _rows(found: DataFrame) -> DataFrame:
    listed = {"tags": F.array_join("tags", ","), "regions": F.array_join("hiring_regions_hint", ",")}
    return found.select(*(listed.get(c, F.col(c) if c != "regions" else None).alias(c) for c in _COLUMNS))


def _under(*names: str) -> Callable[[Column], Column]:
    """Wraps items in objects of these names, outermost first."""
    def wrap(items: Column) -> Column:
        for name in reversed(names):
            items = F.struct(items.alias(name))
        return F.to_json(items)

    return wrap


_bare = F.to_json

_register(
    "greenhouse",
    lambda k: _struct(
        id=_id(k), title=_title(k), location=_named(_place(k)), offices=_if(k % 5 == 0, F.array(_named(F.lit("Pune")))), departments=F.array(_named(F.lit("Eng"))), absolute_url=F.concat(F.lit("https://gh.example/"), _id(k)),
        company_name=_pick(("Rubrik Job Board", "Careers", None), k), content=_html(k), first_published=_if(k % 2 == 0, _iso(k)), updated_at=F.lit("2026-08-01"),
    ),
    _under("jobs"), source_job_id=_OWN, url="'https://gh.example/' || k", company=f"coalesce(name, {_sql(('Rubrik', 'Careers', None))}, slug)", description=_TEXT,
    location_raw=f"coalesce(nullif({_P}, ''), CASE WHEN k % 5 = 0 THEN 'Pune' END)", tags="'Eng'", posted_at=f"CASE WHEN k % 2 = 0 THEN {_AT} ELSE TIMESTAMP '2026-08-01 00:00:00' END",
    regions=_india(_GREENHOUSE, "k % 5 = 0", False), employment_type_hint=_PLURAL,
)
_register(
    "ashby",
    lambda k: _struct(
        id=_id(k), title=_title(k), isListed=_if(k % 3 > 0, k % 19 != 0), location=_place(k), secondaryLocations=_if(k % 4 == 0, F.array(_struct(location=F.lit("Sydney")), _struct(location=F.lit("")))),
        employmentType=_pick(("Full Time", "Intern", "PartTime", "Temporary", "Seasonal", None), k), publishedAt=_iso(k), applyUrl=_if(k % 2 == 0, F.lit("https://a.example")), jobUrl=F.lit("https://j.example"),
        descriptionPlain=_if(k % 2 == 1, F.lit("plain")), descriptionHtml=F.lit("<p>"), department=F.lit("Dev"), team=F.lit(""), workplaceType=F.lit("Hybrid"), compensation=_if(k % 3 == 0, _struct(compensationTierSummary=F.lit("10k"))),
    ),
    _under("jobs"), keep="k % 19 <> 0 OR k % 3 = 0", source_job_id=_OWN, url="CASE WHEN k % 2 = 0 THEN 'https://a.example' ELSE 'https://j.example' END", company=_NAME,
    description="CASE WHEN k % 2 = 1 THEN 'plain' ELSE '<p>' END", location_raw=f"nullif(array_to_string(list_filter([{_P}, CASE WHEN k % 4 = 0 THEN 'Sydney' END], lambda x: coalesce(x, '') <> ''), ', '), '')",
    tags="'Dev,Hybrid'", salary_raw="CASE WHEN k % 3 = 0 THEN '10k' END", posted_at=_AT,
    regions=f"CASE WHEN k % 4 <> 0 THEN {_ASHBY} WHEN {_ASHBY} = 'unknown' THEN 'apac' WHEN contains({_ASHBY}, 'apac') THEN {_ASHBY} WHEN {_ASHBY} IN ('canada', 'latam') THEN 'apac,' || {_ASHBY} ELSE {_ASHBY} || ',apac' END",
    employment_type_hint=_sql(("full_time", "internship", "part_time", "contract", "unknown", "unknown")),
)
_register(
    "smartrecruiters",
    lambda k: _struct(
        id=_id(k), name=_title(k), company=_if(k % 2 == 0, _named(F.lit("Smart Co"))), releasedDate=_iso(k), experienceLevel=_struct(id=_pick(("internship", "associate", "director", "not_applicable", None), k)),
        typeOfEmployment=_struct(id=_pick(("permanent", "Intern", "contractor", "other", None), k)), department=_struct(label=F.lit("R&D")), function=_if(k % 3 == 0, _struct(label=F.lit("Core"))),
        location=_struct(city=_pick(("Pune", None), k), region=F.lit(""), country=_pick(("in", "US", "zz", None), k), fullLocation=_if(k % 5 == 0, F.lit("Full, Place")), remote=k % 3 == 0),
    ),
    _under("content"), source_job_id=_OWN, url="'https://jobs.smartrecruiters.com/' || slug || '/' || k", company="CASE WHEN k % 2 = 0 THEN 'Smart Co' ELSE slug END",
    location_raw=_away(f"CASE WHEN k % 5 = 0 THEN 'Full, Place' ELSE array_to_string(list_filter([{_sql(('Pune', None))}, {_sql(('in', 'US', 'zz', None))}], lambda x: x IS NOT NULL), ', ') END", "k % 3 = 0"),
    tags="CASE WHEN k % 3 = 0 THEN 'R&D,Core' ELSE 'R&D' END", posted_at=_AT, regions=_sql(("india", "us", "unknown", "unknown")), employment_type_hint=_sql(("full_time", "internship", "contract", "unknown", "unknown")),
    min_yoe_hint="CAST(CASE k % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 8 END AS INT)",
)
_register(
    "workable_boards",
    lambda k: _struct(
        shortcode=_id(k), title=_title(k), url=_if(k % 2 == 0, F.lit("https://w.example")), shortlink=F.lit("https://s.example"), description=_html(k), employment_type=_pick(("Full-time", "Internship"), k), telecommuting=k % 3 == 0,
        department=F.lit("Dev"), experience=_pick(("Entry level", "Director", None), k), published_on=_if(k % 4 > 0, _day(k)), created_at=F.lit("2026-08-01"), city=F.lit("Pune"), state=F.lit(""), country=F.lit("India"),
        locations=_if(k % 5 > 0, F.array(_struct(city=F.lit("Oslo"), country=F.lit("Norway"), countryCode=_pick(("IN", "NO"), k)), _struct(city=F.lit("Paris"), country=F.lit(None), countryCode=F.lit(None)))),
    ),
    _under("jobs"), source_job_id=_OWN, url="CASE WHEN k % 2 = 0 THEN 'https://w.example' ELSE 'https://s.example' END", company=_NAME, description=_TEXT,
    location_raw=_away("CASE WHEN k % 5 > 0 THEN 'Oslo, Norway; Paris' ELSE 'Pune, India' END", "k % 3 = 0"), tags=_list("'Dev'", _sql(("Entry level", "Director", None))),
    posted_at=f"CASE WHEN k % 4 > 0 THEN {_DATE} ELSE TIMESTAMP '2026-08-01 00:00:00' END", regions="CASE WHEN k % 5 = 0 THEN 'india' WHEN k % 2 = 0 THEN 'india,europe' ELSE 'europe' END",
    employment_type_hint=f"CASE WHEN k % 2 = 1 THEN 'internship' ELSE {_INTERN} END", min_yoe_hint=f"CAST(CASE WHEN k % 2 = 1 OR k % 3 = 0 OR {_INTERN} = 'internship' THEN 0 END AS INT)",
)
_register(
    "recruitee",
    lambda k: _struct(
        id=_id(k), slug=F.concat(F.lit("o"), _id(k)), status=_pick(("published", "draft", None), k), title=_title(k), location=_place(k), remote=k % 2 == 0, country_code=_pick(("IN", "US"), k), employment_type_code=_pick(("fulltime", "internship", None), k),
        experience_code=_pick(("entry_level", None), k), description=_html(k), requirements=_if(k % 3 == 0, F.lit("<b>Go</b>")), careers_url=_if(k % 5 == 0, F.lit("https://c.example")), company_name=_if(k % 4 == 0, F.lit("Rec Co")), department=_if(k % 2 == 0, F.lit("Ops")),
        tags=F.array(F.lit("x"), F.lit("")), published_at=_if(k % 4 > 0, F.concat(_day(k), F.lit(" 08:11:57 UTC"))), created_at=F.lit("2026-08-01"),
    ),
    _under("offers"), keep="k % 3 <> 1", source_job_id=_OWN, url="CASE WHEN k % 5 = 0 THEN 'https://c.example' ELSE 'https://' || slug || '.recruitee.com/o/o' || k END", company="coalesce(name, CASE WHEN k % 4 = 0 THEN 'Rec Co' END, slug)",
    description=f"nullif(array_to_string(list_filter([{_TEXT}, CASE WHEN k % 3 = 0 THEN 'Go' END], lambda x: x IS NOT NULL), chr(10) || chr(10)), '')", location_raw=_away(_P, "k % 2 = 0"), tags="CASE WHEN k % 2 = 0 THEN 'Ops,x' ELSE 'x' END",
    posted_at=f"CASE WHEN k % 4 > 0 THEN {_AT} END", regions=_india(_WORDS, "k % 2 = 0", True), employment_type_hint=_INTERN, min_yoe_hint=f"CAST(CASE WHEN k % 2 = 0 OR {_INTERN} = 'internship' THEN 0 END AS INT)",
)
_register(
    "gem",
    lambda k: _struct(
        id=_id(k), title=_title(k), location=_named(_place(k)), offices=F.array(_struct(name=F.lit("Chennai"), location=_if(k % 2 == 0, _named(F.lit("Pune"))))), location_type=_pick(("remote", "onsite"), k), employment_type=_pick(("full_time", "intern"), k),
        absolute_url=F.lit("https://g.example"), content_plain=F.lit("text"), departments=F.array(_named(F.lit("Eng")), _named(F.lit(""))), created_at=_iso(k),
    ),
    _bare, source_job_id=_OWN, url="'https://g.example'", company=_NAME, description="'text'", tags="'Eng'", posted_at=_AT, employment_type_hint=f"CASE WHEN k % 2 = 1 THEN 'internship' ELSE {_INTERN} END",
    location_raw=_away(f"CASE WHEN {_P} <> '' THEN {_P} || '; ' ELSE '' END || CASE WHEN k % 2 = 0 THEN 'Pune' ELSE 'Chennai' END", "k % 2 = 0"), regions=_india(_WORDS, "true", False),
)
_register(
    "rippling",
    lambda k: _struct(id=_id(k), name=_title(k), url=F.lit("https://r.example"), department=_named(_pick(("Dev", None), k)), locations=F.array(_struct(name=_place(k), country=F.lit("Norway"), countryCode=_pick(("NO", "IN"), k), workplaceType=_pick(("REMOTE", "ON_SITE", "HYBRID"), k)))),
    _under("items"), source_job_id=_OWN, url="'https://r.example'", company=_NAME, location_raw=_away(f"coalesce(nullif({_P}, ''), 'Norway')", "k % 3 = 0"), tags="CASE WHEN k % 2 = 0 THEN 'Dev' ELSE '' END",
    regions=_india(_WORDS, "k % 2 = 1", False), employment_type_hint=_INTERN,
)
_register(
    "workday",
    lambda k: _struct(title=_title(k), externalPath=_if(k % 19 > 0, F.concat(F.lit("/job/"), _id(k))), locationsText=_place(k), postedOn=_pick(("Posted Today", "Posted Yesterday", "Posted 14 Days Ago", "Posted 30+ Days Ago", "soon", None), k), bulletFields=F.array(F.lit("R1"))),
    _under("jobPostings"), scope=":site", keep="k % 19 > 0", source_job_id="slug || ':site:/job/' || k", url="slug || '.example/site/job/' || k", company="coalesce(name, 'B' || c)", location_raw=f"nullif({_P}, '')", tags="'R1'",
    posted_at=f"CASE k % 6 WHEN 0 THEN TIMESTAMP '{AS_OF}' WHEN 1 THEN TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY WHEN 2 THEN TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY END", regions=_WORDS,
    employment_type_hint=f"CASE WHEN {_T} = 'Summer Analyst' THEN 'unknown' ELSE {_INTERN} END",
)
_register(
    "oracle",
    lambda k: _struct(Id=_id(k), Title=_title(k), PrimaryLocation=_place(k), PrimaryLocationCountry=_pick(("IN", "US", None), k), PostedDate=_pick(("2026-09-05", "soon"), k), ShortDescriptionStr=F.lit("short"), JobFamily=F.lit("IT"), WorkerType=_pick((None, "Regular"), k)),
    lambda items: F.to_json(F.struct(F.array(F.struct(items.alias("requisitionList"))).alias("items"))), scope=":site", source_job_id=_OWN, url="'https://' || slug || '.example/hcmUI/CandidateExperience/en/sites/site/job/' || k", company=_NAME,
    description="'short'", location_raw=f"nullif({_P}, '')", tags="CASE WHEN k % 2 = 1 THEN 'IT,Regular' ELSE 'IT' END", posted_at="CASE WHEN k % 2 = 0 THEN TIMESTAMP '2026-09-05 00:00:00' END", regions=_india(_WORDS, "k % 3 = 0", True),
    employment_type_hint=f"CASE WHEN {_T} = 'Co-op Developer' THEN 'unknown' ELSE {_INTERN} END",
)
_register(
    "ibm",
    lambda k: _struct(_id=F.concat(F.lit("d"), _id(k)), _source=_struct(title=_title(k), url=F.concat(F.lit("https://ibm.example/?"), F.when(k % 2 == 0, "jobId=").otherwise("id="), _id(k)), description=_html(k), dcdate=_day(k), field_keyword_05=_pick(("India", "Peru"), F.floor(k / 2)), field_keyword_08=F.lit("Sw"), field_keyword_18=_pick(("Internship", "Professional", None), k), field_keyword_19=_pick(("Pune", ""), k))),
    _under("hits", "hits"), keep="(k // 2) % 2 = 0", source_job_id="CASE WHEN k % 2 = 0 THEN '' || k ELSE 'd' || k END", url="'https://ibm.example/?' || CASE WHEN k % 2 = 0 THEN 'jobId=' ELSE 'id=' END || k", company="'IBM'", description=_TEXT,
    location_raw="CASE WHEN k % 2 = 0 THEN 'Pune, India' ELSE 'India' END", tags=_list("'Sw'", _sql(("Internship", "Professional", None))), posted_at=_DATE, regions="'india'", employment_type_hint="CASE WHEN k % 3 = 0 THEN 'internship' ELSE 'unknown' END",
)
_register(
    "amazon",
    lambda k: _struct(
        id_icims=_id(k), title=_title(k), job_path=_if(k % 3 > 0, F.lit("/en/jobs/1")), company_name=_pick(("ADCI - Karnataka - A66", "Amazon Web Services, Inc."), k), normalized_location=_if(k % 2 == 0, F.lit("Pune, Maharashtra, IND")), location=_place(k), country_code=_pick(("IND", "USA", "IND"), k),
        description=_html(k), basic_qualifications=_if(k % 2 == 1, F.lit("Java<br/>SQL")), is_intern=_if(k % 3 == 0, k % 2 == 0), university_job=k % 5 == 0, job_category=F.lit("SDE"), business_category=F.lit("aws"), posted_date=F.concat(F.lit("September  "), (k % 28 + 1).cast("string"), F.lit(", 2026")),
    ),
    _under("jobs"), source_job_id="'' || k", url="'https://www.amazon.jobs' || CASE WHEN k % 3 > 0 THEN '/en/jobs/1' ELSE '' END", company=_sql(("Amazon", "Amazon Web Services")),
    description=f"nullif(array_to_string(list_filter([{_TEXT}, CASE WHEN k % 2 = 1 THEN 'Basic qualifications' || chr(10) || 'Java' || chr(10) || 'SQL' END], lambda x: x IS NOT NULL), chr(10) || chr(10)), '')",
    location_raw=f"nullif(CASE WHEN k % 2 = 0 THEN 'Pune, Maharashtra, IND' ELSE {_P} END, '')", tags="'SDE,aws'", posted_at=_DATE, regions=_india(f"CASE WHEN k % 2 = 0 THEN 'india' ELSE {_WORDS} END", "k % 3 <> 1", True),
    employment_type_hint="CASE WHEN k % 6 = 0 OR k % 9 IN (0, 1, 6) THEN 'internship' ELSE 'unknown' END", min_yoe_hint="CAST(CASE WHEN k % 6 = 0 OR k % 9 IN (0, 1, 6) OR k % 5 = 0 THEN 0 END AS INT)",
)
_register(
    "microsoft",
    lambda k: _struct(id=_id(k), name=_title(k), locations=F.array(_place(k)), standardizedLocations=F.array(_pick(("Pune, MH, IN", "Oslo, NO"), k)), positionUrl=_if(k % 2 == 0, F.lit("/p/1")), department=F.lit("Azure"), workLocationOption=_pick(("remote", "onsite", None), k), postedTs=F.when(k % 3 > 0, k + 1000).otherwise(0), creationTs=k + 5),
    _under("data", "positions"), source_job_id="'' || k", url="'https://apply.careers.microsoft.com' || CASE WHEN k % 2 = 0 THEN '/p/1' ELSE '/careers/job/' || k END", company="'Microsoft'", location_raw=_away(_P, "k % 3 = 0"), tags=_list("'Azure'", _sql(("remote", "onsite", None))),
    posted_at="CAST(epoch_ms((CASE WHEN k % 3 > 0 THEN k + 1000 ELSE k + 5 END) * 1000) AS TIMESTAMP)", regions=_india(_WORDS, "k % 2 = 0", False), employment_type_hint=_INTERN,
)
_register(
    "eightfold",
    lambda k: _struct(id=_id(k), name=_title(k), locations=_if(k % 2 == 0, F.array(_place(k), F.lit("Oslo"))), location=_place(k), canonicalPositionUrl=_if(k % 4 == 0, F.lit("https://e.example")), job_description=_html(k), work_location_option=_pick(("remote", "onsite", None), k), department=F.lit("Dev"), business_unit=F.lit(""), t_create=_if(k % 2 == 0, k + 9)),
    _under("positions"), keep=f"contains(lower({_P}), 'india')", source_job_id=_OWN, url="CASE WHEN k % 4 = 0 THEN 'https://e.example' ELSE 'https://' || slug || '.example/careers/job/' || k END", company=_NAME, description=_TEXT,
    location_raw=_away(f"{_P} || CASE WHEN k % 2 = 0 THEN '; Oslo' ELSE '' END", "k % 3 = 0"), tags="'Dev'", posted_at="CASE WHEN k % 2 = 0 THEN CAST(epoch_ms((k + 9) * 1000) AS TIMESTAMP) END", regions=_india(_WORDS, "true", True), employment_type_hint=_INTERN,
)
_register(
    "atlassian",
    lambda k: _struct(id=_id(k), title=_title(k), locations=F.array(_pick(("Remote - India", "Bengaluru, India", "Oslo"), k), F.lit("Sydney")), overview=_html(k), qualifications=F.lit("<i>SQL</i>"), portalJobPost=_if(k % 2 == 0, _struct(portalUrl=F.lit("https://p.example"))), applyUrl=_if(k % 4 > 1, F.lit("https://a.example?mode=apply")), category=_pick(("Interns", "Engineering"), k)),
    _bare, keep="k % 3 < 2", source_job_id="'' || k", url="CASE WHEN k % 2 = 0 THEN 'https://p.example' WHEN k % 4 > 1 THEN 'https://a.example' ELSE 'https://www.atlassian.com/company/careers/all-jobs' END", company="'Atlassian'",
    description=f"array_to_string(list_filter([{_TEXT}, 'SQL'], lambda x: x IS NOT NULL), chr(10) || chr(10))", location_raw=_sql(("Remote - India · Remote", "Bengaluru, India", "")), tags=_sql(("Interns", "Engineering")), regions="'india'",
    employment_type_hint=f"CASE WHEN k % 2 = 0 THEN 'internship' ELSE {_INTERN} END",
)
_register(
    "goldman",
    lambda k: _struct(roleId=F.concat(_id(k), _pick(("_EARLY_CAREER", "_PRO", "_PRO"), k)), jobTitle=_title(k), corporateTitle=_pick(("Associate", "Analyst", "Vice President", None), k), jobFunction=F.lit("Tech"), division=_pick((None, "GBM"), k), status=_pick(("POSTED", None, "CLOSED", "POSTED", "POSTED"), k), externalSource=_struct(sourceId=_if(k % 23 > 0, _id(k))), locations=F.array(_struct(city=F.lit("Bengaluru"), state=F.lit(""), country=F.lit("India")), _struct(city=F.lit(None), state=F.lit(None), country=F.lit("Peru")))),
    _under("data", "roleSearch", "items"), keep="k % 23 > 0 AND k % 5 <> 2 AND (k % 3 = 0 OR k % 4 IN (1, 3))", source_job_id="k || CASE WHEN k % 3 = 0 THEN '_EARLY_CAREER' ELSE '_PRO' END", url="'https://higher.gs.com/roles/' || k", company="'Goldman Sachs'",
    description=f"'Corporate title: ' || coalesce({_sql(('Associate', 'Analyst', 'Vice President', None))}, '') || '. Function: Tech. Division: ' || CASE WHEN k % 2 = 1 THEN 'GBM' ELSE '-' END || '.'", location_raw="'Bengaluru, India; Peru'",
    tags=_list("'Tech'", "CASE WHEN k % 2 = 1 THEN 'GBM' END", _sql(("Associate", "Analyst", "Vice President", None))), regions="'india'", employment_type_hint=_INTERN, min_yoe_hint="CAST(CASE WHEN k % 3 = 0 OR k % 4 = 1 THEN 0 END AS INT)",
)
_register(
    "workable",
    lambda k: _struct(id=_id(k), title=_title(k), url=F.lit("https://w.example"), company=_struct(title=F.lit("Work Co")), description=_html(k), location=_if(k % 2 == 0, _struct(city=F.lit("Oslo"), countryName=_pick(("India", "Norway"), F.floor(k / 2)))), locations=F.array(_place(k), F.lit("Lima")), workplace=_pick(("remote", "hybrid"), k), employmentType=_pick(("Full-time", "Internship", "Other", None), k), created=_iso(k)),
    _under("jobs"), source_job_id="'' || k", url="'https://w.example'", company="'Work Co'", description=_TEXT, location_raw=_away(f"CASE WHEN k % 2 = 0 THEN 'Oslo, ' || {_sql(('India', 'Norway'), 'k // 2')} ELSE {_P} || '; Lima' END", "k % 2 = 0"),
    tags=_sql(("remote", "hybrid")), posted_at=_AT, regions=f"CASE WHEN k % 4 = 0 THEN 'india' WHEN k % 4 = 2 THEN 'unknown' ELSE {_WORDS} END",
    employment_type_hint=f"CASE WHEN k % 4 = 1 OR {_INTERN} = 'internship' AND k % 9 NOT IN (2, 3) OR k % 9 = 7 THEN 'internship' WHEN k % 4 = 0 THEN 'full_time' ELSE 'unknown' END",
)
_register(
    "simplify",
    lambda k: _struct(id=_if(k % 2 == 0, _id(k)), url=F.concat(F.lit("https://s.example/"), _id(k)), title=_title(k), company_name=F.lit("Simple"), active=k % 5 > 0, is_visible=_if(k % 3 == 0, k % 2 == 0), date_posted=_if(k % 4 > 0, F.lit(1793491200) - (k % 200) * 86400), locations=F.array(_place(k)), terms=F.array(F.lit("Summer")), category=F.lit("SWE")),
    _bare, keep="k % 5 > 0 AND (k % 3 > 0 OR k % 2 = 0) AND (k % 4 = 0 OR k % 200 <= 90)", source_job_id="CASE WHEN k % 2 = 0 THEN '' || k ELSE 'https://s.example/' || k END", url="'https://s.example/' || k", company="'Simple'", location_raw=f"nullif({_P}, '')",
    tags="'Summer,SWE'", posted_at=f"CASE WHEN k % 4 > 0 THEN TIMESTAMP '{AS_OF}' - to_days(CAST(k % 200 AS INT)) END", regions=_WORDS, employment_type_hint="'internship'", min_yoe_hint="0",
)


def _restrictions(k: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(k % 4 == 0, none).when(k % 4 == 1, F.array(F.lit("Germany"), F.lit("India"))).when(k % 4 == 2, F.array(F.lit("Narnia")))


_register(
    "himalayas",
    lambda k: _struct(guid=_id(k), title=_title(k), companyName=F.lit("Him"), applicationLink=_if(k % 2 == 0, F.lit("https://h.example")), link=F.lit("https://l.example"), description=_html(k), excerpt=F.lit("short"), locationRestrictions=_restrictions(k), categories=F.array(F.lit("a")), skills=F.array(F.lit("b")), employmentType=_pick(("Full Time", "Internship", "Other"), k), pubDate=k + 7),
    _under("jobs"), source_job_id="'' || k", url="CASE WHEN k % 2 = 0 THEN 'https://h.example' ELSE 'https://l.example' END", company="'Him'", description=_sql((*_PLAIN[:2], "short", None)),
    location_raw="CASE k % 4 WHEN 1 THEN 'Germany, India' WHEN 2 THEN 'Narnia' ELSE 'Worldwide' END", tags="'a,b'", posted_at="CAST(epoch_ms((k + 7) * 1000) AS TIMESTAMP)", regions="CASE k % 4 WHEN 1 THEN 'europe,india' WHEN 2 THEN 'unknown' ELSE 'worldwide' END",
    employment_type_hint=_sql(("full_time", "internship", "unknown")),
)
_register(
    "remoteok",
    lambda k: _struct(id=_id(k), position=_if(k % 19 > 0, _title(k)), company=F.lit("Ok"), url=_if(k % 2 == 0, F.lit("https://r.example")), description=F.lit("<p>raw"), location=_place(k), tags=F.array(F.lit("dev"), F.lit("js")), salary=F.lit("1"), date=_iso(k)),
    _bare, keep="k % 19 > 0", source_job_id="'' || k", url="CASE WHEN k % 2 = 0 THEN 'https://r.example' ELSE 'https://remoteok.com/remote-jobs/' || k END", company="'Ok'", description="'<p>raw'", location_raw=_P, tags="'dev,js'", salary_raw="'1'", posted_at=_AT, regions=_REMOTEOK,
    employment_type_hint="'unknown'",
)
_register(
    "jobicy",
    lambda k: _struct(id=_id(k), jobTitle=_title(k), companyName=F.lit("Job Co"), url=_if(k % 2 == 0, F.lit("https://j.example")), jobDescription=_html(k), jobExcerpt=F.lit("brief"), jobGeo=_place(k), jobIndustry=F.array(F.lit("it")), jobLevel=_pick(("Entry-Level", "Senior", None), k), jobType=_pick((" Full-Time ", "intern", "gig"), k), pubDate=_iso(k)),
    _under("jobs"), source_job_id="'' || k", url="CASE WHEN k % 2 = 0 THEN 'https://j.example' ELSE 'https://jobicy.com/jobs/' || k END", company="'Job Co'", description=_sql((*_PLAIN[:2], "brief", None)),
    location_raw=f"'Remote (' || coalesce(nullif({_P}, ''), 'Anywhere') || ')'", tags=_list("'it'", _sql(("Entry-Level", "Senior", None))), posted_at=_AT, regions=_JOBICY, employment_type_hint=_sql(("full_time", "internship", "unknown")), min_yoe_hint="CAST(CASE WHEN k % 3 = 0 THEN 0 END AS INT)",
)
_register(
    "arbeitnow",
    lambda k: _struct(slug=_id(k), title=_title(k), company_name=F.lit("Arb"), url=F.lit("https://a.example"), description=_html(k), location=_place(k), remote=k % 2 == 1, tags=F.array(F.lit("t")), job_types=_if(k % 3 == 0, F.array(F.lit("Internship"))), created_at=k + 3),
    _under("data"), source_job_id="'' || k", url="'https://a.example'", company="'Arb'", description=_sql(_PLAIN), location_raw=_P, tags="CASE WHEN k % 3 = 0 THEN 't,internship' ELSE 't' END", posted_at="CAST(epoch_ms((k + 3) * 1000) AS TIMESTAMP)",
    regions=f"CASE WHEN {_P} IN ('Bengaluru, Karnataka, India', 'Indianapolis, IN', 'Anywhere in India') THEN 'india' WHEN {_P} = 'Remote - Worldwide' AND k % 2 = 1 THEN 'worldwide' WHEN {_P} = 'Singapore; Berlin' THEN 'europe' ELSE 'unknown' END",
    employment_type_hint="CASE WHEN k % 3 = 0 THEN 'internship' ELSE 'unknown' END",
)
_register(
    "remotive",
    lambda k: _struct(id=_id(k), title=_title(k), company_name=F.lit("Rem"), url=F.lit("https://r.example"), description=F.lit("d"), candidate_required_location=_place(k), tags=F.array(F.lit("x")), salary=F.lit("9"), job_type=_pick(("full_time", "Freelance", "other", None), k), publication_date=_day(k)),
    _under("jobs"), source_job_id="'' || k", url="'https://r.example'", company="'Rem'", description="'d'", location_raw=_P, tags="'x'", salary_raw="'9'", posted_at=_DATE, regions=_REMOTIVE, employment_type_hint=_sql(("full_time", "contract", "unknown", "unknown")),
)


def _rss(items: Column) -> Column:
    part = lambda name: lambda i: F.when(i[name].isNotNull(), F.concat(F.lit(f"<{name}>"), i[name], F.lit(f"</{name}>"))).otherwise("")
    one = lambda i: F.concat(F.lit("<item>"), *(part(n)(i) for n in ("title", "link", "description", "pubDate", "guid", "region")), F.lit("</item>"))
    return F.concat(F.lit("<rss><channel>"), F.array_join(F.transform(items, one), ""), F.lit("</channel></rss>"))


_register(
    "weworkremotely",
    lambda k: _struct(title=F.concat(_pick(("Wwr Co: ", "", ": "), k), _title(k)), link=F.concat(F.lit(" https://w.example/"), _id(k)), description=_if(k % 2 == 0, F.lit("&lt;p&gt;Hi&lt;/p&gt;")), pubDate=F.concat(F.lit("Mon, "), (k % 28 + 1).cast("string"), F.lit(" Sep 2026 08:11:57 +0000")), guid=_if(k % 3 == 0, _id(k)), region=_place(k)),
    _rss, source_job_id="CASE WHEN k % 3 = 0 THEN '' || k ELSE 'https://w.example/' || k END", url="'https://w.example/' || k", company=_sql(("Wwr Co", "Remote Employer", "Remote Employer")), description="CASE WHEN k % 2 = 0 THEN 'Hi' END",
    location_raw=f"CASE WHEN {_P} <> '' THEN 'Remote (' || {_P} || ')' ELSE 'Remote' END", tags="'remote,programming'", posted_at=_AT, employment_type_hint="'full_time'", regions=_REMOTEOK,
)


def board_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards of an object payload by status."""
    found = planted(spark, sf_dir, "recruitee", lambda k: _struct(id=_id(k), status=_pick(("published", "draft", None), k)), _under("offers"))
    return boards.status(found, "recruitee").select("scope", "status")


QUERIES["board_statuses"] = board_statuses
SQL["board_statuses"] = f"""WITH {_BOARD_SQL}, kept AS (SELECT o_custkey AS c, bool_or(o_orderkey % 3 <> 1) AS held FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1)
SELECT 'recruitee:b' || c AS scope, CASE WHEN status = 'ok' AND NOT held THEN 'empty' ELSE status END AS status FROM boards JOIN kept USING (c)"""
