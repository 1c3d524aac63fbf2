"""Queries of venture boards, startup pages and the startup list over planted responses, and their SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.plans.boards import _AT, _INTERN, _P, _T, _WORDS, _away, _id, _india, _iso, _list, _place, _register, _rows, _sql, _struct, _title, _under, planted
from rolecall.plans.pages import _escaped
from rolecall.sources import ventures
from rolecall.sources.postings import AS_OF, _pick

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str) -> Callable:
    def put(query: Callable) -> Callable:
        QUERIES[query.__name__], SQL[query.__name__] = query, sql
        return query

    return put


_labelled = lambda *c: F.array(*(_struct(label=x) for x in c))
_register(
    "vc_consider",
    lambda k: _struct(
        jobId=F.when(k % 3 > 0, _id(k)), title=F.when(k % 19 > 0, _title(k)), applyUrl=F.when(k % 4 > 1, F.concat(F.lit("https://c.example/"), _id(k))), url=F.when(k % 4 > 0, F.concat(F.lit("https://u.example/"), _id(k))), companySlug=F.when(k % 2 == 0, F.lit("acme")), companyId=F.lit("77"), companyName=_pick(("Acme", None), k),
        locations=F.when(k % 5 > 0, F.array(_place(k))), normalizedLocations=_labelled(_pick(("India", "Pune, IN", None), k)), remote=_pick((True, False, None), k), jobSeniorityIds=_pick((("intern",), ("junior",), ("junior", "mid"), ()), k), minYearsExp=F.when(k % 7 == 0, F.lit(2)), jobFunctions=_labelled(F.lit("Eng"), F.lit(None).cast("string")), timeStamp=_iso(k),
    ),
    _under("jobs"), keep="k % 19 > 0 AND k % 4 > 0", read=ventures.read, source_job_id="CASE WHEN k % 2 = 0 THEN 'acme' ELSE '77' END || ':' || CASE WHEN k % 3 > 0 THEN '' || k WHEN k % 4 > 1 THEN 'https://c.example/' || k ELSE 'https://u.example/' || k END",
    url="CASE WHEN k % 4 > 1 THEN 'https://c.example/' || k ELSE 'https://u.example/' || k END", company=f"coalesce({_sql(('Acme', None))}, '')",
    location_raw=_away(f"CASE WHEN k % 5 > 0 THEN {_P} ELSE coalesce({_sql(('India', 'Pune, IN', None))}, '') END", "k % 3 = 0"), tags="'Eng'", posted_at=_AT,
    regions=f"CASE WHEN k % 3 < 2 AND k % 5 = 0 THEN CASE WHEN k % 3 = 0 THEN 'india' ELSE 'india,us' END WHEN k % 5 = 0 THEN 'unknown' WHEN k % 3 = 2 THEN {_india(_WORDS, f'''{_P} = 'Indianapolis, IN' ''', False)}"
            f" WHEN k % 3 = 1 THEN CASE WHEN {_WORDS} = 'unknown' THEN 'india,us' WHEN {_WORDS} = 'india' THEN 'india,us' WHEN contains({_WORDS}, 'us') THEN 'india,' || {_WORDS} WHEN {_WORDS} = 'india,worldwide' THEN 'india,worldwide,us' WHEN {_WORDS} = 'worldwide' THEN 'india,worldwide,us' ELSE 'india,us,' || {_WORDS} END"
            f" ELSE CASE WHEN {_WORDS} = 'unknown' THEN 'india' WHEN contains({_WORDS}, 'india') THEN {_WORDS} ELSE 'india,' || {_WORDS} END END",
    employment_type_hint=f"CASE WHEN k % 4 = 0 OR {_INTERN} = 'internship' THEN 'internship' ELSE 'unknown' END", min_yoe_hint=f"CAST(CASE WHEN k % 7 = 0 THEN 2 WHEN k % 4 < 2 OR {_INTERN} = 'internship' THEN 0 END AS INT)",
)
_register(
    "vc_getro",
    lambda k: _struct(
        id=k, url=F.when(k % 19 > 0, F.lit("https://g.example")), title=F.concat(F.lit(" "), _title(k)), organization=F.when(k % 3 > 0, _struct(name=F.lit("Org"), stage=_pick(("Seed", None), k))), locations=F.when(k % 6 > 0, F.array(_place(k))), searchable_locations=F.when(k % 2 == 0, F.array(F.lit("India"))),
        work_mode=_pick(("remote", "on_site", None), k), seniority=_pick(("internship", "entry_level", "senior", None), k), skills=F.array(F.lit("Go"), F.lit("")), created_at=F.when(k % 5 > 0, k + 1757841600),
    ),
    _under("results", "jobs"), keep="k % 19 > 0", read=ventures.read, source_job_id="'getro:' || k", url="'https://g.example'", company="CASE WHEN k % 3 > 0 THEN 'Org' ELSE '' END", location_raw=_away(f"CASE WHEN k % 6 > 0 THEN {_P} END", "k % 3 = 0"),
    tags="CASE WHEN k % 3 > 0 AND k % 2 = 0 THEN 'Seed,Go' ELSE 'Go' END", posted_at="CASE WHEN k % 5 > 0 THEN CAST(epoch_ms((k + 1757841600) * 1000) AS TIMESTAMP) END", regions=_india(f"CASE WHEN k % 6 > 0 THEN {_WORDS} ELSE 'unknown' END", "k % 2 = 0", False),
    employment_type_hint=f"CASE WHEN k % 4 = 0 OR {_INTERN} = 'internship' THEN 'internship' ELSE 'unknown' END", min_yoe_hint=f"CAST(CASE WHEN k % 4 < 2 OR {_INTERN} = 'internship' THEN 0 END AS INT)",
)

#: A startup posting's place, whether it can be taken up from India, by anyone, and its regions.
_FENCES = (
    ("Bengaluru, KA, IN", True, True, "india,us"), ("Remote (US)", False, False, None), ("San Francisco, CA, US / Remote (CA; US)", False, False, None), ("Remote", True, False, "worldwide"), ("New York / Remote (Anywhere)", True, False, "worldwide,us"),
    ("Remote (US; India)", True, True, "india"), ("London", False, False, None), ("remote (GB) / Remote", True, False, "worldwide"), ("Remote (APAC), remote (US)", False, False, None), (None, False, False, None), ("Indianapolis", False, False, None), ("Remote (Indiana)", False, False, None),
)
_fence = lambda i: _sql(tuple(row[i] for row in _FENCES))


def _yc_item(k: Column) -> Column:
    return _struct(
        id=F.when(k % 23 > 0, _id(k)), title=F.concat(_title(k), F.when(k % 2 == 0, F.lit(" (YC S24) ")).otherwise("")), url=F.when(k % 3 > 0, F.concat(F.lit("/j/"), _id(k))), type=_pick(("Full-time", "Internship", "Contract", None), k), location=_pick(tuple(r[0] for r in _FENCES), k),
        visa=_pick(("US citizen/visa only", "Will sponsor", None, None, None), k), minExperience=_pick(("Any (new grads ok)", "3+ years", None, "11+ Years", "Senior new grad"), k), companyName=F.when(k % 7 == 0, F.lit("Told")), prettyRole=F.lit("Eng & Co"), roleSpecificType=F.when(k % 4 == 0, F.lit("Web")),
        salaryRange=F.when(k % 5 == 0, F.lit("$1")), equityRange=F.lit(""), skills=F.when(k % 3 == 0, F.array(F.lit("Go"), F.lit("C"))),
    )


def _yc_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = lambda items: F.concat(F.lit('<div id="app" data-page="'), _escaped(_under("props", "jobPostings")(items)), F.lit('"></div>'))
    n = F.col("c_custkey")
    companies = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("b"), n.cast("string")).alias("slug"), F.when(n % 2 == 0, F.concat(F.lit("Co "), n.cast("string"))).alias("name"), F.when(n % 3 == 0, F.lit("We do.")).alias("one_liner"))
    return ventures.with_companies(planted(spark, sf_dir, "yc_jobs", _yc_item, page), companies)


_YC_INTERN = f"(k % 4 = 1 OR {_INTERN} = 'internship')"


@_query(f"""WITH boards AS (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_custkey IS NOT NULL AND o_custkey % 11 > 0 AND o_custkey % 13 > 0 AND o_custkey % 7 > 0 AND o_custkey % 17 > 0), items AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders JOIN boards ON o_custkey = c)
SELECT '' || k AS source_job_id, 'https://www.ycombinator.com' || CASE WHEN k % 3 > 0 THEN '/j/' || k ELSE '/companies/b' || c || '/jobs' END AS url, {_T} AS title, CASE WHEN k % 7 = 0 THEN 'Told' WHEN c % 2 = 0 THEN 'Co ' || c ELSE 'b' || c END AS company,
  nullif(array_to_string(list_filter([CASE WHEN c % 3 = 0 THEN 'We do.' END, CASE WHEN k % 4 = 0 THEN 'Role: Eng & Co (Web).' END, CASE WHEN k % 5 = 0 THEN 'Salary: $1.' END, 'Experience: ' || {_sql(("Any (new grads ok)", "3+ years", None, "11+ Years", "Senior new grad"))} || '.', CASE WHEN k % 3 = 0 THEN 'Skills: Go, C.' END], lambda x: x IS NOT NULL), ' '), '') AS description,
  {_fence(0)} AS location_raw, {_list("'Eng & Co'", "CASE WHEN k % 4 = 0 THEN 'Web' END", _sql(("Full-time", "Internship", "Contract", None)), "CASE WHEN k % 3 = 0 THEN 'Go,C' END")} AS tags, CAST(NULL AS VARCHAR) AS salary_raw, CAST(NULL AS TIMESTAMP) AS posted_at, {_fence(3)} AS regions,
  CASE WHEN {_YC_INTERN} THEN 'internship' WHEN k % 4 = 0 THEN 'full_time' ELSE 'unknown' END AS employment_type_hint, CAST(CASE WHEN {_YC_INTERN} THEN 0 ELSE list_extract([0, 3, NULL, 11, 0], CAST(k % 5 + 1 AS INT)) END AS INT) AS min_yoe_hint
FROM items WHERE k % 23 > 0 AND {_fence(1)} AND ({_fence(2)} OR k % 5 > 0)""")
def src_yc_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of startups' pages that can be taken up from India."""
    return _rows(ventures.read(_yc_responses(spark, sf_dir), "yc_jobs", AS_OF))


@_query("SELECT DISTINCT 'yc_jobs:b' || o_custkey AS scope FROM orders WHERE o_custkey IS NOT NULL AND (o_custkey % 11 = 0 OR o_custkey % 13 > 0 AND (o_custkey % 7 = 0 OR o_custkey % 17 > 0))")
def startups_covered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Startups that were checked, those whose page is gone among them."""
    return ventures.covered_startups(_yc_responses(spark, sf_dir))


_PLACES = ("Pune, India", "Indianapolis, IN, USA", None, "Remote; Noida")
_LISTED_SQL = """WITH listed AS (SELECT c_custkey AS k, 'S-' || c_custkey AS slug, 's-' || c_custkey AS low, 'Name ' || c_custkey // 2 AS name, CASE c_custkey % 3 WHEN 0 THEN 'Summer 2024' WHEN 1 THEN 'W21' ELSE '' END AS batch, CASE WHEN c_custkey % 4 > 0 THEN 'https://www.host' || c_custkey % 50 || '.example' ELSE '' END AS website,
  CASE WHEN c_custkey % 5 > 0 THEN CAST(c_custkey % 40 AS INT) END AS team_size, list_extract(['Pune, India', 'Indianapolis, IN, USA', '', 'Remote; Noida'], CAST(c_custkey % 4 + 1 AS INT)) AS locations FROM customer WHERE c_custkey % 6 <> 5),
each AS (SELECT *, unnest([low, 'name' || k // 2, CASE WHEN website <> '' THEN 'host' || k % 50 ELSE 's-' || k END]) AS variant, unnest([1, 2, 3]) AS place FROM listed)"""


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    own = k.cast("string")
    return ventures.startups(spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        k.alias("ordinal"), F.concat(F.lit("S-"), own).alias("slug"), F.concat(F.lit("Name "), F.expr("c_custkey div 2").cast("string")).alias("name"), F.when(k % 3 == 0, "Summer 2024").when(k % 3 == 1, "W21").alias("batch"), F.when(k % 4 > 0, F.concat(F.lit("https://www.host"), (k % 50).cast("string"), F.lit(".example"))).alias("website"),
        F.when(k % 5 > 0, (k % 40).cast("int")).alias("team_size"), _pick(_PLACES, k).alias("all_locations"), F.repeat(F.lit("x"), 300).alias("one_liner"), F.when(k % 6 == 5, "Public").when(k % 2 == 0, "Active").alias("status"), F.lit(None).cast("boolean").alias("is_hiring"),
    ))


@_query(f"""{_LISTED_SQL} SELECT low AS slug, batch = 'Summer 2024' AS is_recent, locations IN ('Pune, India', 'Remote; Noida') AS in_india FROM listed""")
def startup_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open companies of the startup list, with their marks."""
    return _listed(spark, sf_dir).select("slug", "is_recent", "in_india")


@_query(f"""{_LISTED_SQL}, first AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY coalesce(nullif(team_size, 0), 9999), k, place) AS r FROM each)
SELECT variant, name AS yc_name, batch AS yc_batch, team_size, locations AS yc_locations, repeat('x', 200) AS yc_one_liner FROM first WHERE r = 1""")
def startup_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of each name that a startup's board may have."""
    return ventures.startup_index(_listed(spark, sf_dir))


@_query(f"""{_LISTED_SQL}, first AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY coalesce(nullif(team_size, 0), 9999), k, place) AS r FROM each WHERE batch = 'Summer 2024')
SELECT o_orderkey AS k, name AS yc_name, team_size FROM orders LEFT JOIN first ON r = 1 AND variant = CASE o_orderkey % 3 WHEN 0 THEN 's-' || o_custkey WHEN 1 THEN 'host' || o_orderkey % 60 ELSE 'none' END""")
def startup_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings with the recent startup that their board belongs to."""
    k, own = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    slug = F.when(k % 3 == 0, F.concat(F.lit("greenhouse:S-"), own)).when(k % 3 == 1, F.concat(F.lit("zoho_recruit:Host"), (k % 60).cast("string"), F.lit(".zohorecruit.in"))).otherwise("")
    postings = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k.alias("k"), slug.alias("scope"))
    return ventures.attach_startups(postings, ventures.startup_index(_listed(spark, sf_dir), recent_only=True)).select("k", "yc_name", "team_size")


_SKILLS = ("Go", None)


@_query(f"""WITH hits AS (SELECT c_custkey AS k, q FROM customer, range(3) t(q) WHERE (c_custkey + q) % 3 < 2 AND c_custkey % 19 > 0), first AS (SELECT k, min(q) AS q FROM hits GROUP BY k)
SELECT '' || k AS source_job_id, 'https://www.instahyre.com/job-' || k || '/' AS url, {_T} AS title, CASE WHEN k % 2 = 0 THEN 'Emp' ELSE '' END AS company, CASE WHEN k % 2 = 0 THEN 'Skills: Go' END AS description, CASE k % 3 WHEN 0 THEN 'Remote, Pune' WHEN 1 THEN 'Berlin' END AS location_raw,
  CASE WHEN k % 2 = 0 THEN 'Go' ELSE '' END AS tags, CAST(NULL AS VARCHAR) AS salary_raw, CAST(NULL AS TIMESTAMP) AS posted_at, 'india' AS regions, CASE WHEN q = 2 OR {_INTERN} = 'internship' THEN 'internship' ELSE 'unknown' END AS employment_type_hint,
  CAST(CASE WHEN q <> 1 OR {_INTERN} = 'internship' THEN 0 ELSE 1 END AS INT) AS min_yoe_hint FROM first""")
def src_instahyre(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings of three queries that overlap; the first query that has an id says what it is."""
    k, q = F.col("c_custkey"), F.col("q")
    hits = spark.read.parquet(f"{sf_dir}/customer.parquet").withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(2)))).where((k + q) % 3 < 2)
    item = _struct(id=F.when(k % 19 > 0, k), title=F.when(k % 3 > 0, _title(k)), candidate_title=_title(k), employer=F.when(k % 2 == 0, _struct(company_name=F.lit("Emp"))), locations=F.when(k % 3 == 0, "Work From Home, Pune").when(k % 3 == 1, "Berlin"), keywords=F.array(_pick(_SKILLS, k)))
    pages = hits.groupBy("q", (k % 97).alias("page")).agg(F.to_json(F.struct(F.collect_list(item).alias("objects"))).alias("body"))
    none = F.lit(None).cast("string")
    terms = F.element_at(F.array(*map(F.lit, ventures.INSTAHYRE_TERMS)), q + 1)
    responses = pages.select(F.lit("instahyre").alias("connector"), F.lit("instahyre").alias("scope"), F.lit("instahyre").alias("slug"), terms.alias("term"), (q * (1 << 32) + F.col("page")).alias("ordinal"), F.lit(200).alias("http_code"), "body", none.alias("host"), none.alias("name"))
    return _rows(ventures.read(responses, "instahyre", AS_OF))


_NETWORK = json.dumps({"props": {"pageProps": {"network": {"id": 5, "name": "N & M"}}}})


@_query("""SELECT 'v:' || c_custkey AS scope, CASE WHEN c_custkey % 3 = 0 THEN 't' || c_custkey END AS token, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'b' || c_custkey END AS board, CASE WHEN c_custkey % 3 = 1 THEN '5' END AS network, CASE WHEN c_custkey % 3 = 1 THEN 'N & M' END AS label FROM customer""")
def venture_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What venture boards' pages say of themselves."""
    k = F.col("c_custkey")
    own = k.cast("string")
    body = F.when(k % 3 == 0, F.concat(F.lit("<script>var x = {csrfToken: 't"), own, F.lit("', y: 1"), F.when(k % 2 == 0, F.concat(F.lit('}; {"board" : {"id":"b'), own, F.lit('"}'))).otherwise(""), F.lit("}</script>"))).when(k % 3 == 1, F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">\n'), F.lit(_NETWORK), F.lit("</script>"))).otherwise("<html>")
    return ventures.board_keys(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("v:"), own).alias("scope"), body.alias("body")))
