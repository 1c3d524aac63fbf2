"""Queries of link checks, liveness and hiring threads, and their SQL over the same planted answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.operators import links
from rolecall.plans.sql import lit, strings
from rolecall.sources import threads
from rolecall.sources.postings import AS_OF, _pick, _sql_pick

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: A page, and what it means: nothing, or a marker.
_BODIES = (
    ("<title>Engineer</title> Apply now", None), ("<title> 404 </title> gone", "title: 404"), ("<TITLE>Page not found | Acme</TITLE>", "title: Page not found | Acme"),
    ("<p>This position has been filled.</p>", "body: This position has been filled"), ("<p>We found a job; not found is fine</p>", None), ("applications are closed", "body: applications are closed"), ("", None), (None, None),
)
_CODES = (200, 200, 404, 200, 410, 403, 200, 503, 200, None, 200, 302)
_TYPES = ("text/html; charset=utf-8", "application/json", None, "text/plain")


def _query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


_TOKEN = f"lower(list_extract(list_filter(string_split(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#;]*)', 1), '/'), lambda x: length(x) >= 4 AND NOT list_contains({strings(links.GENERIC_PARTS)}, lower(x))), -1))"


@_query(f"""WITH asked AS (
  SELECT page_id, url, {_TOKEN} AS token, {_sql_pick(_CODES, 'page_id')} AS code, coalesce({_sql_pick(_TYPES, 'page_id')}, '') AS kind, {_sql_pick(tuple(b for _, b in _BODIES), 'page_id')} AS marker,
    CASE page_id % 5 WHEN 0 THEN url || '/' WHEN 1 THEN 'https://x.example/careers/search' WHEN 2 THEN upper(url) WHEN 3 THEN NULL ELSE url END AS final FROM pages
), judged AS (
  SELECT *, CASE WHEN code IS NULL THEN 'no answer' WHEN code IN (404, 410) THEN 'http status'
    WHEN page_id % 5 = 1 AND token IS NOT NULL AND NOT contains('https://x.example/careers/search', token) AND rtrim(url, '/') <> 'https://x.example/careers/search' THEN 'redirected to https://x.example/careers/search'
    WHEN code = 403 THEN 'blocked' WHEN code = 503 THEN 'server error' WHEN kind LIKE 'text%' THEN marker END AS reason FROM asked
)
SELECT page_id, CASE WHEN reason IN ('no answer', 'blocked', 'server error') THEN 'unknown' WHEN reason IS NOT NULL THEN 'dead' ELSE 'alive' END AS status, reason, token FROM judged""")
def link_status(spark, sf_dir):
    """The status of every page's URL, by planted answers."""
    k, url = F.col("page_id"), F.col("url")
    final = F.when(k % 5 == 0, F.concat(url, F.lit("/"))).when(k % 5 == 1, "https://x.example/careers/search").when(k % 5 == 2, F.upper(url)).when(k % 5 == 3, None).otherwise(url)
    answers = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", final.alias("final_url"), _pick(_CODES, k).alias("http_code"), _pick(_TYPES, k).alias("content_type"), _pick(tuple(b for b, _ in _BODIES), k).alias("body"))
    return links.link_status(answers).select("page_id", "status", "reason", links.identity_token(url).alias("token"))


_ANSWERS = ('{"jobPostingInfo": {"canApply": true, "endDate": "2026-12-01"}}', '{"jobPostingInfo": {"canApply": false, "endDate": "2026-10-01"}}', '{"jobPostingInfo": {"posted": false}}', "{}", "<html>", '{"jobPostingInfo": {"endDate": "2026-10-01"}}', '{"jobPostingInfo": {"endDate": "soon"}}')
_ANSWER_CODES = (200, 200, 404, 500, 200, None, 200, 200)
_TOLD_SQL = f"""told AS (
  SELECT o_orderkey AS k, {_sql_pick(_ANSWER_CODES, 'o_orderkey')} AS code, o_orderkey % 7 AS b FROM orders
), live AS (
  SELECT k, CASE WHEN code = 404 THEN false WHEN code IS NULL OR code <> 200 OR b = 4 THEN NULL WHEN b IN (1, 2) THEN false ELSE true END AS open,
    CASE WHEN code = 200 THEN CASE b WHEN 0 THEN TIMESTAMP '2026-12-01' WHEN 1 THEN TIMESTAMP '2026-10-01' WHEN 5 THEN TIMESTAMP '2026-10-01' END END AS deadline,
    CASE WHEN code = 404 THEN 'requisition gone' WHEN code IS NULL THEN 'no answer' WHEN code <> 200 THEN 'HTTP ' || code WHEN b = 4 THEN 'unparseable' WHEN b IN (1, 2) THEN 'not accepting applications' END AS reason FROM told
)"""


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return links.liveness(spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.lit("workday").alias("source"), k.cast("string").alias("source_job_id"), _pick(_ANSWER_CODES, k).alias("http_code"), _pick(_ANSWERS, k).alias("body")))


@_query(f"WITH {_TOLD_SQL} SELECT '' || k AS source_job_id, open, deadline, reason FROM live")
def liveness_workday(spark, sf_dir):
    """What the endpoint of each posting says."""
    return _told(spark, sf_dir).drop("source")


@_query(f"""WITH {_TOLD_SQL} SELECT '' || k AS source_job_id, CASE WHEN k % 3 > 0 AND coalesce(open, true) THEN coalesce(deadline, TIMESTAMP '2027-01-01') ELSE TIMESTAMP '2027-01-01' END AS deadline,
  CASE WHEN k % 3 = 0 THEN NULL WHEN NOT open THEN 'board says applications are closed' WHEN deadline < TIMESTAMP '{AS_OF}' THEN 'application deadline passed' END AS closed_reason FROM live""")
def verify_open(spark, sf_dir):
    """Postings after the board was asked about two in three of them."""
    told = _told(spark, sf_dir)
    jobs = told.select("source", "source_job_id", F.lit("2027-01-01").cast("timestamp_ntz").alias("deadline"))
    return links.verify_open(jobs, told.where(F.col("source_job_id").cast("long") % 3 > 0), AS_OF).drop("source")


#: A comment, and its company, role, location and regions; no company if it is no posting.
_COMMENTS = (
    ("Acme | Backend Engineer | Berlin | Remote (US) | https://acme.example/jobs<p>We build things for people.", "Acme", "Backend Engineer", "Berlin | Remote (US)", "us"),
    ("Globex – Remote Worldwide – Founding Developer &amp; more things to say here", "Globex", "Founding Developer & more things to say here", "Remote Worldwide", "worldwide"),
    ("Is anyone hiring interns in India? I would love to hear about it all", None, None, None, None),
    ("Initech • ONSITE • SWE Intern • Bangalore, India • EMEA hours are fine too", "Initech", "SWE Intern", "ONSITE | Bangalore, India", "emea,india"),
    ("Hooli | Engineer", None, None, None, None),
    ("Umbrella | Remote Data Scientist | Remote | Lead Analyst, Canada based or so", "Umbrella", "Remote Data Scientist", "Remote", "canada"),
)


@_query(f"""WITH said AS (SELECT o_orderkey AS k, o_orderkey % 6 AS i FROM orders WHERE o_custkey % 4 > 0)
SELECT '' || k AS source_job_id, {_sql_pick(tuple(c[1] for c in _COMMENTS), 'i')} AS company, {_sql_pick(tuple(c[2] for c in _COMMENTS), 'i')} AS title, {_sql_pick(tuple(c[3] for c in _COMMENTS), 'i')} AS location_raw,
  {_sql_pick(tuple(c[4] for c in _COMMENTS), 'i')} AS regions, CASE WHEN i = 0 THEN 'https://acme.example/jobs' ELSE 'https://news.ycombinator.com/item?id=' || k END AS url, CASE WHEN i = 3 THEN 'internship' ELSE 'unknown' END AS employment_type_hint
FROM said WHERE i NOT IN (2, 4)""")
def src_hn_hiring(spark, sf_dir):
    """Postings of the newest of three threads."""
    stories = spark.sql("""select * from values ('t1', 'Ask HN: Who is hiring? (September)', timestamp_ntz'2026-09-01 15:00:00'), ('t2', 'Ask HN: Who is hiring? (October)', timestamp_ntz'2026-10-01 15:00:00'),
      ('t3', 'Ask HN: Who is hiring right now?', timestamp_ntz'2026-10-20 15:00:00') s(object_id, title, created_at)""")
    k = F.col("o_orderkey")
    comments = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        k.cast("string").alias("object_id"), F.when(F.col("o_custkey") % 4 > 0, "t2").otherwise("t1").alias("parent_id"), _pick(tuple(c[0] for c in _COMMENTS), k).alias("comment_text"), F.lit(AS_OF).cast("timestamp_ntz").alias("created_at"),
    )
    found = threads.read_comments(comments, threads.newest_thread(stories, AS_OF))
    return found.select("source_job_id", "company", "title", "location_raw", F.array_join("hiring_regions_hint", ",").alias("regions"), "url", "employment_type_hint")
