"""A planted corpus of postings, made from ``orders`` by integer arithmetic alone.

Every branch of the rules has a template, so the rules can be held against SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.staging import dealt

AS_OF = "2026-11-01 00:00:00"

SOURCES = ("greenhouse", "himalayas", "lever", "workday", "jobicy", "simplify", "yc_jobs", "remoteok", "hn_hiring", "ashby")
TITLES = (
    "Software Engineer Intern", "Senior Backend Engineer", "Data Scientist I", "Frontend Developer", "Machine Learning Engineer",
    "Full Stack Developer (New Grad)", "Staff Software Engineer", "Marketing Intern", "Intern", "Software Development Engineer II",
    "2027 SWE Intern", "Graduate Engineer Trainee", "React Developer", "Engineering Manager", "Data Analyst Intern", "Python Developer",
    "Freelance Web Developer", "AI Engineer", "Solutions Engineer", "Associate Software Engineer", "Summer Internship 2027",
    "Application Developer", "Principal Engineer 1", "UI Intern",
)
COMPANIES = (
    "Acme Inc.", "Globex Technologies", "Electronic Arts Inc. (EA)", "merkle-science", "Google", "Initech Labs Pvt Ltd", "Jobgether",
    "Confluent Solutions", "Hooli Software", "Stripe", "Umbrella Corp", "Razorpay Software Private Limited", "Vandelay Industries",
    "The Quess Corp", "Soylent Group", "Postman",
)
LOCATIONS = (
    "Bengaluru, India", "Remote", "San Francisco, CA", "Berlin, Germany", "Remote - Worldwide", "Toronto, Canada", "Singapore",
    "Remote (US)", "Mumbai (hybrid)", None, "Anywhere", "London", "Dubai", "New York (onsite)", "Remote, India", "Somewhere",
    "Hyderabad", "Pune, India / Remote",
)
DESCRIPTIONS = (
    "We use Python, React and PostgreSQL. 2-4 years of experience.", "Class of 2026 or 2027. You will work with Node.js and MongoDB.",
    None, "Minimum of 5+ years with Java and Kafka. Must be legally authorized to work here.",
    "Stipend: Rs 25,000 per month. Docker, FastAPI and SQL.", "Visa sponsorship is available. Kubernetes, AWS, Go.",
    "3 years of relevant experience with Scala and Spark.", "PhD required. PyTorch and NLP research.",
    "Unpaid position for students. Git and Linux.", "US citizens only: US citizenship required. C++ and CUDA.",
    "Wir suchen dich (m/w/d). TypeScript und GraphQL.", "Open to the 2027 batch. LangChain, LLM and RAG work. New grad friendly.",
    "Salary 12 - 18 LPA. Express, Redis and Next.js.", "Bachelor's or Master's degree required. Tailwind and REST.",
    "We hire anywhere. Remote first. Power BI and pandas.", "Cannot sponsor visas. Terraform and Ansible.",
    "Graduating in 2025. Socket.IO, Firebase and Postman.", "Compensation $4,500 / month. Rust and Redis.",
    "No experience required. Prompt engineering and AI agents.", "Relocation assistance offered. Snowflake and Airflow.",
)
HINTS = ((), (), ("india",), ("unknown",), ("us",), ("europe", "india"), ())
KINDS = ("unknown", "full_time", "internship", "unknown", "contract", "full_time")
HOSTS = ("boards.greenhouse.io", "www.himalayas.app", "jobs.lever.co", "careers.acme.example", "www.acme.example")


def _pick(values: tuple, index: Column) -> Column:
    literals = [F.array(*map(F.lit, x)).cast("array<string>") if isinstance(x, tuple) else F.lit(x) for x in values]
    return F.element_at(F.array(*literals), (index % len(values) + 1).cast("int"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw posting per order.

    Orders are narrow and the rules that follow are heavy, so their key pairs are
    dealt to all cores, and to more tasks the more they are, before any text is made
    of them.
    """
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    as_of = F.lit(AS_OF).cast("timestamp_ntz")
    url = F.concat(
        F.lit("https://"), _pick(HOSTS, k), F.lit("/jobs/"), F.floor(k / 3).cast("string"),
        F.when(k % 3 == 1, "/?utm_source=feed&gh_jid=7").when(k % 3 == 2, "?gh_jid=7&ref=x#apply").otherwise("?gh_jid=7"),
    )
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    return dealt(orders, "o_orderkey", "o_custkey").select(
        _pick(SOURCES, k).alias("source"), k.cast("string").alias("source_job_id"),
        F.when(k % 23 == 0, "").otherwise(url).alias("url"),
        _pick(TITLES, k * 7 + c * 3).alias("title"), _pick(COMPANIES, c).alias("company"),
        _pick(DESCRIPTIONS, k * 11 + c * 2).alias("description"), _pick(LOCATIONS, k * 5 + c).alias("location_raw"),
        F.when(k % 4 == 0, F.array(F.lit("python"), F.lit("remote"))).otherwise(F.array().cast("array<string>")).alias("tags"),
        F.when(k % 19 != 0, as_of - F.make_dt_interval((k % 200).cast("int"), (c % 24).cast("int"))).alias("posted_at"),
        (as_of - F.make_dt_interval((c % 40).cast("int"))).alias("first_seen_at"),
        _pick(HINTS, k + c).alias("hiring_regions_hint"), _pick(KINDS, k + c * 5).alias("employment_type_hint"),
        F.when(k % 29 == 0, F.lit("S24")).alias("yc_batch"), F.when(k % 29 == 0, (c % 90).cast("int")).alias("team_size"),
        F.when(k % 31 == 0, F.lit("Peak Fund")).alias("vc"),
        F.when(k % 37 == 0, as_of - F.make_dt_interval(F.lit(1))).when(k % 41 == 0, as_of + F.make_dt_interval(F.lit(9))).alias("deadline"),
        k.alias("ordinal"),
    )


def _sql(x) -> str:
    if isinstance(x, tuple):
        return "CAST([" + ", ".join(map(_sql, x)) + "] AS VARCHAR[])"
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"


def _sql_pick(values: tuple, index: str) -> str:
    return f"list_extract([{', '.join(map(_sql, values))}], CAST(({index}) % {len(values)} + 1 AS INT))"


POSTINGS_SQL = f"""postings AS (
  SELECT {_sql_pick(SOURCES, 'o_orderkey')} AS source, CAST(o_orderkey AS VARCHAR) AS source_job_id,
    CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE 'https://' || {_sql_pick(HOSTS, 'o_orderkey')} || '/jobs/' || CAST(o_orderkey // 3 AS VARCHAR) ||
      CASE o_orderkey % 3 WHEN 1 THEN '/?utm_source=feed&gh_jid=7' WHEN 2 THEN '?gh_jid=7&ref=x#apply' ELSE '?gh_jid=7' END END AS url,
    {_sql_pick(TITLES, 'o_orderkey * 7 + o_custkey * 3')} AS title, {_sql_pick(COMPANIES, 'o_custkey')} AS company,
    {_sql_pick(DESCRIPTIONS, 'o_orderkey * 11 + o_custkey * 2')} AS description, {_sql_pick(LOCATIONS, 'o_orderkey * 5 + o_custkey')} AS location_raw,
    CASE WHEN o_orderkey % 4 = 0 THEN ['python', 'remote'] ELSE CAST([] AS VARCHAR[]) END AS tags,
    CASE WHEN o_orderkey % 19 <> 0 THEN TIMESTAMP '{AS_OF}' - to_days(CAST(o_orderkey % 200 AS INT)) - to_hours(CAST(o_custkey % 24 AS INT)) END AS posted_at,
    TIMESTAMP '{AS_OF}' - to_days(CAST(o_custkey % 40 AS INT)) AS first_seen_at,
    {_sql_pick(HINTS, 'o_orderkey + o_custkey')} AS hiring_regions_hint, {_sql_pick(KINDS, 'o_orderkey + o_custkey * 5')} AS employment_type_hint,
    CASE WHEN o_orderkey % 29 = 0 THEN 'S24' END AS yc_batch, CASE WHEN o_orderkey % 29 = 0 THEN CAST(o_custkey % 90 AS INT) END AS team_size,
    CASE WHEN o_orderkey % 31 = 0 THEN 'Peak Fund' END AS vc,
    CASE WHEN o_orderkey % 37 = 0 THEN TIMESTAMP '{AS_OF}' - to_days(1) WHEN o_orderkey % 41 = 0 THEN TIMESTAMP '{AS_OF}' + to_days(9) END AS deadline,
    o_orderkey AS ordinal
  FROM orders
)"""
