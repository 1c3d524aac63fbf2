"""Queries of the registry and of enrichment over planted tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.operators import enrichment, registry
from rolecall.sources.postings import _pick, _sql_pick

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


_REGISTRY_SQL = """entries AS (SELECT 'p' || c_nationkey AS platform, c_custkey AS k, 's' || c_custkey AS slug FROM customer),
registry AS (
  SELECT platform, k, slug, CAST(CASE WHEN k % 3 = 1 THEN k % 4 + 1 ELSE 2 END AS INT) AS tier, CASE WHEN k % 3 = 1 AND k % 2 = 0 THEN 'n' || k END AS note, 'verified' AS state FROM entries WHERE k % 3 < 2
  UNION ALL SELECT platform, k, slug, 2, NULL, CASE WHEN k % 2 = 0 THEN 'candidate' ELSE 'rejected' END FROM entries WHERE k % 3 = 2
)"""


def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block per nation: two in three customers are verified, by name or as an object; a verified one may also stand among the candidates."""
    k = F.col("c_custkey")
    slug = F.concat(F.lit("s"), k.cast("string"))
    entry = F.when(k % 3 == 0, F.to_json(F.array(slug))).when(k % 3 == 1, F.to_json(F.array(F.struct(slug.alias("slug"), (k % 4 + 1).alias("tier"), F.when(k % 2 == 0, F.concat(F.lit("n"), k.cast("string"))).alias("note"), F.lit("x").alias("site")))))
    blocks = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy(F.concat(F.lit("p"), F.col("c_nationkey").cast("string")).alias("platform")).agg(
        F.array_join(F.transform(F.collect_list(entry), lambda e: F.substring(e, 2, 1000).substr(F.lit(1), F.length(e) - 2)), ",").alias("verified"),
        F.to_json(F.collect_list(F.when((k % 3 == 2) & (k % 2 == 0) | (k % 15 == 0), slug))).alias("candidates"), F.to_json(F.collect_list(F.when((k % 3 == 2) & (k % 2 == 1), slug))).alias("rejected"),
    )
    body = F.concat(F.lit('{"verified": ['), "verified", F.lit('], "candidates": '), "candidates", F.lit(', "rejected": '), "rejected", F.lit("}"))
    return registry.explode_registry(blocks.select("platform", body.alias("body")))


@_query(f"WITH {_REGISTRY_SQL} SELECT platform, slug, tier, note, state FROM registry")
def registry_explode(spark, sf_dir):
    """Every board of the registry with its state."""
    return _registry(spark, sf_dir)


@_query(f"WITH {_REGISTRY_SQL} SELECT slug, tier FROM registry WHERE platform = 'p7' AND state = 'verified' AND tier <= 2")
def companies_for(spark, sf_dir):
    """One platform's boards up to tier 2."""
    return registry.companies_for(_registry(spark, sf_dir), "p7", 2).select("slug", "tier")


_URLS = (
    ("greenhouse", "https://boards.greenhouse.io/Acme_1/jobs/5", "acme_1"), ("greenhouse", "https://boards.greenhouse.io/embed/job_board", None), ("lever", "https://jobs.lever.co/12345/x", None), ("keka", "https://Globex.keka.com/careers", "globex"),
    ("zoho_recruit", "https://init-ech.zohorecruit.in/jobs", "init-ech.zohorecruit.in"), ("recruitee", "https://www.recruitee.com/", None), ("gem", "https://x.example/", None),
)


@_query(f"""WITH named AS (SELECT {_sql_pick(tuple(u[0] for u in _URLS), 'page_id')} AS platform, {_sql_pick(tuple(u[2] for u in _URLS), 'page_id')} AS slug FROM pages)
SELECT platform, slug, count(*) AS n FROM named WHERE slug IS NOT NULL GROUP BY ALL""")
def discover_boards(spark, sf_dir):
    """Board names in a list of URLs."""
    k = F.col("page_id")
    return registry.discover(spark.read.parquet(f"{sf_dir}/pages.parquet").select(_pick(tuple(u[0] for u in _URLS), k).alias("platform"), _pick(tuple(u[1] for u in _URLS), k).alias("url")))


_STATUSES = ("ok", "empty", "no_board", "failed", None)


@_query(f"""WITH {_REGISTRY_SQL}, renamed AS (SELECT *, CASE WHEN platform = 'p3' THEN 'smartrecruiters' ELSE platform END AS name, {_sql_pick(_STATUSES, 'k')} AS status FROM registry)
SELECT name AS platform, slug, tier, CASE WHEN state = 'candidate' AND status = 'ok' THEN k || ' jobs' ELSE note END AS note,
  CASE WHEN state = 'candidate' AND status = 'ok' THEN 'verified' WHEN state = 'candidate' AND (status = 'no_board' OR status = 'empty' AND name = 'smartrecruiters') THEN 'rejected' ELSE state END AS state FROM renamed
UNION ALL SELECT 'p1', 'new' || o_orderkey, 2, NULL, 'candidate' FROM orders WHERE o_orderkey < 40""")
def validate_boards(spark, sf_dir):
    """The registry after its candidates were tried, and with newly found names."""
    named = _registry(spark, sf_dir).withColumn("platform", F.when(F.col("platform") == "p3", registry.NEVER_MISSING).otherwise(F.col("platform")))
    k = F.substring("slug", 2, 99).cast("long")
    after = registry.validate(named, named.select("platform", "slug", _pick(_STATUSES, k).alias("status"), k.alias("jobs")))
    found = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey < 40").select(F.lit("p1").alias("platform"), F.concat(F.lit("new"), F.col("o_orderkey").cast("string")).alias("slug"))
    return registry.add_discovered(after, found.unionByName(after.select("platform", "slug")))


#: An answer's regions and confidence, the posting's words, and what is left of the regions with its confidence and notes.
_ANSWERS = (
    (("india", "unknown"), "high", "Office in Pune", "india", "high", None), (("worldwide",), "high", "Remote", "unknown", "low", "rejected worldwide: no supporting wording"),
    (("worldwide", "us"), "medium", "Work from anywhere", "worldwide", "medium", "rejected us: no supporting wording"), (("europe",), "low", "Berlin, Europe", "unknown", "low", None), (("mars",), "sure", "Mars", "unknown", "low", None), (("india", "india", "canada"), "high", "Delhi or Canada", "india,canada", "high", None),
)


@_query(f"""WITH said AS (SELECT o_orderkey AS k, o_orderkey % 6 AS i FROM orders WHERE o_orderkey % 12 <> 11)
SELECT 'h' || k AS description_hash, {_sql_pick(tuple(a[3] for a in _ANSWERS), 'i')} AS regions, {_sql_pick(tuple(a[4] for a in _ANSWERS), 'i')} AS confidence, {_sql_pick(tuple(a[5] for a in _ANSWERS), 'i')} AS notes,
  CAST(CASE WHEN k % 4 > 0 THEN k % 4 END AS INT) AS min_yoe, {_sql_pick(("swe", "other", "other", "data"), 'k')} AS role_category, {_sql_pick(("internship", "unknown", "unknown"), 'k')} AS employment_type FROM said""")
def parse_answers(spark, sf_dir):
    """Extractions of a model's answers, twelve postings a batch; the last posting's index is out of range."""
    k = F.col("o_orderkey")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.floor(k / 12).alias("batch"), (k % 12).cast("int").alias("idx"))
    jobs = orders.select("batch", "idx", F.concat(F.lit("h"), k.cast("string")).alias("description_hash"), F.lit("Engineer").alias("title"), F.lit(None).cast("string").alias("location_raw"), _pick(tuple(a[2] for a in _ANSWERS), k).alias("description"))
    regions = F.element_at(F.array(*(F.array(*map(F.lit, a[0])) for a in _ANSWERS)), (k % 6 + 1).cast("int"))
    item = F.struct(
        F.when(F.col("idx") == 11, 99).otherwise(F.col("idx")).alias("idx"), F.when(k % 4 > 0, k % 4).alias("min_yoe"), regions.alias("hiring_regions"), _pick(tuple(a[1] for a in _ANSWERS), k).alias("confidence"),
        _pick(("swe", "devops", "pirate", "data"), k).alias("role_category"), _pick(("internship", "gig", None), k).alias("employment_type"),
    )
    answers = orders.groupBy("batch").agg(F.to_json(F.struct(F.collect_list(item).alias("results"))).alias("body"))
    found = enrichment.parse_answers(answers, jobs)
    return found.select("description_hash", F.array_join("hiring_regions", ",").alias("regions"), "confidence", "notes", "min_yoe", "role_category", "employment_type")


@_query(f"""SELECT 'h' || o_orderkey AS description_hash, {_sql_pick(("swe", "other"), 'o_orderkey')} AS role_category, CAST(o_orderkey % 5 AS INT) AS min_yoe FROM orders WHERE o_orderkey % 7 > 0 AND o_orderkey % 3 > 0""")
def read_cache(spark, sf_dir):
    """Cached answers of two postings in three; one row in seven can't be read."""
    k = F.col("o_orderkey")
    key = F.concat(F.lit("h"), k.cast("string")).alias("description_hash")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    payload = F.when(k % 7 == 0, "{broken").otherwise(F.to_json(F.struct((k % 5).alias("min_yoe"), _pick(("swe", "devops"), k).alias("role_category"))))
    return enrichment.read_cache(orders.select(key, payload.alias("payload")), orders.where(k % 3 > 0).select(key)).select("description_hash", "role_category", "min_yoe")


@_query("""SELECT 'h' || o_orderkey AS description_hash, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 4 WHEN o_orderkey % 3 > 0 THEN 1 END AS INT) AS min_yoe, CASE WHEN o_orderkey % 3 > 0 AND o_orderkey % 5 = 0 THEN 'india' WHEN o_orderkey % 5 = 0 THEN 'unknown' ELSE 'us' END AS regions,
  CASE WHEN o_orderkey % 4 = 0 THEN 'other' WHEN o_orderkey % 3 > 0 THEN 'ml' ELSE 'swe' END AS role_category, CASE WHEN o_orderkey % 3 > 0 THEN 'python,sql' ELSE 'sql' END AS tech_stack, o_orderkey % 3 > 0 AS visa_sponsorship FROM orders""")
def apply_extractions(spark, sf_dir):
    """Jobs after two in three got an extraction."""
    k = F.col("o_orderkey")
    none = lambda kind: F.lit(None).cast(kind)
    key = F.concat(F.lit("h"), k.cast("string")).alias("description_hash")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    jobs = orders.select(
        key, F.when(k % 2 == 0, 4).alias("min_yoe"), none("int").alias("max_yoe"), F.lit(False).alias("is_new_grad"), none("int").alias("grad_year"), F.when(k % 5 == 0, F.array(F.lit("unknown"))).otherwise(F.array(F.lit("us"))).alias("hiring_regions"),
        none("boolean").alias("requires_work_auth"), F.when(k % 3 == 0, False).alias("visa_sponsorship"), F.lit("unknown").alias("employment_type"), F.when(k % 4 == 0, "other").otherwise("swe").alias("role_category"), F.array(F.lit("sql")).alias("tech_stack"),
    )
    told = orders.where(k % 3 > 0).select(
        key, F.lit(1).alias("min_yoe"), F.lit(2).alias("max_yoe"), F.lit(True).alias("is_new_grad"), none("int").alias("grad_year"), F.array(F.lit("india")).alias("hiring_regions"), F.lit("high").alias("confidence"), none("boolean").alias("work_auth_required"),
        F.lit(True).alias("visa_sponsorship"), F.lit("internship").alias("employment_type"), F.lit("ml").alias("role_category"), none("string").alias("notes"), F.array(F.lit("python")).alias("tech_stack"),
    )
    return enrichment.apply(jobs, told).select("description_hash", "min_yoe", F.array_join("hiring_regions", ",").alias("regions"), "role_category", F.array_join("tech_stack", ",").alias("tech_stack"), "visa_sponsorship")
