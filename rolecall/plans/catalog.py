"""All queries of the posting engine by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rolecall import vocabulary as v
from rolecall.functions import text as t
from rolecall.functions import urls, windows
from rolecall.operators import client, dedupe, export, gate, health, listing, normalize, score, sync, vectors
from rolecall.operators.client import ClientFilter
from rolecall.operators.listing import JobFilter
from rolecall.plans import boards, discovery, landing, links, pages, searches, upkeep, ventures
from rolecall.plans.sql import (
    JOBS_SQL, NORMALIZED_SQL, NOW, PARTS_SQL, REASONS_SQL, brand_sql, canonical_sql, company_sql, host_sql, lit, rx, strip_sql,
)
from rolecall.sources.postings import AS_OF, DESCRIPTIONS, POSTINGS_SQL, postings
from rolecall.staging import stage_table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None):
    def register(f: Query) -> Query:
        name = f.__name__
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return _QUERIES | landing.QUERIES | boards.QUERIES | pages.QUERIES | searches.QUERIES | discovery.QUERIES | ventures.QUERIES | links.QUERIES | upkeep.QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL | landing.SQL | boards.SQL | pages.SQL | searches.SQL | discovery.SQL | ventures.SQL | links.SQL | upkeep.SQL


def _normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.normalize(postings(spark, sf_dir), AS_OF)


_STORED: dict[tuple, DataFrame] = {}


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored jobs, ingested once a session and folder; listings read the stored table."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        _STORED[key] = stage_table(ingest(spark, sf_dir))
    return _STORED[key]


def ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalized, gated and scored jobs with planted link states.

    The rules' fields are staged first: gate and score use each of them many times,
    and a plan that carried the patterns along would match them at every use.
    """
    jobs = stage_table(_normalized(spark, sf_dir))
    k = F.col("ordinal")
    return score.scored(jobs.withColumn("drop_reason", gate.drop_reason(AS_OF)), AS_OF).withColumns({
        "is_active": k % 13 != 0, "link_status": F.when(k % 17 == 0, "dead").when(k % 17 == 1, "alive"),
        "link_checked_at": F.when(k % 17 <= 1, F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), (k % 50).cast("int"))),
    })


_LIVE = "coalesce(link_status <> 'dead', true)"
_CARD = ("source", "source_job_id", "title", "match_score")


@_query(f"WITH {JOBS_SQL} SELECT source, source_job_id, role_category, employment_type, min_yoe, match_score, drop_reason FROM jobs")
def stored_jobs(spark, sf_dir):
    """The whole ingest: rules, gate and score over every posting."""
    return ingest(spark, sf_dir).select("source", "source_job_id", "role_category", "employment_type", "min_yoe", "match_score", "drop_reason")


@_query(f"WITH {JOBS_SQL} SELECT source, source_job_id, title, company, match_score, array_to_string({REASONS_SQL}, '; ') AS reasons FROM jobs "
        "WHERE drop_reason IS NULL AND employment_type = 'internship' ORDER BY match_score DESC, source, source_job_id LIMIT 50")
def ranked_internships(spark, sf_dir):
    """The top 50 internships that pass the gate, with reasons: the flagship."""
    jobs = _jobs(spark, sf_dir).where("drop_reason is null and employment_type = 'internship'")
    return jobs.orderBy(F.desc("match_score"), "source", "source_job_id").limit(50).select(*_CARD, "company", F.array_join("match_reasons", "; ").alias("reasons"))


def _page(f: JobFilter, order_by: str = "match_score", limit: int = 50, offset: int = 0):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return listing.page(_jobs(spark, sf_dir), f, AS_OF, order_by, limit, offset).select(*_CARD)

    return run


def _listing(name: str, f: JobFilter, where: str, order_by: str = "match_score", order: str = "match_score DESC", limit: int = 50, offset: int = 0) -> None:
    _QUERIES[name] = _page(f, order_by, limit, offset)
    _SQL[name] = f"WITH {JOBS_SQL} SELECT {', '.join(_CARD)} FROM jobs WHERE {_LIVE} AND {where} ORDER BY {order} NULLS LAST, source, source_job_id LIMIT {limit} OFFSET {offset}"


_listing("search_active_newest", JobFilter(), "is_active", "posted_at", "coalesce(posted_at, first_seen_at) DESC")
_listing("search_yoe_or_unknown", JobFilter(max_yoe=2), "is_active AND (min_yoe <= 2 OR min_yoe IS NULL)")
_listing("search_yoe_known", JobFilter(max_yoe=3, include_unknown_yoe=False), "is_active AND min_yoe <= 3")
_listing("search_regions_any", JobFilter(regions=("india", "apac")), "is_active AND list_has_any(hiring_regions, ['india', 'apac'])")
_listing("search_tech_all", JobFilter(tech=("python", "react")), "is_active AND list_has_all(tech_stack, ['python', 'react'])")
_listing("search_text_like", JobFilter(query="soft_are"), "is_active AND (lower(title) LIKE '%soft_are%' OR lower(company) LIKE '%soft_are%')")
_listing("search_fresh_coalesced", JobFilter(max_age_days=30), f"is_active AND coalesce(posted_at, first_seen_at) >= {NOW} - INTERVAL 30 DAY")
_listing("search_page_two", JobFilter(), "is_active", limit=40, offset=40)
_listing("search_reachable", JobFilter(reachable_only=True), "is_active AND (list_has_any(hiring_regions, ['worldwide', 'india']) OR coalesce(visa_sponsorship, false))")
_listing("search_roles_and_sources", JobFilter(roles=("swe", "backend"), employment=("internship", "full_time"), sources=("lever", "ashby")),
         "is_active AND role_category IN ('swe', 'backend') AND employment_type IN ('internship', 'full_time') AND source IN ('lever', 'ashby')")
_listing("search_remote_new_grad", JobFilter(remote_only=True, new_grad_only=True), "is_active AND is_remote AND is_new_grad")
_listing("search_first_seen", JobFilter(active_only=False), "true", "first_seen_at", "first_seen_at DESC")


@_query(f"WITH {JOBS_SQL} SELECT count(*) AS total, count(*) > 80 AS has_more FROM jobs WHERE {_LIVE} AND is_active AND is_remote")
def search_total(spark, sf_dir):
    """The total beside a page."""
    return listing.total(_jobs(spark, sf_dir), JobFilter(remote_only=True), AS_OF, 40, 40)


@_query(f"""WITH {JOBS_SQL} SELECT count(*) AS total, count(*) FILTER (is_active) AS active, count(*) FILTER (is_active AND is_remote) AS remote,
  count(*) FILTER (is_active AND employment_type = 'internship') AS internships, count(*) FILTER (is_active AND list_has_any(hiring_regions, ['worldwide', 'india'])) AS reachable,
  count(*) FILTER (is_active AND list_contains(hiring_regions, 'unknown')) AS pending FROM jobs""")
def stats_counts(spark, sf_dir):
    return listing.stats(_jobs(spark, sf_dir))


@_query(f"WITH {JOBS_SQL} SELECT role_category, count(*) AS n FROM jobs WHERE is_active GROUP BY 1")
def stats_by_role(spark, sf_dir):
    return listing.counts_by(_jobs(spark, sf_dir), "role_category")


@_query(f"WITH {JOBS_SQL} SELECT source, count(*) AS n FROM jobs WHERE is_active GROUP BY 1")
def stats_by_source(spark, sf_dir):
    return listing.counts_by(_jobs(spark, sf_dir), "source")


@_query(f"WITH {JOBS_SQL} SELECT " + ", ".join(f"array_to_string(list_sort(list(DISTINCT {a})), ',') AS {b}" for a, b in (("source", "sources"), ("role_category", "roles"), ("employment_type", "employment"))) + " FROM jobs")
def facets(spark, sf_dir):
    return listing.facets(_jobs(spark, sf_dir))


@_query(f"WITH {JOBS_SQL} SELECT source, source_job_id FROM jobs WHERE is_active AND (link_checked_at IS NULL OR link_checked_at < {NOW} - INTERVAL 24 HOUR) ORDER BY match_score DESC, source, source_job_id LIMIT 200")
def link_check_queue(spark, sf_dir):
    """The 200 best active jobs whose link check is due."""
    return listing.needs_link_check(_jobs(spark, sf_dir), AS_OF, 24, 200).select("source", "source_job_id")


@_query(f"WITH {NORMALIZED_SQL} SELECT source_job_id, min_yoe, max_yoe, yoe_source FROM (SELECT source_job_id, read_min AS min_yoe, read_max AS max_yoe, yoe_source FROM read)")
def yoe_extraction(spark, sf_dir):
    yoe = t.extract_yoe(F.col("title"), F.col("description"))
    return postings(spark, sf_dir).select("source_job_id", yoe.alias("y")).select("source_job_id", F.col("y.min_yoe").alias("min_yoe"), F.col("y.max_yoe").alias("max_yoe"), F.col("y.source").alias("yoe_source"))


@_query(f"WITH {NORMALIZED_SQL} SELECT source_job_id, array_to_string(grad_years, ',') AS grad_years FROM read WHERE len(grad_years) > 0")
def grad_years(spark, sf_dir):
    years = t.extract_grad_years(t.text_of(F.col("title"), F.col("description")), int(AS_OF[:4]))
    found = postings(spark, sf_dir).select("source_job_id", years.alias("y")).where("size(y) > 0")
    return found.select("source_job_id", F.array_join(F.transform("y", lambda x: x.cast("string")), ",").alias("grad_years"))


@_query(f"WITH {NORMALIZED_SQL} SELECT source_job_id, role_category FROM read")
def role_classification(spark, sf_dir):
    return postings(spark, sf_dir).select("source_job_id", t.classify_role(F.col("title"), F.col("description"), F.col("tags")).alias("role_category"))


@_query(f"WITH {NORMALIZED_SQL} SELECT source_job_id, array_to_string(hiring_regions, ',') AS regions, region_source, region_confidence FROM read")
def region_resolution(spark, sf_dir):
    place = t.resolve_regions(F.col("description"), F.col("location_raw"), F.col("hiring_regions_hint"))
    return postings(spark, sf_dir).select("source_job_id", place.alias("p")).select("source_job_id", F.array_join("p.regions", ",").alias("regions"), F.col("p.source").alias("region_source"), F.col("p.confidence").alias("region_confidence"))


@_query(f"WITH {NORMALIZED_SQL} SELECT source_job_id, is_remote, requires_work_auth, visa_sponsorship, {rx('description', v.RELOCATION)} AS relocation, us_eligibility, unpaid, employment_type FROM read")
def eligibility_flags(spark, sf_dir):
    body, desc = t.text_of(F.col("title"), F.col("description")), F.col("description")
    kind = F.when(F.col("title").rlike(v.INTERN), "internship").when(F.col("title").rlike(v.STRONG_SENIORITY), "full_time").otherwise(F.col("employment_type_hint"))
    return postings(spark, sf_dir).select(
        "source_job_id", t.detect_remote(F.col("title"), F.col("location_raw"), F.col("tags")).alias("is_remote"), t.detect_work_auth(desc).alias("requires_work_auth"),
        t.detect_sponsorship(desc).alias("visa_sponsorship"), t.detect_relocation(desc).alias("relocation"), t.requires_us_eligibility(body).alias("us_eligibility"),
        t.is_unpaid(body).alias("unpaid"), kind.alias("employment_type"),
    )


@_query(f"WITH {NORMALIZED_SQL} SELECT source_job_id, array_to_string(tech_stack, ',') AS tech_stack FROM read")
def tech_stack_array(spark, sf_dir):
    return postings(spark, sf_dir).select("source_job_id", F.array_join(t.extract_tech_stack(t.text_of(F.col("title"), F.col("description")), F.col("tags")), ",").alias("tech_stack"))


@_query(f"WITH {POSTINGS_SQL} SELECT source_job_id, {company_sql('company')} AS company_normalized, {brand_sql('company')} AS brand, "
        "trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9 +#.]', ' ', 'g'), '\\s+', ' ', 'g')) AS title_normalized, "
        "sha256(title || chr(0) || company || chr(0) || coalesce(description, '')) AS description_hash FROM postings")
def dedupe_keys(spark, sf_dir):
    c = F.col
    return postings(spark, sf_dir).select("source_job_id", t.normalize_company(c("company")).alias("company_normalized"), t.brand_name(c("company")).alias("brand"), t.normalize_title(c("title")).alias("title_normalized"), t.description_hash(c("title"), c("company"), c("description")).alias("description_hash"))


#: Query parts planted on page URLs: repeated, escaped, empty and tracking parameters.
_PLANTED = "CASE page_id % 4 WHEN 0 THEN '?b=2&a=%26x+y&b=%C3%A9&utm%5Fid=1' WHEN 1 THEN '?q=1=&y=&mode=z&Ref=7#top' WHEN 2 THEN '/?z&=5&src=a&gh_jid=%2B' ELSE '' END"


@_query(f"WITH planted AS (SELECT page_id, url || {_PLANTED} AS url FROM pages) SELECT page_id, {canonical_sql('url')} AS canonical, {strip_sql('url')} AS stripped, {host_sql('url')} AS host FROM planted")
def canonical_urls(spark, sf_dir):
    """Canonical forms of all page URLs, with query parts planted on them."""
    url = F.concat("url", F.expr(_PLANTED))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", urls.canonical_url(url).alias("canonical"), urls.strip_tracking(url).alias("stripped"), urls.host_of(url).alias("host"))


@_query(f"WITH {POSTINGS_SQL} SELECT source_job_id, {canonical_sql('url')} AS canonical_url, CASE " + " ".join(f"WHEN {rx('url', p)} THEN {lit(n)}" for n, p in v.ATS_SIGNATURES)
        + f" END AS ats, {host_sql('url')} IN ({', '.join(map(lit, v.AGGREGATOR_HOSTS))}) AS aggregator FROM postings")
def posting_urls(spark, sf_dir):
    url = F.col("url")
    return postings(spark, sf_dir).select("source_job_id", urls.canonical_url(url).alias("canonical_url"), urls.detect_ats(url).alias("ats"), urls.is_aggregator(url).alias("aggregator"))


@_query(f"WITH {JOBS_SQL} SELECT source_job_id, drop_reason FROM gated")
def gate_reasons(spark, sf_dir):
    return _jobs(spark, sf_dir).select("source_job_id", "drop_reason")


@_query(f"WITH {JOBS_SQL} SELECT drop_reason, count(*) AS n FROM gated WHERE drop_reason IS NOT NULL GROUP BY 1 ORDER BY n DESC, drop_reason LIMIT 10")
def drop_reasons(spark, sf_dir):
    """The ten most frequent reasons."""
    found = gate_reasons(spark, sf_dir).where("drop_reason is not null").groupBy("drop_reason").agg(F.count("*").alias("n"))
    return found.orderBy(F.desc("n"), "drop_reason").limit(10)


@_query(f"WITH {JOBS_SQL} SELECT source_job_id, match_score, " + ", ".join(f"round({sql}, 2) AS {name}" for name, sql in PARTS_SQL.items()) + " FROM jobs")
def score_parts(spark, sf_dir):
    return _jobs(spark, sf_dir).select("source_job_id", "match_score", *(F.col("match_parts")[name].alias(name) for name in PARTS_SQL))


@_query(f"WITH {JOBS_SQL} SELECT source_job_id, array_to_string({REASONS_SQL}, '; ') AS reasons FROM jobs")
def score_reasons(spark, sf_dir):
    return _jobs(spark, sf_dir).select("source_job_id", F.array_join("match_reasons", "; ").alias("reasons"))


@_query(None)
def dedupe_survivors(spark, sf_dir):
    """What greedy dedupe keeps; order-dependent, so tests hold it against a sequential version."""
    marked = dedupe.dedupe(_jobs(spark, sf_dir))
    return dedupe.survivors(marked).select("source", "source_job_id", "canonical_url", "company_normalized", "title_normalized", F.size("tech_stack").alias("n_skills"))


def _run_of(jobs: DataFrame, run: int) -> DataFrame:
    """A listing as of run ``run``: some keys gone, some titles changed."""
    k = F.col("ordinal")
    title = F.when(k % 17 == run, F.concat("title", F.lit(" (updated)"))).otherwise(F.col("title"))
    return jobs.where(k % 10 != run).select("source", "source_job_id", F.concat(F.lit("board-"), (k % 6).cast("string")).alias("scope"), F.sha1(title).alias("fingerprint"), F.lit(0).alias("missed_runs"), "ordinal")


@_query(f"""WITH {POSTINGS_SQL}, both AS (
  SELECT source, source_job_id, 'board-' || CAST(ordinal % 6 AS VARCHAR) AS scope, ordinal,
    ordinal % 10 <> 1 AS had, ordinal % 10 <> 2 AS has, (ordinal % 17 = 1) <> (ordinal % 17 = 2) AS changed FROM postings
)
SELECT source, source_job_id,
  CASE WHEN NOT had THEN 'insert' WHEN has THEN CASE WHEN changed THEN 'update' ELSE 'skip' END WHEN scope = 'board-5' THEN 'retired' WHEN scope IN ('board-3', 'board-4') THEN 'uncovered' ELSE 'miss' END AS action,
  CAST(CASE WHEN had AND NOT has AND scope IN ('board-0', 'board-1', 'board-2') THEN 1 ELSE 0 END AS INT) AS missed_runs
FROM both WHERE had OR has""".replace("both AS", "states AS").replace("FROM both", "FROM states"))
def sync_actions(spark, sf_dir):
    """Second run against the first: three boards covered, one retired, two failed."""
    raw = postings(spark, sf_dir)
    return sync.sync_actions(_run_of(raw, 1), _run_of(raw, 2), ["board-0", "board-1", "board-2"], [f"board-{i}" for i in range(5)], full=False)


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run history out of ``events``: a connector per type, a run per day."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("ts is not null")
    return events.groupBy(F.col("event_type").alias("connector"), F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("started_at")).agg(
        F.when(F.count_if(F.col("user_id") % 97 == 0) > 2, F.lit(0)).otherwise(F.count("*")).cast("long").alias("found"))


_RUNS_SQL = "runs AS (SELECT event_type AS connector, CAST(date_trunc('day', ts) AS TIMESTAMP) AS started_at, CASE WHEN count(*) FILTER (user_id % 97 = 0) > 2 THEN 0 ELSE count(*) END AS found FROM events WHERE ts IS NOT NULL GROUP BY 1, 2)"


@_query(f"WITH {_RUNS_SQL} SELECT connector, started_at, found, k FROM (SELECT *, CAST(row_number() OVER (PARTITION BY connector ORDER BY started_at DESC) AS INT) AS k FROM runs) WHERE k <= 9")
def run_history_top9(spark, sf_dir):
    return health.run_history(_runs(spark, sf_dir)).select("connector", "started_at", "found", "k")


@_query(f"WITH {_RUNS_SQL} SELECT connector, max(started_at) AS started_at, arg_max(found, started_at) AS found FROM runs GROUP BY 1")
def connector_health_latest(spark, sf_dir):
    return health.latest_runs(_runs(spark, sf_dir)).select("connector", "started_at", "found")


@_query(f"""WITH {_RUNS_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY connector ORDER BY started_at DESC) AS k FROM runs), seen AS (
  SELECT connector, max(CASE WHEN k = 1 THEN found END) AS last_run, list_sort(list(found) FILTER (k > 1 AND found > 0)) AS b FROM ranked WHERE k <= 9 GROUP BY 1
), told AS (SELECT connector, last_run, CASE WHEN len(b) >= 3 THEN b[len(b) // 2 + 1] END AS median_run FROM seen)
SELECT connector, last_run, median_run, CASE WHEN last_run = 0 THEN 'broken' WHEN coalesce(last_run < greatest(1, 0.4e0 * median_run), false) THEN 'degraded' ELSE 'ok' END AS severity FROM told""")
def trend_median_collapse(spark, sf_dir):
    trend = health.trends(_runs(spark, sf_dir))
    down = health.collapsed(F.col("last_run"), F.col("median_run"))
    return trend.withColumn("severity", health.severity(F.lit(None), F.col("last_run"), down, F.lit(0), F.lit(0)))


@_query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def drop_duplicate_documents(spark, sf_dir):
    """Texts that occur more than once; grouped by a digest, so that texts aren't shuffled."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    return docs.groupBy(F.sha2("text", 256).alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).where("copies > 1").drop("digest")


@_query(None)
def export_snapshot(spark, sf_dir):
    """The snapshot's JSON lines; a test holds every key against the stored columns."""
    return export.snapshot(_jobs(spark, sf_dir).where("drop_reason is null"), AS_OF)


@_query(None)
def export_header(spark, sf_dir):
    """The snapshot's header."""
    return export.header(export_snapshot(spark, sf_dir), AS_OF)


_PAY = {4: (25000, None, "INR", "₹25,000/month"), 12: (1200000, 1800000, "INR", "₹12-18 LPA"), 17: (4500, None, "USD", "$4,500/month")}
_PAY_AT = f"(o_orderkey * 11 + o_custkey * 2) % {len(DESCRIPTIONS)}"


def _pay_sql(part: int, kind: str) -> str:
    cases = " ".join(f"WHEN {k} THEN {lit(row[part]) if isinstance(row[part], str) else row[part] or 'NULL'}" for k, row in _PAY.items())
    return f"CAST(CASE {_PAY_AT} {cases} END AS {kind})"


@_query(f"SELECT '' || o_orderkey AS source_job_id, {_pay_sql(0, 'BIGINT')} AS pay_min, {_pay_sql(1, 'BIGINT')} AS pay_max, {_pay_sql(2, 'VARCHAR')} AS currency, {_pay_sql(3, 'VARCHAR')} AS label FROM orders")
def extract_pay(spark, sf_dir):
    """Pay that the description states; its SQL knows by hand which descriptions do."""
    pay = windows.extract_pay("description")
    return postings(spark, sf_dir).select("source_job_id", pay.alias("pay")).select("source_job_id", "pay.pay_min", "pay.pay_max", "pay.currency", "pay.label")


@_query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Merkle Science' WHEN 1 THEN 'eBay' WHEN 2 THEN '3M Corp' ELSE c_name END AS company FROM customer WHERE c_name <> lower(c_name)")
def display_company(spark, sf_dir):
    """Names as cards show them."""
    k = F.col("c_custkey")
    name = F.when(k % 4 == 0, "merkle-science").when(k % 4 == 1, "eBay").when(k % 4 == 2, "3m_corp").otherwise(F.col("c_name"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", t.display_company(name).alias("company"))


@_query(f"""WITH {JOBS_SQL} SELECT source_job_id, CASE WHEN drop_reason IS NULL OR drop_reason LIKE 'requires %+ yoe' OR drop_reason LIKE 'region%' OR drop_reason LIKE 'onsite%' OR drop_reason LIKE 'remote in%' OR drop_reason LIKE 'requires local%'
  THEN CASE WHEN min_yoe IS NULL THEN 'yoe unknown' WHEN drop_reason IS NULL AND list_contains(hiring_regions, 'unknown') THEN 'region unresolved' ELSE drop_reason END ELSE drop_reason END AS drop_reason FROM jobs""")
def strict_gate_reasons(spark, sf_dir):
    """The gate where postings must state their years and region."""
    return _jobs(spark, sf_dir).withColumn("drop_reason", gate.drop_reason(AS_OF, unknown_yoe=False, unknown_region=False)).select("source_job_id", "drop_reason")


@_query(f"""WITH {NORMALIZED_SQL}, gaps AS (
  SELECT sha256(title || chr(0) || company || chr(0) || description) AS description_hash, CASE WHEN list_contains(hiring_regions, 'unknown') THEN 0 ELSE 1 END AS u, ordinal
  FROM normalized WHERE description IS NOT NULL AND (list_contains(hiring_regions, 'unknown') OR min_yoe IS NULL OR requires_work_auth IS NULL)
), cached AS (SELECT DISTINCT description_hash FROM gaps WHERE ordinal % 5 = 0), firsts AS (
  SELECT description_hash, min((u, ordinal)) AS f FROM gaps WHERE description_hash NOT IN (SELECT description_hash FROM cached) GROUP BY 1
), picked AS (SELECT description_hash, f[1] AS u, f[2] AS ordinal FROM firsts ORDER BY 2, 3 LIMIT 480)
SELECT description_hash, ordinal, CAST((row_number() OVER (ORDER BY u, ordinal) - 1) // 12 AS INT) AS batch FROM picked""")
def enrichment_todo(spark, sf_dir):
    """The next texts to enrich, those of every fifth posting being cached."""
    jobs = _jobs(spark, sf_dir)
    gaps = jobs.where(normalize.needs_enrichment() & F.col("description").isNotNull())
    return export.enrichment_todo(jobs, gaps.where("ordinal % 5 = 0").select("description_hash").distinct())


@_query(f"WITH {JOBS_SQL} SELECT source, source_job_id, match_score FROM jobs WHERE first_seen_at > {NOW} - INTERVAL 3 DAY AND source || ':' || source_job_id NOT IN (SELECT source || ':' || source_job_id FROM postings WHERE ordinal % 3 = 0) "
        "AND source || ':' || source_job_id IN (SELECT source || ':' || source_job_id FROM postings WHERE ordinal % 2 = 0)")
def saved_not_applied_new(spark, sf_dir):
    """Saved jobs not applied to and new since the last visit: a semi and an anti join."""
    raw, key = postings(spark, sf_dir), ["source", "source_job_id"]
    jobs = _jobs(spark, sf_dir).where(F.col("first_seen_at") > F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval(F.lit(3)))
    return jobs.join(raw.where("ordinal % 2 = 0").select(*key), key, "left_semi").join(raw.where("ordinal % 3 = 0").select(*key), key, "left_anti").select(*key, "match_score")


_REACHABLE_SQL = "CASE WHEN coalesce(requires_work_auth, false) AND NOT coalesce(visa_sponsorship, false) THEN list_contains(hiring_regions, 'india') ELSE list_has_any(hiring_regions, ['worldwide', 'india', 'apac']) END"
_SHOWN_SQL = "coalesce(posted_at, first_seen_at)"
_PAID_SQL = f"ordinal IN (SELECT o_orderkey FROM orders WHERE {_PAY_AT} IN ({', '.join(map(str, _PAY))}))"


def _shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the snapshot's reader sees: active jobs that pass the gate."""
    return _jobs(spark, sf_dir).where("is_active and drop_reason is null")


def _marks(spark: SparkSession, sf_dir: str, every: int) -> DataFrame:
    return postings(spark, sf_dir).where(F.col("ordinal") % every == 0).select("source", "source_job_id")


@_query(f"""WITH {JOBS_SQL} SELECT source, source_job_id, match_score FROM jobs WHERE is_active AND drop_reason IS NULL AND coalesce(min_yoe <= 0, true) AND (is_new_grad OR employment_type = 'internship')
  AND greatest(floor((epoch({NOW}) - epoch({_SHOWN_SQL})) / 86400), 0) <= 45 AND ordinal % 3 <> 0 AND list_contains(tech_stack, 'python')""")
def client_new_grads(spark, sf_dir):
    """The reader's filters: no years asked, new graduates, posted within 45 days, a skill, none applied to."""
    f = ClientFilter(new_grad_only=True, posted_within_days=45, tech=("python",), hide_applied=True)
    return client.chosen(_shown(spark, sf_dir), f, AS_OF, _marks(spark, sf_dir, 2), _marks(spark, sf_dir, 3)).select("source", "source_job_id", "match_score")


@_query(f"""WITH {JOBS_SQL} SELECT source, source_job_id FROM jobs WHERE is_active AND min_yoe <= 4 AND {_PAID_SQL} AND ordinal % 2 = 0 AND {_REACHABLE_SQL} AND employment_type IN ('internship', 'full_time')
  AND (contains(lower(title), 'engineer') OR contains(lower(company), 'engineer') OR contains(lower(coalesce(location_raw, '')), 'engineer'))""")
def client_paid_saved(spark, sf_dir):
    """Saved jobs that state pay, are reachable, and hold a word; unstated years are left out."""
    f = ClientFilter(query=" Engineer ", employment=("internship", "full_time"), max_min_yoe=4, include_unknown_yoe=False, reachable_only=True, paid_only=True, saved_only=True)
    return client.chosen(_jobs(spark, sf_dir).where("is_active"), f, AS_OF, _marks(spark, sf_dir, 2), _marks(spark, sf_dir, 3)).select("source", "source_job_id")


@_query(f"WITH {JOBS_SQL} SELECT source, source_job_id, {_SHOWN_SQL} AS shown_at, CAST(row_number() OVER (ORDER BY {_SHOWN_SQL} DESC NULLS LAST, source, source_job_id) AS BIGINT) AS place FROM jobs WHERE is_active AND drop_reason IS NULL ORDER BY place LIMIT 40")
def client_newest(spark, sf_dir):
    """The reader's first page of 40 by date, with places on it."""
    page = client.ordered(_shown(spark, sf_dir), "posted_at").limit(40)
    place = F.row_number().over(W.orderBy(client.effective_date().desc_nulls_last(), "source", "source_job_id"))
    return page.select("source", "source_job_id", client.effective_date().alias("shown_at"), place.cast("long").alias("place"))


@_query(f"WITH {JOBS_SQL} SELECT count(*) AS total, count(*) FILTER (employment_type = 'internship') AS internships, count(*) FILTER ({_REACHABLE_SQL}) AS reachable, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM jobs WHERE is_active AND drop_reason IS NULL")
def client_summary(spark, sf_dir):
    """The reader's header."""
    return client.summary(_shown(spark, sf_dir))


@_query(f"""WITH {JOBS_SQL} SELECT source, source_job_id, url, title, min_yoe, grad_year, requires_work_auth AS work_auth_required, deadline AS apply_deadline, {_REACHABLE_SQL} AS reachable_from_india, yc_batch, team_size, {_PAID_SQL} AS paid,
  coalesce(link_status, '') AS link_status, age_days, match_score FROM jobs WHERE is_active""")
def job_summaries(spark, sf_dir):
    """Jobs as listings send them."""
    sent = client.to_summary(_jobs(spark, sf_dir).where("is_active"))
    return sent.select("source", "source_job_id", "url", "title", "min_yoe", "grad_year", "work_auth_required", "apply_deadline", "reachable_from_india", "yc_batch", "team_size", F.col("pay").isNotNull().alias("paid"), "link_status", "age_days", "match_score")


@_query(f"""WITH {JOBS_SQL} SELECT source, source_job_id, CASE WHEN ordinal % 4 = 0 THEN 'board-' || (ordinal % 6) ELSE source END AS scope, concat_ws(',', CASE WHEN team_size IS NOT NULL THEN 'team_size' END, CASE WHEN vc IS NOT NULL THEN 'vc' END, CASE WHEN yc_batch IS NOT NULL THEN 'yc_batch' END) AS kept,
  array_to_string(tech_stack, ',') AS tech_stack, array_to_string(hiring_regions, ',') AS hiring_regions FROM jobs""")
def stored_rows(spark, sf_dir):
    """Jobs encoded as rows and decoded again, with payloads that hold more than what stays."""
    k = F.col("ordinal")
    payload = F.create_map(F.lit("yc_batch"), F.when(F.col("yc_batch").isNotNull(), F.concat(F.lit('"'), "yc_batch", F.lit('"'))), F.lit("team_size"), F.col("team_size").cast("string"), F.lit("vc"), F.when(F.col("vc").isNotNull(), F.concat(F.lit('"'), "vc", F.lit('"'))), F.lit("pay"), F.lit('""'), F.lit("funding_stage"), F.lit("[]"), F.lit("html"), F.lit('"x"'))
    jobs = _jobs(spark, sf_dir).withColumns({"payload": payload, "scope": F.when(k % 4 == 0, F.concat(F.lit("board-"), (k % 6).cast("string")))})
    back = client.from_row(client.to_row(jobs))
    return back.select("source", "source_job_id", "scope", F.array_join(F.map_keys("payload"), ",").alias("kept"), F.array_join("tech_stack", ",").alias("tech_stack"), F.array_join("hiring_regions", ",").alias("hiring_regions"))


@_query(f"WITH {_RUNS_SQL}, newest AS (SELECT connector, arg_max(found, started_at) AS found FROM runs GROUP BY 1) SELECT connector, CASE WHEN found % 3 = 1 THEN 'HTTP 500' END AS error FROM newest WHERE found % 3 = 1 OR found = 0")
def unhealthy_connectors(spark, sf_dir):
    """Connectors whose newest run failed or found nothing."""
    runs = _runs(spark, sf_dir)
    return health.unhealthy(runs.withColumn("error", F.when(F.col("found") % 3 == 1, "HTTP 500")))


@_query(f"WITH {_RUNS_SQL} SELECT CAST(sum(found) AS BIGINT) AS found, CAST(sum(found // 2) AS BIGINT) AS new, CAST(sum(found // 5) AS BIGINT) AS updated, CAST(sum(found // 7) AS BIGINT) AS closed FROM runs")
def pipeline_totals(spark, sf_dir):
    """What all runs found, added, changed and closed."""
    part = lambda n: F.floor(F.col("found") / n)
    return health.totals(_runs(spark, sf_dir).withColumns({"new": part(2), "updated": part(5), "closed": part(7)}))


_COPIED = 1_000_000_000


@_query(f"""WITH RECURSIVE own AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), vectors AS (
  SELECT * FROM own UNION ALL SELECT id + {_COPIED}, list_concat([v[1] + 0.25e0], v[2:]) FROM own WHERE id % 5 = 0 UNION ALL SELECT id + {2 * _COPIED}, v FROM own WHERE id % 10 = 0
), classed AS (SELECT id, v, min(id) OVER (PARTITION BY v) AS class_id FROM vectors), heads AS (SELECT id, v FROM classed WHERE id = class_id
), links AS (SELECT a.id AS a, b.id AS b FROM heads a JOIN heads b ON a.id <> b.id AND list_cosine_similarity(a.v, b.v) >= 0.9
), reach AS (SELECT id, id AS seen FROM heads UNION SELECT r.id, l.b FROM reach r JOIN links l ON l.a = r.seen
), named AS (SELECT id, min(seen) AS component_id FROM reach GROUP BY id), degree AS (SELECT a AS id, count(*) AS n FROM links GROUP BY a)
SELECT c.id, c.class_id, coalesce(n, 0) AS n_links, component_id FROM classed c JOIN named n2 ON n2.id = c.class_id LEFT JOIN degree d ON d.id = c.class_id""")
def vector_duplicates(spark, sf_dir):
    """Groups of near vectors: one in five has an edited copy, one in ten an equal one."""
    own = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    edited = own.where("id % 5 = 0").select(F.col("id") + _COPIED, F.expr("concat(array(v[0] + 0.25d), slice(v, 2, size(v)))"))
    return vectors.vector_groups(own.union(edited).union(own.where("id % 10 = 0").select(F.col("id") + 2 * _COPIED, "v")), "id", "v")
