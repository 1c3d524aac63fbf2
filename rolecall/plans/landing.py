"""Queries over landed responses, stored tables and labels, and their SQL.

Boards are planted: one per customer, whose payload lists the customer's orders.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall import vocabulary as v
from rolecall.functions import labels
from rolecall.operators import store, tables
from rolecall.plans.sql import NOW, lit, rx
from rolecall.sources import landed
from rolecall.sources.postings import AS_OF, POSTINGS_SQL, TITLES, _pick, _sql_pick, postings
from rolecall.staging import shared_dir
from rolecall.streaming import ingest
from rolecall.streaming import state
from rolecall.streaming import sync as stream_sync_runs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_COUNTRIES = ("IN", "us", "DE", None, "SG", "XX", "AE")
_PLACES = ("Bengaluru, India", "Remote - Worldwide", "Berlin", "", None)
_COMMITMENTS = ("Full-time", "Internship", "Contract", "Seasonal", None)
_BRANCHES = ("Chennai, India", "", "London")
_CITIES = ("Chennai", "Pune", "London")
#: What these places mean, and no place.
_BRANCH_REGIONS = ("india", "india", "europe", "unknown")


def _query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _boards(spark: SparkSession, sf_dir: str, connector: str, body) -> DataFrame:
    """One response per customer with orders: some not found, some failed, some empty, some not JSON."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    boards = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey").where(c.isNotNull()).groupBy("o_custkey").agg(body(k).alias("body"))
    slug = F.concat(F.lit("b"), c.cast("string"))
    return boards.select(
        F.lit(connector).alias("connector"), F.concat(F.lit(f"{connector}:"), slug).alias("scope"), slug.alias("slug"),
        F.when(c % 11 == 0, 404).when(c % 13 == 0, 503).otherwise(200).alias("http_code"),
        F.when(c % 7 == 0, "[]").when(c % 17 == 0, "<html>").otherwise(F.col("body")).alias("body"),
    )


def _array_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    def body(k):
        cats = F.struct(_pick(_PLACES, k).alias("location"), F.lit("Core").alias("team"), _pick(_COMMITMENTS, k).alias("commitment"))
        item = F.struct(k.cast("string").alias("id"), _pick(TITLES, k).alias("text"), cats.alias("categories"), _pick(_COUNTRIES, k).alias("country"), (k * 1000000007).alias("createdAt"), F.lit("Hybrid").alias("workplaceType"))
        return F.to_json(F.collect_list(item))

    return _boards(spark, sf_dir, "lever", body)


_BOARD_SQL = """boards AS (SELECT DISTINCT o_custkey AS c, CASE WHEN o_custkey % 11 = 0 THEN 'no_board' WHEN o_custkey % 13 = 0 THEN 'failed'
  WHEN o_custkey % 7 = 0 THEN 'empty' WHEN o_custkey % 17 = 0 THEN 'failed' ELSE 'ok' END AS status FROM orders WHERE o_custkey IS NOT NULL)"""
_COUNTRY_SQL = "CASE upper(country) " + " ".join(f"WHEN {lit(k)} THEN {lit(r)}" for k, r in landed.COUNTRY_REGION.items()) + " END"
_ARRAY_SQL = f"""WITH {_BOARD_SQL}, items AS (
  SELECT o_orderkey AS k, c, {_sql_pick(_PLACES, 'o_orderkey')} AS place, {_sql_pick(_COMMITMENTS, 'o_orderkey')} AS kind, {_sql_pick(_COUNTRIES, 'o_orderkey')} AS country
  FROM orders JOIN boards ON o_custkey = c AND status = 'ok'
), read AS (SELECT *, {_COUNTRY_SQL} AS region, lower(coalesce(place, '')) AS blob FROM items)
SELECT 'b' || c || ':' || k AS source_job_id, 'lever:b' || c AS scope, {_sql_pick(TITLES, 'k')} AS title, nullif(place, '') AS location_raw,
  array_to_string(list_filter(['Core', lower(kind), 'hybrid'], lambda x: x IS NOT NULL), ',') AS tags, CASE WHEN k <> 0 THEN CAST(epoch_ms(k * 1000000007) AS TIMESTAMP) END AS posted_at,
  coalesce(nullif(array_to_string(list_filter([CASE WHEN regexp_matches(blob, '{landed.BORDERLESS}') THEN 'worldwide' END, region, CASE WHEN contains(blob, 'india') AND coalesce(region <> 'india', true) THEN 'india' END], lambda x: x IS NOT NULL), ','), ''), 'unknown') AS regions,
  CASE lower(kind) WHEN 'full-time' THEN 'full_time' WHEN 'internship' THEN 'internship' WHEN 'contract' THEN 'contract' ELSE 'unknown' END AS employment_type_hint
FROM read"""


def _array_rows(found: DataFrame) -> DataFrame:
    return found.select("source_job_id", "scope", "title", "location_raw", F.array_join("tags", ",").alias("tags"), "posted_at", F.array_join("hiring_regions_hint", ",").alias("regions"), "employment_type_hint")


@_query(_ARRAY_SQL)
def src_array_board(spark, sf_dir):
    """Postings of boards that answer with a bare array."""
    return _array_rows(landed.read_array_board(_array_boards(spark, sf_dir)))


@_query(_ARRAY_SQL)
def stream_landed_postings(spark, sf_dir):
    """The same postings, read as a stream of landed files in micro-batches."""
    base = f"{shared_dir(spark)}/rolecall/{uuid.uuid4().hex}"
    _array_boards(spark, sf_dir).write.parquet(f"{base}/landed")
    return _array_rows(ingest.ingest_available(spark, f"{base}/landed", landed.LANDED, landed.read_array_board, f"{base}/postings", f"{base}/progress"))


@_query(f"""WITH {_BOARD_SQL}, items AS (SELECT o_orderkey AS k, c FROM orders JOIN boards ON o_custkey = c AND status = 'ok' WHERE o_orderkey % 19 <> 0)
SELECT 'b' || c || ':' || k AS source_job_id, {_sql_pick(TITLES, 'k')} AS title, CASE WHEN k % 4 = 3 THEN CASE WHEN k % 2 = 0 THEN NULL ELSE '· Remote' END
  ELSE coalesce(nullif({_sql_pick(_BRANCHES, 'k % 4')}, ''), {_sql_pick(_CITIES, 'k % 4')}) || CASE WHEN k % 2 = 1 THEN ' · Remote' ELSE '' END END AS place,
  CASE WHEN k % 3 <> 2 THEN 'role ' || k % 3 END AS role, CASE WHEN k % 4 <> 3 THEN k % 4 <> 2 END AS in_india, {_sql_pick(_BRANCH_REGIONS, 'k % 4')} AS regions,
  CASE WHEN k % 5 = 0 THEN 'https://jobs.example/' || k ELSE 'https://b' || c || '.freshteam.com/jobs' END AS url, CASE k % 5 WHEN 1 THEN 'Café crew' || chr(10) || 'Ship & sail ' || k WHEN 2 THEN 'plain ' || k END AS description,
  CASE WHEN {rx(_sql_pick(TITLES, 'k'), v.INTERN)} THEN 'internship' ELSE 'unknown' END AS employment_type_hint FROM items""")
def src_joined_board(spark, sf_dir):
    """Postings of boards whose payload keeps branches and roles apart from the jobs."""
    branches = F.array(*(F.struct(F.lit(str(i)).alias("id"), F.lit(_BRANCHES[i]).alias("location"), F.lit(_CITIES[i]).alias("city"), F.lit("GB" if i == 2 else "IN").alias("country_code")) for i in range(3)))
    roles = F.array(*(F.struct(F.lit(str(i)).alias("id"), F.lit(f"role {i}").alias("name")) for i in range(2)))

    def body(k):
        job = F.struct(
            k.cast("string").alias("id"), _pick(TITLES, k).alias("title"), (k % 4).cast("string").alias("branch_id"), (k % 3).cast("string").alias("job_role_id"),
            (k % 2 == 1).alias("remote"), (k % 19 == 0).alias("deleted"), F.when(k % 5 == 0, F.concat(F.lit("https://jobs.example/"), k.cast("string"))).when(k % 5 == 1, "").alias("url"),
            F.when(k % 5 == 1, F.concat(F.lit("<style>p {}</style><p>Caf&eacute; crew</p>\n<ul><li>Ship &#38; sail "), k.cast("string"), F.lit("</li></ul>")))
            .when(k % 5 == 2, F.concat(F.lit("plain "), k.cast("string"))).when(k % 5 == 3, "<br>").alias("description"),
        )
        return F.to_json(F.struct(F.collect_list(job).alias("jobs"), branches.alias("branches"), roles.alias("job_roles")))

    found = landed.read_joined_board(_boards(spark, sf_dir, "freshteam", body))
    return found.select("source_job_id", "title", F.trim("location_raw").alias("place"), F.try_element_at("tags", F.lit(1)).alias("role"), "in_india", F.array_join("hiring_regions_hint", ",").alias("regions"), "url", "description", "employment_type_hint")


_SYNCED_SQL = f"""WITH {POSTINGS_SQL}, states AS (
  SELECT source, source_job_id, ordinal % 6 AS board, ordinal % 10 <> 1 AS one, ordinal % 10 <> 2 AS two, ordinal % 10 NOT IN (2, 3) AS three, ordinal % 17 AS form FROM postings
)
SELECT source, source_job_id, CAST(CASE WHEN three OR board > 2 THEN 0 ELSE CASE WHEN two THEN 1 ELSE 2 END END AS INT) AS missed_runs,
  sha1(source_job_id || CASE WHEN three THEN CASE WHEN form = 3 THEN '!' ELSE '' END WHEN two THEN CASE WHEN form = 2 THEN '!' ELSE '' END ELSE CASE WHEN form = 1 THEN '!' ELSE '' END END) AS fingerprint
FROM states WHERE three OR board > 2 OR two"""


def _three_runs(spark, sf_dir, base, sync):
    """The table that ``sync`` gives after the last of three runs of a searched source; three boards are read wholly."""
    k, found = F.col("ordinal"), None
    scopes = spark.sql("select cast(null as string) as source, cast(null as string) as source_job_id, concat('board-', id) as scope, cast(null as string) as fingerprint, cast(null as bigint) as ordinal from range(3)")
    for run, gone in ((1, (1,)), (2, (2,)), (3, (2, 3))):
        seen = postings(spark, sf_dir).where(~(k % 10).isin(*gone)).select(
            "source", "source_job_id", F.concat(F.lit("board-"), (k % 6).cast("string")).alias("scope"), F.sha1(F.concat("source_job_id", F.when(k % 17 == run, "!").otherwise(""))).alias("fingerprint"), "ordinal"
        )
        rows = seen.unionByName(scopes)
        rows.write.mode("append").parquet(f"{base}/runs")
        found = sync(rows, f"{base}/runs", f"{base}/table", f"{base}/progress")
    return found.select("source", "source_job_id", "missed_runs", "fingerprint")


@_query(_SYNCED_SQL)
def stream_sync(spark, sf_dir):
    """The stored table after three runs of a searched source, whose postings go after two misses."""
    base = f"{shared_dir(spark)}/rolecall/{uuid.uuid4().hex}"
    return _three_runs(spark, sf_dir, base, lambda _, *where: stream_sync_runs.sync_available(spark, *where, AS_OF, full=False))


@_query(_SYNCED_SQL)
def state_sync(spark, sf_dir):
    """The same three runs with the table in the state store."""
    base = f"{shared_dir(spark)}/rolecall/{uuid.uuid4().hex}"
    return _three_runs(spark, sf_dir, base, lambda _, *where: state.sync_state(spark, *where, AS_OF, full=False))


@_query(_SYNCED_SQL)
def stored_sync(spark, sf_dir):
    """The same three runs with the table on disk, of which each run writes the sources that it changes."""
    base = f"{shared_dir(spark)}/rolecall/{uuid.uuid4().hex}"
    kinds = [part.rsplit(" ", 1) for part in stream_sync_runs.TABLE.split(", ")]

    def sync(rows, runs, table, progress):
        every = postings(spark, sf_dir).select("source").distinct()  # a source that found nothing has run too
        seen = rows.where("source_job_id is not null").unionByName(every, allowMissingColumns=True)
        wanted = seen.select(*(F.col(n) if n in rows.columns else F.lit(None).cast(kind).alias(n) for n, kind in kinds))
        tables.sync_sources(spark, table, stream_sync_runs.TABLE, wanted, rows.where("source_job_id is null").select("scope"), None, False, AS_OF)
        return tables.load(spark, table, stream_sync_runs.TABLE)

    return _three_runs(spark, sf_dir, base, sync)


@_query(f"WITH {_BOARD_SQL} SELECT 'lever:b' || c AS scope, status FROM boards")
def fetch_board_status(spark, sf_dir):
    return landed.board_status(_array_boards(spark, sf_dir)).select("scope", "status")


@_query(f"WITH {_BOARD_SQL} SELECT 'lever:b' || c AS scope FROM boards WHERE status IN ('ok', 'empty')")
def covered_scopes(spark, sf_dir):
    return landed.covered_scopes(landed.board_status(_array_boards(spark, sf_dir)))


@_query(f"""WITH {_BOARD_SQL} SELECT 'lever' AS connector, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'empty') AS empty, count(*) FILTER (status = 'no_board') AS no_board,
  count(*) FILTER (status = 'failed') AS failed, CAST((SELECT count(*) FROM orders JOIN boards ON o_custkey = c AND status = 'ok') AS BIGINT) AS found, count(*) FILTER (status IN ('ok', 'empty')) AS covered FROM boards""")
def run_coverage(spark, sf_dir):
    return landed.run_coverage(landed.board_status(_array_boards(spark, sf_dir)))


@_query(f"WITH {POSTINGS_SQL} SELECT source, source_job_id, CASE WHEN ordinal % 3 = 0 THEN round(ordinal / 7e0, 2) ELSE 1e0 END AS match_score, CASE WHEN ordinal % 3 = 0 THEN 'new' ELSE 'old' END AS reasons FROM postings")
def update_scored(spark, sf_dir):
    """Every third posting scored anew."""
    raw = postings(spark, sf_dir)
    stored = raw.select("source", "source_job_id", F.lit(1.0).alias("match_score"), F.array(F.lit("old")).alias("match_reasons"))
    scored = raw.where("ordinal % 3 = 0").select("source", "source_job_id", (F.col("ordinal") / 7).alias("match_score"), F.array(F.lit("new")).alias("match_reasons"))
    return store.update_scored(stored, scored).select("source", "source_job_id", "match_score", F.array_join("match_reasons", ",").alias("reasons"))


@_query(f"""WITH {POSTINGS_SQL} SELECT sha256(source_job_id) AS description_hash, CASE WHEN ordinal % 3 = 0 THEN 'two' ELSE 'one' END AS model,
  CASE WHEN ordinal % 2 = 0 THEN first_seen_at ELSE {NOW} END AS created_at FROM postings WHERE ordinal % 2 = 0 OR ordinal % 3 = 0""")
def store_extractions(spark, sf_dir):
    """An upsert into the cache of model answers."""
    raw = postings(spark, sf_dir).withColumn("description_hash", F.sha2("source_job_id", 256))
    cache = raw.where("ordinal % 2 = 0").select("description_hash", F.lit("{}").alias("payload"), F.lit("one").alias("model"), F.col("first_seen_at").alias("created_at"))
    new = raw.where("ordinal % 3 = 0").select("description_hash", F.lit("{}").alias("payload"), F.lit("two").alias("model"))
    return store.store_extractions(cache, new, AS_OF).drop("payload")


@_query(f"WITH {POSTINGS_SQL} SELECT source, count(*) AS n FROM postings WHERE first_seen_at >= {NOW} - INTERVAL 14 DAY GROUP BY 1")
def prune_housekeeping(spark, sf_dir):
    """What a retention of 14 days leaves, per source."""
    return store.prune(postings(spark, sf_dir), "first_seen_at", AS_OF, 14).groupBy("source").agg(F.count("*").alias("n"))


_LEVELS = ("internship", "student", "entry_level", "associate", "mid_senior_level", "director", "executive", "not_applicable")


@_query(f"""WITH {POSTINGS_SQL}, read AS (
  SELECT *, CASE WHEN ordinal % 5 < 4 THEN ordinal % 5 END AS low, CASE WHEN ordinal % 7 > 0 THEN ordinal % 7 END AS high, date_diff('second', coalesce(posted_at, first_seen_at), {NOW}) // 86400 AS days,
    ceil(date_diff('second', {NOW}, deadline) / 86400e0) AS ahead FROM postings
)
SELECT source_job_id, CASE WHEN posted_at IS NOT NULL THEN 'Posted ' ELSE 'Found ' END || CASE WHEN days = 0 THEN 'today' WHEN days = 1 THEN 'yesterday' WHEN days < 60 THEN days || ' days ago'
    WHEN days < 365 THEN (days // 30) || ' months ago' ELSE 'over a year ago' END AS age,
  CASE WHEN ahead = 0 THEN 'Closes today' WHEN ahead > 0 THEN 'Apply by ' || strftime(deadline, '%-d %b') END AS deadline,
  CASE WHEN low = 0 OR low IS NULL AND ordinal % 2 = 0 THEN '0 yrs · freshers ok' WHEN low IS NULL THEN 'Experience not stated'
    ELSE CASE WHEN high > low THEN low || '-' || high ELSE low || '+' END || CASE WHEN low = 1 AND high IS NULL THEN ' yr' ELSE ' yrs' END || ' experience' END AS experience,
  list_extract([0, 0, 0, 1, 3, 8, 10, NULL], CAST(ordinal % 8 + 1 AS INT)) AS level_yoe, trim(title) AS title
FROM read""")
def card_labels(spark, sf_dir):
    """The words on a posting's card."""
    now, k = F.lit(AS_OF).cast("timestamp_ntz"), F.col("ordinal")
    low, high = F.when(k % 5 < 4, k % 5), F.when(k % 7 > 0, k % 7)
    return postings(spark, sf_dir).select(
        "source_job_id", labels.age_label(F.col("posted_at"), F.col("first_seen_at"), now).alias("age"), labels.deadline_label(F.col("deadline"), now).alias("deadline"),
        labels.experience_label(low, high, k % 2 == 0).alias("experience"), labels.level_yoe(_pick(_LEVELS, k)).alias("level_yoe"),
        labels.strip_batch(F.concat("title", F.when(k % 2 == 0, " (YC S24)").otherwise(""))).alias("title"),
    )


@_query("""WITH named AS (SELECT c_custkey, 'c-' || c_custkey AS slug, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS squashed, lower(c_mktsegment) AS host FROM customer)
SELECT c_custkey, array_to_string(list_filter([slug, squashed, CASE WHEN host <> squashed THEN host END], lambda s: s IS NOT NULL AND length(s) BETWEEN 2 AND 40), ',') AS variants FROM named""")
def slug_variants(spark, sf_dir):
    """Board names to try for each company."""
    slug, site = F.concat(F.lit("c-"), F.col("c_custkey").cast("string")), F.concat(F.lit("https://www."), F.col("c_mktsegment"), F.lit(".example/jobs"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.array_join(labels.slug_variants(slug, F.col("c_name"), site), ",").alias("variants"))
