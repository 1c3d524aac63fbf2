"""Queries of careers pages, of the import of boards and of condensed texts, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.operators import careers, enrichment, probes
from rolecall.sources.postings import _pick, _sql_pick
from rolecall.staging import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(sql: str) -> Callable:
    def put(query: Callable) -> Callable:
        QUERIES[query.__name__], SQL[query.__name__] = query, sql
        return query

    return put


_text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))


def _sites(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A site per page, whose html follows planted links, and the pages that landed of it."""
    k = F.col("page_id").cast("string")
    n, site = F.col("page_id"), _text("https://www.Site", k, ".example/a/b/index.html")
    direct = (
        F.when(n % 5 == 0, _text("https://boards.greenhouse.io/Acme", k, "/jobs/1")).when(n % 5 == 1, _text("jobs.lever.co/x.y.", k, "./1 JOBS.eu.lever.co/X.Y.", k))
        .when(n % 5 == 2, _text("https://boards.greenhouse.io/embed/job_board?for=emb", k, "&x=1")).when(n % 5 == 3, _text("//KK", k, ".zohorecruit.in/")).otherwise("www.recruitee.com apply.workable.com/j/5")
    )
    link = F.when(n % 3 == 0, 'href="../careers/x"').when(n % 3 == 1, _text('href="//jobs.site', k, '.example/./jobs"')).otherwise('href="https://other.example/careers" href="mailto:jobs@site.example"')
    home = _text(direct, " <a ", link, "> <a ", link, ">", F.coalesce("html", F.lit("")))
    more = F.when(n % 3 == 0, _text("https://c", k, ".keka.com/careers")).when(n % 3 == 1, _text("jobs.gem.com/g", k, "a jobs.gem.com/g", k, "b https://jobs.ashbyhq.com/two-words", k, "-hq"))
    base = spark.read.parquet(f"{sf_dir}/pages.parquet").where("page_id is not null")
    landed = base.select(site.alias("url"), F.lit(None).cast("string").alias("final_url"), home.alias("html"), F.lit(200).alias("http_code")).unionByName(base.where(n % 3 < 2).select(
        F.when(n % 3 == 0, _text("https://www.Site", k, ".example/a/careers/x")).otherwise(_text("https://jobs.site", k, ".example/jobs")).alias("url"), F.lit(None).cast("string").alias("final_url"), more.alias("html"), F.when(n % 7 == 0, 404).otherwise(200).alias("http_code"),
    ))
    prefound = F.when(n % 11 == 0, F.array(F.struct(F.lit("gem").alias("platform"), F.lit("shared").alias("slug"))))
    return base.select(site.alias("website"), _text("Name ", k).alias("name"), prefound.alias("prefound"), n.alias("ordinal")), landed


_FOUND_SQL = """WITH sites AS (SELECT page_id AS k, 'https://www.Site' || page_id || '.example/a/b/index.html' AS website FROM pages WHERE page_id IS NOT NULL), boards AS (
  SELECT k, 'greenhouse' AS platform, 'acme' || k AS slug FROM sites WHERE k % 5 = 0 UNION ALL SELECT k, 'lever', 'x.y.' || k FROM sites WHERE k % 5 = 1 UNION ALL SELECT k, 'greenhouse', 'emb' || k FROM sites WHERE k % 5 = 2
  UNION ALL SELECT k, 'zoho_recruit', 'KK' || k || '.zohorecruit.in' FROM sites WHERE k % 5 = 3 UNION ALL SELECT k, 'keka', 'c' || k FROM sites WHERE k % 3 = 0 AND k % 7 > 0
  UNION ALL SELECT k, b.platform, b.slug FROM sites, unnest([{'platform': 'gem', 'slug': 'g' || k || 'a'}, {'platform': 'gem', 'slug': 'g' || k || 'b'}, {'platform': 'ashby', 'slug': 'two-words' || k || '-hq'}]) t(b) WHERE k % 3 = 1 AND k % 7 > 0
  UNION ALL SELECT k, 'gem', 'shared' FROM sites WHERE k % 11 = 0
)"""


@_query(f"""{_FOUND_SQL} SELECT website, coalesce(string_agg(platform || ':' || slug, ' ' ORDER BY platform, slug), '') AS boards FROM sites LEFT JOIN boards USING (k) GROUP BY website""")
def careers_boards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boards of each site."""
    found = careers.scan(*_sites(spark, sf_dir))
    return found.select("website", F.array_join(F.transform("boards", lambda b: F.concat_ws(":", b["platform"], b["slug"])), " ").alias("boards"))


@_query(f"""{_FOUND_SQL}, counted AS (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM boards), last AS (SELECT platform, slug, max(k) AS k, arg_max(n, k) AS n FROM counted GROUP BY ALL)
SELECT platform, slug, CASE WHEN n <= 2 THEN 'Name ' || k WHEN platform = 'ashby' THEN 'Two Words' || k || ' ' WHEN platform = 'gem' THEN CASE WHEN slug = 'shared' THEN 'Shared' ELSE 'G' || k || upper(slug[-1]) END
  WHEN platform = 'greenhouse' AND slug LIKE 'acme%' THEN 'Acme' || k WHEN platform = 'greenhouse' THEN 'Emb' || k WHEN platform = 'lever' THEN 'X' WHEN platform = 'zoho_recruit' THEN 'Kk' || k ELSE 'C' || k END AS name,
  CASE WHEN n <= 2 THEN website END AS website FROM last JOIN sites USING (k) WHERE NOT (platform = 'greenhouse' AND slug LIKE 'acme%' AND k % 10 = 0)""")
def careers_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards that the registry lacks; a site of more than two doesn't give them its name."""
    k = F.col("page_id")
    registry = spark.read.parquet(f"{sf_dir}/pages.parquet").where("page_id is not null").select(F.lit("greenhouse").alias("platform"), _text("ACME", k.cast("string")).alias("slug"), F.when(k % 10 == 0, "candidate").otherwise("rejected").alias("state"))
    return careers.candidates(careers.scan(*_sites(spark, sf_dir)), registry)


_PLACED = ("Pune, India", "Indianapolis, IN", "Remote - Global", "Worldwide (not India)", None, "Berlin")
_TITLED = ("Graduate Engineer", "Engineer", "Internal Auditor", "New Grad 2027")
_PROBED_SQL = f"""WITH asked AS (SELECT c_custkey AS c, 'p' || c_custkey % 3 AS platform, 's' || c_custkey AS slug, CASE WHEN c_custkey % 11 = 0 THEN 404 WHEN c_custkey % 13 = 0 THEN 503 WHEN c_custkey % 17 = 0 THEN NULL ELSE 200 END AS status FROM customer),
rows AS (SELECT o_custkey AS c, {_sql_pick(_PLACED, 'o_orderkey')} IN ('Pune, India', 'Worldwide (not India)') AS india, {_sql_pick(_PLACED, 'o_orderkey')} = 'Remote - Global' AS world, {_sql_pick(_TITLED, 'o_orderkey')} IN ('Graduate Engineer', 'New Grad 2027') AS early FROM orders),
probed AS (SELECT c, platform, slug, coalesce(status = 200, false) AS ok, count(*) FILTER (india) AS india, count(*) FILTER (india AND early) AS intern_india, count(*) FILTER (world) AS worldwide FROM asked LEFT JOIN rows USING (c) GROUP BY ALL)"""


def _import(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates, registry and log of an import that stopped after two chunks and went on."""
    c = F.col("c_custkey")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key = [_text("p", (c % 3).cast("string")).alias("platform"), _text("s", c.cast("string")).alias("slug")]
    candidates = customers.select(*key)
    registry = customers.where(c % 9 < 3).select(*key, F.lit(2).alias("tier"), F.lit(None).cast("string").alias("note"), F.when(c % 9 == 0, "verified").when(c % 9 == 1, "candidate").otherwise("rejected").alias("state"))
    answers = customers.select(*key, F.when(c % 11 == 0, 404).when(c % 13 == 0, 503).when(c % 17 != 0, 200).alias("status"))
    k, owner = F.col("o_orderkey"), F.col("o_custkey")
    postings = spark.read.parquet(f"{sf_dir}/orders.parquet").select(_text("p", (owner % 3).cast("string")).alias("platform"), _text("s", owner.cast("string")).alias("slug"), _pick(_TITLED, k).alias("title"), _pick(_PLACED, k).alias("location"))
    probe = lambda chunk: probes.tally(chunk.join(answers, ["platform", "slug"], "left"), postings.join(chunk, ["platform", "slug"], "left_semi"))
    log, chunk = f"{shared_dir(spark)}/rolecall/{uuid.uuid4().hex}", max(1, candidates.count() // 5)
    probes.import_boards(spark, log, candidates, registry, probe, chunk, most_chunks=2)
    return candidates, registry, probes.import_boards(spark, log, candidates, registry, probe, chunk)


@_query(f"""{_PROBED_SQL} SELECT platform, count(*) AS probed, count(*) FILTER (ok) AS reachable, count(*) FILTER (ok AND india + worldwide > 0) AS relevant, count(*) FILTER (ok AND intern_india > 0) AS with_interns FROM probed WHERE c % 9 NOT IN (0, 1) GROUP BY platform""")
def import_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an import found, by platform."""
    return probes.summary(*_import(spark, sf_dir))


@_query(f"""{_PROBED_SQL}, hit AS (SELECT * FROM probed WHERE c % 9 NOT IN (0, 1) AND ok AND india + worldwide > 0)
SELECT platform, slug, CAST(2 AS INT) AS tier, CAST(NULL AS VARCHAR) AS note, CASE c % 9 WHEN 0 THEN 'verified' WHEN 1 THEN 'candidate' ELSE 'rejected' END AS state FROM asked WHERE c % 9 < 3 AND c NOT IN (SELECT c FROM hit)
UNION ALL SELECT platform, slug, CAST(CASE WHEN intern_india > 0 THEN 1 ELSE 2 END AS INT), 'India ' || india || ', intern/grad ' || intern_india, 'verified' FROM hit""")
def import_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry after an import that was stopped and resumed."""
    _, registry, probed = _import(spark, sf_dir)
    return probes.apply_import(registry, probed)


@_query(r"""WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_replace(regexp_replace(trim(coalesce(text, ''), E' \n\t\r'), '\n{3,}', E'\n\n', 'g'), '\n(T)', chr(10) || chr(10) || 'Must have \1', 'g') AS text FROM documents
), parts AS (SELECT doc_id, unnest(string_split_regex(text, '\n\s*\n')) AS raw, generate_subscripts(string_split_regex(text, '\n\s*\n'), 1) AS i FROM texts WHERE length(text) > 1400
), ranked AS (SELECT doc_id, i, trim(raw, E' \n\t\r') AS p, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN regexp_matches(trim(raw, E' \n\t\r'), '(?i)(requirement|qualification|who\s+you\s+are|what\s+we.?re\s+looking|about\s+you|eligib|experience|must\s+have|minimum|basic\s+qualif|location|remote|visa|sponsor|authoriz|work\s+permit|time\s?zone)') THEN 0 ELSE 1 END, i) AS r
  FROM parts WHERE trim(raw, E' \n\t\r') <> ''
), walk AS (
  SELECT doc_id, 0::BIGINT AS r, 0::BIGINT AS used, []::BIGINT[] AS kept FROM (SELECT DISTINCT doc_id FROM ranked)
  UNION ALL SELECT w.doc_id, k.r, CASE WHEN w.used + least(length(k.p), 600) <= 1400 THEN w.used + least(length(k.p), 600) ELSE w.used END, CASE WHEN w.used + least(length(k.p), 600) <= 1400 THEN list_append(w.kept, k.i::BIGINT) ELSE w.kept END
  FROM walk w JOIN ranked k ON k.doc_id = w.doc_id AND k.r = w.r + 1
), ends AS (SELECT doc_id, arg_max(kept, r) AS kept FROM walk GROUP BY doc_id
), joined AS (SELECT k.doc_id, string_agg(left(k.p, 600), E'\n\n' ORDER BY k.i) AS said FROM ranked k JOIN ends e ON e.doc_id = k.doc_id AND list_contains(e.kept, k.i) GROUP BY k.doc_id)
SELECT t.doc_id, CASE WHEN length(t.text) <= 1400 THEN t.text WHEN coalesce(said, '') <> '' THEN said ELSE left(t.text, 1400) END AS condensed FROM texts t LEFT JOIN joined USING (doc_id)""")
def condensed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as texts of a posting's length; lines that begin with a T become paragraphs with signal."""
    blank = "[ \n\t\r]"
    text = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), f"^{blank}+|{blank}+$", ""), "\n{3,}", "\n\n")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", enrichment.condense(F.regexp_replace(text, "\n(T)", "\n\nMust have $1")).alias("condensed"))
