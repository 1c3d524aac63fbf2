"""The import of candidate boards: a log of probes that a stopped run resumes, their tallies, and what they add to the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from rolecall.staging import stage_table

# Places and titles that a probe counts, and codes that mean a board is gone.
INDIA = r"(?i)\b(india|bengaluru|bangalore|hyderabad|pune|chennai|mumbai|delhi|gurgaon|gurugram|noida|kolkata|ahmedabad|coimbatore|kochi)\b"
WORLDWIDE = r"(?i)\b(worldwide|anywhere|global)\b"
EARLY = r"(?i)\b(intern|internship|graduate|new\s*grad|trainee|apprentice)\b"
DEAD = (400, 401, 404, 410, 422)

COUNTS = "ok boolean, status int, india long, intern_india long, worldwide long"
LOG = f"platform string, slug string, {COUNTS}, batch long"
_KEY = ["platform", "slug"]
#: Candidates that are probed before the log is written.
CHUNK = 500


def known(registry: DataFrame) -> DataFrame:
    """``platform, slug`` of the registry's boards but for the rejected ones."""
    return registry.where("state <> 'rejected'").select(*_KEY)


def tally(asked: DataFrame, postings: DataFrame) -> DataFrame:
    """``platform, slug`` and ``COUNTS`` of boards ``platform, slug, status`` whose ``postings`` (platform, slug, title, location) were read.

    An answer of 200 is ok, with any number of postings. A posting in India isn't counted as worldwide.
    """
    place = F.coalesce("location", F.lit(""))
    india, early = place.rlike(INDIA), F.coalesce("title", F.lit("")).rlike(EARLY)
    counts = {"india": india, "intern_india": india & early, "worldwide": ~india & place.rlike(WORLDWIDE)}
    found = postings.groupBy(*_KEY).agg(*(F.count_if(c).alias(k) for k, c in counts.items()))
    ok = F.coalesce(F.col("status") == 200, F.lit(False))
    return asked.join(found, _KEY, "left").select(*_KEY, ok.alias("ok"), F.col("status").cast("int"), *(F.when(ok, F.coalesce(k, F.lit(0))).otherwise(0).cast("long").alias(k) for k in counts))


def read_log(spark: SparkSession, log: str) -> DataFrame:
    """The last probe of each board; empty before the first. A chunk that was cut off left nothing, as Spark commits its files together."""
    try:
        lines = spark.read.schema(LOG).parquet(log)
    except AnalysisException:
        lines = spark.createDataFrame([], LOG)
    return lines.groupBy(*_KEY).agg(F.max_by(F.struct(*(c.split()[0] for c in LOG.split(", ")[2:])), "batch").alias("p")).select(*_KEY, "p.*")


def to_probe(candidates: DataFrame, registry: DataFrame, probed: DataFrame, retry_failed: bool = False) -> DataFrame:
    """``platform, slug`` of candidates that neither the registry nor the log has. ``retry_failed``: those that failed, but aren't gone, too."""
    settled = probed.where(F.col("ok") | F.col("status").isin(*DEAD)) if retry_failed else probed
    return candidates.select(*_KEY).where("slug is not null").distinct().join(known(registry), _KEY, "left_anti").join(settled.select(*_KEY), _KEY, "left_anti")


def import_boards(spark: SparkSession, log: str, candidates: DataFrame, registry: DataFrame, probe: Callable[[DataFrame], DataFrame], chunk: int = CHUNK, most_chunks: int | None = None, retry_failed: bool = False) -> DataFrame:
    """Probes what is left in chunks, each appended to ``log`` before the next, and returns the log's last lines.

    ``probe`` gives ``platform, slug`` and ``COUNTS`` for a chunk. A run that is stopped
    loses a chunk at most: the next one probes what the log lacks. What is left is taken
    in order of platform and slug when the run begins, so a failure isn't tried twice in a run.
    """
    number = read_log(spark, log).agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]
    left = stage_table(to_probe(candidates, registry, read_log(spark, log), retry_failed))
    # A chunk is a range of a global order: sorted partitions and their counts, no window over all.
    placed = stage_table(left.repartitionByRange(*_KEY).sortWithinPartitions(*_KEY).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    counts = placed.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = stage_table(placed.join(F.broadcast(counts), "part").select(*_KEY, F.floor((F.col("at") - F.col("first") + F.col("before")) / chunk).alias("chunk")))
    chunks = (placed.agg(F.max("chunk")).first()[0] or 0) + 1 if not placed.isEmpty() else 0
    for k in range(chunks if most_chunks is None else min(chunks, most_chunks)):
        found = probe(placed.where(F.col("chunk") == k).select(*_KEY))
        found.select(*_KEY, *(c.split()[0] for c in COUNTS.split(", "))).withColumn("batch", F.lit(number + 1 + k).cast("long")).write.mode("append").parquet(log)
    return read_log(spark, log)


def summary(candidates: DataFrame, registry: DataFrame, probed: DataFrame) -> DataFrame:
    """By platform: candidates that the registry lacks, and of those probed the boards that answered, have openings, and have early ones in India."""
    new = candidates.select(*_KEY).where("slug is not null").distinct().join(known(registry), _KEY, "left_anti").join(probed, _KEY, "left")
    relevant = F.col("ok") & ((F.col("india") > 0) | (F.col("worldwide") > 0))
    return new.groupBy("platform").agg(
        F.count("*").alias("probed"), F.count_if("ok").alias("reachable"), F.count_if(relevant).alias("relevant"), F.count_if(relevant & (F.col("intern_india") > 0)).alias("with_interns")
    )


def apply_import(registry: DataFrame, probed: DataFrame) -> DataFrame:
    """The registry with the boards that have openings in India or worldwide, verified; verified ones stay as they are."""
    new = probed.where("ok and (india > 0 or worldwide > 0)").join(registry.where("state = 'verified'").select(*_KEY), _KEY, "left_anti")
    note = F.format_string("India %d, intern/grad %d", "india", "intern_india")
    return registry.join(new.select(*_KEY), _KEY, "left_anti").select("platform", "slug", "tier", "note", "state").unionByName(
        new.select("platform", "slug", F.when(F.col("intern_india") > 0, 1).otherwise(2).alias("tier"), note.alias("note"), F.lit("verified").alias("state"))
    )
