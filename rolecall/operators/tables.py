"""The stored tables on disk: a run writes the sources that it changes, and counts once it is committed.

``<path>/<run>/data/source=<name>`` holds a source's rows, ``<path>/<run>/commit`` a row
for each source that the run wrote. A source's rows are those of the last committed run
that wrote it; a run without a commit was cut off and counts for nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.operators import store, sync
from rolecall.staging import stage_table

COMMIT = "source string, n_rows long, new long, updated long, deleted long"
#: Days that a manual reset leaves of the cache of extractions and of the history of runs.
RESET_CACHE_DAYS, RESET_RUN_DAYS = 30, 7


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _runs(spark: SparkSession, path: str) -> dict[int, bool]:
    """Every run below ``path`` and whether it is committed."""
    at, files = _files(spark, path)
    names = [f.getPath().getName() for f in files.listStatus(at)] if files.exists(at) else []
    return {int(n): files.exists(_files(spark, f"{path}/{n}/commit/_SUCCESS")[0]) for n in sorted(names) if n.isdigit()}


def commits(spark: SparkSession, path: str) -> DataFrame:
    """``COMMIT`` with ``run``: what each committed run wrote, a row a source; as small as sources times runs."""
    found = [spark.read.schema(COMMIT).parquet(f"{path}/{run:09d}/commit").withColumn("run", F.lit(run)) for run, done in _runs(spark, path).items() if done]
    out = spark.createDataFrame([], f"{COMMIT}, run int")
    for one in found:
        out = out.unionByName(one)
    return out


def load(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table: each source's rows of the last run that wrote it. ``schema`` is that of the rows, with ``source``."""
    last = commits(spark, path).groupBy("source").agg(F.max_by(F.struct("run", "n_rows"), "run").alias("r")).where("r.n_rows > 0").select("source", "r.run").collect()  # a row a source
    out = spark.createDataFrame([], schema)
    for run in sorted({r["run"] for r in last}):
        rows = spark.read.schema(schema).parquet(f"{path}/{run:09d}/data")
        out = out.unionByName(rows.where(F.col("source").isin(*(r["source"] for r in last if r["run"] == run))).select(*out.columns))
    return out


def commit_run(rows: DataFrame, counts: DataFrame, path: str) -> int:
    """Writes ``rows`` of the sources in ``counts`` (source, new, updated, deleted) as the next run; a source without rows is then empty.

    The data are written first and the commit last, so readers see the old rows or all
    the new. Without sources nothing is written, and -1 returned.
    """
    spark, counts = rows.sparkSession, stage_table(counts)
    if counts.isEmpty():
        return -1
    run = max(_runs(spark, path), default=-1) + 1
    own = rows.join(F.broadcast(counts.select("source")), "source", "left_semi")  # a row a source
    own.write.partitionBy("source").parquet(f"{path}/{run:09d}/data")
    written = spark.read.schema(rows.schema).parquet(f"{path}/{run:09d}/data").groupBy("source").agg(F.count("*").alias("n_rows"))
    counts.join(written, "source", "left").select("source", F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"), *(F.col(c).cast("long") for c in ("new", "updated", "deleted"))).coalesce(1).write.parquet(f"{path}/{run:09d}/commit")
    return run


def sync_sources(spark: SparkSession, path: str, schema: str, wanted: DataFrame, covered: DataFrame | list[str] | None, known: DataFrame | list[str] | None, full: bool, as_of: str) -> DataFrame:
    """Makes the stored rows of the sources in ``wanted`` match a run; returns ``source, new, updated, deleted`` of every source that it judged.

    Rules are those of ``sync.sync_actions``; a source that nothing changed isn't written.
    ``wanted`` has the columns of ``schema``. A source that found nothing has a row without
    a key, which alone says that it ran.
    """
    ran, wanted = stage_table(wanted.select("source").distinct()), wanted.where("source_job_id is not null")
    before = load(spark, path, schema).join(F.broadcast(ran), "source", "left_semi")
    actions = stage_table(sync.judged(before, wanted, covered, known, full))
    tally = {"new": ("insert",), "updated": ("update",), "deleted": ("close", "retired"), "missed": ("miss",)}
    found = stage_table(ran.join(actions.select("source", "action"), "source", "left").groupBy("source").agg(*(F.count_if(F.coalesce(F.col("action").isin(*a), F.lit(False))).alias(c) for c, a in tally.items())))
    changed = found.where("new + updated + deleted + missed > 0").drop("missed")
    commit_run(sync.applied(actions, before.columns, as_of), changed, path)
    return found.drop("missed")


def vacuum(spark: SparkSession, path: str) -> list[int]:
    """Deletes runs of which no source's rows are read any more, and runs that were cut off before the last commit; returns their numbers."""
    runs = _runs(spark, path)
    last = max((r for r, done in runs.items() if done), default=-1)
    used = {r["run"] for r in commits(spark, path).groupBy("source").agg(F.max("run").alias("run")).collect()}  # a row a source
    gone = [r for r, done in runs.items() if r < last and (not done or r not in used)]
    for run in gone:
        at, files = _files(spark, f"{path}/{run:09d}")
        files.delete(at, True)
    return gone


def record_run(runs: DataFrame, path: str) -> None:
    """Appends run results (connector, started_at and more) to the history; Spark commits a call's files together."""
    runs.write.mode("append").parquet(path)


def reset(spark: SparkSession, path: str, jobs: DataFrame, cache: DataFrame, history: DataFrame, as_of: str, cache_days: int = RESET_CACHE_DAYS, run_days: int = RESET_RUN_DAYS) -> dict[str, int]:
    """Empties the stored table by a run that leaves every source without rows, and counts what goes.

    The extraction cache and the run history are returned to neither: ``cache_pruned`` and
    ``runs_pruned`` say how many of their rows ``store.prune`` takes at these ages.
    """
    counts = jobs.groupBy("source").agg(F.count("*").alias("deleted")).select("source", F.lit(0).alias("new"), F.lit(0).alias("updated"), "deleted")
    told = {"jobs_deleted": jobs.count(), "cache_pruned": cache.count() - store.prune(cache, "created_at", as_of, cache_days).count(), "runs_pruned": history.count() - store.prune(history, "started_at", as_of, run_days).count()}
    commit_run(jobs.where("false"), counts, path)
    return told
