"""The keyed sync as a stream: what lands between two calls is one run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.operators import sync

#: A posting that a run saw or, without an id, a scope that it read wholly.
RUN = "source string, source_job_id string, scope string, fingerprint string, ordinal long"
TABLE = RUN + ", missed_runs int, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, link_status string, link_checked_at timestamp_ntz"


def sync_available(spark: SparkSession, landed: str, out: str, checkpoint: str, as_of: str, full: bool, known: DataFrame | None = None) -> DataFrame:
    """Syncs the stored table with what has landed since the last call, and returns it.

    Each run reads the table's last version and writes the next, numbered as its
    micro-batch: a batch that is run again after a failure reads the same version
    and replaces its own. Missed runs are counted in the table, so a posting that
    comes back starts again at none. A call with nothing new changes nothing.
    """

    def version(number: int) -> DataFrame:
        return spark.read.schema(TABLE).parquet(f"{out}/{number:09d}") if number >= 0 else spark.createDataFrame([], TABLE)

    last = [-1]

    def step(batch: DataFrame, batch_id: int) -> None:
        before, wanted = version(batch_id - 1), batch.where("source_job_id is not null")
        nothing = [F.lit(None).cast(kind).alias(name) for name, kind in spark.createDataFrame([], TABLE).dtypes[5:]]
        wanted = wanted.select("*", *nothing)
        marked = sync.judged(before, wanted, batch.where("source_job_id is null"), known, full)
        sync.applied(marked, before.columns, as_of).write.mode("overwrite").parquet(f"{out}/{batch_id:09d}")
        last[0] = batch_id

    stream = spark.readStream.schema(RUN).parquet(landed)
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return version(last[0] if last[0] >= 0 else _last(spark, out))


def _last(spark: SparkSession, out: str) -> int:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return max((int(f.getPath().getName()) for f in files.listStatus(path)), default=-1) if files.exists(path) else -1
