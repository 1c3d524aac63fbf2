"""Intermediate tables in the cluster's shared folder.

Long lineages are cut by writing Parquet below ``spark.checkpoint.dir`` and
reading it again, so a lost executor costs one stage and never the whole job.
"""

from __future__ import annotations

import functools
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. On a cluster it must be named; a local session, as in tests, gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.partition("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (named or _own_dir()).rstrip("/")


@functools.cache
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="rolecall-")


#: Of Spark's session: whether a query's shuffle files go as soon as it ends, instead of when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage_table(df: DataFrame, by: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder, in a folder for each value of ``by``, and reads it back. The shuffle files that it took are deleted."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rolecall/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, partitionBy=by)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that one task gets of a table whose every row costs much, or grows.
ROWS_A_TASK = 1 << 18


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by its ``keys`` to as many tasks as its rows ask for, all cores at least; small files would make few tasks of many rows.

    ``df`` should be cheap to count, as Parquet files are by what they tell of themselves.
    """
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_A_TASK))
    return df.repartition(tasks, *keys)


def drop_stage(df: DataFrame, part: str = "") -> None:
    """Deletes a staged table, or one folder of it, that nothing will read again."""
    context = df.sparkSession.sparkContext
    for folder in {m[0] for f in df.inputFiles() if (m := re.match(".*/rolecall/[0-9a-f]{32}", f))}:
        path = context._jvm.org.apache.hadoop.fs.Path(f"{folder}/{part}" if part else folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
