"""Heavy values are computed once a row."""

from pyspark.sql import functions as F

from rolecall.sources import boards, pages, threads


def _cost(df, sign: str) -> int:
    """How often the optimized plan applies a pattern to rows."""
    return df._jdf.queryExecution().optimizedPlan().toString().count(sign)


def test_page_is_cut_and_parsed_once(spark):
    given = spark.range(1).select(*(F.col("id").cast(kind).alias(name) for name, kind in (f.split() for f in boards.RESPONSE.split(", "))))
    found = pages.read(given, "zoho_recruit", "2026-11-01 00:00:00").select("source_job_id", "title")
    assert _cost(found, pages.ZOHO_INPUT) <= 2 and _cost(found, "from_json(") == 1  # nullif names its argument twice


def test_header_is_split_once(spark):
    given = spark.range(1).select(*(F.col("id").cast("string").alias(c) for c in ("object_id", "parent_id", "comment_text")), F.lit("2026-11-01").cast("timestamp_ntz").alias("created_at"))
    found = threads.read_comments(given, spark.range(1).select(F.col("id").cast("string").alias("thread")))
    assert _cost(found, threads.DIVIDERS) <= 11  # a header names its parts so often
