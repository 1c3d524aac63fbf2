"""Work dealt to as many tasks as it asks for."""

from pyspark.sql import functions as F

from rolecall import staging
from rolecall.functions import text as t
from rolecall.sources.postings import postings
from tests.conftest import SMALL


def test_more_rows_make_more_tasks(spark, monkeypatch):
    """Postings follow their count, and not the number of cores alone."""
    orders = spark.read.parquet(f"{SMALL}/orders.parquet").count()
    assert postings(spark, SMALL).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    monkeypatch.setattr(staging, "ROWS_A_TASK", 50)
    found = postings(spark, SMALL)
    assert found.rdd.getNumPartitions() == -(-orders // 50) > spark.sparkContext.defaultParallelism
    assert found.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 150


def test_hints_hide_no_place(spark):
    """Plain words come before the patterns; each word that a pattern knows still tells."""
    told = {"Work\tFrom  Home": True, "WFH ok": True, "Globally distributed": True, "global": True, "Anywhere": True, "onsite": False, "On-Site, remote": True, "In-Office": False, "inoffice, worldwide": False, "hybrid WFH": False, "Offices": False, "workshop": False, None: False}
    places = spark.createDataFrame([(x, y) for x, y in told.items()], "place string, told boolean").withColumn("found", t.detect_remote(F.lit("Engineer"), F.col("place"), F.array().cast("array<string>")))
    assert places.where("not (found <=> told)").collect() == []
