"""Queries over orders whose keys are as large as those of big tables."""

from pathlib import Path

import pytest

from rolecall.plans import catalog
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def far(duck, tmp_path_factory):
    """The folder of some orders with keys up to nine millions, whose planted times lie far after the year 9999."""
    folder = tmp_path_factory.mktemp("far")
    duck.execute(f"COPY (SELECT * REPLACE (o_orderkey + 8990000 AS o_orderkey) FROM '{SMALL}/orders.parquet') TO '{folder}/orders.parquet' (FORMAT parquet)")
    return folder


@pytest.mark.parametrize("name", ["src_array_board", "stream_landed_postings", "src_google"])
def test_far_times_equal_sql(spark, far, name):
    import duckdb

    catalog.queries()[name](spark, str(far)).write.parquet(f"{far}/{name}")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{far}/orders.parquet'")
    con.execute(f"CREATE TABLE wanted AS {catalog.oracle_sql()[name]}")
    con.execute(f"CREATE TABLE got AS SELECT {', '.join(c[0] for c in con.execute('DESCRIBE wanted').fetchall())} FROM '{Path(far)}/{name}/*.parquet'")
    assert con.execute("SELECT count(*) FROM got").fetchall()[0][0] > 0
    assert con.execute("SELECT count(*) FROM ((FROM got EXCEPT ALL FROM wanted) UNION ALL (FROM wanted EXCEPT ALL FROM got))").fetchall() == [(0,)]


def test_times_out_of_range_are_absent(spark):
    from pyspark.sql import functions as F

    from rolecall.functions import parsing as p

    one = spark.range(1)
    said = [one.select((p.moment(F.lit(n), k)).cast("string").alias("t")).first()["t"] for n, k in ((-1, 1000), (86_400_001, 1000), (1 << 62, 1000), (-(1 << 62), 1), (0, 1))]
    assert said == ["1969-12-31 23:59:59.999", "1970-01-02 00:00:00.001", None, None, "1970-01-01 00:00:00"]
