"""One local session for all tests."""

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g"}
    session = SparkSession.builder.master("local[8]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p if p.is_file() else f'{p}/*.parquet'}')")
    return con


def rows(df) -> list[tuple]:
    """Sorted rows with columns by name; floats to nine digits."""
    def plain(x):
        if isinstance(x, float):
            return f"{x:.9g}"
        return str([plain(y) for y in x]) if isinstance(x, (list, tuple)) else str(x)

    if hasattr(df, "sparkSession"):
        df = df.select(*sorted(df.columns))
        return sorted(tuple(map(plain, r)) for r in df.collect())
    order = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in df.fetchall())
