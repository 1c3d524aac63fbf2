"""Skewed joins and blocks against plain ones."""

import pytest
from pyspark.sql import functions as F

from rolecall import staging
from rolecall.operators import joins
from rolecall.operators.blocks import attend, blocks_by_size, meetings


@pytest.mark.parametrize(("how", "most"), [("inner", 1 << 20), ("inner", 0), ("left", 1 << 20), ("left", 0)])
def test_heavy_keys(spark, monkeypatch, how, most):
    monkeypatch.setattr(joins, "MOST_BYTES", most)
    left = spark.range(4000).selectExpr("id", "if(id % 2 = 0, 7, id) as key", "'x' as salt0").unionByName(spark.sql("select -1L as id, cast(null as bigint) as key, 'x' as salt0"))
    right = left.where("key < 100").groupBy("key").agg(F.count("*").alias("n_rows")).withColumn("name", F.concat(F.lit("n"), "key"))
    got = joins.join_hot(left, staging.stage_table(right), "key", how)
    assert sorted(map(tuple, got.select("id", "key", "name").collect()), key=str) == sorted(map(tuple, left.join(right.drop("n_rows"), "key", how).select("id", "key", "name").collect()), key=str)


def test_blocks_hold_every_pair_once(spark):
    rows = staging.stage_table(spark.range(90).selectExpr("id % 3 as g", "id as item", "10 + id % 7 as size"))
    placed = staging.stage_table(blocks_by_size(rows, "g", "item", F.lit(1), 5))
    heads = placed.groupBy("g", "block").agg(F.min("size").alias("lo"), F.max("size").alias("hi"), F.count("*").alias("n"))
    assert heads.agg(F.max("n")).first()[0] <= 12

    def met(where):
        groups = attend(placed, meetings(heads, "g", where), "g").groupBy("g", "own", "other").agg(F.collect_list(F.struct("block", "item")).alias("rows"))
        for r in groups.collect():
            left, right = ([x["item"] for x in r["rows"] if x["block"] == b] for b in (r["own"], r["other"]))
            yield from (tuple(sorted((x, y))) for x in left for y in right if r["own"] != r["other"] or x < y)

    want = {(a, b) for a in range(90) for b in range(90) if a < b and a % 3 == b % 3}
    got = [*met("true")]
    assert len(got) == len(set(got)) and set(got) == want
    assert {(a, b) for a, b in want if min(10 + a % 7, 10 + b % 7) >= 0.9 * max(10 + a % 7, 10 + b % 7)} <= set(met("l.hi >= 0.9 * r.lo"))


def test_dropped_stage_is_gone(spark):
    import pathlib

    kept, gone = (staging.stage_table(spark.range(3), by=None) for _ in range(2))
    files = [pathlib.Path(f.removeprefix("file://")) for df in (kept, gone) for f in df.inputFiles()]
    staging.drop_stage(gone)
    assert files[0].exists() and not files[-1].exists() and kept.count() == 3
