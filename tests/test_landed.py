"""Landed responses with gaps, stored tables, and the stream."""

from pyspark.sql import functions as F

from rolecall.operators import store
from rolecall.sources import landed
from rolecall.streaming import ingest


def _responses(spark, *bodies):
    return spark.createDataFrame([("lever", f"lever:s{i}", f"s{i}", code, body) for i, (code, body) in enumerate(bodies)], landed.LANDED)


def test_statuses(spark):
    given = _responses(spark, (200, '[{"id": "1"}]'), (200, "[]"), (200, '{"jobs": []}'), (200, '[{"text": "x"}]'), (404, "[]"), (410, None), (500, "[]"), (None, "[]"), (200, None), (200, ""), (200, "[{"))
    said = [r.status for r in landed.board_status(given).orderBy(F.col("slug").substr(2, 9).cast("int")).collect()]
    assert said == ["ok", "empty", "empty", "empty", "no_board", "no_board", "failed", "failed", "failed", "failed", "failed"]


def test_array_board_gaps(spark):
    got = landed.read_array_board(_responses(spark, (200, '[{"id": "7", "createdAt": 0, "categories": null, "applyUrl": "u", "hostedUrl": ""}, {"id": ""}, {"id": "8", "country": "in", "categories": {"allLocations": ["Global", "India"]}}]')))
    a, b = sorted(got.collect(), key=lambda r: r.source_job_id)
    assert (a.source_job_id, a.url, a.title, a.location_raw, a.tags, a.posted_at, a.hiring_regions_hint, a.employment_type_hint) == ("s0:7", "u", "", None, [], None, ["unknown"], "unknown")
    assert b.hiring_regions_hint == ["worldwide", "india"]


def test_joined_board_gaps(spark):
    body = '{"jobs": [{"id": "1", "branch_id": "9"}, {"id": "2", "branch_id": "1", "remote": true}], "branches": [{"id": "1", "city": "A"}, {"id": "1", "city": "B"}]}'
    got = {r.source_job_id: (r.location_raw, r.tags) for r in landed.read_joined_board(_responses(spark, (200, body), (200, "{}"), (200, None))).collect()}
    assert got == {"s0:1": (None, []), "s0:2": ("B · Remote", [])}


def test_joined_board_texts_and_regions(spark):
    body = """{"jobs": [{"id": 1, "branch_id": 4, "description": "<p>A &lt; B</p>"}, {"id": 2, "branch_id": 5, "url": "https://x.example/2"}, {"id": 3}, {"id": 4, "deleted": true}],
        "branches": [{"id": 4, "location": "Paris, France", "country_code": "IN"}, {"id": 5, "location": "", "city": "Toronto", "country_code": "CA"}]}"""
    got = {r.source_job_id: (r.url, r.description, r.hiring_regions_hint) for r in landed.read_joined_board(_responses(spark, (200, body))).collect()}
    assert got == {
        "s0:1": ("https://s0.freshteam.com/jobs", "A < B", ["india"]), "s0:2": ("https://x.example/2", None, ["canada"]), "s0:3": ("https://s0.freshteam.com/jobs", None, ["unknown"]),
    }


def test_prune_keeps_the_limit(spark):
    t = spark.sql("select timestamp_ntz'2026-10-18 00:00:00' as at union all select timestamp_ntz'2026-10-17 23:59:59'")
    assert store.prune(t, "at", "2026-11-01 00:00:00", 14).count() == 1


def test_stream_takes_only_what_is_new(spark, tmp_path):
    where = [f"file://{tmp_path}/{x}" for x in ("landed", "out", "progress")]
    for k in (1, 2):
        _responses(spark, (200, f'[{{"id": "{k}"}}]')).write.mode("append").parquet(where[0])
        got = ingest.ingest_available(spark, where[0], landed.LANDED, landed.read_array_board, *where[1:])
        assert sorted(r.source_job_id for r in got.collect()) == [f"s0:{i}" for i in range(1, k + 1)]


def test_first_arrivals(spark, tmp_path):
    src, out, progress = (f"file://{tmp_path}/{x}" for x in "sop")
    rows = spark.sql("select * from values ('a', timestamp'2026-01-01 00:00:00'), ('a', timestamp'2026-01-01 00:01:00'), ('b', timestamp'2026-01-01 00:00:00') t(id, at)")
    rows.write.parquet(src)
    stream = ingest.first_arrivals(spark.readStream.schema(rows.schema).parquet(src), ["id"], "at", "1 hour")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["a", "b"]
