"""Jobs that lack a key, in the dedupe."""

from pyspark.sql import functions as F

from rolecall.operators import dedupe


def test_jobs_without_a_url_are_not_one_group(spark, monkeypatch):
    """Rows without a key are never joined by it: they would all meet in one task."""
    seen = []
    monkeypatch.setattr(dedupe, "join_hot", lambda left, right, key, how="inner", real=dedupe.join_hot: seen.append(left.where(F.col(key).isNull()).count()) or real(left, right, key, how))
    jobs = spark.range(60).selectExpr(
        "id as ordinal", "'lever' as source", "case when id % 2 = 0 then '' else concat('https://a/', id % 7) end as canonical_url", "case when id % 3 = 0 then '' else 'acme' end as company_normalized",
        "concat('t', id % 5) as title_normalized", "cast(null as string) as description",
    )
    marked = {r["ordinal"]: r["kept"] for r in dedupe.dedupe(jobs).collect()}
    kept = {}
    for i in range(60):
        keys = {k for k in (f"u{i % 7}" if i % 2 else None, f"t{i % 5}" if i % 3 else None) if k}
        kept[i] = not any(kept[j] and keys & held for j, held in ((j, {k for k in (f"u{j % 7}" if j % 2 else None, f"t{j % 5}" if j % 3 else None) if k}) for j in range(i)))
    assert marked == kept
    assert seen and not any(seen)
