"""The snapshot document and the enrichment work list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rolecall.operators import dedupe
from rolecall.operators.gate import reachable

# The snapshot's keys and what they stand for.
KEYS = (
    ("s", "source"), ("i", "source_job_id"), ("u", "url"), ("t", "title"), ("c", "company"), ("l", "location_raw"), ("r", "role_category"),
    ("e", "employment_type"), ("y", "min_yoe"), ("Y", "max_yoe"), ("g", "is_new_grad"), ("m", "is_remote"), ("R", "hiring_regions"),
    ("k", "tech_stack"), ("p", "posted_at"), ("d", "apply_deadline"), ("f", "first_seen_at"), ("a", "age_days"), ("$", "pay"), ("v", "match_score"),
)


#: Where a field isn't a column of its name.
_HELD = {"apply_deadline": "deadline", "pay": "pay.label"}


def _shown(name: str, kind: str) -> Column:
    """The value, or null where the document leaves it out: empty, false, and zero too. Scores have one place, halves go up."""
    c = F.col(_HELD.get(name, name))
    if kind.startswith("array"):
        return F.when(F.size(c) > 0, c)
    if kind == "timestamp_ntz":
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    if name == "match_score":
        return F.when(c != 0, F.round(c, 1))
    return F.when(c if kind == "boolean" else c != ("" if kind == "string" else 0), c)


def snapshot(jobs: DataFrame, as_of: str) -> DataFrame:
    """``source, source_job_id, match_score, doc``: one short-keyed JSON object per open job that no better one repeats. ``x`` tells if it is reachable.

    Stored jobs are deduplicated by score, without their descriptions, as the listing has none.
    """
    open_ = jobs.where(F.col("is_active") & F.coalesce(F.col("link_status") != "dead", F.lit(True)) & (F.col("deadline").isNull() | (F.col("deadline") >= F.lit(as_of).cast("timestamp_ntz"))))
    score = F.coalesce(F.col("match_score").cast("double"), F.lit(0.0))
    best = dedupe.survivors(dedupe.dedupe(open_.withColumn("description", F.lit(None).cast("string")), score), score)
    kinds = dict(best.dtypes) | {"apply_deadline": "timestamp_ntz", "pay": "string"}
    fields = [_shown(name, kinds[name]).alias(key) for key, name in KEYS]
    x = F.coalesce(reachable(F.col("hiring_regions"), F.col("requires_work_auth"), F.col("visa_sponsorship")), F.lit(False)).alias("x")
    return best.select("source", "source_job_id", "match_score", F.to_json(F.struct(*fields, x)).alias("doc"))


def header(docs: DataFrame, as_of: str) -> DataFrame:
    """The snapshot's first line: when it was made, how many jobs it holds, and what its keys stand for."""
    made = F.date_format(F.lit(as_of).cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    fields = F.struct(*(F.lit(name).alias(key) for key, name in KEYS))
    return docs.agg(F.count("*").alias("total")).select(F.to_json(F.struct(made.alias("generated_at"), "total", fields.alias("fields"))).alias("doc"))


def enrichment_todo(jobs: DataFrame, cached: DataFrame, size: int = 12, most: int = 40) -> DataFrame:
    """``description_hash, ordinal, batch``: uncached texts with a gap, unresolved regions first, one job a text.

    ``size * most`` texts at most are asked for in a run; the limit is the feature, a budget of calls.
    """
    unresolved = F.when(F.array_contains("hiring_regions", "unknown"), 0).otherwise(1)
    gap = F.array_contains("hiring_regions", "unknown") | F.col("min_yoe").isNull() | F.col("requires_work_auth").isNull()
    open_ = jobs.where(gap & F.col("description").isNotNull()).join(cached.select("description_hash"), "description_hash", "left_anti")
    first = open_.groupBy("description_hash").agg(F.min(F.struct(unresolved.alias("u"), F.col("ordinal").alias("o"))).alias("f"))
    picked = first.select("description_hash", F.col("f.u").alias("u"), F.col("f.o").alias("ordinal")).orderBy("u", "ordinal").limit(size * most)
    k = F.row_number().over(W.orderBy("u", "ordinal"))
    return picked.select("description_hash", "ordinal", F.floor((k - 1) / size).cast("int").alias("batch"))
