"""Listing predicates, pages, counts and facets over stored jobs."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class JobFilter:
    """What a listing asks for; unset fields don't filter."""

    active_only: bool = True
    roles: tuple[str, ...] = ()
    employment: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    remote_only: bool = False
    new_grad_only: bool = False
    max_yoe: int | None = None
    include_unknown_yoe: bool = True
    max_age_days: int | None = None
    query: str = ""
    regions: tuple[str, ...] = field(default=())
    reachable_only: bool = False
    tech: tuple[str, ...] = ()


def _strings(values: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, values))


def predicate(f: JobFilter, as_of: str) -> Column:
    """The filter as one column; dead links never show."""
    c, tests = F.col, [F.coalesce(F.col("link_status") != "dead", F.lit(True))]
    if f.active_only:
        tests.append(c("is_active"))
    for name, values in (("role_category", f.roles), ("employment_type", f.employment), ("source", f.sources)):
        if values:
            tests.append(c(name).isin(*values))
    if f.remote_only:
        tests.append(c("is_remote"))
    if f.new_grad_only:
        tests.append(c("is_new_grad"))
    if f.max_yoe is not None:
        fits = c("min_yoe") <= f.max_yoe
        tests.append(fits | c("min_yoe").isNull() if f.include_unknown_yoe else fits)
    if f.max_age_days is not None:
        tests.append(F.coalesce("posted_at", "first_seen_at") >= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(f.max_age_days)))
    if f.query:
        # % and _ in the text act as wildcards, as they always have here.
        like = f"%{f.query.lower()}%"
        tests.append(F.lower("title").like(like) | F.lower("company").like(like))
    if f.regions:
        tests.append(F.arrays_overlap("hiring_regions", _strings(f.regions)))
    if f.reachable_only:
        tests.append(F.arrays_overlap("hiring_regions", _strings(("worldwide", "india"))) | c("visa_sponsorship").eqNullSafe(F.lit(True)))
    if f.tech:
        tests.append(F.size(F.array_except(_strings(f.tech), "tech_stack")) == 0)
    return reduce(lambda a, b: a & b, tests)


def page(jobs: DataFrame, f: JobFilter, as_of: str, order_by: str = "match_score", limit: int = 50, offset: int = 0) -> DataFrame:
    """One page, best first; ties by key."""
    order = {
        "match_score": F.desc_nulls_last("match_score"), "first_seen_at": F.desc_nulls_last("first_seen_at"),
        "posted_at": F.coalesce("posted_at", "first_seen_at").desc_nulls_last(),
    }[order_by]
    return jobs.where(predicate(f, as_of)).orderBy(order, "source", "source_job_id").offset(offset).limit(limit)


def total(jobs: DataFrame, f: JobFilter, as_of: str, limit: int, offset: int) -> DataFrame:
    """``total, has_more`` beside a page."""
    return jobs.where(predicate(f, as_of)).agg(F.count("*").alias("total")).withColumn("has_more", F.col("total") > limit + offset)


def stats(jobs: DataFrame) -> DataFrame:
    """Counts of all, active, remote, internship and reachable jobs."""
    active = F.col("is_active")
    return jobs.agg(
        F.count("*").alias("total"), F.count_if(active).alias("active"), F.count_if(active & F.col("is_remote")).alias("remote"),
        F.count_if(active & (F.col("employment_type") == "internship")).alias("internships"),
        F.count_if(active & F.arrays_overlap("hiring_regions", _strings(("worldwide", "india")))).alias("reachable"),
        F.count_if(active & F.array_contains("hiring_regions", "unknown")).alias("pending"),
    )


def counts_by(jobs: DataFrame, column: str) -> DataFrame:
    return jobs.where("is_active").groupBy(column).agg(F.count("*").alias("n"))


def facets(jobs: DataFrame) -> DataFrame:
    """The values to filter by, sorted."""
    sorted_ = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return jobs.agg(sorted_("source").alias("sources"), sorted_("role_category").alias("roles"), sorted_("employment_type").alias("employment"))


def needs_link_check(jobs: DataFrame, as_of: str, hours: int, limit: int) -> DataFrame:
    """The work queue: active jobs unchecked or checked too long ago, the best scored first."""
    cutoff = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(0), F.lit(hours))
    return jobs.where(F.col("is_active") & (F.col("link_checked_at").isNull() | (F.col("link_checked_at") < cutoff))).orderBy(F.desc("match_score"), "source", "source_job_id").limit(limit)
