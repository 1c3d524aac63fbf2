"""The labelled gate: the first failing test names the reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall import vocabulary as v


def reachable(regions: Column, work_auth: Column, sponsors: Column) -> Column:
    """Worldwide, India or Asia-Pacific; with local authorization and no sponsor, India only."""
    fenced = work_auth.eqNullSafe(F.lit(True)) & ~sponsors.eqNullSafe(F.lit(True))
    return F.when(fenced, F.array_contains(regions, "india")).otherwise(F.arrays_overlap(regions, F.array(*map(F.lit, ("worldwide", "india", "apac")))))


def drop_reason(as_of: str, unknown_yoe: bool = True, unknown_region: bool = True) -> Column:
    """Null for postings to keep. Needs the columns of ``normalize`` and ``advanced_degree``. The flags tell if postings that don't state their years or region may stay."""
    c, now = F.col, F.lit(as_of).cast("timestamp_ntz")
    regions = c("hiring_regions")
    label = F.array_join(F.array_sort(regions), "/")
    internship = c("employment_type") == "internship"
    cap = F.when(c("source").isin(*v.ATS_SOURCES), v.ATS_MAX_AGE_DAYS).otherwise(v.MAX_AGE_DAYS)
    cap = F.when(internship, F.least(cap, F.lit(v.INTERN_MAX_AGE_DAYS))).otherwise(cap)
    # A plausible age is asked for only where it comes from the first sight.
    age = F.when(c("posted_at").isNotNull(), c("raw_age_days")).otherwise(c("age_days"))
    excluded = None
    for pattern in v.EMPLOYMENT_EXCLUDED:
        hit = F.concat_ws(" ", "title", "location_raw").rlike("(?i)" + pattern)
        told = F.lit(f"employment type excluded ({pattern})")
        excluded = F.when(hit, told) if excluded is None else excluded.when(hit, told)
    sponsors, india = c("visa_sponsorship").eqNullSafe(F.lit(True)), F.array_contains(regions, "india")
    blocked = (F.size(regions) > 0) & F.forall(regions, lambda r: r.isin(*v.BLOCKING_REGIONS))
    unknown = F.array_contains(regions, "unknown")
    allowed = F.arrays_overlap(regions, F.array(*map(F.lit, v.ALLOWED_REGIONS)))
    return F.coalesce(
        F.when(c("role_category") == "other", "role not in scope"),
        F.when(c("company_normalized").isin(*v.EXCLUDED_COMPANIES), "aggregator / staffing agency"),
        F.when(c("deadline") < now, "application deadline passed"),
        F.when(c("advanced_degree"), "requires PhD / Master's"),
        F.when(c("us_eligibility") & ~india, "requires US work eligibility"),
        F.when(c("unpaid"), "unpaid"),
        F.when((F.size("grad_years") > 0) & ~F.array_contains("grad_years", v.GRADUATION_YEAR), F.concat(F.lit("class of "), F.array_join(F.transform("grad_years", lambda y: y.cast("string")), "/"), F.lit(" only"))),
        F.when(age > cap, F.concat(F.lit("posted "), age.cast("string"), F.lit("d ago"))),
        excluded,
        F.when(~c("employment_type").isin(*v.EMPLOYMENT_ALLOWED), F.concat(F.lit("employment type "), c("employment_type"))),
        F.lit(None) if unknown_yoe else F.when(c("min_yoe").isNull(), "yoe unknown"),
        F.when(c("min_yoe") > v.MAX_MIN_YOE, F.concat(F.lit("requires "), c("min_yoe").cast("string"), F.lit("+ yoe"))),
        F.when(blocked & ~sponsors, F.concat(F.lit("region not reachable ("), regions[0], F.lit(")"))),
        F.when(c("requires_work_auth").eqNullSafe(F.lit(True)) & ~sponsors & ~reachable(regions, c("requires_work_auth"), c("visa_sponsorship")), "requires local work authorization"),
        F.when(unknown & ~c("is_remote"), "onsite, region unresolved"),
        F.lit(None) if unknown_region else F.when(unknown, "region unresolved"),
        F.when(~unknown & ~allowed, F.concat(F.when(c("is_remote"), "remote in ").otherwise("onsite in "), label, F.lit(", not reachable"))),
    )


def passed(jobs: DataFrame, as_of: str) -> DataFrame:
    return jobs.withColumn("drop_reason", drop_reason(as_of)).where("drop_reason is null").drop("drop_reason")
