"""The seven-part match score with its reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall import vocabulary as v


def parts(as_of: str) -> dict[str, Column]:
    """The parts by name, in the order of their reasons."""
    c, now = F.col, F.lit(as_of).cast("timestamp_ntz")
    has = lambda r: F.array_contains("hiring_regions", r)
    w = v.WEIGHTS
    strong, learning = (F.size(F.array_intersect("tech_stack", F.array(*map(F.lit, x)))) for x in (v.STRONG, v.LEARNING))
    base = F.when(c("source").isin(*v.EMPLOYER_SOURCES), 0.5).otherwise(0.15)
    base = F.when(c("vc").isNotNull(), F.greatest(base, F.lit(0.75))).otherwise(base)
    small = F.when(c("team_size").between(1, v.SMALL_TEAM), 0.2).otherwise(0.0)
    company = F.when(c("yc_batch").isNotNull(), F.greatest(base, F.lit(0.8)) + small).otherwise(base)
    hours = (F.unix_timestamp(now) - F.unix_timestamp("posted_at")) / 3600
    return {
        "reachability": w["reachability"] * (
            F.when(has("worldwide"), F.when(c("is_remote"), 1.0).otherwise(0.8)).when(has("india"), F.when(c("is_remote"), 0.9).otherwise(0.7))
            .when(~c("is_remote"), 0.0).when(c("visa_sponsorship"), 0.45).when(has("apac"), 0.4)
            .when(c("hiring_regions") == F.array(F.lit("unknown")), 0.3).otherwise(0.0)
        ),
        "stage": w["stage"] * (
            F.when(c("employment_type") == "internship", 1.0).when(c("grad_year") == v.GRADUATION_YEAR, 0.95).when(c("grad_year").isNotNull(), 0.3)
            .when(c("is_new_grad"), 0.8).when(c("min_yoe") == 0, 0.6).when(c("min_yoe").isNull(), 0.25)
            .otherwise(F.greatest(F.lit(0.0), (1 - c("min_yoe") / 3) * 0.5))
        ),
        "stack": w["stack"] * F.when(F.size("tech_stack") == 0, 0.4).otherwise(0.8 * F.least(F.lit(1.0), strong / 4) + 0.2 * F.least(F.lit(1.0), learning / 2)),
        "freshness": w["freshness"] * F.when(c("posted_at").isNull() | c("age_days").isNull(), 0.3).when(hours <= 24, 1.0).when(hours <= 72, 0.7).when(hours <= 168, 0.4).otherwise(0.1),
        "company": w["company"] * F.when(c("brand").isin(*v.NOTABLE_COMPANIES), 1.0).otherwise(F.least(F.lit(1.0), company)),
        "role": w["role"] * F.when(c("role_category") != "other", 1.0).otherwise(0.0),
        "confidence": w["confidence"] * F.when(c("region_confidence") == "high", 1.0).otherwise(0.0),
    }


def reasons(as_of: str) -> Column:
    """At most five reasons: reachability, stage, stack, freshness, company."""
    c, now = F.col, F.lit(as_of).cast("timestamp_ntz")
    has = lambda r: F.array_contains("hiring_regions", r)
    hits = F.slice(F.array_sort(F.array_intersect("tech_stack", F.array(*map(F.lit, v.STRONG)))), 1, 3)
    hours = (F.unix_timestamp(now) - F.unix_timestamp("posted_at")) / 3600
    notable = c("brand").isin(*v.NOTABLE_COMPANIES)
    yc = ~notable & c("yc_batch").isNotNull()
    return F.slice(F.array_compact(F.array(
        F.when(has("worldwide"), F.when(c("is_remote"), "remote, hires worldwide").otherwise("hires worldwide"))
        .when(has("india"), F.when(c("is_remote"), "remote in India").otherwise("onsite in India")).when(~c("is_remote"), "onsite abroad")
        .when(c("visa_sponsorship"), "remote, sponsors visa").when(has("apac"), None).when(c("hiring_regions") == F.array(F.lit("unknown")), "region unclear"),
        F.when(c("employment_type") == "internship", "internship").when(c("grad_year") == v.GRADUATION_YEAR, F.lit(f"class of {v.GRADUATION_YEAR}"))
        .when(c("grad_year").isNotNull(), None).when(c("is_new_grad"), "new-grad friendly").when(c("min_yoe") == 0, "0 years required"),
        F.when(F.size(hits) > 0, F.concat(F.lit("matches "), F.array_join(hits, ", "))),
        F.when(c("age_days").isNull(), None).when(hours <= 24, "posted today").when(hours <= 72, "posted this week"),
        F.when(notable, "well-known company").when(c("vc").isNotNull(), F.concat(F.lit("backed by "), c("vc"))),
        F.when(yc, F.concat(F.lit("YC "), c("yc_batch"))),
        F.when(yc & c("team_size").between(1, v.SMALL_TEAM), F.concat(F.lit("small team ("), c("team_size").cast("string"), F.lit(")"))),
    )), 1, 5)


def scored(jobs: DataFrame, as_of: str) -> DataFrame:
    """Adds match_score, match_parts and match_reasons; ``brand``, the company's, is used up."""
    p = parts(as_of)
    total = sum(p.values(), F.lit(0.0))
    return jobs.withColumns({
        "match_score": F.round(total, 2), "match_parts": F.create_map(*(x for k, part in p.items() for x in (F.lit(k), F.round(part, 2)))),
        "match_reasons": reasons(as_of),
    }).drop("brand")
