"""From raw postings to normalized jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecall import vocabulary as v
from rolecall.functions import text as t
from rolecall.functions import urls, windows
from rolecall.operators.repeats import once_a_value


def normalize(raw: DataFrame, as_of: str, in_scope_only: bool = True) -> DataFrame:
    """Adds the derived fields, also pay and the degree flag, which look around their matches; titles out of scope go.

    What follows from texts, places and companies is computed once for each distinct value.
    """
    now = F.lit(as_of).cast("timestamp_ntz")
    title, desc, place, tags = F.col("title"), F.col("description"), F.col("location_raw"), F.col("tags")
    jobs = once_a_value(raw, ["title", "description", "tags"], lambda texts: _of_texts(texts, as_of, in_scope_only))
    jobs = once_a_value(jobs, ["description", "location_raw", "hiring_regions_hint"], lambda places: places.withColumn("place", t.resolve_regions(desc, place, F.col("hiring_regions_hint"))), raw)
    jobs = once_a_value(jobs, ["company"], lambda names: names.withColumns({"company_normalized": t.normalize_company(F.col("company")), "brand": t.brand_name(F.col("company"))}), raw)
    return (
        jobs.withColumns({
            "employment_type": F.coalesce("titled_type", "employment_type_hint"),
            "is_remote": t.detect_remote(title, place, tags),
            "canonical_url": urls.canonical_url(F.col("url")),
            "age_days": t.age_days(F.col("posted_at"), F.col("first_seen_at"), now),
            "raw_age_days": F.greatest(F.floor((F.unix_timestamp(now) - F.unix_timestamp(F.coalesce("posted_at", "first_seen_at"))) / 86400), F.lit(0)).cast("int"),
            "description_hash": t.description_hash(title, F.col("company"), desc),
        })
        .withColumns({
            "min_yoe": F.when(F.col("employment_type") == "internship", 0).otherwise(F.col("yoe.min_yoe")),
            "max_yoe": F.when(F.col("employment_type") != "internship", F.col("yoe.max_yoe")),
            "hiring_regions": F.col("place.regions"), "region_source": F.col("place.source"), "region_confidence": F.col("place.confidence"),
            "grad_year": F.try_element_at("grad_years", F.lit(1)),
        })
        .drop("yoe", "place", "titled_type")
    )


def _of_texts(texts: DataFrame, as_of: str, in_scope_only: bool) -> DataFrame:
    """What title, description and tags tell. Titles out of scope go first, before any other rule reads a description."""
    title, desc, tags = F.col("title"), F.col("description"), F.col("tags")
    jobs = texts.withColumn("role_category", t.classify_role(title, desc, tags))
    if in_scope_only:
        jobs = jobs.where("role_category <> 'other'")
    everything = t.text_of(title, desc)
    return jobs.withColumns({
        "yoe": t.extract_yoe(title, desc),
        "grad_years": t.extract_grad_years(everything, int(as_of[:4])),
        "tech_stack": t.extract_tech_stack(everything, tags),
        "titled_type": F.when(title.rlike(v.INTERN), "internship").when(title.rlike(v.STRONG_SENIORITY), "full_time"),
        "requires_work_auth": t.detect_work_auth(desc),
        "visa_sponsorship": t.detect_sponsorship(desc),
        "is_new_grad": title.rlike(v.NEW_GRAD) | title.rlike(v.INTERN) | F.coalesce(desc.rlike(v.NEW_GRAD), F.lit(False)),
        "us_eligibility": t.requires_us_eligibility(everything),
        "unpaid": t.is_unpaid(everything),
        "title_normalized": t.normalize_title(title),
        "advanced_degree": windows.needs_advanced_degree(title, desc),
        "pay": windows.extract_pay("description"),
    })


def needs_enrichment():
    return F.array_contains("hiring_regions", "unknown") | F.col("min_yoe").isNull() | F.col("requires_work_auth").isNull()
