"""What the snapshot's reader does with it: filters, orders, the summary, and the projection on the wire."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.operators.gate import reachable

KEY = ["source", "source_job_id"]
# The payload's keys that stay after storage.
KEPT = ("yc_batch", "team_size", "vc", "funding_stage", "pay")


@dataclass(frozen=True)
class ClientFilter:
    """A reader's choices. Years of 0 at most, unstated ones allowed, are the choice until another is made; None lifts the bound."""

    query: str = ""
    employment: tuple[str, ...] = ()
    roles: tuple[str, ...] = ()
    tech: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    max_min_yoe: int | None = 0
    include_unknown_yoe: bool = True
    reachable_only: bool = False
    remote_only: bool = False
    new_grad_only: bool = False
    paid_only: bool = False
    saved_only: bool = False
    hide_applied: bool = False
    posted_within_days: int | None = None


def count_active(f: ClientFilter) -> int:
    """How many choices differ from those that nobody made."""
    base = ClientFilter()
    return sum(getattr(f, x.name) != getattr(base, x.name) for x in fields(f))


def is_reachable() -> Column:
    return F.coalesce(reachable(F.col("hiring_regions"), F.col("requires_work_auth"), F.col("visa_sponsorship")), F.lit(False))


def effective_date() -> Column:
    return F.coalesce("posted_at", "first_seen_at")


def shown_age(as_of: str) -> Column:
    """Whole days since the effective date, 0 for later ones; null without a date."""
    return F.greatest(F.timestamp_diff("DAY", effective_date(), F.lit(as_of).cast("timestamp_ntz")), F.when(effective_date().isNotNull(), F.lit(0)))


def predicate(f: ClientFilter, as_of: str) -> Column:
    """The choices that a job's own columns decide. The query is plain text, sought in title, company and place; nulls hold nothing."""
    c, tests = F.col, [F.lit(True)]
    if needle := f.query.strip().lower():
        tests.append(reduce(lambda a, b: a | b, (F.contains(F.lower(F.coalesce(x, F.lit(""))), F.lit(needle)) for x in ("title", "company", "location_raw"))))
    tests += [c(name).isin(*values) for name, values in (("employment_type", f.employment), ("role_category", f.roles), ("source", f.sources)) if values]
    if f.tech:
        tests.append(F.size(F.array_except(F.array(*map(F.lit, f.tech)), F.transform("tech_stack", F.lower))) == 0)
    if f.max_min_yoe is not None:
        tests.append(F.coalesce(c("min_yoe") <= f.max_min_yoe, F.lit(f.include_unknown_yoe)))
    if f.reachable_only:
        tests.append(is_reachable())
    if f.remote_only:
        tests.append(c("is_remote"))
    if f.new_grad_only:
        tests.append(c("is_new_grad") | (c("employment_type") == "internship"))
    if f.paid_only:
        tests.append(F.coalesce(c("pay.label") != "", F.lit(False)))
    if f.posted_within_days is not None:
        tests.append(shown_age(as_of) <= f.posted_within_days)
    return reduce(lambda a, b: a & b, tests)


def chosen(jobs: DataFrame, f: ClientFilter, as_of: str, saved: DataFrame, applied: DataFrame) -> DataFrame:
    """``jobs`` that fit. ``saved`` and ``applied`` hold the reader's ``source, source_job_id``; without saved keys, none is saved."""
    found = jobs.where(predicate(f, as_of))
    if f.saved_only:
        found = found.join(saved.select(*KEY), KEY, "left_semi")
    return found.join(applied.select(*KEY), KEY, "left_anti") if f.hide_applied else found


def toggled(keys: DataFrame, pressed: DataFrame) -> DataFrame:
    """The reader's keys after some were pressed: held ones go, others come; a key pressed twice is as before."""
    odd = pressed.groupBy(*KEY).agg(F.count("*").alias("times")).where("times % 2 = 1").select(*KEY)
    return keys.select(*KEY).distinct().withColumn("times", F.lit(1)).unionByName(odd.withColumn("times", F.lit(1))).groupBy(*KEY).agg(F.sum("times").alias("times")).where("times = 1").select(*KEY)


def ordered(jobs: DataFrame, by: str = "match_score") -> DataFrame:
    """By score, by effective date with undated jobs last, or by first sight with unseen ones last; ties by key."""
    order = {"match_score": F.desc_nulls_last("match_score"), "posted_at": effective_date().desc_nulls_last(), "first_seen_at": F.desc_nulls_last("first_seen_at")}[by]
    return jobs.orderBy(order, *KEY)


def summary(jobs: DataFrame) -> DataFrame:
    """``total, internships, reachable, sources``: one row, also of no jobs; sources sorted and joined by commas."""
    return jobs.agg(
        F.count("*").alias("total"), F.count_if(F.col("employment_type") == "internship").alias("internships"), F.count_if(is_reachable()).alias("reachable"),
        F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"),
    )


def slim_payload(payload: Column) -> Column:
    """Of a payload, JSON by key, what stays stored: ``KEPT`` without null, empty text and empty lists; keys sorted."""
    held = F.map_filter(payload, lambda k, v: k.isin(*KEPT) & v.isNotNull() & ~v.isin("null", '""', "[]"))
    return F.map_from_entries(F.array_sort(F.map_entries(held)))


_LISTS = ("tech_stack", "hiring_regions", "match_reasons")
_TEXT_LIST = "array<string>"


def to_row(jobs: DataFrame) -> DataFrame:
    """Jobs as stored: lists as JSON, ``scope`` the source where none is given, ``fingerprint`` of all that doesn't change by itself.

    ``payload``, a map from key to JSON, is slimmed and stored as one JSON text. A null list is stored as an empty one.
    """
    lists = {c: F.to_json(F.coalesce(c, F.array().cast(_TEXT_LIST))) for c in _LISTS}
    slim = slim_payload(F.coalesce("payload", F.create_map().cast("map<string,string>")))
    scope = F.coalesce(F.nullif(F.col("scope"), F.lit("")), "source") if "scope" in jobs.columns else F.col("source")
    rows = jobs.withColumns(lists | {"payload": F.to_json(slim), "scope": scope, "missed_runs": F.lit(0)})
    stable = sorted(set(rows.columns) - {"first_seen_at", "last_seen_at", "link_status", "link_checked_at", "missed_runs", "fingerprint"})
    return rows.withColumn("fingerprint", F.sha1(F.to_json(F.struct(*stable), {"ignoreNullFields": "false"})))


def from_row(rows: DataFrame) -> DataFrame:
    """Stored rows as jobs again; what can't be read as a list is an empty one."""
    lists = {c: F.coalesce(F.from_json(c, _TEXT_LIST), F.array().cast(_TEXT_LIST)) for c in _LISTS}
    return rows.withColumns(lists | {"payload": F.coalesce(F.from_json("payload", "map<string,string>"), F.create_map().cast("map<string,string>")), "link_status": F.coalesce("link_status", F.lit(""))}).drop("fingerprint", "missed_runs")


_WIRE = (
    "source", "source_job_id", "url", "title", "company", "location_raw", "role_category", "employment_type", "tech_stack", "min_yoe", "max_yoe", "is_new_grad",
    "grad_year", "is_remote", "hiring_regions", "visa_sponsorship", "region_confidence", "region_source", "match_score", "match_reasons", "posted_at", "first_seen_at", "age_days",
)


def to_summary(jobs: DataFrame) -> DataFrame:
    """What a listing sends of a job: its card, whether it is reachable, and what its payload states; empty batch and pay are null, no link state is empty."""
    return jobs.select(
        *_WIRE, F.col("requires_work_auth").alias("work_auth_required"), F.col("deadline").alias("apply_deadline"), is_reachable().alias("reachable_from_india"),
        F.nullif(F.col("yc_batch"), F.lit("")).alias("yc_batch"), "team_size", F.nullif(F.col("pay.label"), F.lit("")).alias("pay"), F.coalesce("link_status", F.lit("")).alias("link_status"),
    )
