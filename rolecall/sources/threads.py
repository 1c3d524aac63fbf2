"""Postings in the comments of a monthly thread, whose first line is ``Company | Role | Location``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.functions import parsing as p
from rolecall.sources.boards import with_once

# What divides a header, what a role and a place look like, and the limits of a header, its parts, a comment and a thread's age.
DIVIDERS = r"\s*(?:\||–|—| - |•)\s*"
LINK = r"""https?://[^\s<>"')]+"""
ROLE_HINT = r"(?i)\b(engineer|developer|dev|swe|sde|scientist|architect|designer|programmer|analyst|intern|manager|lead|sre|devops|founding)\b"
PLACE_HINT = r"(?i)\b(remote|onsite|on-site|hybrid|worldwide|anywhere|[A-Z][a-z]+,\s*[A-Z]{2}\b|SF|NYC|bay\s+area|san\s+francisco|new\s+york|london|berlin|bangalore|toronto|austin|seattle)\b"
REGION_WORDS = (("emea", "emea"), ("europe", "europe"), ("apac", "apac"), ("india", "india"), ("canada", "canada"), ("latam", "latam"))
HEADER_CHARS, PART_CHARS, LEAST_CHARS, THREAD_DAYS = 400, 120, 40, 75


def split_header(text: Column) -> Column:
    """A struct ``company, role, location``: the first part is the company, then the first part that looks like a role, then all other parts that look like places."""
    head = F.substring(F.element_at(F.split(text, "\n", 2), 1), 1, HEADER_CHARS)
    parts = F.filter(F.transform(F.split(head, DIVIDERS), F.trim), lambda x: x != "")
    rest = F.filter(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda x: ~x.rlike(LINK) & (F.length(x) <= PART_CHARS))
    at = F.array_position(F.transform(rest, lambda x: x.rlike(ROLE_HINT)), F.lit(True))
    places = F.filter(rest, lambda x, i: x.rlike(PLACE_HINT) & (i + 1 != at))
    empty = F.lit("")
    return F.struct(
        F.coalesce(F.try_element_at(parts, F.lit(1)), empty).alias("company"), F.coalesce(F.when(at > 0, F.try_element_at(rest, at.cast("int"))), empty).alias("role"), F.array_join(places, " | ").alias("location"),
    )


def regions(text: Column) -> Column:
    """Regions that a comment names; a bare "remote" tells nothing."""
    low = F.lower(text)
    wide = low.rlike(r"remote\s*\(?\s*(worldwide|global|anywhere)") | low.contains("remote worldwide")
    us = low.rlike(r"remote\s*\(?\s*(us|usa|united states)\b") | low.contains("us only")
    return p.regions_of(("worldwide", wide), ("us", us), *((region, low.contains(word)) for word, region in REGION_WORDS))


def newest_thread(stories: DataFrame, as_of: str) -> DataFrame:
    """The newest hiring thread of ``object_id, title, created_at``; none if it is older than ``THREAD_DAYS``."""
    title = F.lower("title")
    named = stories.where(title.contains("who is hiring") & ~title.contains("hiring right now"))
    newest = named.agg(F.max_by("object_id", F.struct("created_at", "object_id")).alias("thread"), F.max("created_at").alias("created_at"))
    return newest.where(F.col("created_at") >= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(THREAD_DAYS))).select("thread")


def read_comments(comments: DataFrame, threads: DataFrame) -> DataFrame:
    """Postings among ``object_id, parent_id, comment_text, created_at``: top-level comments with a company and a role in their header.

    ``threads`` is one row at most, so Spark broadcasts it.
    """
    body = F.coalesce(p.html_to_text(F.col("comment_text"), escaped=False, by=" "), F.lit(""))
    top = comments.join(threads, F.col("parent_id") == F.col("thread"), "left_semi")
    top = with_once(top, "body", body).where(F.length("body") >= LEAST_CHARS)
    found = with_once(top, "h", split_header(F.col("body"))).where("h.company <> '' and h.role <> ''")
    link = F.regexp_extract("comment_text", LINK, 0)
    return found.select(
        F.lit("hn_hiring").alias("source"), F.col("object_id").alias("source_job_id"), F.when(link != "", link).otherwise(F.concat(F.lit("https://news.ycombinator.com/item?id="), "object_id")).alias("url"),
        F.col("h.role").alias("title"), F.col("h.company").alias("company"), F.col("body").alias("description"), F.nullif("h.location", F.lit("")).alias("location_raw"), F.col("created_at").alias("posted_at"),
        regions(F.col("body")).alias("hiring_regions_hint"), F.when(F.col("body").rlike(r"(?i)\bintern(ship)?\b"), "internship").otherwise("unknown").alias("employment_type_hint"),
    )
