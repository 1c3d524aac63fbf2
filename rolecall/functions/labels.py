"""Labels and hints by threshold, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Least years of experience by a board's level.
LEVEL_YOE = {"internship": 0, "student": 0, "entry_level": 0, "associate": 1, "mid_senior_level": 3, "director": 8, "executive": 10}
# Fixed value: the batch mark that may close a title.
BATCH_MARK = r"\s*\(YC [A-Z]\d{2}\)\s*$"


def level_yoe(level: Column) -> Column:
    """Least years of a level; null for any other."""
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in LEVEL_YOE.items() for x in pair)), level)


def strip_batch(title: Column) -> Column:
    """A title without its closing "(YC S24)"."""
    return F.regexp_replace(title, BATCH_MARK, "")


def age_label(posted_at: Column, first_seen_at: Column, as_of: Column) -> Column:
    """When a posting was posted, or found, in words; null without either time."""
    days = F.greatest(F.timestamp_diff("DAY", F.coalesce(posted_at, first_seen_at), as_of), F.lit(0))
    said = (
        F.when(days == 0, "today").when(days == 1, "yesterday").when(days < 60, F.concat(days.cast("string"), F.lit(" days ago")))
        .when(days < 365, F.concat(F.floor(days / 30).cast("string"), F.lit(" months ago"))).when(days.isNotNull(), "over a year ago")
    )
    return F.concat(F.when(posted_at.isNotNull(), "Posted ").otherwise("Found "), said)


def deadline_label(deadline: Column, as_of: Column) -> Column:
    """The closing day; null without one or once it has passed."""
    days = F.ceil(F.timestamp_diff("SECOND", as_of, deadline) / 86400)
    return F.when(days == 0, "Closes today").when(days > 0, F.concat(F.lit("Apply by "), F.date_format(deadline, "d MMM")))


def experience_label(min_yoe: Column, max_yoe: Column, is_new_grad: Column) -> Column:
    """Years of experience asked for, in words."""
    years = F.when((max_yoe != 0) & (max_yoe > min_yoe), F.concat_ws("-", min_yoe, max_yoe)).otherwise(F.concat(min_yoe.cast("string"), F.lit("+")))
    one = (min_yoe == 1) & (F.coalesce(max_yoe, F.lit(0)) == 0)
    return (
        F.when((min_yoe == 0) | (min_yoe.isNull() & F.coalesce(is_new_grad, F.lit(False))), "0 yrs · freshers ok").when(min_yoe.isNull(), "Experience not stated")
        .otherwise(F.concat(years, F.when(one, " yr").otherwise(" yrs"), F.lit(" experience")))
    )


def slug_variants(slug: Column, name: Column, website: Column) -> Column:
    """Names under which a company's board may stand: its slug, its squashed name, its host; 2 to 40 characters."""
    squashed = F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
    host = F.regexp_extract(F.lower(website), r"https?://(?:www\.)?([a-z0-9-]+)\.", 1)
    return F.filter(F.array_distinct(F.array_compact(F.array(slug, squashed, host))), lambda s: F.length(s).between(2, 40))
