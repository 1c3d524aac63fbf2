"""Boards that companies' own pages link to: found, followed one step, held against the registry, and named."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.functions.urls import resolve, site_of

# How a page names a board, by platform; parts of addresses that are no names; what a link to a careers page holds.
BOARD_IN_TEXT = {
    "greenhouse": r"(?i)(?:boards|job-boards)(?:\.eu)?\.greenhouse\.io/(?:embed/job_board(?:/js)?\?for=)?([A-Za-z0-9_-]{2,60})",
    "lever": r"(?i)jobs\.(?:eu\.)?lever\.co/([A-Za-z0-9_.-]{2,60})",
    "ashby": r"(?i)jobs\.ashbyhq\.com/([A-Za-z0-9_.%-]{2,60})",
    "workable": r"(?i)apply\.workable\.com/([A-Za-z0-9_-]{2,60})",
    "smartrecruiters": r"(?i)(?:jobs|careers)\.smartrecruiters\.com/([A-Za-z0-9_-]{2,60})",
    "recruitee": r"(?i)([A-Za-z0-9-]{2,60})\.recruitee\.com",
    "freshteam": r"(?i)([A-Za-z0-9-]{2,60})\.freshteam\.com",
    "keka": r"(?i)([A-Za-z0-9-]{2,60})\.keka\.com/careers",
    "zoho_recruit": r"(?i)([A-Za-z0-9-]{2,60}\.zohorecruit\.(?:in|com|eu))",
    "rippling": r"(?i)ats\.rippling\.com/([A-Za-z0-9_-]{2,60})",
    "gem": r"(?i)jobs\.gem\.com/([A-Za-z0-9_-]{2,60})",
}
NO_BOARDS = ("embed", "jobs", "job", "api", "careers", "apply", "j", "www", "app", "static", "assets", "v1", "o")
CAREERS_LINK = r'(?i)href="([^"#]*(?:career|jobs|job-openings|join-us|joinus|join|work-with-us|workwithus|hiring|open-roles|openings|team#jobs)[^"#]*)"'
#: Careers pages that are read of each site.
MOST_PAGES = 3
#: A site that links to more boards shows its customers': they don't get its name.
OWN_BOARDS = 2

BOARDS = "array<struct<platform:string,slug:string>>"


def find_boards(page: Column) -> Column:
    """The boards that a text names, each once, by platform and order: an array of ``platform, slug``."""
    found = []
    for platform, pattern in BOARD_IN_TEXT.items():
        slug = lambda s: F.regexp_replace(s, r"^\.+|\.+$", "")
        named = F.transform(F.regexp_extract_all(page, F.lit(pattern), F.lit(1)), slug if platform == "zoho_recruit" else lambda s: F.lower(slug(s)))  # noqa: B023
        found.append(F.transform(F.filter(named, lambda s: ~F.lower(s).isin(*NO_BOARDS)), lambda s: F.struct(F.lit(platform).alias("platform"), s.alias("slug"))))  # noqa: B023
    return F.coalesce(F.array_distinct(F.concat(*found)), F.array().cast(BOARDS))


def careers_links(page: Column, url: Column, most: int = MOST_PAGES) -> Column:
    """The first links of a page to careers pages of its own site or a part of it, resolved, each once."""
    links = F.transform(F.regexp_extract_all(page, F.lit(CAREERS_LINK), F.lit(1)), lambda h: resolve(url, h))
    site = site_of(url)
    own = F.filter(links, lambda u: (site_of(u) == site) | F.endswith(site_of(u), F.concat(F.lit("."), site)))
    return F.coalesce(F.slice(F.array_distinct(own), 1, most), F.array().cast("array<string>"))


def scan(sites: DataFrame, pages: DataFrame) -> DataFrame:
    """``website`` and the rest of each site, with ``boards``: what its page, its careers pages and ``prefound`` name.

    sites: ``website`` (unique), ``prefound`` (``BOARDS`` or null) and more; pages: what
    landed, ``url, final_url, html, http_code``, one row a url. A page that failed names none.
    """
    told = pages.where("coalesce(http_code, 0) between 1 and 399").select(F.col("url").alias("at"), F.coalesce("final_url", "url").alias("final"), "html")
    home = sites.select("website").join(told, F.col("website") == F.col("at")).select("website", find_boards(F.col("html")).alias("found"), careers_links(F.col("html"), F.col("final")).alias("links"))
    more = home.select("website", F.explode("links").alias("at")).join(told, "at").select("website", find_boards(F.col("html")).alias("found"))
    found = home.select("website", "found").unionByName(more).groupBy("website").agg(F.flatten(F.collect_list("found")).alias("found"))  # 1 + MOST_PAGES rows a site
    boards = F.array_sort(F.array_distinct(F.concat(F.coalesce("found", F.array().cast(BOARDS)), F.coalesce("prefound", F.array().cast(BOARDS)))))
    return sites.join(found, "website", "left").withColumn("boards", boards).drop("found", "prefound")


def titled(slug: Column) -> Column:
    """A name out of a board's: without ``inc`` or ``hq`` at the end, words in capitals."""
    bare = F.replace(F.regexp_replace(F.substring_index(slug, ".", 1), "(inc|hq)$", ""), F.lit("-"), F.lit(" "))
    return F.array_join(F.transform(F.regexp_extract_all(bare, F.lit("[A-Za-z]+|[^A-Za-z]+"), F.lit(0)), F.initcap), "")


def candidates(scanned: DataFrame, registry: DataFrame) -> DataFrame:
    """``platform, slug, name, website`` of boards that the registry lacks; of sites that share one the last by ``ordinal``."""
    known = registry.where("state <> 'rejected'").select("platform", F.lower("slug").alias("low")).distinct()
    each = scanned.select(F.explode("boards").alias("b"), F.size("boards").alias("n"), "name", "website", "ordinal").select("b.*", "n", "name", "website", "ordinal")
    own = F.col("n") <= OWN_BOARDS
    return (
        each.groupBy("platform", "slug").agg(F.max_by(F.struct("n", "name", "website"), "ordinal").alias("s")).select("platform", "slug", F.lower("slug").alias("low"), "s.*")
        .join(known, ["platform", "low"], "left_anti")
        .select("platform", "slug", F.coalesce(F.when(own, F.col("name")).otherwise(titled(F.col("slug"))), F.col("slug")).alias("name"), F.when(own, F.col("website")).alias("website"))
    )


def new_entries(found: DataFrame, probed: DataFrame, source: str) -> DataFrame:
    """Candidates that answered with openings in India or worldwide, as verified boards: ``platform, slug, tier, name, website, note``."""
    told = found.join(probed.select("platform", "slug", "ok", "india", "intern_india", "worldwide"), ["platform", "slug"]).where("ok and (india > 0 or worldwide > 0)")
    note = F.format_string(f"{source} careers page · India %d, intern %d", "india", "intern_india")
    return told.select("platform", "slug", F.when(F.col("intern_india") > 0, 1).otherwise(2).alias("tier"), "name", "website", note.alias("note"))
