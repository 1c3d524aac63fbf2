"""The registry of boards as a table: reading it, discovering names, and what a check of candidates changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# How a board's name stands in a URL, by platform; path parts that are no names; the platform whose empty answers prove nothing.
NAME_IN_URL = {
    "greenhouse": r"boards\.greenhouse\.io/([A-Za-z0-9_-]{2,40})", "lever": r"jobs\.lever\.co/([A-Za-z0-9_-]{2,40})", "ashby": r"jobs\.ashbyhq\.com/([A-Za-z0-9_-]{2,40})",
    "workable": r"apply\.workable\.com/([A-Za-z0-9_-]{2,40})", "freshteam": r"([A-Za-z0-9-]{2,40})\.freshteam\.com", "recruitee": r"([A-Za-z0-9-]{2,40})\.recruitee\.com", "keka": r"([A-Za-z0-9-]{2,40})\.keka\.com",
    "zoho_recruit": r"([A-Za-z0-9-]{2,40}\.zohorecruit\.(?:in|com|eu))", "gem": r"jobs\.gem\.com/([A-Za-z0-9_-]{2,40})", "rippling": r"ats\.rippling\.com/([A-Za-z0-9_-]{2,40})", "smartrecruiters": r"jobs\.smartrecruiters\.com/([A-Za-z0-9_-]{2,40})",
}
NO_NAMES = (
    "embed", "jobs", "job", "api", "v1", "board", "boards", "search", "assets", "static", "css", "js", "img", "images", "favicon.ico", "robots.txt", "sitemap.xml", "login", "signup", "apply", "oauth",
    "en-us", "en", "www", "careers", "company", "companies",
)
NEVER_MISSING = "smartrecruiters"
DEFAULT_TIER = 2

#: A registry document's platform: verified boards are names or objects.
BLOCK = "struct<verified:array<variant>,candidates:array<string>,rejected:array<string>>"
#: A board: verified, candidate or rejected.
REGISTRY = "platform string, slug string, tier int, note string, state string"


def explode_registry(documents: DataFrame) -> DataFrame:
    """``REGISTRY`` rows of ``platform, body``, a block of JSON each. A candidate or rejection that is verified isn't listed again."""
    block = documents.select("platform", F.from_json("body", BLOCK).alias("b"))
    entry = block.select("platform", F.explode("b.verified").alias("e"))
    named = F.coalesce(F.try_variant_get("e", "$.slug", "string"), F.try_variant_get("e", "$", "string"))
    plain = F.schema_of_variant("e") == "STRING"
    verified = entry.select(
        "platform", named.alias("slug"), F.coalesce(F.try_variant_get("e", "$.tier", "int"), F.lit(DEFAULT_TIER)).alias("tier"), F.when(~plain, F.try_variant_get("e", "$.note", "string")).alias("note"), F.lit("verified").alias("state"),
    ).dropDuplicates(["platform", "slug"])
    found = verified
    for state, field in (("candidate", "candidates"), ("rejected", "rejected")):
        more = block.select("platform", F.explode(f"b.{field}").alias("slug")).distinct().select("platform", "slug", F.lit(DEFAULT_TIER).alias("tier"), F.lit(None).cast("string").alias("note"), F.lit(state).alias("state"))
        found = found.unionByName(more.join(found.select("platform", "slug"), ["platform", "slug"], "left_anti"))
    return found


def companies_for(registry: DataFrame, platform: str, tier: int | None = None) -> DataFrame:
    """The platform's verified boards up to a tier."""
    own = registry.where((F.col("platform") == platform) & (F.col("state") == "verified"))
    return own if tier is None else own.where(F.col("tier") <= tier)


def name_in_url(url: Column, platform: Column) -> Column:
    """The board that a URL names, in lower case; null if it names none."""
    found = None
    for key, pattern in NAME_IN_URL.items():
        name = F.lower(F.regexp_extract(url, pattern, 1))
        found = F.when(platform == key, name) if found is None else found.when(platform == key, name)
    return F.when((found != "") & ~found.isin(*NO_NAMES) & ~found.rlike(r"^\d+$"), found)


def discover(urls: DataFrame) -> DataFrame:
    """``platform, slug, n``: names in ``platform, url``, with how many URLs hold them."""
    named = urls.select("platform", name_in_url(F.col("url"), F.col("platform")).alias("slug")).where("slug is not null")
    return named.groupBy("platform", "slug").agg(F.count("*").alias("n"))


def add_discovered(registry: DataFrame, found: DataFrame) -> DataFrame:
    """The registry with found names that it doesn't know, not even as rejected, as candidates."""
    new = found.select("platform", "slug").distinct().join(registry.select("platform", "slug"), ["platform", "slug"], "left_anti")
    return registry.unionByName(new.select("platform", "slug", F.lit(DEFAULT_TIER).alias("tier"), F.lit(None).cast("string").alias("note"), F.lit("candidate").alias("state")))


def validate(registry: DataFrame, checked: DataFrame) -> DataFrame:
    """The registry after candidates were tried: ``checked`` has ``platform, slug, status, jobs``, one row a board.

    One that answers with postings is verified, with a note of how many. One that
    doesn't exist is rejected, so that it isn't tried again; so is an empty one of
    the platform that answers for any name. Failures and verified boards change nothing.
    """
    tried = registry.join(checked.select("platform", "slug", "status", "jobs"), ["platform", "slug"], "left")
    candidate = F.col("state") == "candidate"
    found = candidate & (F.col("status") == "ok")
    missing = candidate & ((F.col("status") == "no_board") | ((F.col("status") == "empty") & (F.col("platform") == NEVER_MISSING)))
    return tried.withColumns({
        "note": F.when(found, F.concat(F.col("jobs").cast("string"), F.lit(" jobs"))).otherwise(F.col("note")),
        "state": F.when(found, "verified").when(missing, "rejected").otherwise(F.col("state")),
    }).select("platform", "slug", "tier", "note", "state")
