"""Readers of landed responses: one row per HTTP response in, one row per posting out.

A response has ``connector, scope, slug, http_code, body``; a body is one board's
payload, so exploding it stays within a row and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall import vocabulary as v
from rolecall.functions.parsing import html_to_text, moment, parse_iso, regions_from_text, with_india
from rolecall.functions.text import fit_id

# Region by country code, employment type by commitment, words of a listing without borders.
COUNTRY_REGION = {
    "IN": "india", "US": "us", "CA": "canada", "GB": "europe", "UK": "europe", "DE": "europe", "FR": "europe", "NL": "europe", "ES": "europe",
    "PL": "europe", "PT": "europe", "IE": "europe", "SE": "europe", "SG": "apac", "JP": "apac", "AU": "apac", "ID": "apac", "BR": "latam", "MX": "latam", "AE": "emea",
}
COMMITMENT = {
    "full-time": "full_time", "full time": "full_time", "intern": "internship", "internship": "internship",
    "contract": "contract", "part-time": "part_time", "temporary": "contract",
}
BORDERLESS = "worldwide|anywhere|global"

LANDED = "connector string, scope string, slug string, http_code int, body string"

_ARRAY_BOARD = (
    "array<struct<id:string,text:string,categories:struct<location:string,team:string,commitment:string,allLocations:array<string>>,"
    "country:string,workplaceType:string,createdAt:bigint,hostedUrl:string,applyUrl:string,descriptionPlain:string,description:string,additionalPlain:string>>"
)
_JOINED_BOARD = (
    "struct<jobs:array<struct<id:string,title:string,branch_id:string,job_role_id:string,remote:boolean,deleted:boolean,url:string,description:string,created_at:string>>,"
    "branches:array<struct<id:string,location:string,city:string,country_code:string>>,job_roles:array<struct<id:string,name:string>>>"
)


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def _text(c: Column) -> Column:
    """Empty counts as absent."""
    return F.nullif(c, F.lit(""))


def array_items(body: Column) -> Column:
    """The rows of a body that is a bare array; none of any other JSON value; null if it can't be parsed."""
    return F.when(body.rlike(r"^\s*\["), F.from_json(body, _ARRAY_BOARD, {"mode": "PERMISSIVE"})).when(F.try_parse_json(body).isNotNull(), F.array().cast(_ARRAY_BOARD))


def board_status(responses: DataFrame) -> DataFrame:
    """``responses`` with ``status``: no_board (404, 410), failed (other codes, or no JSON), empty or ok.

    A board is empty if its body has no item with an id.
    """
    items = array_items(F.col("body"))
    return responses.withColumn("items", items).withColumn(
        "status",
        F.when(F.col("http_code").isin(404, 410), "no_board").when(F.coalesce(F.col("http_code"), F.lit(0)) != 200, "failed")
        .when(F.try_parse_json("body").isNull(), "failed")
        .when(F.exists(F.coalesce("items", F.array().cast(_ARRAY_BOARD)), lambda x: _text(x["id"]).isNotNull()), "ok").otherwise("empty"),
    )


def covered_scopes(statuses: DataFrame) -> DataFrame:
    """Scopes that were fully read: only their unseen postings may close."""
    return statuses.where("status in ('ok', 'empty')").select("scope").distinct()


def run_coverage(statuses: DataFrame) -> DataFrame:
    """Per connector: boards by status, and whether the run found anything."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return statuses.groupBy("connector").agg(
        n("ok"), n("empty"), n("no_board"), n("failed"), F.sum(F.when(F.col("status") == "ok", F.size("items")).otherwise(0)).alias("found"),
        F.count_if(F.col("status").isin("ok", "empty")).alias("covered"),
    )


def read_array_board(responses: DataFrame) -> DataFrame:
    """Postings of boards whose payload is a bare array with nested categories and a time in milliseconds."""
    item = board_status(responses).where("status = 'ok'").select("connector", "scope", "slug", F.explode("items").alias("i")).where(_text(F.col("i.id")).isNotNull())
    i = F.col("i")
    cats = i["categories"]
    commitment, workplace = F.lower(cats["commitment"]), F.lower(i["workplaceType"])
    blob = F.lower(F.concat_ws(" ", cats["location"], cats["allLocations"]))
    none = F.array().cast("array<string>")
    by_country = _lookup(COUNTRY_REGION, F.upper(F.coalesce(i["country"], F.lit(""))))
    regions = F.concat(
        F.when(blob.rlike(BORDERLESS), F.array(F.lit("worldwide"))).otherwise(none), F.when(by_country.isNotNull(), F.array(by_country)).otherwise(none),
        F.when(blob.contains("india") & F.coalesce(by_country != "india", F.lit(True)), F.array(F.lit("india"))).otherwise(none),
    )
    return item.select(
        F.col("connector").alias("source"), fit_id(F.concat_ws(":", "slug", i["id"])).alias("source_job_id"), "scope",
        F.coalesce(_text(i["hostedUrl"]), i["applyUrl"], F.lit("")).alias("url"), F.coalesce(i["text"], F.lit("")).alias("title"), F.col("slug").alias("company"),
        F.coalesce(_text(i["descriptionPlain"]), _text(i["description"]), i["additionalPlain"], F.lit("")).alias("description"), _text(cats["location"]).alias("location_raw"),
        F.filter(F.array(cats["team"], commitment, workplace), lambda x: F.coalesce(x, F.lit("")) != "").alias("tags"),
        F.when(i["createdAt"] != 0, moment(i["createdAt"], 1000)).alias("posted_at"),
        F.when(F.size(regions) == 0, F.array(F.lit("unknown"))).otherwise(regions).alias("hiring_regions_hint"),
        F.coalesce(_lookup(COMMITMENT, F.coalesce(commitment, F.lit(""))), F.lit("unknown")).alias("employment_type_hint"),
    )


def read_joined_board(responses: DataFrame) -> DataFrame:
    """Postings of boards whose payload holds jobs, branches and roles, joined inside the row by map lookups."""
    board = responses.where("http_code = 200").select("connector", "scope", "slug", F.from_json("body", _JOINED_BOARD).alias("b"))

    def by_id(items: Column, value) -> Column:
        """A map from id to value; of equal ids the last counts."""
        good = F.filter(items, lambda x: x["id"].isNotNull())
        last = F.filter(good, lambda x, k: ~F.exists(F.slice(good, k + 2, F.size(good)), lambda y: y["id"] == x["id"]))
        return F.map_from_entries(F.transform(last, lambda x: F.struct(x["id"], value(x))))

    held = board.select("connector", "scope", "slug", F.explode("b.jobs").alias("j"), by_id(F.col("b.branches"), lambda x: x).alias("branches"), by_id(F.col("b.job_roles"), lambda x: x["name"]).alias("roles"))
    j = F.col("j")
    branch = F.try_element_at(F.col("branches"), j["branch_id"])
    place = F.coalesce(_text(branch["location"]), branch["city"], F.lit(""))
    title = F.trim(F.coalesce(j["title"], F.lit("")))
    return held.where(_text(j["id"]).isNotNull() & ~F.coalesce(j["deleted"], F.lit(False))).select(
        F.col("connector").alias("source"), fit_id(F.concat_ws(":", "slug", j["id"])).alias("source_job_id"), "scope", title.alias("title"), F.col("slug").alias("company"),
        _text(F.concat(place, F.when(j["remote"], " · Remote").otherwise(""))).alias("location_raw"),
        F.coalesce(_text(j["url"]), F.concat(F.lit("https://"), "slug", F.lit(".freshteam.com/jobs"))).alias("url"), html_to_text(j["description"]).alias("description"),
        F.array_compact(F.array(_text(F.try_element_at(F.col("roles"), j["job_role_id"])))).alias("tags"), (branch["country_code"] == "IN").alias("in_india"),
        with_india(regions_from_text(place), branch["country_code"] == "IN", alone=True).alias("hiring_regions_hint"),
        F.when(title.rlike(v.INTERN), "internship").otherwise("unknown").alias("employment_type_hint"), parse_iso(j["created_at"]).alias("posted_at"),
    )
