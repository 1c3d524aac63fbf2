"""Readers of landed JSON and RSS responses: one response in, one row per posting out.

Each source says where its items lie in the payload and how an item's fields become a
raw posting; ``read`` does the rest, so that a new source is one more entry here. An
item is exploded within its response's row: reading needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.functions import parsing as p
from rolecall.functions.parsing import text
from rolecall.functions.text import fit_id, parse_relative_posted

#: A response and what the registry says of its scope: ``host`` and ``name``, null if unknown.
RESPONSE = "connector string, scope string, slug string, http_code int, body string, host string, name string"
#: What every reader gives.
POSTING = ("source", "source_job_id", "scope", "url", "title", "company", "description", "location_raw", "tags", "salary_raw", "posted_at", "hiring_regions_hint", "employment_type_hint", "min_yoe_hint")

# Regions by country code or by parts of a place name, in order; employment types by the sources' own names.
SMART_COUNTRY = {
    "in": "india", "us": "us", "ca": "canada", "gb": "europe", "uk": "europe", "de": "europe", "fr": "europe", "nl": "europe", "es": "europe",
    "pl": "europe", "pt": "europe", "ie": "europe", "it": "europe", "sg": "apac", "jp": "apac", "au": "apac", "id": "apac", "br": "latam", "mx": "latam", "ae": "emea",
}
SMART_TYPES = {"permanent": "full_time", "full_time": "full_time", "intern": "internship", "internship": "internship", "temporary": "contract", "contractor": "contract", "part_time": "part_time"}
SMART_YOE = {"internship": 0, "student": 0, "entry_level": 0, "associate": 1, "mid_senior_level": 3, "director": 8, "executive": 10}
GREENHOUSE_WORDS = (
    ("india", ("india", "bengaluru", "bangalore", "hyderabad", "pune", "chennai", "mumbai", "gurgaon", "noida", "delhi", "kolkata")),
    ("worldwide", ("worldwide", "anywhere", "global", "remote - global")),
    ("us", ("united states", "usa", ", ca", ", ny", ", tx", ", wa", ", ma", "san francisco", "new york")),
    ("europe", ("united kingdom", "uk", "london", "ireland", "dublin", "germany", "berlin", "munich", "france", "paris", "netherlands", "amsterdam", "spain", "poland", "portugal", "europe")),
    ("apac", ("singapore", "japan", "tokyo", "australia", "sydney", "apac")),
    ("canada", ("canada", "toronto", "vancouver")),
)
ASHBY_WORDS = (
    ("india", ("india", "bengaluru", "bangalore", "hyderabad", "pune", "chennai", "mumbai", "gurgaon", "noida", "delhi")),
    ("worldwide", ("worldwide", "anywhere", "global", "remote - global")),
    ("us", ("united states", "usa", "san francisco", "new york", "seattle", "austin", "boston")),
    ("europe", ("united kingdom", "london", "germany", "berlin", "france", "paris", "netherlands", "amsterdam", "ireland", "dublin", "europe", "spain", "poland")),
    ("apac", ("singapore", "tokyo", "japan", "sydney", "australia", "apac")),
    ("canada", ("canada", "toronto", "vancouver")),
    ("latam", ("brazil", "mexico", "latam", "argentina")),
)
ASHBY_TYPES = {"fulltime": "full_time", "full_time": "full_time", "intern": "internship", "internship": "internship", "contract": "contract", "parttime": "part_time", "temporary": "contract"}
REMOTEOK_WORDS = (
    ("worldwide", "worldwide"), ("anywhere", "worldwide"), ("united states", "us"), ("usa", "us"), ("us only", "us"), ("canada", "canada"), ("emea", "emea"),
    ("europe", "europe"), ("apac", "apac"), ("asia", "apac"), ("india", "india"), ("latam", "latam"),
)
WWR_WORDS = (
    ("anywhere", "worldwide"), ("worldwide", "worldwide"), ("global", "worldwide"), ("india", "india"), ("asia", "apac"), ("apac", "apac"), ("usa", "us"),
    ("united states", "us"), ("north america", "us"), ("canada", "canada"), ("europe", "europe"), ("uk", "europe"), ("emea", "emea"), ("latam", "latam"),
)
JOBICY_WORDS = (
    ("anywhere", "worldwide"), ("worldwide", "worldwide"), ("global", "worldwide"), ("india", "india"), ("asia", "apac"), ("apac", "apac"), ("usa", "us"), ("united states", "us"),
    ("canada", "canada"), ("europe", "europe"), ("uk", "europe"), ("united kingdom", "europe"), ("germany", "europe"), ("emea", "emea"), ("latam", "latam"), ("latin america", "latam"),
)
JOBICY_TYPES = {"full-time": "full_time", "full time": "full_time", "internship": "internship", "intern": "internship", "contract": "contract", "part-time": "part_time"}
HIMALAYAS_WORDS = (
    ("worldwide", "worldwide"), ("anywhere", "worldwide"), ("united states", "us"), ("usa", "us"), ("canada", "canada"), ("emea", "emea"), ("europe", "europe"),
    ("united kingdom", "europe"), ("germany", "europe"), ("asia", "apac"), ("apac", "apac"), ("india", "india"), ("latin america", "latam"), ("latam", "latam"),
)
HIMALAYAS_TYPES = {"full-time": "full_time", "full time": "full_time", "internship": "internship", "contract": "contract", "part-time": "part_time"}
REMOTIVE_WORDS = (
    ("worldwide", "worldwide"), ("anywhere", "worldwide"), ("usa", "us"), ("united states", "us"), ("canada", "canada"), ("emea", "emea"), ("europe", "europe"),
    ("uk", "europe"), ("apac", "apac"), ("asia", "apac"), ("india", "india"), ("latam", "latam"), ("latin america", "latam"),
)
REMOTIVE_TYPES = {"full_time": "full_time", "internship": "internship", "contract": "contract", "part_time": "part_time", "freelance": "contract"}
ARBEITNOW_EUROPE = ("germany", "berlin", "munich", "netherlands", "amsterdam", "france", "paris", "spain", "poland", "portugal")
LATERAL_RANKS = ("Associate", "Vice President", "Managing Director")


class Source(NamedTuple):
    """``payload`` is the schema, with the item's in the place of ``%``; ``items`` finds them; ``row`` maps an item, given its response, to fields.

    ``cut`` takes the payload out of a body that holds more, null if there is none, which
    is ``without``. ``parse`` reads items that no schema describes.
    """

    payload: str
    item: str
    items: Callable[[Column], Column]
    keep: Callable[[Column], Column]
    row: Callable[[Column], dict[str, Column]]
    cut: Callable[[Column], Column] | None = None
    without: str = "failed"
    parse: Callable[[Column], Column] | None = None


def _slug() -> Column:
    return F.col("slug")


def _host() -> Column:
    return F.col("host")


def _in(name: str) -> Callable[[Column], Column]:
    return lambda body: body[name]


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), F.coalesce(key, F.lit("")))


def _kind(table: dict[str, str], key: Column) -> Column:
    return F.coalesce(_lookup(table, key), F.lit("unknown"))


def _intern(title: Column, *also: Column, pattern: str = p.INTERN_TITLE) -> Column:
    found = F.coalesce(title.rlike(pattern), F.lit(False))
    for condition in also:
        found = found | F.coalesce(condition, F.lit(False))
    return F.when(found, "internship").otherwise("unknown")


def _some(*parts: Column) -> Column:
    """The parts that hold text."""
    return F.filter(F.array(*parts), lambda x: F.coalesce(x, F.lit("")) != "")


def _all(items: Column) -> Column:
    return F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.coalesce(x, F.lit("")) != "")


def _joined(parts: Column, by: str) -> Column:
    return F.array_join(_all(parts), by)


def _remote(place: Column, remote: Column) -> Column:
    return text(F.concat(F.coalesce(place, F.lit("")), F.when(F.coalesce(remote, F.lit(False)), " · Remote").otherwise("")))


def _own(i: Column, name: str = "id") -> Column:
    return F.concat_ws(":", _slug(), i[name])


def _by_words(place: Column, groups: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    return p.regions_by_words(place, tuple((word, region) for region, words in groups for word in words))


def _blank_is_worldwide(place: Column, blank: tuple[str, ...], words: tuple[tuple[str, str], ...]) -> Column:
    low = F.trim(F.lower(F.coalesce(place, F.lit(""))))
    return F.when(low.isin("", *blank), F.array(F.lit("worldwide"))).otherwise(p.regions_by_words(place, words))


def _has(i: Column, *names: str) -> Column:
    found = F.lit(True)
    for name in names:
        found = found & text(i[name]).isNotNull()
    return found


def _greenhouse(i: Column) -> dict[str, Column]:
    offices = F.transform(F.coalesce(i["offices"], F.array().cast("array<struct<name:string>>")), lambda o: F.coalesce(o["name"], F.lit("")))
    place = F.coalesce(i["location"]["name"], F.lit(""))
    board = F.trim(F.regexp_replace(i["company_name"], r"(?i)\s*[-|:]?\s*(job\s*board|careers?|jobs)\s*$", ""))
    return {
        "source_job_id": _own(i), "url": i["absolute_url"], "title": i["title"], "company": F.coalesce(text(board), text(i["company_name"]), _slug()),
        "description": p.html_to_text(i["content"]), "location_raw": F.coalesce(text(place), text(F.array_join(offices, ", "))),
        "tags": F.transform(i["departments"], lambda d: F.coalesce(d["name"], F.lit(""))), "posted_at": F.coalesce(p.parse_iso(i["first_published"]), p.parse_iso(i["updated_at"])),
        "hiring_regions_hint": _by_words(F.concat_ws(" ", place, offices), GREENHOUSE_WORDS), "employment_type_hint": _intern(i["title"], pattern=p.INTERN_TITLE_PLURAL),
    }


def _ashby(i: Column) -> dict[str, Column]:
    others = F.transform(F.coalesce(i["secondaryLocations"], F.array().cast("array<struct<location:string>>")), lambda s: F.coalesce(s["location"], F.lit("")))
    places = F.concat(F.array(F.coalesce(i["location"], F.lit(""))), others)
    return {
        "source_job_id": _own(i), "url": F.coalesce(text(i["applyUrl"]), i["jobUrl"]), "title": i["title"], "description": F.coalesce(text(i["descriptionPlain"]), i["descriptionHtml"]),
        "location_raw": text(_joined(places, ", ")), "tags": _some(i["department"], i["team"], i["workplaceType"]), "posted_at": p.parse_iso(i["publishedAt"]),
        "salary_raw": F.coalesce(text(i["compensation"]["compensationTierSummary"]), text(i["compensation"]["summary"])),
        "hiring_regions_hint": _by_words(F.array_join(places, " "), ASHBY_WORDS), "employment_type_hint": _kind(ASHBY_TYPES, F.replace(F.lower(i["employmentType"]), F.lit(" "), F.lit(""))),
    }


def _smartrecruiters(i: Column) -> dict[str, Column]:
    loc = i["location"]
    place = F.coalesce(text(loc["fullLocation"]), _joined(F.array(loc["city"], loc["region"], loc["country"]), ", "))
    region = _lookup(SMART_COUNTRY, F.lower(loc["country"]))
    return {
        "source_job_id": _own(i), "url": F.concat(F.lit("https://jobs.smartrecruiters.com/"), _slug(), F.lit("/"), i["id"]), "title": i["name"], "company": F.coalesce(text(i["company"]["name"]), _slug()),
        "location_raw": _remote(place, loc["remote"]), "tags": _some(i["department"]["label"], i["function"]["label"], i["industry"]["label"]), "posted_at": p.parse_iso(i["releasedDate"]),
        "hiring_regions_hint": F.array(F.coalesce(region, F.lit("unknown"))), "employment_type_hint": _kind(SMART_TYPES, F.lower(i["typeOfEmployment"]["id"])),
        "min_yoe_hint": _lookup(SMART_YOE, i["experienceLevel"]["id"]),
    }


def _workable_boards(i: Column) -> dict[str, Column]:
    many = F.array_join(F.transform(i["locations"], lambda x: _joined(F.array(x["city"], x["region"], x["country"]), ", ")), "; ")
    place = F.coalesce(text(many), _joined(F.array(i["city"], i["state"], i["country"]), ", "))
    kind = _intern(i["title"], F.lower(i["employment_type"]).contains("intern"))
    return {
        "source_job_id": _own(i, "shortcode"), "url": F.coalesce(text(i["url"]), i["shortlink"]), "title": i["title"], "description": p.html_to_text(i["description"]),
        "location_raw": _remote(place, i["telecommuting"]), "tags": _some(i["department"], i["function"], i["experience"]), "posted_at": p.parse_iso(F.coalesce(text(i["published_on"]), i["created_at"])),
        "hiring_regions_hint": p.with_india(p.regions_from_text(place), F.exists(i["locations"], lambda x: x["countryCode"] == "IN"), alone=False), "employment_type_hint": kind,
        "min_yoe_hint": F.when((kind == "internship") | i["experience"].isin("Entry level", "Internship"), 0),
    }


def _recruitee(i: Column) -> dict[str, Column]:
    kind = _intern(i["title"], i["employment_type_code"].contains("intern"))
    stamp = lambda c: F.when(c.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d UTC$"), F.try_to_timestamp(F.substr(c, F.lit(1), F.lit(19)))).cast("timestamp_ntz")
    return {
        "source_job_id": _own(i), "url": F.coalesce(text(i["careers_url"]), F.concat(F.lit("https://"), _slug(), F.lit(".recruitee.com/o/"), i["slug"])), "title": i["title"],
        "company": F.coalesce(text(i["company_name"]), _slug()), "description": text(_joined(F.array(p.html_to_text(i["description"]), p.html_to_text(i["requirements"])), "\n\n")),
        "location_raw": _remote(i["location"], i["remote"]), "tags": _all(F.concat(F.array(i["department"]), F.coalesce(i["tags"], F.array().cast("array<string>")))),
        "posted_at": stamp(F.coalesce(text(i["published_at"]), i["created_at"])), "employment_type_hint": kind,
        "hiring_regions_hint": p.with_india(p.regions_from_text(i["location"]), i["country_code"] == "IN", alone=True),
        "min_yoe_hint": F.when((kind == "internship") | (i["experience_code"] == "entry_level"), 0),
    }


def _gem(i: Column) -> dict[str, Column]:
    offices = F.transform(F.coalesce(i["offices"], F.array().cast("array<struct<name:string,location:struct<name:string>>>")), lambda o: F.coalesce(text(o["location"]["name"]), o["name"], F.lit("")))
    place = _joined(F.concat(F.array(i["location"]["name"]), offices), "; ")
    return {
        "source_job_id": _own(i), "url": i["absolute_url"], "title": i["title"], "description": i["content_plain"], "location_raw": _remote(place, i["location_type"] == "remote"),
        "tags": _all(F.transform(i["departments"], lambda d: d["name"])), "posted_at": p.parse_iso(F.coalesce(text(i["first_published_at"]), i["created_at"])),
        "hiring_regions_hint": p.regions_from_text(place), "employment_type_hint": _intern(i["title"], i["employment_type"].contains("intern")),
    }


def _rippling(i: Column) -> dict[str, Column]:
    place = F.array_join(F.transform(i["locations"], lambda x: F.coalesce(text(x["name"]), x["country"], F.lit(""))), "; ")
    return {
        "source_job_id": _own(i), "url": i["url"], "title": i["name"], "location_raw": _remote(place, F.exists(i["locations"], lambda x: x["workplaceType"] == "REMOTE")),
        "tags": _some(i["department"]["name"]), "hiring_regions_hint": p.with_india(p.regions_from_text(place), F.exists(i["locations"], lambda x: x["countryCode"] == "IN"), alone=False),
        "employment_type_hint": _intern(i["name"]),
    }


def _workday(i: Column) -> dict[str, Column]:
    site = F.element_at(F.split("scope", ":"), -1)
    return {
        "source_job_id": F.concat_ws(":", _slug(), site, i["externalPath"]), "url": F.concat(_host(), F.lit("/"), site, i["externalPath"]), "title": i["title"],
        "company": F.initcap(F.replace(_slug(), F.lit("-"), F.lit(" "))), "location_raw": text(i["locationsText"]), "tags": i["bulletFields"], "posted_on": i["postedOn"],
        "hiring_regions_hint": p.regions_from_text(F.concat_ws(" ", F.coalesce(i["locationsText"], F.lit("")), i["title"])),
        "employment_type_hint": F.when(i["title"].rlike(r"(?i)\b(intern|internship|co-?op|apprentice|trainee)\b"), "internship").otherwise("unknown"),
    }


def _oracle(i: Column) -> dict[str, Column]:
    site = F.element_at(F.split("scope", ":"), -1)
    return {
        "source_job_id": _own(i, "Id"), "url": F.concat(F.lit("https://"), _host(), F.lit("/hcmUI/CandidateExperience/en/sites/"), site, F.lit("/job/"), i["Id"]), "title": i["Title"],
        "description": i["ShortDescriptionStr"], "location_raw": text(i["PrimaryLocation"]), "tags": _some(i["JobFamily"], i["WorkerType"]), "posted_at": p.parse_iso(i["PostedDate"]),
        "hiring_regions_hint": p.with_india(p.regions_from_text(i["PrimaryLocation"]), i["PrimaryLocationCountry"] == "IN", alone=True),
        "employment_type_hint": F.when(i["Title"].rlike(r"(?i)\b(intern|internship|trainee|apprentice|summer\s+analyst)\b"), "internship").otherwise("unknown"),
    }


def _ibm(i: Column) -> dict[str, Column]:
    s = i["_source"]
    return {
        "source_job_id": F.when(s["url"].contains("jobId="), F.substring_index(s["url"], "jobId=", -1)).otherwise(i["_id"]), "url": s["url"], "title": s["title"], "company": F.lit("IBM"),
        "description": p.html_to_text(s["description"]), "location_raw": _joined(F.array(s["field_keyword_19"], F.lit("India")), ", "), "tags": _some(s["field_keyword_08"], s["field_keyword_18"]),
        "posted_at": p.parse_iso(s["dcdate"]), "hiring_regions_hint": F.array(F.lit("india")), "employment_type_hint": F.when(F.lower(s["field_keyword_18"]).contains("intern"), "internship").otherwise("unknown"),
    }


def _amazon(i: Column) -> dict[str, Column]:
    place = F.coalesce(text(i["normalized_location"]), i["location"])
    intern = F.coalesce(i["is_intern"], F.lit(False)) | F.coalesce(F.lower(i["title"]).contains("intern"), F.lit(False))
    part = lambda head, c: F.when(text(c).isNotNull(), F.concat(F.lit(head), p.html_to_text(c)))
    day = F.regexp_replace(F.trim(i["posted_date"]), r"\s+", " ")
    return {
        "source_job_id": i["id_icims"], "url": F.concat(F.lit("https://www.amazon.jobs"), F.coalesce(i["job_path"], F.lit(""))), "title": i["title"],
        "company": F.when(F.lower(i["company_name"]).contains("web services"), "Amazon Web Services").otherwise("Amazon"),
        "description": text(_joined(F.array(p.html_to_text(i["description"]), part("Basic qualifications\n", i["basic_qualifications"]), part("Preferred qualifications\n", i["preferred_qualifications"])), "\n\n")),
        "location_raw": text(place), "tags": _some(i["job_category"], i["business_category"]), "posted_at": F.try_to_timestamp(day, F.lit("MMMM d, yyyy")).cast("timestamp_ntz"),
        "hiring_regions_hint": p.with_india(p.regions_from_text(place), i["country_code"] == "IND", alone=True), "employment_type_hint": F.when(intern, "internship").otherwise("unknown"),
        "min_yoe_hint": F.when(intern | F.coalesce(i["university_job"], F.lit(False)), 0),
    }


def _microsoft(i: Column) -> dict[str, Column]:
    place = F.array_join(i["locations"], "; ")
    return {
        "source_job_id": i["id"], "url": F.concat(F.lit("https://apply.careers.microsoft.com"), F.coalesce(text(i["positionUrl"]), F.concat(F.lit("/careers/job/"), i["id"]))), "title": i["name"], "company": F.lit("Microsoft"),
        "location_raw": _remote(place, i["workLocationOption"] == "remote"), "tags": _some(i["department"], i["workLocationOption"]), "posted_at": p.seconds(F.coalesce(F.nullif(i["postedTs"], F.lit(0)), i["creationTs"])),
        "hiring_regions_hint": p.with_india(p.regions_from_text(place), F.exists(i["standardizedLocations"], lambda x: x.endswith(", IN")), alone=False), "employment_type_hint": _intern(i["name"]),
    }


def _eightfold_place(i: Column) -> Column:
    return F.array_join(F.when(F.size(i["locations"]) > 0, i["locations"]).otherwise(F.array(F.coalesce(i["location"], F.lit("")))), "; ")


def _eightfold(i: Column) -> dict[str, Column]:
    place = _eightfold_place(i)
    return {
        "source_job_id": _own(i), "url": F.coalesce(text(i["canonicalPositionUrl"]), F.concat(F.lit("https://"), _host(), F.lit("/careers/job/"), i["id"])), "title": i["name"],
        "description": p.html_to_text(i["job_description"]), "location_raw": _remote(place, i["work_location_option"] == "remote"), "tags": _some(i["department"], i["business_unit"]),
        "posted_at": p.seconds(i["t_create"]), "hiring_regions_hint": p.with_india(p.regions_from_text(place), F.lit(True), alone=True), "employment_type_hint": _intern(i["name"]),
    }


def _atlassian(i: Column) -> dict[str, Column]:
    india = F.filter(i["locations"], lambda x: F.lower(x).contains("india"))
    return {
        "source_job_id": i["id"], "url": F.coalesce(text(i["portalJobPost"]["portalUrl"]), text(F.replace(i["applyUrl"], F.lit("?mode=apply"), F.lit(""))), F.lit("https://www.atlassian.com/company/careers/all-jobs")),
        "title": i["title"], "company": F.lit("Atlassian"), "description": text(_joined(F.array(*(p.html_to_text(i[c]) for c in ("overview", "responsibilities", "qualifications"))), "\n\n")),
        "location_raw": _remote(F.array_join(india, "; "), F.exists(india, lambda x: F.lower(x).startswith("remote"))), "tags": _some(i["category"]),
        "hiring_regions_hint": F.array(F.lit("india")), "employment_type_hint": _intern(i["title"], i["category"] == "Interns"),
    }


def _early(i: Column) -> Column:
    return F.coalesce(i["roleId"].contains("EARLY_CAREER") | (i["corporateTitle"] == "Analyst"), F.lit(False))


def _goldman(i: Column) -> dict[str, Column]:
    place = F.array_join(F.transform(i["locations"], lambda x: _joined(F.array(x["city"], x["state"], x["country"]), ", ")), "; ")
    said = lambda c, other: F.coalesce(text(c), F.lit(other))
    return {
        "source_job_id": i["roleId"], "url": F.concat(F.lit("https://higher.gs.com/roles/"), i["externalSource"]["sourceId"]), "title": i["jobTitle"], "company": F.lit("Goldman Sachs"),
        "description": F.concat(F.lit("Corporate title: "), said(i["corporateTitle"], ""), F.lit(". Function: "), said(i["jobFunction"], "-"), F.lit(". Division: "), said(i["division"], "-"), F.lit(".")),
        "location_raw": text(place), "tags": _some(i["jobFunction"], i["division"], i["corporateTitle"]),
        "hiring_regions_hint": p.with_india(p.regions_from_text(place), F.exists(i["locations"], lambda x: x["country"] == "India"), alone=True),
        "employment_type_hint": _intern(i["jobTitle"]), "min_yoe_hint": F.when(_early(i), 0),
    }


def _workable(i: Column) -> dict[str, Column]:
    loc = i["location"]
    place = F.coalesce(text(_joined(F.array(loc["city"], loc["subregion"], loc["countryName"]), ", ")), F.array_join(i["locations"], "; "))
    kind = F.lower(i["employmentType"])
    intern = i["title"].rlike(r"(?i)\b(intern|internship|trainee|apprentice)\b") | F.coalesce(kind.contains("intern"), F.lit(False))
    return {
        "source_job_id": i["id"], "url": i["url"], "title": i["title"], "company": F.coalesce(i["company"]["title"], F.lit("")), "description": p.html_to_text(i["description"]),
        "location_raw": _remote(place, i["workplace"] == "remote"), "tags": _some(i["department"], i["workplace"]), "posted_at": p.parse_iso(i["created"]),
        "hiring_regions_hint": p.with_india(p.regions_from_text(place), F.lower(loc["countryName"]) == "india", alone=True),
        "employment_type_hint": F.when(intern, "internship").when(kind.contains("full"), "full_time").otherwise("unknown"),
    }


def _simplify(i: Column) -> dict[str, Column]:
    place = F.array_join(i["locations"], "; ")
    return {
        "source_job_id": F.coalesce(text(i["id"]), i["url"]), "url": i["url"], "title": i["title"], "company": F.coalesce(i["company_name"], F.lit("")), "location_raw": text(place),
        "tags": F.concat(F.coalesce(i["terms"], F.array().cast("array<string>")), _some(i["category"])), "posted_at": p.seconds(i["date_posted"]), "hiring_regions_hint": p.regions_from_text(place),
        "employment_type_hint": F.when(_slug() == "new-grad", "full_time").otherwise("internship"), "min_yoe_hint": F.lit(0),
    }


def _himalayas(i: Column) -> dict[str, Column]:
    limits = F.coalesce(i["locationRestrictions"], F.array().cast("array<string>"))
    # Needles are tried for one restriction after the other, so the first restriction's regions come first.
    each = F.flatten(F.transform(limits, lambda x: F.filter(p.regions_by_words(x, HIMALAYAS_WORDS), lambda r: r != "unknown")))
    none = F.array().cast("array<string>")
    return {
        "source_job_id": i["guid"], "url": F.coalesce(text(i["applicationLink"]), i["link"]), "title": i["title"], "company": F.coalesce(i["companyName"], F.lit("")),
        "description": p.html_to_text(F.coalesce(text(i["description"]), i["excerpt"]), escaped=False), "location_raw": F.coalesce(text(F.array_join(limits, ", ")), F.lit("Worldwide")),
        "tags": F.concat(F.coalesce(i["categories"], none), F.coalesce(i["skills"], none)), "posted_at": p.seconds(i["pubDate"]),
        "hiring_regions_hint": F.when(F.size(limits) == 0, F.array(F.lit("worldwide"))).otherwise(p.or_unknown(F.array_distinct(each))), "employment_type_hint": _kind(HIMALAYAS_TYPES, F.lower(i["employmentType"])),
    }


def _remoteok(i: Column) -> dict[str, Column]:
    return {
        "source_job_id": i["id"], "url": F.coalesce(text(i["url"]), F.concat(F.lit("https://remoteok.com/remote-jobs/"), i["id"])), "title": i["position"], "company": F.coalesce(i["company"], F.lit("")),
        "description": i["description"], "location_raw": i["location"], "tags": i["tags"], "salary_raw": i["salary"], "posted_at": p.parse_iso(i["date"]),
        "hiring_regions_hint": _blank_is_worldwide(i["location"], ("worldwide", "anywhere", "remote", "global"), REMOTEOK_WORDS), "employment_type_hint": F.lit("unknown"),
    }


def _jobicy(i: Column) -> dict[str, Column]:
    place = F.coalesce(text(i["jobGeo"]), F.lit("Anywhere"))
    return {
        "source_job_id": i["id"], "url": F.coalesce(text(i["url"]), F.concat(F.lit("https://jobicy.com/jobs/"), i["id"])), "title": i["jobTitle"], "company": F.coalesce(i["companyName"], F.lit("")),
        "description": p.html_to_text(F.coalesce(text(i["jobDescription"]), i["jobExcerpt"]), escaped=False), "location_raw": F.concat(F.lit("Remote ("), place, F.lit(")")),
        "tags": F.concat(F.coalesce(i["jobIndustry"], F.array().cast("array<string>")), _some(i["jobLevel"])), "posted_at": p.parse_iso(i["pubDate"]),
        "hiring_regions_hint": _blank_is_worldwide(place, ("anywhere", "worldwide", "everywhere", "global"), JOBICY_WORDS), "employment_type_hint": _kind(JOBICY_TYPES, F.trim(F.lower(i["jobType"]))),
        "min_yoe_hint": F.when(F.lower(i["jobLevel"]).rlike("entry|junior|trainee|intern|student"), 0),
    }


def _arbeitnow(i: Column) -> dict[str, Column]:
    low, remote = F.lower(F.coalesce(i["location"], F.lit(""))), F.coalesce(i["remote"], F.lit(False))
    types = F.transform(F.coalesce(i["job_types"], F.array().cast("array<string>")), F.lower)
    region = F.when(low.contains("india"), "india").when(remote & low.rlike("worldwide|anywhere"), "worldwide").when(low.rlike("|".join(ARBEITNOW_EUROPE)), "europe").otherwise("unknown")
    return {
        "source_job_id": i["slug"], "url": i["url"], "title": i["title"], "company": F.coalesce(i["company_name"], F.lit("")), "description": p.html_to_text(i["description"], escaped=False), "location_raw": i["location"],
        "tags": F.concat(F.coalesce(i["tags"], F.array().cast("array<string>")), types), "posted_at": p.seconds(i["created_at"]), "hiring_regions_hint": F.array(region),
        "employment_type_hint": F.when(F.exists(types, lambda x: x.contains("intern")), "internship").otherwise("unknown"),
    }


def _remotive(i: Column) -> dict[str, Column]:
    place = i["candidate_required_location"]
    return {
        "source_job_id": i["id"], "url": i["url"], "title": i["title"], "company": F.coalesce(i["company_name"], F.lit("")), "description": i["description"], "location_raw": place, "tags": i["tags"],
        "salary_raw": i["salary"], "posted_at": p.parse_iso(i["publication_date"]), "hiring_regions_hint": p.regions_by_words(place, REMOTIVE_WORDS), "employment_type_hint": _kind(REMOTIVE_TYPES, F.lower(i["job_type"])),
    }


def _weworkremotely(i: Column) -> dict[str, Column]:
    """An RSS item; the title is ``Company: Role``."""
    said, region = F.trim(i["title"]), F.trim(F.coalesce(i["region"], F.lit("")))
    company = F.when(said.contains(":"), F.trim(F.substring_index(said, ":", 1)))
    role = F.when(said.contains(":"), F.trim(F.expr("substr(trim(i.title), instr(trim(i.title), ':') + 1)"))).otherwise(said)
    day = F.regexp_replace(F.regexp_replace(F.trim(i["pubDate"]), r"^[A-Za-z]+,\s*", ""), "(GMT|UTC|UT)$", "+0000")
    return {
        "source_job_id": F.coalesce(text(F.trim(i["guid"])), F.trim(i["link"])), "url": F.trim(i["link"]), "title": F.coalesce(text(role), said), "company": F.coalesce(text(company), F.lit("Remote Employer")),
        "description": p.html_to_text(i["description"]), "location_raw": F.when(region != "", F.concat(F.lit("Remote ("), region, F.lit(")"))).otherwise("Remote"),
        "tags": F.array(F.lit("remote"), F.lit("programming")), "posted_at": p.utc(F.try_to_timestamp(day, F.lit("d MMM yyyy HH:mm:ss Z"))),
        "hiring_regions_hint": F.when((region == "") | F.lower(region).rlike("anywhere in the world|worldwide"), F.array(F.lit("worldwide"))).otherwise(p.regions_by_words(region, WWR_WORDS)),
        "employment_type_hint": F.lit("full_time"),
    }


_NAMED, _LABEL = "struct<name:string>", "struct<label:string>"
SOURCES: dict[str, Source] = {
    "greenhouse": Source("struct<jobs:%>", f"id:string,title:string,absolute_url:string,company_name:string,content:string,first_published:string,updated_at:string,location:{_NAMED},offices:array<{_NAMED}>,departments:array<{_NAMED}>", _in("jobs"), lambda i: _has(i, "id"), _greenhouse),
    "ashby": Source("struct<jobs:%>", "id:string,title:string,isListed:boolean,location:string,secondaryLocations:array<struct<location:string>>,employmentType:string,publishedAt:string,compensation:struct<compensationTierSummary:string,summary:string>,applyUrl:string,jobUrl:string,descriptionPlain:string,descriptionHtml:string,department:string,team:string,workplaceType:string", _in("jobs"), lambda i: _has(i, "id") & F.coalesce(i["isListed"], F.lit(True)), _ashby),
    "smartrecruiters": Source("struct<content:%>", f"id:string,name:string,company:{_NAMED},releasedDate:string,location:struct<city:string,region:string,country:string,fullLocation:string,remote:boolean>,experienceLevel:struct<id:string>,typeOfEmployment:struct<id:string>,department:{_LABEL},function:{_LABEL},industry:{_LABEL}", _in("content"), lambda i: _has(i, "id"), _smartrecruiters),
    "workable_boards": Source("struct<jobs:%>", "shortcode:string,title:string,url:string,shortlink:string,description:string,employment_type:string,telecommuting:boolean,department:string,function:string,experience:string,published_on:string,created_at:string,city:string,state:string,country:string,locations:array<struct<city:string,region:string,country:string,countryCode:string>>", _in("jobs"), lambda i: _has(i, "shortcode"), _workable_boards),
    "recruitee": Source("struct<offers:%>", "id:string,slug:string,status:string,title:string,location:string,remote:boolean,country_code:string,employment_type_code:string,experience_code:string,description:string,requirements:string,careers_url:string,company_name:string,department:string,tags:array<string>,published_at:string,created_at:string", _in("offers"), lambda i: _has(i, "id") & (F.coalesce(i["status"], F.lit("published")) == "published"), _recruitee),
    "gem": Source("%", f"id:string,title:string,location:{_NAMED},offices:array<struct<name:string,location:{_NAMED}>>,location_type:string,employment_type:string,absolute_url:string,content_plain:string,departments:array<{_NAMED}>,first_published_at:string,created_at:string", lambda b: b, lambda i: _has(i, "id"), _gem),
    "rippling": Source("struct<items:%>", f"id:string,name:string,url:string,department:{_NAMED},locations:array<struct<name:string,country:string,countryCode:string,workplaceType:string>>", _in("items"), lambda i: _has(i, "id"), _rippling),
    "workday": Source("struct<jobPostings:%>", "title:string,externalPath:string,locationsText:string,postedOn:string,bulletFields:array<string>", _in("jobPostings"), lambda i: _has(i, "externalPath", "title"), _workday),
    "oracle": Source("struct<items:array<struct<requisitionList:%>>>", "Id:string,Title:string,PrimaryLocation:string,PrimaryLocationCountry:string,PostedDate:string,ShortDescriptionStr:string,JobFamily:string,WorkerType:string", lambda b: F.get(b["items"], F.lit(0))["requisitionList"], lambda i: _has(i, "Id", "Title"), _oracle),
    "ibm": Source("struct<hits:struct<hits:%>>", "_id:string,_source:struct<title:string,url:string,description:string,dcdate:string,field_keyword_05:string,field_keyword_08:string,field_keyword_18:string,field_keyword_19:string>", lambda b: b["hits"]["hits"], lambda i: (F.lower(i["_source"]["field_keyword_05"]) == "india") & text(i["_source"]["url"]).isNotNull(), _ibm),
    "amazon": Source("struct<jobs:%>", "id_icims:string,title:string,job_path:string,company_name:string,normalized_location:string,location:string,country_code:string,description:string,basic_qualifications:string,preferred_qualifications:string,is_intern:boolean,university_job:boolean,job_category:string,business_category:string,posted_date:string", _in("jobs"), lambda i: _has(i, "id_icims"), _amazon),
    "microsoft": Source("struct<data:struct<positions:%>>", "id:string,name:string,locations:array<string>,standardizedLocations:array<string>,positionUrl:string,department:string,workLocationOption:string,postedTs:bigint,creationTs:bigint", lambda b: b["data"]["positions"], lambda i: _has(i, "id", "name"), _microsoft),
    "eightfold": Source("struct<positions:%>", "id:string,name:string,locations:array<string>,location:string,canonicalPositionUrl:string,job_description:string,work_location_option:string,department:string,business_unit:string,t_create:bigint", _in("positions"), lambda i: _has(i, "id") & F.lower(_eightfold_place(i)).contains("india"), _eightfold),
    "atlassian": Source("%", "id:string,title:string,locations:array<string>,overview:string,responsibilities:string,qualifications:string,portalJobPost:struct<portalUrl:string>,applyUrl:string,category:string", lambda b: b, lambda i: _has(i, "id") & F.exists(i["locations"], lambda x: F.lower(x).contains("india")), _atlassian),
    "goldman": Source("struct<data:struct<roleSearch:struct<items:%>>>", "roleId:string,jobTitle:string,corporateTitle:string,jobFunction:string,division:string,status:string,externalSource:struct<sourceId:string>,locations:array<struct<city:string,state:string,country:string>>", lambda b: b["data"]["roleSearch"]["items"], lambda i: _has(i, "roleId") & text(i["externalSource"]["sourceId"]).isNotNull() & (F.coalesce(i["status"], F.lit("POSTED")) == "POSTED") & (_early(i) | ~F.coalesce(i["corporateTitle"].isin(*LATERAL_RANKS), F.lit(False))), _goldman),
    "workable": Source("struct<jobs:%>", "id:string,title:string,url:string,company:struct<title:string>,description:string,location:struct<city:string,subregion:string,countryName:string>,locations:array<string>,workplace:string,employmentType:string,department:string,created:string", _in("jobs"), lambda i: _has(i, "id"), _workable),
    "simplify": Source("%", "id:string,url:string,title:string,company_name:string,active:boolean,is_visible:boolean,date_posted:bigint,locations:array<string>,terms:array<string>,category:string", lambda b: b, lambda i: F.coalesce(i["active"], F.lit(False)) & F.coalesce(i["is_visible"], F.lit(True)) & _has(i, "url", "title"), _simplify),
    "himalayas": Source("struct<jobs:%>", "guid:string,title:string,companyName:string,applicationLink:string,link:string,description:string,excerpt:string,locationRestrictions:array<string>,categories:array<string>,skills:array<string>,employmentType:string,pubDate:bigint", _in("jobs"), lambda i: _has(i, "guid"), _himalayas),
    "remoteok": Source("%", "id:string,position:string,company:string,url:string,description:string,location:string,tags:array<string>,salary:string,date:string", lambda b: b, lambda i: i["id"].isNotNull() & i["position"].isNotNull(), _remoteok),
    "jobicy": Source("struct<jobs:%>", "id:string,jobTitle:string,companyName:string,url:string,jobDescription:string,jobExcerpt:string,jobGeo:string,jobIndustry:array<string>,jobLevel:string,jobType:string,pubDate:string", _in("jobs"), lambda i: _has(i, "id", "jobTitle"), _jobicy),
    "arbeitnow": Source("struct<data:%>", "slug:string,title:string,company_name:string,url:string,description:string,location:string,remote:boolean,tags:array<string>,job_types:array<string>,created_at:bigint", _in("data"), lambda i: _has(i, "slug"), _arbeitnow),
    "remotive": Source("struct<jobs:%>", "id:string,title:string,company_name:string,url:string,description:string,candidate_required_location:string,tags:array<string>,salary:string,job_type:string,publication_date:string", _in("jobs"), lambda i: _has(i, "id"), _remotive),
    "weworkremotely": Source("struct<channel:struct<item:%>>", "title:string,link:string,description:string,pubDate:string,guid:string,region:string", lambda b: b["channel"]["item"], lambda i: text(F.trim(i["link"])).isNotNull(), _weworkremotely),
}
#: Sources whose complete answer proves that what it lacks is gone.
FULL = ("greenhouse", "ashby", "smartrecruiters", "workable_boards", "recruitee", "gem", "rippling", "eightfold", "atlassian", "goldman", "simplify")
RSS = ("weworkremotely",)
#: Days after which a listing that still says it is open counts as closed.
SIMPLIFY_DAYS = 90


def items(connector: str, body: Column) -> Column:
    """The payload's items; null if it can't be parsed or has another shape, empty if it has none."""
    return _items(SOURCES[connector], body, connector in RSS)


def _items(source: Source, body: Column, rss: bool = False) -> Column:
    if source.parse:
        return source.parse(body)
    kind = source.payload.replace("%", f"array<struct<{source.item}>>")
    parse = F.from_xml if rss else F.from_json
    starts = "<" if rss else r"\[" if source.payload == "%" else r"\{"
    parsed = parse(body, kind)
    found = source.items(parsed)
    if rss:  # without items there is no array
        found = F.when(parsed["channel"].isNotNull(), F.coalesce(found, F.array().cast(f"array<struct<{source.item}>>")))
    return F.when(body.rlike(rf"^\s*{starts}"), found)


def with_once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once a row, however often it is used: no filter or projection is merged with what an explode gives."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def status(responses: DataFrame, connector: str) -> DataFrame:
    """The source's responses with ``items`` and ``status``: no_board (404, 410), failed (other codes, or a payload of another shape), empty or ok."""
    return status_of(responses, connector, SOURCES[connector], connector in RSS)


def status_of(responses: DataFrame, connector: str, source: Source, rss: bool = False) -> DataFrame:
    """As ``status``, of a source that is given."""
    own = responses.where(F.col("connector") == connector)
    own = with_once(own, "cut", source.cut(F.col("body"))) if source.cut else own.withColumn("cut", F.col("body"))
    own = with_once(own, "items", _items(source, F.col("cut"), rss))
    return own.withColumn(
        "status",
        F.when(F.col("http_code").isin(404, 410), "no_board").when((F.coalesce(F.col("http_code"), F.lit(0)) != 200) | F.col("body").isNull(), "failed").when(F.col("cut").isNull(), source.without).when(F.col("items").isNull(), "failed")
        .when(F.exists("items", source.keep), "ok").otherwise("empty"),
    ).drop("cut")


def read(responses: DataFrame, connector: str, as_of: str) -> DataFrame:
    """Raw postings of one source; ``as_of`` is what relative dates and age limits count from."""
    named = connector in FULL + ("workday", "oracle") and connector not in ("atlassian", "goldman", "simplify", "smartrecruiters")
    found = read_source(responses, connector, SOURCES[connector], as_of, named, connector in RSS)
    if connector == "simplify":
        found = found.where(F.col("posted_at").isNull() | (F.col("posted_at") >= F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(SIMPLIFY_DAYS))))
    return found


def read_source(responses: DataFrame, connector: str, source: Source, as_of: str, named: bool, rss: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """As ``read``, of a source that is given; ``named``: the registry's name of a scope comes before the item's.

    ``carry``: columns of responses that ``row`` reads too. With an ``ordinal`` among them rows get ``place``, which orders
    them by it and by their place in the response.
    """
    i, now = F.col("i"), F.lit(as_of).cast("timestamp_ntz")
    rows = status_of(responses, connector, source, rss).where("status = 'ok'")
    rows = rows.select("connector", "scope", "slug", "host", "name", *carry, F.posexplode("items").alias("at", "i")).where(source.keep(i))
    fields = source.row(i)
    if "posted_on" in fields:
        fields["posted_at"] = parse_relative_posted(fields.pop("posted_on"), now)
    nothing = {"description": "string", "salary_raw": "string", "posted_at": "timestamp_ntz", "min_yoe_hint": "int"}
    fields = {c: F.lit(None).cast(kind) for c, kind in nothing.items()} | {"company": _slug(), "tags": F.lit(None)} | fields
    company = F.coalesce(text(F.col("name")), fields["company"]) if named else fields["company"]
    return rows.select(
        F.col("connector").alias("source"), fit_id(fields["source_job_id"]).alias("source_job_id"), "scope", F.coalesce(fields["url"], F.lit("")).alias("url"), F.coalesce(fields["title"], F.lit("")).alias("title"),
        company.alias("company"), fields["description"].alias("description"), fields["location_raw"].alias("location_raw"), F.coalesce(fields["tags"], F.array().cast("array<string>")).alias("tags"),
        *(fields[c].alias(c) for c in ("salary_raw", "posted_at", "hiring_regions_hint", "employment_type_hint", "min_yoe_hint")), *([F.struct("ordinal", "at").alias("place")] if "ordinal" in carry else []),
    )


def with_registry(responses: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds ``host`` and ``name`` of each scope's entry in the registry, ``scope, host, name``; one row per scope, so Spark may broadcast it by its size."""
    return responses.join(registry.select("scope", "host", "name"), "scope", "left")
