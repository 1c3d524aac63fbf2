"""Readers of landed HTML pages, whose postings stand in script blocks, attributes or elements.

Each source cuts the items out of the page as JSON; from there on it is read as a
board's payload. A value within a script is cut by the JSON parser, which ends where
the value does, whatever brackets its texts hold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.functions import parsing as p
from rolecall.functions.markup import Pick, pick
from rolecall.functions.parsing import text
from rolecall.functions.text import slugify
from rolecall.sources.boards import Source, _intern, _lookup, _own, _slug, _some, read_source, status_of

# Where each page keeps its postings, what their fields mean, and the addresses of their pages.
GOOGLE_URL = "https://www.google.com/about/careers/applications/jobs/results"
GOOGLE_BLOCK = r"(?s)AF_initDataCallback\(\{key: 'ds:1'.*?data:(.*)$"
GOOGLE_INTERN = r"(?i)\b(intern|internship|apprentice)\b"
GOOGLE_SECTIONS = (("About the job", (10,)), ("Responsibilities", (3,)), ("Minimum qualifications", (19, 4)), ("Eligibility", (15,)))
APPLE_URL = "https://jobs.apple.com/en-in/details/"
APPLE_BLOCK = r'(?s)window\.__staticRouterHydrationData\s*=\s*JSON\.parse\((".*?")\);'
JUSPAY_URL = "https://juspay.io/careers"
JUSPAY_TYPES = {"intern": "internship", "full-time": "full_time", "full time": "full_time", "contract": "contract"}
ZOHO_INPUT = r'<input type="hidden" value="(\[[^"]*?)"\s*id="jobs"'
KEKA_PORTAL = r"(?i)/ats/documents/([0-9a-f-]{36})/careerportal"
KEKA_YEARS = r"(?i)(\d+)\s*(?:-|to|–)?\s*(\d+)?\s*(?:\+\s*)?years?"
CAMPUS_ID = r"amazon\.jobs(?:/[a-z-]{2,5})?/jobs/(\d{6,9})"
CAMPUS_TITLE = r'<meta property="og:title" content="([^"]+)"'
CAMPUS_TEXT = r'<meta property="og:description" content="([^"]+)"'
CAMPUS_PLACE = r'(?s)class="association location-icon".*?<ul class="association-content"><li>([^<]+)</li>'
CAMPUS_CATEGORY = r'(?s)class="association job-category-icon.*?<ul class="association-content"><li>([^<]+)</li>'
CAMPUS_URL = "https://www.amazon.jobs/en/jobs/"
#: Pages of campus postings that one run reads.
CAMPUS_PAGES = 40

STRINGS = "array<string>"


def _strings(value: Column) -> Column:
    """The elements of a JSON array as texts: strings as they are, other values as JSON. Null if it isn't an array."""
    return F.when(value.rlike(r"^\s*\["), F.from_json(value, STRINGS))


def _at(values: Column, k: int) -> Column:
    return F.get(values, F.lit(k))


def _cut(body: Column, pattern: str) -> Column:
    return text(F.regexp_extract(body, pattern, 1))


def _strip(value: Column) -> Column:
    return F.regexp_replace(value, r"^\s+|\s+$", "")


# google: rows of a nested array, by place.

def _google_rows(block: Column) -> Column:
    rows = _strings(_at(F.from_json(block, STRINGS), 0))
    return F.when(block.isNotNull(), F.coalesce(F.transform(F.filter(rows, lambda r: F.coalesce(r.rlike(r'^\[\s*"'), F.lit(False))), lambda r: F.from_json(r, STRINGS)), F.array().cast("array<array<string>>")))


def _second(value: Column) -> Column:
    return F.coalesce(_at(_strings(value), 1), F.lit(""))


def _google(i: Column) -> dict[str, Column]:
    parts = []
    for heading, places in GOOGLE_SECTIONS:
        body = F.coalesce(*(text(_second(_at(i, k))) for k in places))
        parts.append(F.concat(F.lit(heading + "\n"), p.html_to_text(body)))
    places = F.filter(F.transform(F.coalesce(_strings(_at(i, 9)), F.array().cast(STRINGS)), _strings), lambda x: x.isNotNull())
    names = F.array_compact(F.transform(places, lambda x: _at(x, 0)))
    joined = F.array_join(names, "; ")
    at = _at(_strings(_at(i, 12)), 0).try_cast("bigint")
    return {
        "source_job_id": _at(i, 0), "url": F.concat(F.lit(GOOGLE_URL + "/"), _at(i, 0), F.lit("-"), slugify(_at(i, 1))), "title": _at(i, 1), "company": F.coalesce(_at(i, 7), F.lit("Google")),
        "description": text(F.array_join(F.array_compact(F.array(*parts)), "\n\n")), "location_raw": text(joined), "posted_at": p.moment(at),
        "hiring_regions_hint": p.with_india(p.regions_from_text(joined), F.exists(places, lambda x: F.coalesce(_at(x, 5) == "IN", F.lit(False))), alone=False), "employment_type_hint": _intern(_at(i, 1), pattern=GOOGLE_INTERN),
    }


# apple: JSON within a string of a script.

def _apple_block(body: Column) -> Column:
    return _at(F.from_json(F.concat(F.lit("["), _cut(body, APPLE_BLOCK), F.lit("]")), STRINGS), 0)


def _apple(i: Column) -> dict[str, Column]:
    names = F.transform(i["locations"], lambda x: F.coalesce(text(F.array_join(_some(x["city"], x["stateProvince"], x["countryName"]), ", ")), x["name"]))
    title = _strip(F.coalesce(i["postingTitle"], F.lit("")))
    india = F.exists(i["locations"], lambda x: F.coalesce(x["countryID"] == "iso-country-IND", F.lit(False)))
    return {
        "source_job_id": i["positionId"], "url": F.concat(F.lit(APPLE_URL), i["positionId"], F.lit("/"), F.coalesce(i["transformedPostingTitle"], F.lit(""))), "title": title, "company": F.lit("Apple"),
        "description": i["jobSummary"], "location_raw": text(F.array_join(F.filter(names, lambda x: x != ""), "; ")), "tags": _some(i["team"]["teamName"]), "posted_at": p.parse_iso(i["postDateInGMT"]),
        "hiring_regions_hint": F.when(F.coalesce(india, F.lit(False)), F.array(F.lit("india"))).otherwise(F.array().cast(STRINGS)), "employment_type_hint": _intern(title),
    }


# juspay: values as [type, value] in an attribute; type 0 is a plain value, 1 a list.

def _plain_value(node: Column) -> Column:
    return F.when(node.rlike(r"^\s*\[\s*0\s*,"), _at(F.from_json(node, STRINGS), 1)).otherwise(node)


def _list_value(node: Column) -> Column:
    return F.when(node.rlike(r"^\s*\[\s*1\s*,"), _strings(_at(F.from_json(node, STRINGS), 1)))


def _juspay_items(props: Column) -> Column:
    """Objects whose values are texts of [type, value]; open ones only, and of equal ids the first."""
    node = F.from_json(props, "jobData string")["jobData"]
    found = F.transform(F.coalesce(_list_value(node), F.array().cast(STRINGS)), lambda x: F.from_json(_plain_value(x), f"struct<{_JUSPAY}>"))
    return F.filter(found, lambda x: text(_plain_value(x["job_id"])).isNotNull() & (F.coalesce(_plain_value(x["opening_status"]), F.lit("")) != "false"))


def _juspay_found(islands: Column) -> Column:
    """The items of all islands; of equal ids the first."""
    named = F.filter(F.from_json(islands, "array<struct<props:string>>"), lambda x: x["props"].contains("job_id"))
    every = F.flatten(F.transform(named, lambda x: _juspay_items(x["props"])))
    none = F.struct(F.array().cast(STRINGS).alias("ids"), F.array().cast(f"array<struct<{_JUSPAY}>>").alias("kept"))

    def add(told: Column, x: Column) -> Column:
        own = _plain_value(x["job_id"])
        return F.when(F.array_contains(told["ids"], own), told).otherwise(F.struct(F.array_append(told["ids"], own).alias("ids"), F.array_append(told["kept"], x).alias("kept")))

    return F.aggregate(every, none, add)["kept"]


def _juspay(i: Column) -> dict[str, Column]:
    own = {name: _plain_value(i[name]) for name in ("job_id", "job_title", "job_type", "job_location", "job_description_career", "category", "experience_year")}
    kind, place = F.coalesce(own["job_type"], F.lit("")), F.coalesce(own["job_location"], F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(own["job_description_career"], "[*_`#>]+", ""), "\n{3,}", "\n\n")
    return {
        "source_job_id": own["job_id"], "url": F.concat(F.lit(JUSPAY_URL + "/"), own["job_id"]), "title": own["job_title"], "company": F.lit("Juspay"), "description": text(_strip(bare)), "location_raw": text(place),
        "tags": _some(own["category"], kind), "hiring_regions_hint": p.regions_from_text(place), "employment_type_hint": F.coalesce(_lookup(JUSPAY_TYPES, F.lower(kind)), F.lit("unknown")),
        "min_yoe_hint": F.when(i["experience_year"].rlike(r"^\s*(\[\s*0\s*,\s*-?\d+\s*\]|-?\d+)\s*$"), own["experience_year"].try_cast("int")),
    }


# avature, successfactors: elements.

_ARTICLE = {
    "href": Pick("a.link_result", "href"), "title": Pick("a.link_result"), "location": Pick(".list-item-location"), "worker": Pick(".list-item-workerType"), "id": Pick(".list-item-id"),
}
_ROW = {
    "href": Pick("a.jobTitle-link", "href"), "title": Pick("a.jobTitle-link"), "cell": Pick("td.colLocation span.jobLocation", pieces=False), "place": Pick("span.jobLocation", pieces=False), "day": Pick("span.jobDate", pieces=False),
}


def _avature(i: Column) -> dict[str, Column]:
    href, worker, place = (F.coalesce(i[c], F.lit("")) for c in ("href", "worker", "location"))
    own = F.coalesce(text(F.regexp_extract(F.coalesce(i["id"], F.lit("")), r"\d{3,}", 0)), text(F.regexp_extract(href, r"\d{3,}", 0)), href)
    intern = F.lower(worker).contains("intern") | F.lower(i["title"]).contains("intern")
    return {
        "source_job_id": F.concat_ws(":", _slug(), own), "url": href, "title": i["title"], "location_raw": text(place), "tags": _some(worker), "hiring_regions_hint": p.regions_from_text(place),
        "employment_type_hint": F.when(intern, "internship").otherwise("unknown"), "min_yoe_hint": F.when(intern, 0),
    }


def _named_day(value: Column) -> Column:
    """``Sep 4, 2026``, ``4 Sep 2026`` or ``2026-09-04``; null for other forms."""
    day = F.initcap(_strip(F.regexp_replace(value, r"\s+", " ")))
    found = [F.try_to_timestamp(day, F.lit(form)) for form in ("MMM d, yyyy", "d MMM yyyy", "yyyy-M-d")]
    return F.when(day.rlike(r"^(?:[A-Z][a-z]{2} \d{1,2}, \d{4}|\d{1,2} [A-Z][a-z]{2} \d{4}|\d{4}-\d{1,2}-\d{1,2})$"), F.coalesce(*found).cast("date").cast("timestamp_ntz"))


def _successfactors(i: Column) -> dict[str, Column]:
    href, place = F.coalesce(i["href"], F.lit("")), _strip(F.regexp_replace(F.coalesce(i["cell"], i["place"], F.lit("")), r"[\s ]+", " "))
    base = F.regexp_replace(F.coalesce(F.col("host"), F.lit("")), "/+$", "")
    return {
        "source_job_id": F.concat_ws(":", _slug(), F.coalesce(text(F.regexp_extract(href, r"/(\d{5,})/?$", 1)), href)), "url": F.when(href.startswith("/"), F.concat(base, href)).otherwise(href), "title": i["title"],
        "location_raw": text(place), "posted_at": _named_day(i["day"]), "hiring_regions_hint": p.with_india(p.regions_from_text(place), place.rlike(r",\s*IN\b"), alone=True), "employment_type_hint": _intern(i["title"]),
    }


# zoho_recruit, keka: JSON of a form field, and of the address that a portal's page names.

def _years(intern: Column, experience: Column, pattern: str, years_first: bool) -> Column:
    said, number = F.coalesce(experience, F.lit("")), F.lit(None).cast("int")
    found, fresh = F.regexp_extract(said, pattern, 1).try_cast("int"), (intern == "internship") | F.lower(said).contains("fresher")
    return F.coalesce(found, F.when(fresh, 0)) if years_first else F.when(fresh, 0).otherwise(F.coalesce(found, number))


def _zoho_recruit(i: Column) -> dict[str, Column]:
    place = F.array_join(_some(i["City"], i["State"], i["Country"]), ", ")
    title = _strip(F.coalesce(text(i["Posting_Title"]), i["Job_Opening_Name"], F.lit("")))
    kind = F.coalesce(i["Job_Type"], F.lit(""))
    intern = _intern(title, F.lower(kind).contains("intern"))
    away = ~F.coalesce(i["Remote_Job"], F.lit("")).isin("", "false", "0")
    return {
        "source_job_id": _own(i), "url": F.concat(F.lit("https://"), _slug(), F.lit("/jobs/Careers/"), i["id"]), "title": title, "company": F.substring_index(_slug(), ".", 1),
        "description": p.html_to_text(i["Job_Description"]), "location_raw": text(F.concat(place, F.when(away, " · Remote").otherwise(""))), "tags": _some(i["Industry"], kind),
        "posted_at": F.when(i["Date_Opened"].rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_timestamp(i["Date_Opened"], F.lit("yyyy-M-d"))).cast("date").cast("timestamp_ntz"),
        "hiring_regions_hint": p.with_india(p.regions_from_text(place), F.lower(i["Country"]) == "india", alone=True), "employment_type_hint": intern, "min_yoe_hint": _years(intern, i["Work_Experience"], r"(\d+)", False),
    }


def _keka(i: Column) -> dict[str, Column]:
    place = F.array_join(F.transform(i["jobLocations"], lambda x: F.array_join(_some(F.coalesce(text(x["city"]), x["name"]), x["countryName"]), ", ")), "; ")
    title, skills = _strip(F.coalesce(i["title"], F.lit(""))), F.filter(i["skillNames"], lambda x: F.coalesce(x, F.lit("")) != "")
    intern = _intern(title)
    said = p.html_to_text(i["description"])
    listed = F.when(F.size(skills) > 0, _strip(F.concat(F.coalesce(said, F.lit("")), F.lit("\n\nSkills: "), F.array_join(skills, ", "))))
    return {
        "source_job_id": _own(i), "url": F.concat(F.lit("https://"), _slug(), F.lit(".keka.com/careers/jobdetails/"), i["id"]), "title": title, "description": F.coalesce(listed, said), "location_raw": text(place),
        "tags": F.concat(_some(i["departmentName"]), F.coalesce(skills, F.array().cast(STRINGS))), "posted_at": p.parse_iso(i["publishedOn"]),
        "hiring_regions_hint": p.with_india(p.regions_from_text(F.coalesce(place, F.lit(""))), F.exists(i["jobLocations"], lambda x: F.coalesce(x["countryCode"] == "IN", F.lit(False))), alone=True),
        "employment_type_hint": intern, "min_yoe_hint": _years(intern, i["experience"], KEKA_YEARS, True),
    }


# amazon_campus: one posting a page.

def _campus_page(body: Column) -> Column:
    own = {name: _strip(p.unescape(_cut(body, pattern))) for name, pattern in (("title", CAMPUS_TITLE), ("place", CAMPUS_PLACE), ("category", CAMPUS_CATEGORY))}
    item = F.struct(*(c.alias(k) for k, c in own.items()), p.unescape(_cut(body, CAMPUS_TEXT)).alias("said"))
    return F.to_json(F.filter(F.array(item), lambda x: x["title"].isNotNull() & F.coalesce(x["place"].rlike(r"(?i)^\s*IND\b"), F.lit(False))))


def _amazon_campus(i: Column) -> dict[str, Column]:
    intern = _intern(i["title"])
    return {
        "source_job_id": _slug(), "url": F.concat(F.lit(CAMPUS_URL), _slug()), "title": i["title"], "company": F.lit("Amazon"), "description": i["said"], "location_raw": i["place"], "tags": _some(i["category"]),
        "hiring_regions_hint": p.regions_from_text(i["place"]), "employment_type_hint": intern, "min_yoe_hint": F.when(intern == "internship", 0),
    }


_JUSPAY = ", ".join(f"{c}: string" for c in ("job_id", "job_title", "job_type", "experience_year", "job_location", "opening_status", "job_description_career", "category"))
_same: Callable[[Column], Column] = lambda b: b


def _named(i: Column, *names: str) -> Column:
    return F.forall(F.array(*(i[n] for n in names)), lambda x: F.coalesce(x, F.lit("")) != "")


#: By connector; ``cut`` takes the items' JSON out of a page, and ``without`` is what a page without any means.
SOURCES: dict[str, Source] = {
    "google": Source(STRINGS, "", _same, lambda i: F.size(i) > 9, _google, cut=lambda b: _cut(b, GOOGLE_BLOCK), without="empty", parse=_google_rows),
    "apple": Source("struct<loaderData:struct<search:struct<searchResults:%>>>", "positionId:string,postingTitle:string,transformedPostingTitle:string,jobSummary:string,postDateInGMT:string,team:struct<teamName:string>,locations:array<struct<city:string,stateProvince:string,countryName:string,name:string,countryID:string>>", lambda b: b["loaderData"]["search"]["searchResults"], lambda i: _named(i, "positionId"), _apple, cut=_apple_block, without="empty"),
    "juspay": Source("%", _JUSPAY.replace(": ", ":"), _same, lambda i: F.lit(True), _juspay, cut=lambda b: pick(b, "astro-island", {"props": Pick("", "props")}), parse=_juspay_found),
    "avature": Source("%", "href:string,title:string,location:string,worker:string,id:string", _same, lambda i: i["title"].isNotNull(), _avature, cut=lambda b: pick(b, "article.article--result", _ARTICLE)),
    "successfactors": Source("%", "href:string,title:string,cell:string,place:string,day:string", _same, lambda i: i["title"].isNotNull(), _successfactors, cut=lambda b: pick(b, "tr.data-row", _ROW)),
    "zoho_recruit": Source("%", "id:string,Publish:boolean,City:string,State:string,Country:string,Remote_Job:string,Posting_Title:string,Job_Opening_Name:string,Job_Type:string,Work_Experience:string,Job_Description:string,Industry:string,Date_Opened:string", _same, lambda i: _named(i, "id") & F.coalesce(i["Publish"], F.lit(True)), _zoho_recruit, cut=lambda b: p.unescape(_cut(b, ZOHO_INPUT)), without="no_board"),
    "keka": Source("%", "id:string,title:string,description:string,departmentName:string,publishedOn:string,experience:string,skillNames:array<string>,jobLocations:array<struct<city:string,name:string,countryName:string,countryCode:string>>", _same, lambda i: _named(i, "id"), _keka),
    "amazon_campus": Source("%", "title:string,place:string,category:string,said:string", _same, lambda i: F.lit(True), _amazon_campus, cut=_campus_page),
}
#: Sources whose postings carry the registry's name of a scope.
NAMED = ("avature", "successfactors", "zoho_recruit", "keka")


def status(responses: DataFrame, connector: str) -> DataFrame:
    """The source's pages with ``items`` and ``status``; see ``boards.status``."""
    return status_of(responses, connector, SOURCES[connector])


def read(responses: DataFrame, connector: str, as_of: str) -> DataFrame:
    """Raw postings of one source's pages; see ``boards.read``."""
    return read_source(responses, connector, SOURCES[connector], as_of, connector in NAMED)


def keka_portals(responses: DataFrame) -> DataFrame:
    """``slug, portal, url`` of careers pages: the portal that a page names and the address of its postings; both null for a page without one."""
    portal = _cut(F.col("body"), KEKA_PORTAL)
    return responses.select("slug", portal.alias("portal"), F.concat(F.lit("https://"), _slug(), F.lit(".keka.com/careers/api/embedjobs/default/active/"), portal).alias("url"))


def campus_wanted(found: DataFrame, known: DataFrame, most: int = CAMPUS_PAGES) -> DataFrame:
    """``job_id`` of the campus pages to read: those stored before, and those that landed searches or indexes (``body``) name; the first ``most`` as texts."""
    named = found.select(F.explode(F.regexp_extract_all("body", F.lit(CAMPUS_ID), F.lit(1))).alias("job_id"))
    return known.select(F.col("source_job_id").alias("job_id")).where("job_id is not null").unionByName(named).distinct().orderBy("job_id").limit(most)
