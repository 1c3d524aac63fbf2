"""Readers of venture boards, of startup job pages and of one paged search, and what a startup list says of a board's company."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall.functions import parsing as p
from rolecall.functions.labels import slug_variants, strip_batch
from rolecall.functions.parsing import text
from rolecall.sources import search
from rolecall.sources.boards import Source, _intern, _some, read_source, status_of
from rolecall.sources.pages import STRINGS, _cut, _named, _strip
from rolecall.staging import dealt

# Places in India and places that a fenced remote role may name, recent batches, where pages keep what they need, and addresses.
YC_INDIA = r"(?i)(,\s*IN\b|\bIndia\b|Bengaluru|Bangalore|Hyderabad|Gurugram|Gurgaon|Mumbai|Pune|Chennai|Noida|Delhi)"
YC_OPEN = r"(?i)\b(IN|India|Anywhere|Worldwide|Global|Asia|APAC)\b"
YC_FENCE = r"(?i)remote\s*\(([^)]*)\)"
YC_YEARS = r"(?i)(\d+)\+?\s*year"
YC_PAGE = 'data-page="([^"]+)"'
YC_URL = "https://www.ycombinator.com"
RECENT_BATCH = "(2024|2025|2026)"
INDIA_HINT = r"(?i)\b(india|bengaluru|bangalore|hyderabad|pune|chennai|mumbai|delhi|gurgaon|gurugram|noida)\b"
CONSIDER_TOKEN = r"""csrfToken["']?\s*[:=]\s*["']([^"']+)"""
CONSIDER_BOARD = r'"board"\s*:\s*\{\s*"id"\s*:\s*"([^"]+)"'
GETRO_DATA = r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>'
INSTAHYRE_URL = "https://www.instahyre.com/job-"
#: The one paged search of this module: three queries, of which a limited rate leaves what was read.
INSTAHYRE = search.Paging("offset", "objects", "id", 20, 60, next="meta.next", partial=(429,))
INSTAHYRE_TERMS = ("years=0", "years=1", "job_type=2")


def _labels(items: Column, name: str = "label") -> Column:
    return F.coalesce(F.transform(items, lambda x: F.coalesce(x[name], F.lit(""))), F.array().cast(STRINGS))


def _texts(items: Column) -> Column:
    return F.coalesce(items, F.array().cast(STRINGS))


def _present(items: Column) -> Column:
    return F.filter(_texts(items), lambda x: F.coalesce(x, F.lit("")) != "")


def _vc_consider(i: Column) -> dict[str, Column]:
    places, labels = _texts(i["locations"]), _labels(i["normalizedLocations"])
    every = F.concat(places, labels)
    india = F.exists(every, lambda x: F.coalesce(F.lower(x).contains("india") | x.rlike(r",\s*IN\b"), F.lit(False)))
    title, ranks = _strip(i["title"]), _texts(i["jobSeniorityIds"])
    intern = _intern(title, F.array_contains(ranks, "intern"))
    url = F.coalesce(text(i["applyUrl"]), i["url"])
    place = F.array_join(F.when(F.size(places) > 0, places).otherwise(labels), "; ")
    return {
        "source_job_id": F.concat(F.coalesce(text(i["companySlug"]), i["companyId"], F.lit("None")), F.lit(":"), F.coalesce(text(i["jobId"]), url)), "url": url, "title": title, "company": F.coalesce(i["companyName"], F.lit("")),
        "location_raw": text(F.concat(place, F.when(i["remote"], " · Remote").otherwise(""))), "tags": _present(_labels(i["jobFunctions"])), "posted_at": p.parse_iso(i["timeStamp"]),
        "hiring_regions_hint": p.with_india(p.regions_from_text(F.array_join(every, "; ")), india, alone=False), "employment_type_hint": intern,
        "min_yoe_hint": F.coalesce(F.when(i["minYearsExp"].rlike(r"^-?\d+$"), i["minYearsExp"].try_cast("int")), F.when((intern == "internship") | (F.array_join(ranks, ",") == "junior"), 0)),
    }


def _vc_getro(i: Column) -> dict[str, Column]:
    places = F.array_join(_texts(i["locations"]), "; ")
    title, rank = _strip(F.coalesce(i["title"], F.lit(""))), F.coalesce(i["seniority"], F.lit(""))
    intern = _intern(title, rank == "internship")
    return {
        "source_job_id": F.concat(F.lit("getro:"), i["id"]), "url": i["url"], "title": title, "company": F.coalesce(i["organization"]["name"], F.lit("")),
        "location_raw": text(F.concat(places, F.when(i["work_mode"] == "remote", " · Remote").otherwise(""))), "tags": F.concat(_some(i["organization"]["stage"]), _present(i["skills"])), "posted_at": p.seconds(i["created_at"]),
        "hiring_regions_hint": p.with_india(p.regions_from_text(places), F.array_contains(_texts(i["searchable_locations"]), "India"), alone=False), "employment_type_hint": intern,
        "min_yoe_hint": F.when((intern == "internship") | (rank == "entry_level"), 0),
    }


def _instahyre(i: Column) -> dict[str, Column]:
    """The query, in ``term``, says whether the posting is an internship's and what years it asks for."""
    place, skills = F.coalesce(i["locations"], F.lit("")), _present(i["keywords"])
    title = _strip(F.coalesce(text(i["title"]), i["candidate_title"], F.lit("")))
    intern = _intern(title, F.col("term").startswith("job_type"))
    return {
        "source_job_id": i["id"], "url": F.coalesce(text(i["public_url"]), F.concat(F.lit(INSTAHYRE_URL), i["id"], F.lit("/"))), "title": title, "company": F.coalesce(i["employer"]["company_name"], F.lit("")),
        "description": F.when(F.size(skills) > 0, F.concat(F.lit("Skills: "), F.array_join(skills, ", "))), "location_raw": text(F.replace(place, F.lit("Work From Home"), F.lit("Remote"))), "tags": skills,
        "hiring_regions_hint": p.with_india(p.regions_from_text(place), F.lit(True), alone=True), "employment_type_hint": intern, "min_yoe_hint": F.when((intern == "internship") | (F.col("term") == "years=0"), 0).otherwise(1),
    }


def reachable(location: Column) -> Column:
    """Whether a posting can be taken up from India: it is there, or one of its places, parted by slashes, is remote and not fenced to others."""
    fenced = lambda part: F.exists(F.regexp_extract_all(part, F.lit(YC_FENCE), F.lit(1)), lambda inside: ~inside.rlike(YC_OPEN))
    parts = F.transform(F.split(location, r"\s*/\s*"), _strip)
    return location.rlike(YC_INDIA) | F.exists(parts, lambda part: F.lower(part).startswith("remote") & ~fenced(part))


def takeable(location: Column, visa: Column) -> Column:
    """Reachable, and in India or not reserved for US citizens."""
    place = F.coalesce(location, F.lit(""))
    return reachable(place) & (place.rlike(YC_INDIA) | ~F.lower(F.coalesce(visa, F.lit(""))).contains("us citizen"))


def _yc_jobs(i: Column) -> dict[str, Column]:
    place, kind, said = (F.coalesce(i[c], F.lit("")) for c in ("location", "type", "minExperience"))
    title, skills, india = _strip(strip_batch(F.coalesce(i["title"], F.lit("")))), _present(i["skills"]), place.rlike(YC_INDIA)
    intern, regions = _intern(title, F.lower(kind) == "internship"), p.regions_from_text(place)
    none = F.lit(None).cast("string")
    named = lambda name, c: F.when(text(c).isNotNull(), F.concat(F.lit(f"{name}: "), c, F.lit("."))).otherwise(none)
    role = F.when(text(i["roleSpecificType"]).isNotNull(), F.concat(F.lit("Role: "), F.coalesce(i["prettyRole"], F.lit("None")), F.lit(" ("), i["roleSpecificType"], F.lit(").")))
    parts = _some(F.col("one_liner"), role, named("Salary", i["salaryRange"]), named("Equity", i["equityRange"]), named("Experience", said), named("Skills", F.array_join(skills, ", ")))
    return {
        "source_job_id": i["id"], "url": F.concat(F.lit(YC_URL), F.coalesce(text(i["url"]), F.concat(F.lit("/companies/"), F.col("slug"), F.lit("/jobs")))), "title": title,
        "company": F.coalesce(text(i["companyName"]), text(F.col("name")), F.col("slug")), "description": text(F.array_join(parts, " ")), "location_raw": text(place), "tags": F.concat(_some(i["prettyRole"], i["roleSpecificType"], kind), skills),
        "hiring_regions_hint": F.when(india, p.with_india(regions, india, alone=False)).when(~F.array_contains(regions, "worldwide"), F.array(F.lit("worldwide"))).otherwise(regions),
        "employment_type_hint": F.when(intern == "internship", intern).when(F.lower(kind) == "full-time", "full_time").otherwise("unknown"),
        "min_yoe_hint": F.when((intern == "internship") | F.lower(said).contains("new grad") | F.lower(said).startswith("any"), 0).otherwise(F.regexp_extract(said, YC_YEARS, 1).try_cast("int")),
    }


_LABEL = "array<struct<label:string>>"
SOURCES: dict[str, Source] = {
    "vc_consider": Source("struct<jobs:%>", f"jobId:string,title:string,applyUrl:string,url:string,companySlug:string,companyId:string,companyName:string,locations:array<string>,normalizedLocations:{_LABEL},remote:boolean,jobSeniorityIds:array<string>,minYearsExp:string,jobFunctions:{_LABEL},timeStamp:string", lambda b: b["jobs"], lambda i: (_named(i, "applyUrl") | _named(i, "url")) & _named(i, "title"), _vc_consider),
    "vc_getro": Source("struct<results:struct<jobs:%>>", "id:string,url:string,title:string,organization:struct<name:string,stage:string>,locations:array<string>,searchable_locations:array<string>,work_mode:string,seniority:string,skills:array<string>,created_at:bigint", lambda b: b["results"]["jobs"], lambda i: _named(i, "id", "url"), _vc_getro),
    "instahyre": Source("struct<objects:%>", "id:string,title:string,candidate_title:string,public_url:string,employer:struct<company_name:string>,locations:string,keywords:array<string>", lambda b: b["objects"], lambda i: _named(i, "id"), _instahyre),
    "yc_jobs": Source("struct<props:struct<jobPostings:%>>", "id:string,title:string,url:string,type:string,location:string,visa:string,minExperience:string,companyName:string,prettyRole:string,roleSpecificType:string,salaryRange:string,equityRange:string,skills:array<string>", lambda b: F.when(b["props"].isNotNull(), F.coalesce(b["props"]["jobPostings"], F.array().cast("array<struct<id:string,title:string,url:string,type:string,location:string,visa:string,minExperience:string,companyName:string,prettyRole:string,roleSpecificType:string,salaryRange:string,equityRange:string,skills:array<string>>>"))), lambda i: _named(i, "id") & takeable(i["location"], i["visa"]), _yc_jobs, cut=lambda b: p.unescape(_cut(b, YC_PAGE))),
}
#: Columns of responses that a source's rows read beside the usual.
CARRY = {"instahyre": ("ordinal", "term"), "yc_jobs": ("one_liner",)}


def status(responses: DataFrame, connector: str) -> DataFrame:
    """The source's responses with ``items`` and ``status``; see ``boards.status``."""
    return status_of(responses, connector, SOURCES[connector])


def read(responses: DataFrame, connector: str, as_of: str) -> DataFrame:
    """Raw postings of one source's responses; see ``boards.read``. Of a paged search's postings with one id the first stays."""
    found = read_source(responses, connector, SOURCES[connector], as_of, False, carry=CARRY.get(connector, ()))
    return search.first_wins(found) if "place" in found.columns else found


def covered_startups(responses: DataFrame) -> DataFrame:
    """``scope`` of startups whose page was read, and of those whose page is gone."""
    return status(responses, "yc_jobs").where("status in ('ok', 'empty') or http_code = 404").select("scope").distinct()


def with_companies(responses: DataFrame, companies: DataFrame) -> DataFrame:
    """Startups' responses with ``name`` and ``one_liner`` of the startup list, by slug."""
    return responses.drop("name").join(companies.select("slug", "name", "one_liner"), "slug")


def board_keys(responses: DataFrame) -> DataFrame:
    """``scope`` and what a search of a venture board needs of its page: ``token`` and ``board``, or ``network`` and its ``label``; nulls if the page lacks them."""
    network = F.from_json(_cut(F.col("body"), GETRO_DATA), "struct<props:struct<pageProps:struct<network:struct<id:string,name:string>>>>")["props"]["pageProps"]["network"]
    return responses.select("scope", _cut(F.col("body"), CONSIDER_TOKEN).alias("token"), _cut(F.col("body"), CONSIDER_BOARD).alias("board"), network["id"].alias("network"), network["name"].alias("label"))


def startups(listed: DataFrame, hiring_only: bool = True) -> DataFrame:
    """The companies of a startup list that are open: ``ordinal, slug, name, batch, website, team_size, locations, one_liner, is_recent, in_india, variants``.

    listed: ``ordinal, slug, name, batch, website, team_size, all_locations, one_liner,
    status, is_hiring``; ``hiring_only``: the list is already one of those that hire.
    """
    words = {c: F.coalesce(c, F.lit("")) for c in ("name", "batch", "website", "one_liner")}
    kept = listed.where("coalesce(slug, '') <> '' and coalesce(status, 'Active') = 'Active'")
    kept = kept if hiring_only else kept.where("is_hiring")
    out = kept.select("ordinal", F.lower("slug").alias("slug"), "team_size", F.coalesce("all_locations", F.lit("")).alias("locations"), *(c.alias(k) for k, c in words.items()))
    return out.withColumns({"is_recent": F.col("batch").rlike(RECENT_BATCH), "in_india": F.col("locations").rlike(INDIA_HINT), "variants": slug_variants(F.col("slug"), F.col("name"), F.col("website"))})


def startup_index(companies: DataFrame, recent_only: bool = False) -> DataFrame:
    """``variant, yc_name, yc_batch, team_size, yc_locations, yc_one_liner``: of each name that a board may have, the company with the smallest team, then the first listed.

    A company makes several rows that are sorted by name, so companies are dealt first:
    a list is a small file, and would be few tasks that sort many times what they read.
    """
    pool = dealt(companies.where("is_recent") if recent_only else companies, "ordinal", "slug")
    size = F.coalesce(F.nullif("team_size", F.lit(0)), F.lit(9999))
    meta = F.struct(F.col("name").alias("yc_name"), F.col("batch").alias("yc_batch"), "team_size", F.col("locations").alias("yc_locations"), F.substring("one_liner", 1, 200).alias("yc_one_liner"))
    each = pool.select(F.posexplode("variants").alias("k", "variant"), size.alias("size"), "ordinal", meta.alias("meta"))
    return each.groupBy("variant").agg(F.min_by("meta", F.struct("size", "ordinal", "k")).alias("meta")).select("variant", "meta.*")


def attach_startups(postings: DataFrame, index: DataFrame) -> DataFrame:
    """Postings with what the index says of their board, whose name is the scope's, up to the first full stop; nulls for other boards."""
    variant = F.lower(F.substring_index(F.substring_index("scope", ":", -1), ".", 1))
    return postings.withColumn("variant", variant).join(index, "variant", "left").drop("variant")
