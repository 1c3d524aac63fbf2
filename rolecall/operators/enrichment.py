"""Answers of a model about postings: parsed, held against the posting's own words, and read from the cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall import vocabulary as v

# What a field may say, words that bear a region out, and the roles a listing asks for.
CONFIDENCES = ("high", "medium", "low")
EMPLOYMENTS = ("full_time", "internship", "contract", "part_time", "unknown")
ROLES = ("swe", "frontend", "backend", "fullstack", "ml", "data")
EVIDENCE = (
    ("worldwide", r"(?i)(worldwide|world\s?wide|anywhere\s+in\s+the\s+world|from\s+anywhere|work\s+from\s+anywhere|any\s+(country|timezone|time\s?zone)|globally|global(ly)?\s+(remote|distributed|team)|remote\s*[,(-]?\s*(global|anywhere)|no\s+location\s+requirement|fully\s+distributed|all\s+time\s?zones)"),
    ("india", r"(?i)\b(india|bangalore|bengaluru|hyderabad|pune|chennai|mumbai|delhi|gurgaon|noida)\b"),
    ("us", r"(?i)\b(united\s+states|u\.?s\.?a?\b|us[\s-]based|us\s+only)\b"),
    ("europe", r"(?i)\b(europe|european|eu\b|uk\b|united\s+kingdom|germany|netherlands|france|spain|poland|portugal)\b"),
    ("emea", r"(?i)\bemea\b"), ("apac", r"(?i)\b(apac|asia|singapore|japan|australia)\b"), ("canada", r"(?i)\bcanada|canadian\b"), ("latam", r"(?i)\b(latam|latin\s+america|brazil|mexico|argentina)\b"),
)

ANSWER = (
    "struct<results:array<struct<idx:int,min_yoe:int,max_yoe:int,is_new_grad:boolean,grad_year:int,hiring_regions:array<string>,confidence:string,"
    "work_auth_required:boolean,visa_sponsorship:boolean,employment_type:string,role_category:string,tech_stack:array<string>>>>"
)
EXTRACTION = (
    "min_yoe int, max_yoe int, is_new_grad boolean, grad_year int, hiring_regions array<string>, confidence string, "
    "work_auth_required boolean, visa_sponsorship boolean, employment_type string, role_category string, notes string, tech_stack array<string>"
)


def clamp_role(role: Column) -> Column:
    """A role that the listing doesn't ask for is other."""
    return F.when(role.isin(*ROLES), role).otherwise("other")


def _known(value: Column, known: tuple[str, ...], other: str) -> Column:
    return F.when(value.isin(*known), value).otherwise(other)


def verify_regions(regions: Column, text: Column) -> Column:
    """A struct ``regions, notes``: the regions that the text bears out, ``unknown`` if none, and what was rejected. ``unknown`` never stands beside another."""
    real = F.filter(regions, lambda r: r != "unknown")
    borne = F.lit(False)
    seen = lambda r: F.coalesce(*(F.when(r == name, F.coalesce(text.rlike(pattern), borne)) for name, pattern in EVIDENCE), F.lit(True))
    kept = F.filter(real, seen)
    said = F.array_join(F.transform(F.filter(real, lambda r: ~seen(r)), lambda r: F.concat(F.lit("rejected "), r, F.lit(": no supporting wording"))), "; ")
    return F.struct(F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lit("unknown"))).alias("regions"), F.nullif(said, F.lit("")).alias("notes"))


def parse_answers(answers: DataFrame, jobs: DataFrame) -> DataFrame:
    """``description_hash`` and ``EXTRACTION`` of ``batch, body`` answers about ``batch, idx, description_hash, title, location_raw, description``.

    An answer's index must be one of its batch's; of repeated indices the last counts.
    Values that aren't known become unknown, other or low; a region of low confidence
    is dropped, and any other needs wording in the posting. Bodies that aren't JSON give nothing.
    """
    item = answers.select("batch", F.posexplode(F.from_json("body", ANSWER)["results"]).alias("at", "a")).where("a.idx is not null")
    last = item.groupBy("batch", F.col("a.idx").alias("idx")).agg(F.max_by("a", "at").alias("a"))
    held = last.join(jobs.select("batch", "idx", "description_hash", "title", "location_raw", "description"), ["batch", "idx"])
    a = F.col("a")
    confidence = _known(a["confidence"], CONFIDENCES, "low")
    regions = F.array_distinct(F.transform(F.coalesce(a["hiring_regions"], F.array().cast("array<string>")), lambda r: _known(r, v.REGIONS, "unknown")))
    regions = F.when(confidence == "low", F.array().cast("array<string>")).otherwise(regions)
    checked = held.withColumn("checked", verify_regions(regions, F.concat_ws(" ", *(F.nullif(F.col(c), F.lit("")) for c in ("title", "location_raw", "description")))))
    rejected = F.col("checked.notes").isNotNull() & (F.col("checked.regions") == F.array(F.lit("unknown")))
    return checked.select(
        "description_hash", a["min_yoe"].alias("min_yoe"), a["max_yoe"].alias("max_yoe"), F.coalesce(a["is_new_grad"], F.lit(False)).alias("is_new_grad"), a["grad_year"].alias("grad_year"),
        F.col("checked.regions").alias("hiring_regions"), F.when(rejected, "low").otherwise(confidence).alias("confidence"), a["work_auth_required"].alias("work_auth_required"), a["visa_sponsorship"].alias("visa_sponsorship"),
        _known(a["employment_type"], EMPLOYMENTS, "unknown").alias("employment_type"), clamp_role(a["role_category"]).alias("role_category"), F.col("checked.notes").alias("notes"), F.coalesce(a["tech_stack"], F.array().cast("array<string>")).alias("tech_stack"),
    )


def read_cache(cache: DataFrame, wanted: DataFrame) -> DataFrame:
    """The cached extractions of the wanted ``description_hash``; roles are clamped again, rows that can't be read are left out."""
    kind = "struct<" + ",".join(f.replace(" ", ":", 1) for f in EXTRACTION.split(", ")) + ">"
    own = cache.join(wanted.select("description_hash").distinct(), "description_hash", "left_semi").where(F.try_parse_json("payload").isNotNull() & F.col("payload").rlike(r"^\s*\{"))
    read = own.select("description_hash", F.from_json("payload", kind).alias("e"))
    return read.select("description_hash", "e.*").withColumn("role_category", clamp_role(F.col("role_category")))


def apply(jobs: DataFrame, extractions: DataFrame) -> DataFrame:
    """``jobs`` with what the rules left open filled in; ``extractions`` has one row per description_hash. Nothing known is overridden."""
    names = [c.split()[0] for c in EXTRACTION.split(", ")]
    told = extractions.select("description_hash", *(F.col(c).alias(f"e_{c}") for c in names), F.lit(True).alias("told"))
    c = F.col
    open_region = (F.size("hiring_regions") == 0) | (c("hiring_regions") == F.array(F.lit("unknown")))
    yoe = c("min_yoe").isNull() & c("e_min_yoe").isNotNull()
    refined = (c("role_category") != "other") & (F.coalesce("e_role_category", F.lit("other")) != "other")
    return jobs.join(told, "description_hash", "left").withColumns({
        "min_yoe": F.coalesce("min_yoe", "e_min_yoe"), "max_yoe": F.when(yoe, c("e_max_yoe")).otherwise(c("max_yoe")), "is_new_grad": c("is_new_grad") | F.coalesce("e_is_new_grad", F.lit(False)),
        "grad_year": F.coalesce("grad_year", "e_grad_year"), "hiring_regions": F.when(open_region & (F.size("e_hiring_regions") > 0), c("e_hiring_regions")).otherwise(c("hiring_regions")),
        "requires_work_auth": F.coalesce("requires_work_auth", "e_work_auth_required"), "visa_sponsorship": F.coalesce("visa_sponsorship", "e_visa_sponsorship"),
        "employment_type": F.when(c("employment_type") == "unknown", F.coalesce("e_employment_type", "employment_type")).otherwise(c("employment_type")), "role_category": F.when(refined, c("e_role_category")).otherwise(c("role_category")),
        "tech_stack": F.when(F.size("e_tech_stack") > 0, F.array_sort(F.array_union("tech_stack", "e_tech_stack"))).otherwise(c("tech_stack")),
    }).select(*jobs.columns)


# Words of the paragraphs that say who may apply; the characters of a text and of a paragraph that are sent.
SIGNAL = (
    r"(?i)(requirement|qualification|who\s+you\s+are|what\s+we.?re\s+looking|about\s+you|eligib|experience|must\s+have|minimum|basic\s+qualif|"
    r"location|remote|visa|sponsor|authoriz|work\s+permit|time\s?zone)"
)
BUDGET, PARAGRAPH = 1400, 600


def condense(description: Column, budget: int = BUDGET) -> Column:
    """A text of at most ``budget`` characters: as it is if short enough, else its paragraphs, those with signal first, as far as they fit, in their order.

    A paragraph counts with its first 600 characters; one that doesn't fit is passed
    over. If none fits, the text's beginning. Null is empty.
    """
    blank = r"[\s\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
    strip = lambda c: F.regexp_replace(c, f"^{blank}+|{blank}+$", "")
    text = F.regexp_replace(strip(F.coalesce(description, F.lit(""))), "\n{3,}", "\n\n")
    paragraphs = F.filter(F.transform(F.split(text, f"\n{blank}*\n"), strip), lambda p: p != "")
    ranked = F.array_sort(F.transform(paragraphs, lambda p, i: F.struct(F.when(p.rlike(SIGNAL), 0).otherwise(1).alias("rank"), i.alias("i"), F.substring(p, 1, PARAGRAPH).alias("p"))))
    none = F.struct(F.lit(0).alias("used"), F.array().cast("array<struct<i:int,p:string>>").alias("kept"))
    fits = lambda told, x: told["used"] + F.char_length(x["p"]) <= budget
    add = lambda told, x: F.struct((told["used"] + F.char_length(x["p"])).alias("used"), F.array_append(told["kept"], F.struct(x["i"].alias("i"), x["p"].alias("p"))).alias("kept"))
    kept = F.aggregate(ranked, none, lambda told, x: F.when(fits(told, x), add(told, x)).otherwise(told))["kept"]
    joined = F.array_join(F.transform(F.array_sort(kept), lambda x: x["p"]), "\n\n")
    return F.when(F.char_length(text) <= budget, text).when(joined != "", joined).otherwise(F.substring(text, 1, budget))
