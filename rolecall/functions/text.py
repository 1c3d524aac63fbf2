"""Facts about a posting from its title, description and location, as column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolecall import vocabulary as v


def text_of(title: Column, description: Column) -> Column:
    return F.concat(title, F.lit("\n"), F.coalesce(description, F.lit("")))


def _number(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).cast("int")


def extract_yoe(title: Column, description: Column) -> Column:
    """``struct(min_yoe, max_yoe, source)``: a word of the title outranks any number of the text; null is not 0."""
    text, none = text_of(title, description), F.lit(None).cast("int")
    made = lambda low, high, source: F.struct(low.alias("min_yoe"), high.alias("max_yoe"), F.lit(source).alias("source"))
    low, high = _number(text, v.YOE_RANGE, 1), _number(text, v.YOE_RANGE, 2)
    return (
        F.when(title.rlike(v.STRONG_SENIORITY), made(F.lit(3), none, "title"))
        .when(title.rlike(v.INTERN) | title.rlike(v.NEW_GRAD) | title.rlike(v.JUNIOR_TITLE), made(F.lit(0), none, "title"))
        .when(title.rlike(v.SENIORITY), made(F.lit(3), none, "title"))
        .when(text.rlike(v.YOE_RANGE), made(F.least(low, high), F.greatest(low, high), "regex"))
        .when(text.rlike(v.YOE_MIN), made(_number(text, v.YOE_MIN, 1), none, "regex"))
        .when(text.rlike(v.YOE_PLAIN), made(_number(text, v.YOE_PLAIN, 1), none, "regex"))
        .when(text.rlike(v.NEW_GRAD) | text.rlike(v.INTERN), made(F.lit(0), none, "regex"))
        .otherwise(made(none, none, "none"))
    )


def extract_grad_years(text: Column, as_of_year: int) -> Column:
    """All graduation years named, from last year to six years ahead, distinct and sorted."""
    found = F.concat(*(F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in v.GRAD_PATTERNS))
    years = F.flatten(F.transform(found, lambda m: F.regexp_extract_all(m, F.lit(v.GRAD_YEAR), F.lit(0))))
    near = F.filter(F.transform(years, lambda y: y.cast("int")), lambda y: y.between(as_of_year - 1, as_of_year + 6))
    return F.array_sort(F.array_distinct(near))


def classify_role(title: Column, description: Column, tags: Column) -> Column:
    """The first role with a word in the title; interns' generic titles go by narrower words, then by the skills around."""
    t = F.lower(title)
    holds = lambda words: reduce(lambda a, b: a | b, (t.contains(w) for w in words))
    role = F.when(holds(v.ROLE_EXCLUDED), "other")
    for name, words in v.ROLE_WORDS:
        role = role.when(holds(words), name)
    intern = t.rlike(v.INTERN)
    for name, pattern in v.INTERN_ROLES:
        role = role.when(intern & t.rlike(pattern), name)
    around = F.concat_ws(" ", F.array_join(tags, " "), F.substring(F.coalesce(description, F.lit("")), 1, 1500))
    return role.when(intern, once(extract_tech_stack(around, tags), _role_of_skills)).otherwise("other")


def _role_of_skills(skills: Column) -> Column:
    has = lambda names: F.arrays_overlap(skills, F.array(*map(F.lit, names)))
    role = F.when(F.size(skills) == 0, "other")
    for name, names in v.SKILL_ROLES:
        if name == "frontend":
            role = role.when(has(names) & has(v.FULLSTACK_SERVERS), "fullstack")
        role = role.when(has(names), name)
    return role.otherwise("swe")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used: a lambda's argument is a variable."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _bounded(skill: str) -> str:
    return "(^|[^a-z0-9])" + "".join("\\" + c if c in ".+" else c for c in skill) + "([^a-z0-9]|$)"


def extract_tech_stack(text: Column, tags: Column) -> Column:
    """Known skills that stand alone in the text or the tags, aliases resolved, sorted."""
    hay = F.lower(F.concat_ws(" ", text, F.array_join(tags, " ")))
    names = dict(v.ALIASES)

    def found(h: Column) -> Column:
        # Most skills are nowhere in a text: the plain search is much cheaper than the pattern.
        return F.array_compact(F.array(*(F.when(h.contains(s) & h.rlike(_bounded(s)), F.lit(names.get(s, s))) for s in v.SKILLS)))

    return F.array_sort(F.array_distinct(once(hay, found)))


def detect_work_auth(description: Column) -> Column:
    """False if the employer sponsors, true if local authorization is asked for, else null."""
    return F.when(description.rlike(v.SPONSORS), False).when(description.rlike(v.WORK_AUTH), True)


def detect_sponsorship(description: Column) -> Column:
    return F.when(description.rlike(v.SPONSORS), True).when(description.rlike(v.NO_SPONSOR), False)


def detect_relocation(description: Column) -> Column:
    return F.coalesce(description.rlike(v.RELOCATION), F.lit(False))


def detect_remote(title: Column, location: Column, tags: Column) -> Column:
    hay = F.lower(F.concat_ws(" ", title, F.coalesce(location, F.lit("")), F.array_join(tags, " ")))
    # As with skills, plain searches come first: a pattern is tried where one of its words can be.
    named = lambda h, words: reduce(lambda a, b: a | b, (h.contains(w) for w in words))
    onsite = lambda h: ~h.contains("remote") & named(h, v.ONSITE_HINTS) & h.rlike(v.ONSITE)
    return once(hay, lambda h: F.when(onsite(h), False).otherwise(named(h, v.REMOTE_HINTS) & h.rlike(v.REMOTE)))


def region_of_location(location: Column, description: Column) -> Column:
    """The region of the first city table that fits; a German text means Europe; else null."""
    text = F.coalesce(location, F.lit(""))
    region = None
    for name, pattern in v.CITIES:
        region = F.when(text.rlike(pattern), name) if region is None else region.when(text.rlike(pattern), name)
    return region.when(description.rlike(v.GERMAN), "europe")


def resolve_regions(description: Column, location: Column, hints: Column) -> Column:
    """``struct(regions, source, confidence)``: a worldwide word, else the source's hint, else US-remote, else a city, else unknown."""
    text, place = F.coalesce(description, F.lit("")), F.coalesce(location, F.lit(""))
    made = lambda regions, source, confidence: F.struct(regions.alias("regions"), F.lit(source).alias("source"), F.lit(confidence).alias("confidence"))
    known = F.array_remove(hints, "unknown")
    city = region_of_location(location, description)
    everywhere = F.when(F.array_contains(hints, "india"), F.array(F.lit("india"), F.lit("worldwide"))).otherwise(F.array(F.lit("worldwide")))
    return (
        F.when(place.rlike(v.WORLDWIDE) | text.rlike(v.WORLDWIDE), made(everywhere, "regex", "high"))
        .when(F.size(known) > 0, made(known, "source", "high"))
        .when(text.rlike(v.US_REMOTE) | place.rlike(v.US_REMOTE), made(F.array(F.lit("us")), "regex", "medium"))
        .when(city.isNotNull(), made(F.array(city), "regex", "medium"))
        .otherwise(made(F.array(F.lit("unknown")), "none", "low"))
    )


def requires_us_eligibility(text: Column) -> Column:
    return F.coalesce(text.rlike(v.US_ONLY), F.lit(False))


def is_unpaid(text: Column) -> Column:
    return F.coalesce(text.rlike(v.UNPAID), F.lit(False))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def display_company(name: Column) -> Column:
    """A readable name for one that is all in lower case and without spaces, such as ``merkle-science``; others stay."""
    n = F.trim(F.coalesce(name, F.lit("")))
    runs = F.split(F.translate(n, "-_", "  "), r"(?<=\P{L})|(?=\P{L})")
    titled = F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)))), "")
    return F.when((n == F.lower(n)) & ~n.contains(" ") & (n != ""), titled).otherwise(n)


def normalize_company(name: Column) -> Column:
    """The name without parentheses and filler words, letters and digits only: what dedupe and exclusions compare."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(name), r"\([^)]*\)", " "), v.COMPANY_NOISE, "")
    return squeeze(F.regexp_replace(plain, "[^a-z0-9 ]", " "))


def normalize_title(title: Column) -> Column:
    return squeeze(F.regexp_replace(F.lower(title), "[^a-z0-9 +#.]", " "))


def brand_name(name: Column) -> Column:
    """Stricter than ``normalize_company``: only legal suffixes go."""
    plain = F.regexp_replace(F.translate(F.lower(name), "&", " "), r"\([^)]*\)", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, v.LEGAL_SUFFIX, " "), "[^a-z0-9. ]", " "), r"\s+", " "), r"^[ .]+|[ .]+$", "")


def description_hash(title: Column, company: Column, description: Column) -> Column:
    return F.sha2(F.concat_ws("\u0000", title, company, F.coalesce(description, F.lit(""))), 256)


def fit_id(source_job_id: Column) -> Column:
    """Ids over 256 characters become 214 and a digest."""
    return F.when(F.length(source_job_id) > 256, F.concat(F.substring(source_job_id, 1, 214), F.lit("~"), F.sha1(source_job_id))).otherwise(source_job_id)


def age_days(posted_at: Column, first_seen_at: Column, as_of: Column) -> Column:
    """Whole 24-hour periods since posting, or first sight; null if implausible."""
    age = F.greatest(F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(F.coalesce(posted_at, first_seen_at))) / 86400), F.lit(0)).cast("int")
    return F.when(age <= v.PLAUSIBLE_AGE_DAYS, age)


def parse_relative_posted(text: Column, as_of: Column) -> Column:
    """posted today, yesterday or n days ago; a plus sign ("30+ days") tells nothing."""
    t = F.lower(F.trim(text))
    days = F.regexp_extract(t, r"posted\s+(\d+)\s+days?\s+ago", 1).try_cast("int")
    back = F.when(t.contains("today"), 0).when(t.contains("yesterday"), 1).when(~t.contains("+"), days)
    return F.when(back.isNotNull(), as_of - F.make_dt_interval(back))


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-|-$", "")
