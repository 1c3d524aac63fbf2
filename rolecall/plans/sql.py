"""The rules once more in SQL, as common table expressions that the oracle queries start from."""

from __future__ import annotations

from rolecall import vocabulary as v
from rolecall.sources.postings import AS_OF, POSTINGS_SQL

NOW = f"TIMESTAMP '{AS_OF}'"


def lit(x: object) -> str:
    return "'" + str(x).replace("'", "''") + "'"


def rx(text: str, pattern: str) -> str:
    return f"coalesce(regexp_matches({text}, {lit(pattern)}), false)"


def strings(values) -> str:
    return "[" + ", ".join(map(lit, values)) + "]"


def _case(tests, otherwise: str | None = None) -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in tests) + (f" ELSE {otherwise}" if otherwise else "") + " END"


def _stack(hay: str) -> str:
    names = dict(v.ALIASES)
    tests = ", ".join(
        f"CASE WHEN regexp_matches({hay}, {lit('(^|[^a-z0-9])' + ''.join(chr(92) + c if c in '.+' else c for c in s) + '([^a-z0-9]|$)')}) THEN {lit(names.get(s, s))} END"
        for s in v.SKILLS
    )
    return f"list_sort(list_distinct(list_filter([{tests}], lambda s: s IS NOT NULL)))"


def _holds(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(w)})" for w in words) + ")"


def _role() -> str:
    intern = rx("lower(title)", v.INTERN)
    has = lambda names: f"list_has_any(around_skills, {strings(names)})"
    tests = [(_holds("lower(title)", v.ROLE_EXCLUDED), "'other'")]
    tests += [(_holds("lower(title)", words), lit(name)) for name, words in v.ROLE_WORDS]
    tests += [(f"{intern} AND {rx('lower(title)', p)}", lit(name)) for name, p in v.INTERN_ROLES]
    for name, names in v.SKILL_ROLES:
        if name == "frontend":
            tests.append((f"{intern} AND {has(names)} AND {has(v.FULLSTACK_SERVERS)}", "'fullstack'"))
        tests.append((f"{intern} AND {has(names)}", lit(name)))
    return _case([*tests, (f"{intern} AND len(around_skills) > 0", "'swe'")], "'other'")


def _yoe(part: str) -> str:
    num = lambda p, g: f"CAST(regexp_extract(body, {lit(p)}, {g}) AS INT)"
    low, high = num(v.YOE_RANGE, 1), num(v.YOE_RANGE, 2)
    value = {
        "min": ("3", "0", f"least({low}, {high})", num(v.YOE_MIN, 1), num(v.YOE_PLAIN, 1), "0", "NULL"),
        "max": ("NULL", "NULL", f"greatest({low}, {high})", "NULL", "NULL", "NULL", "NULL"),
        "source": ("'title'", "'title'", "'regex'", "'regex'", "'regex'", "'regex'", "'none'"),
    }[part]
    return _case([
        (rx("title", v.STRONG_SENIORITY), value[0]),
        (" OR ".join(rx("title", p) for p in (v.INTERN, v.NEW_GRAD, v.JUNIOR_TITLE)), value[1]),
        (rx("title", v.SENIORITY), value[0]), (rx("body", v.YOE_RANGE), value[2]), (rx("body", v.YOE_MIN), value[3]),
        (rx("body", v.YOE_PLAIN), value[4]), (rx("body", v.NEW_GRAD) + " OR " + rx("body", v.INTERN), value[5]),
    ], value[6])


def _grad_years() -> str:
    found = ", ".join(f"flatten(list_transform(regexp_extract_all(body, {lit(p)}), lambda m: regexp_extract_all(m, '{v.GRAD_YEAR}')))" for p in v.GRAD_PATTERNS)
    year = int(AS_OF[:4])
    return f"list_sort(list_distinct(list_filter(list_transform(flatten([{found}]), lambda y: CAST(y AS INT)), lambda y: y BETWEEN {year - 1} AND {year + 6})))"


def _place(part: str) -> str:
    city = _case([*((rx("place", p), lit(name)) for name, p in v.CITIES), (rx("description", v.GERMAN), "'europe'")])
    known = "list_filter(hiring_regions_hint, lambda r: r <> 'unknown')"
    value = {
        "regions": ("CASE WHEN list_contains(hiring_regions_hint, 'india') THEN ['india', 'worldwide'] ELSE ['worldwide'] END", known, "['us']", f"[{city}]", "['unknown']"),
        "source": ("'regex'", "'source'", "'regex'", "'regex'", "'none'"),
        "confidence": ("'high'", "'high'", "'medium'", "'medium'", "'low'"),
    }[part]
    return _case([
        (rx("place", v.WORLDWIDE) + " OR " + rx("description", v.WORLDWIDE), value[0]), (f"len({known}) > 0", value[1]),
        (rx("description", v.US_REMOTE) + " OR " + rx("place", v.US_REMOTE), value[2]), (f"{city} IS NOT NULL", value[3]),
    ], value[4])


def _degree_in(text: str) -> str:
    """Whether a degree is asked for with no bachelor's within 160 characters of it: each match is put back between the pieces around it."""
    gaps, hits = f"regexp_split_to_array({text}, {lit(v.ADVANCED_DEGREE)})", f"regexp_extract_all({text}, {lit(v.ADVANCED_DEGREE)})"
    before = f"right(array_to_string(list_transform(range(1, k + 1), lambda i: coalesce({hits}[i - 1], '') || {gaps}[i]), ''), 160)"
    after = f"left(array_to_string(list_transform(range(k + 1, len({gaps}) + 1), lambda i: {gaps}[i] || coalesce({hits}[i], '')), ''), 160)"
    near = f"list_transform(range(1, len({hits}) + 1), lambda k: {before} || {hits}[k] || {after})"
    return f"coalesce(len(list_filter({near}, lambda w: NOT {rx('w', v.BACHELOR_OK)})) > 0, false)"


def url_part(url: str, k: int) -> str:
    return f"coalesce(regexp_extract({url}, '(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\\?([^#]*))?', {k}), '')"


def host_sql(url: str) -> str:
    return f"regexp_replace(lower(regexp_replace(regexp_replace({url_part(url, 2)}, '^.*@', ''), ':[0-9]*$', '')), '^www\\.', '')"


def kept_sql(url: str, tracking: str) -> str:
    decoded = lambda text: f"url_decode(replace({text}, '+', ' '))"
    pairs = f"list_filter(string_split({url_part(url, 4)}, '&'), lambda p: instr(p, '=') BETWEEN 1 AND length(p) - 1)"
    named = f"list_transform({pairs}, lambda p: {{'k': {decoded('p[:instr(p, chr(61)) - 1]')}, 'v': {decoded('p[instr(p, chr(61)) + 1:]')}}})"
    return f"list_filter({named}, lambda x: NOT regexp_matches(x.k, {lit(tracking)}))"


def canonical_sql(url: str) -> str:
    kept = f"list_sort(list_transform({kept_sql(url, v.DEDUPE_TRACKING)}, lambda x: x.k || '=' || x.v))"
    return (
        f"CASE WHEN coalesce({url}, '') = '' THEN '' ELSE lower({url_part(url, 1)}) || '://' || {host_sql(url)} || regexp_extract({url_part(url, 2)}, '(:[0-9]+)$', 1) || "
        f"regexp_replace({url_part(url, 3)}, '/+$', '') || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END END"
    )


def strip_sql(url: str) -> str:
    kept, path = kept_sql(url, v.TRACKING), f"regexp_replace({url_part(url, 3)}, '/+$', '')"
    names = f"list_transform({kept}, lambda x: x.k)"
    by_name = f"list_transform(list_distinct({names}), lambda n: {{'at': list_position({names}, n), 'said': array_to_string(list_transform(list_filter({kept}, lambda x: x.k = n), lambda x: x.k || '=' || x.v), '&')}})"
    return (
        f"lower({url_part(url, 1)}) || '://' || lower({url_part(url, 2)}) || CASE WHEN {path} = '' THEN '/' ELSE {path} END || "
        f"CASE WHEN len({kept}) > 0 THEN '?' || array_to_string(list_transform(list_sort({by_name}), lambda x: x.said), '&') ELSE '' END"
    )


def company_sql(name: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({name}), '\\([^)]*\\)', ' ', 'g'), {lit(v.COMPANY_NOISE)}, '', 'g'), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g'))"


def brand_sql(name: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(lower({name}), '&', ' '), '\\([^)]*\\)', ' ', 'g'), {lit(v.LEGAL_SUFFIX)}, ' ', 'g'), '[^a-z0-9. ]', ' ', 'g'), '\\s+', ' ', 'g'), '^[ .]+|[ .]+$', '', 'g')"


_AGE = f"CAST(greatest(floor((epoch({NOW}) - epoch(coalesce(posted_at, first_seen_at))) / 86400), 0) AS INT)"
_HAY = "lower(concat_ws(' ', title, place, array_to_string(tags, ' ')))"

NORMALIZED_SQL = POSTINGS_SQL + f""", texts AS (
  SELECT *, title || chr(10) || coalesce(description, '') AS body, coalesce(location_raw, '') AS place FROM postings
), skilled AS (
  SELECT *, {_stack("lower(concat_ws(' ', body, array_to_string(tags, ' ')))")} AS tech_stack,
    {_stack("lower(concat_ws(' ', array_to_string(tags, ' '), substring(coalesce(description, ''), 1, 1500), array_to_string(tags, ' ')))")} AS around_skills
  FROM texts
), read AS (
  SELECT *, {_role()} AS role_category, {_yoe("min")} AS read_min, {_yoe("max")} AS read_max, {_yoe("source")} AS yoe_source, {_grad_years()} AS grad_years,
    {_place("regions")} AS hiring_regions, {_place("source")} AS region_source, {_place("confidence")} AS region_confidence,
    CASE WHEN {rx("title", v.INTERN)} THEN 'internship' WHEN {rx("title", v.STRONG_SENIORITY)} THEN 'full_time' ELSE employment_type_hint END AS employment_type,
    CASE WHEN {rx(_HAY, v.ONSITE)} AND NOT contains({_HAY}, 'remote') THEN false ELSE {rx(_HAY, v.REMOTE)} END AS is_remote,
    CASE WHEN {rx("description", v.SPONSORS)} THEN false WHEN {rx("description", v.WORK_AUTH)} THEN true END AS requires_work_auth,
    CASE WHEN {rx("description", v.SPONSORS)} THEN true WHEN {rx("description", v.NO_SPONSOR)} THEN false END AS visa_sponsorship,
    {rx("title", v.NEW_GRAD)} OR {rx("title", v.INTERN)} OR {rx("description", v.NEW_GRAD)} AS is_new_grad,
    {rx("body", v.US_ONLY)} AS us_eligibility, {rx("body", v.UNPAID)} AS unpaid,
    {company_sql("company")} AS company_normalized,
    trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9 +#.]', ' ', 'g'), '\\s+', ' ', 'g')) AS title_normalized,
    {canonical_sql("url")} AS canonical_url, {_AGE} AS raw_age_days, CASE WHEN {_AGE} <= {v.PLAUSIBLE_AGE_DAYS} THEN {_AGE} END AS age_days,
    {rx("title", v.ADVANCED_DEGREE)} OR {_degree_in("description")} AS advanced_degree
  FROM skilled
), normalized AS (
  SELECT *, CASE WHEN employment_type = 'internship' THEN 0 ELSE read_min END AS min_yoe, CASE WHEN employment_type <> 'internship' THEN read_max END AS max_yoe, grad_years[1] AS grad_year
  FROM read WHERE role_category <> 'other'
)"""


def _gate() -> str:
    cap = f"CASE WHEN source IN ({', '.join(map(lit, v.ATS_SOURCES))}) THEN {v.ATS_MAX_AGE_DAYS} ELSE {v.MAX_AGE_DAYS} END"
    cap = f"CASE WHEN employment_type = 'internship' THEN least({cap}, {v.INTERN_MAX_AGE_DAYS}) ELSE {cap} END"
    age = "CASE WHEN posted_at IS NOT NULL THEN raw_age_days ELSE age_days END"
    blocked = f"len(hiring_regions) > 0 AND len(list_filter(hiring_regions, lambda r: r NOT IN ({', '.join(map(lit, v.BLOCKING_REGIONS))}))) = 0"
    sponsors, unknown = "coalesce(visa_sponsorship, false)", "list_contains(hiring_regions, 'unknown')"
    return _case([
        ("role_category = 'other'", "'role not in scope'"),
        (f"company_normalized IN ({', '.join(map(lit, v.EXCLUDED_COMPANIES))})", "'aggregator / staffing agency'"),
        (f"deadline < {NOW}", "'application deadline passed'"), ("advanced_degree", "'requires PhD / Master''s'"),
        ("us_eligibility AND NOT list_contains(hiring_regions, 'india')", "'requires US work eligibility'"), ("unpaid", "'unpaid'"),
        (f"len(grad_years) > 0 AND NOT list_contains(grad_years, {v.GRADUATION_YEAR})", "'class of ' || array_to_string(grad_years, '/') || ' only'"),
        (f"({age}) > ({cap})", f"'posted ' || CAST(({age}) AS VARCHAR) || 'd ago'"),
        *((rx("concat_ws(' ', title, location_raw)", "(?i)" + p), lit(f"employment type excluded ({p})")) for p in v.EMPLOYMENT_EXCLUDED),
        (f"employment_type NOT IN ({', '.join(map(lit, v.EMPLOYMENT_ALLOWED))})", "'employment type ' || employment_type"),
        (f"min_yoe > {v.MAX_MIN_YOE}", "'requires ' || CAST(min_yoe AS VARCHAR) || '+ yoe'"),
        (f"{blocked} AND NOT {sponsors}", "'region not reachable (' || hiring_regions[1] || ')'"),
        (f"coalesce(requires_work_auth, false) AND NOT {sponsors} AND NOT list_contains(hiring_regions, 'india')", "'requires local work authorization'"),
        (f"{unknown} AND NOT is_remote", "'onsite, region unresolved'"),
        (f"NOT {unknown} AND NOT list_has_any(hiring_regions, {strings(v.ALLOWED_REGIONS)})", "CASE WHEN is_remote THEN 'remote in ' ELSE 'onsite in ' END || array_to_string(list_sort(hiring_regions), '/') || ', not reachable'"),
    ])


_COMPANY = f"CASE WHEN source IN ({', '.join(map(lit, v.EMPLOYER_SOURCES))}) THEN 0.5e0 ELSE 0.15e0 END"
_COMPANY = f"CASE WHEN vc IS NOT NULL THEN greatest({_COMPANY}, 0.75e0) ELSE {_COMPANY} END"
_COMPANY = f"CASE WHEN yc_batch IS NOT NULL THEN greatest({_COMPANY}, 0.8e0) + CASE WHEN team_size BETWEEN 1 AND {v.SMALL_TEAM} THEN 0.2e0 ELSE 0e0 END ELSE {_COMPANY} END"
_NOTABLE = f"{brand_sql('company')} IN ({', '.join(map(lit, v.NOTABLE_COMPANIES))})"
_HOURS = f"(epoch({NOW}) - epoch(posted_at)) / 3600"
_HITS = lambda names: f"len(list_intersect(tech_stack, {strings(names)}))"
PARTS_SQL = {
    "reachability": "28 * CASE WHEN list_contains(hiring_regions, 'worldwide') THEN CASE WHEN is_remote THEN 1e0 ELSE 0.8e0 END WHEN list_contains(hiring_regions, 'india') THEN CASE WHEN is_remote THEN 0.9e0 ELSE 0.7e0 END WHEN NOT is_remote THEN 0e0 WHEN visa_sponsorship THEN 0.45e0 WHEN list_contains(hiring_regions, 'apac') THEN 0.4e0 WHEN hiring_regions = ['unknown'] THEN 0.3e0 ELSE 0e0 END",
    "stage": f"25 * CASE WHEN employment_type = 'internship' THEN 1e0 WHEN grad_year = {v.GRADUATION_YEAR} THEN 0.95e0 WHEN grad_year IS NOT NULL THEN 0.3e0 WHEN is_new_grad THEN 0.8e0 WHEN min_yoe = 0 THEN 0.6e0 WHEN min_yoe IS NULL THEN 0.25e0 ELSE greatest(0e0, (1 - min_yoe / 3e0) * 0.5e0) END",
    "stack": f"18 * CASE WHEN len(tech_stack) = 0 THEN 0.4e0 ELSE 0.8e0 * least(1e0, {_HITS(v.STRONG)} / 4e0) + 0.2e0 * least(1e0, {_HITS(v.LEARNING)} / 2e0) END",
    "freshness": f"9 * CASE WHEN posted_at IS NULL OR age_days IS NULL THEN 0.3e0 WHEN {_HOURS} <= 24 THEN 1e0 WHEN {_HOURS} <= 72 THEN 0.7e0 WHEN {_HOURS} <= 168 THEN 0.4e0 ELSE 0.1e0 END",
    "company": f"15 * CASE WHEN {_NOTABLE} THEN 1e0 ELSE least(1e0, {_COMPANY}) END",
    "role": "3 * CASE WHEN role_category <> 'other' THEN 1e0 ELSE 0e0 END",
    "confidence": "2 * CASE WHEN region_confidence = 'high' THEN 1e0 ELSE 0e0 END",
}
_TOP_HITS = f"list_slice(list_sort(list_intersect(tech_stack, {strings(v.STRONG)})), 1, 3)"
REASONS_SQL = f"""list_slice(list_filter([
  CASE WHEN list_contains(hiring_regions, 'worldwide') THEN CASE WHEN is_remote THEN 'remote, hires worldwide' ELSE 'hires worldwide' END
    WHEN list_contains(hiring_regions, 'india') THEN CASE WHEN is_remote THEN 'remote in India' ELSE 'onsite in India' END WHEN NOT is_remote THEN 'onsite abroad'
    WHEN visa_sponsorship THEN 'remote, sponsors visa' WHEN list_contains(hiring_regions, 'apac') THEN NULL WHEN hiring_regions = ['unknown'] THEN 'region unclear' END,
  CASE WHEN employment_type = 'internship' THEN 'internship' WHEN grad_year = {v.GRADUATION_YEAR} THEN 'class of {v.GRADUATION_YEAR}' WHEN grad_year IS NOT NULL THEN NULL
    WHEN is_new_grad THEN 'new-grad friendly' WHEN min_yoe = 0 THEN '0 years required' END,
  CASE WHEN len({_TOP_HITS}) > 0 THEN 'matches ' || array_to_string({_TOP_HITS}, ', ') END,
  CASE WHEN posted_at IS NULL OR age_days IS NULL THEN NULL WHEN {_HOURS} <= 24 THEN 'posted today' WHEN {_HOURS} <= 72 THEN 'posted this week' END,
  CASE WHEN {_NOTABLE} THEN 'well-known company' WHEN vc IS NOT NULL THEN 'backed by ' || vc END,
  CASE WHEN NOT {_NOTABLE} AND yc_batch IS NOT NULL THEN 'YC ' || yc_batch END,
  CASE WHEN NOT {_NOTABLE} AND yc_batch IS NOT NULL AND team_size BETWEEN 1 AND {v.SMALL_TEAM} THEN 'small team (' || CAST(team_size AS VARCHAR) || ')' END
], lambda x: x IS NOT NULL), 1, 5)"""

JOBS_SQL = NORMALIZED_SQL + f""", gated AS (
  SELECT *, {_gate()} AS drop_reason FROM normalized
), jobs AS (
  SELECT *, round({' + '.join(PARTS_SQL.values())}, 2) AS match_score, ordinal % 13 <> 0 AS is_active,
    CASE ordinal % 17 WHEN 0 THEN 'dead' WHEN 1 THEN 'alive' END AS link_status,
    CASE WHEN ordinal % 17 <= 1 THEN {NOW} - to_hours(CAST(ordinal % 50 AS INT)) END AS link_checked_at
  FROM gated
)"""
