"""Whether a posting is still open: by its page, and by what its board's own endpoint says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a page that is gone says, codes, path parts that name no posting, and how much of a page is looked at.
GONE = (
    r"(?i)(page\s+not\s+found|404\s*[-–—:|]?\s*(page|not\s+found|error)|job\s+(is\s+)?(no\s+longer|not)\s+(available|active|found|listed)|"
    r"this\s+(job|position|posting|role|requisition|opportunity)\s+(has\s+been|is)\s+(closed|filled|removed|expired|archived)|position\s+(has\s+been\s+)?filled|"
    r"no\s+longer\s+accepting\s+(applications|applicants|submissions)|posting\s+(has\s+)?expired|this\s+listing\s+has\s+expired|"
    r"the\s+(job|position|role)\s+you\s+are\s+looking\s+for\s+is\s+no\s+longer\s+available|we\s+are\s+no\s+longer\s+accepting\s+applications|"
    r"applications\s+(are\s+)?closed|check\s+if\s+the\s+url\s+is\s+correct)"
)
PAGE_TITLE = r"(?i)<title[^>]*>([^<]{0,160})</title>"
DEAD_CODES, BLOCKED_CODES = (404, 410), (401, 403, 429)
GENERIC_PARTS = ("job", "jobs", "career", "careers", "apply", "opening", "openings", "en", "en-us", "us", "india", "position", "positions", "search", "search-jobs")
LOOKED_AT = 60_000


def identity_token(url: Column) -> Column:
    """The last part of the path that names this posting, in lower case; null if none does."""
    path = F.regexp_replace(F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), ";[^/]*$", "")
    parts = F.filter(F.split(path, "/"), lambda x: (F.length(x) >= 4) & ~F.lower(x).isin(*GENERIC_PARTS))
    return F.lower(F.try_element_at(parts, F.lit(-1)))


def redirected_away(requested: Column, final: Column) -> Column:
    """Whether the URL that answered no longer names the posting that was asked for."""
    token, bare = identity_token(requested), lambda u: F.regexp_replace(u, "/+$", "")
    return F.coalesce((bare(requested) != bare(final)) & ~F.contains(F.lower(final), token), F.lit(False))


def looks_dead(body: Column) -> Column:
    """The marker if a page reads like one that isn't there; its title counts most."""
    seen = F.substring(body, 1, LOOKED_AT)
    title = F.regexp_extract(seen, PAGE_TITLE, 1)
    marker = F.regexp_extract(seen, GONE, 0)
    return F.when(title.rlike(GONE) | title.rlike(r"^\s*404\s*$"), F.concat(F.lit("title: "), F.substring(F.trim(title), 1, 60))).when(marker != "", F.concat(F.lit("body: "), F.substring(marker, 1, 60)))


def link_status(answers: DataFrame) -> DataFrame:
    """Adds ``status`` and ``reason`` to ``url, final_url, http_code, content_type, body``.

    dead: 404 or 410, a redirect to another page, or a page that says so. unknown: no
    answer, a refusal or a server error, which never count against a posting. Else alive.
    """
    code, kind = F.col("http_code"), F.coalesce(F.col("content_type"), F.lit(""))
    said = F.when(kind.contains("html") | kind.contains("text"), looks_dead(F.col("body")))
    away = redirected_away(F.col("url"), F.coalesce("final_url", "url"))
    told = lambda status, reason: F.struct(F.lit(status).alias("status"), reason.cast("string").alias("reason"))
    state = (
        F.when(code.isNull(), told("unknown", F.lit("no answer"))).when(code.isin(*DEAD_CODES), told("dead", F.lit("http status")))
        .when(away, told("dead", F.concat(F.lit("redirected to "), F.substring("final_url", 1, 60)))).when(code.isin(*BLOCKED_CODES), told("unknown", F.lit("blocked")))
        .when(code >= 500, told("unknown", F.lit("server error"))).when(said.isNotNull(), told("dead", said)).otherwise(told("alive", F.lit(None)))
    )
    return answers.withColumn("state", state).select(*answers.columns, "state.status", "state.reason")


def workday_api_url(source_job_id: Column, url: Column) -> Column:
    """The endpoint that answers for one posting, rebuilt from its id ``tenant:site:path``; null for ids and hosts of other kinds."""
    parts = F.split(source_job_id, ":", 3)
    host = F.when(url.contains("//"), F.regexp_extract(url, r"//([^/]*)", 1)).otherwise(F.concat(F.get(parts, F.lit(0)), F.lit(".wd1.myworkdayjobs.com")))
    return F.when((F.size(parts) == 3) & host.endswith("myworkdayjobs.com"), F.concat(F.lit("https://"), host, F.lit("/wday/cxs/"), F.get(parts, F.lit(0)), F.lit("/"), F.get(parts, F.lit(1)), F.get(parts, F.lit(2))))


def liveness(answers: DataFrame) -> DataFrame:
    """``source, source_job_id, open, deadline, reason`` of the endpoint's answers; ``open`` is null where they tell nothing."""
    code = F.col("http_code")
    info = F.from_json("body", "struct<jobPostingInfo:struct<canApply:boolean,posted:boolean,endDate:string>>")["jobPostingInfo"]
    shut = F.coalesce(~info["canApply"], F.lit(False)) | F.coalesce(~info["posted"], F.lit(False))
    readable = F.try_parse_json("body").isNotNull()
    told = lambda open_, reason: F.struct(F.lit(open_).cast("boolean").alias("open"), reason.cast("string").alias("reason"))
    state = (
        F.when(code.isin(*DEAD_CODES), told(False, F.lit("requisition gone"))).when(code.isNull(), told(None, F.lit("no answer")))
        .when(code != 200, told(None, F.concat(F.lit("HTTP "), code.cast("string")))).when(~readable, told(None, F.lit("unparseable")))
        .when(shut, told(False, F.lit("not accepting applications"))).otherwise(told(True, F.lit(None)))
    )
    day = F.when((code == 200) & info["endDate"].rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), info["endDate"].try_cast("timestamp")).cast("timestamp_ntz")
    return answers.select("source", "source_job_id", state.alias("s"), day.alias("deadline")).select("source", "source_job_id", "s.open", "deadline", "s.reason")


def verify_open(jobs: DataFrame, told: DataFrame, as_of: str) -> DataFrame:
    """``jobs`` with ``closed_reason``: null where they stay. A deadline that the board gives replaces the stored one.

    Jobs the board says nothing of stay as they are. ``told`` has one row per key.
    """
    deadline = F.when(F.coalesce(F.col("open"), F.lit(True)), F.coalesce("told_deadline", "deadline")).otherwise(F.col("deadline"))
    reason = F.when(~F.col("open"), "board says applications are closed").when(F.col("told_deadline") < F.lit(as_of).cast("timestamp_ntz"), "application deadline passed")
    found = jobs.join(told.select("source", "source_job_id", "open", F.col("deadline").alias("told_deadline")), ["source", "source_job_id"], "left")
    return found.withColumns({"closed_reason": reason, "deadline": deadline}).select(*jobs.columns, "closed_reason")
