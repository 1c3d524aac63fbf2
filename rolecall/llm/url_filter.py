"""URL filtering by host and path rules, carried over redirect and canonical-link aliases."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.functions.urls import resolve
from rolecall.operators.components import connected_components
from rolecall.operators.joins import join_hot
from rolecall.staging import stage_table


class Rule(NamedTuple):
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    host: str
    path: str
    verdict: str


RULES = (
    Rule("com", "/", "allow"),
    Rule("example.com", "/en/", "block"),
    Rule("www.example.com", "/en/", "allow"),
    Rule("net", "/es/", "block"),
    Rule("net", "/fr/", "block"),
)
#: Up to so many rules are one CASE expression; more are joined as a table.
MOST_RULES = 500
RULE_COLUMNS = "host string, path string, verdict string, ordinal int"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Query parameters that don't change the page.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
#: Links with a scheme; without ``//`` after it they lead to no page, as ``mailto:``.
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
#: A tag up to its end, which isn't one within quotes, and an attribute with its value.
TAG = r"""(?is)<%s\b(?:"[^"]*+"|'[^']*+'|[^'">]++)*+>"""
ATTRIBUTE = r"""(?s)[^\s"'>/=]+\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>]+)"""


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def page_key(url: Column) -> Column:
    """The URL without scheme, fragment, tracking parameters and slashes at the end; null without a host."""
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)), "&")
    key = F.concat(host_of(url), F.regexp_replace(path_of(url), "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(host_of(url) != "", key)


def _attribute(tag: Column, name: str) -> Column:
    """The value of a tag's first attribute of that name; null if it has none."""
    own = F.filter(F.regexp_extract_all(tag, F.lit(ATTRIBUTE), F.lit(0)), lambda a: F.lower(F.regexp_extract(a, r"^[^\s=]+", 0)) == name)
    value = F.regexp_extract(F.get(own, F.lit(0)), r"(?s)=\s*(.*)$", 1)
    return F.regexp_replace(value, r"""(?s)^(["'])(.*)\1$""", "$2")


def _first(html: Column, tag: str, key: str, word: str, value: str) -> Column:
    """``value`` of the first ``tag`` whose attribute ``key`` has ``word`` among its blank-separated words."""
    fits = lambda t: F.array_contains(F.split(F.lower(F.coalesce(_attribute(t, key), F.lit(""))), r"\s+"), word)
    return _attribute(F.get(F.filter(F.regexp_extract_all(html, F.lit(TAG % tag), F.lit(0)), fits), F.lit(0)), value)


def link_target(html: Column, url: Column) -> Column:
    """Where a page says it really is: its canonical link, else its refresh redirect; else null.

    ``rel`` may name more than ``canonical``. A link is resolved by RFC 3986 against the
    page; one that starts with a scheme and ``//`` is absolute, whatever its query holds.
    """
    html = F.when(F.lower(html).rlike("canonical|refresh"), html)
    canonical = F.trim(_first(html, "link", "rel", "canonical", "href"))
    refresh = F.regexp_extract(_first(html, "meta", "http-equiv", "refresh", "content"), r"""(?is)(?:^|[\s;,])url\s*=\s*["']?([^"'\s>]+)""", 1)
    link = F.regexp_replace(F.coalesce(F.nullif(canonical, F.lit("")), refresh), "(?i)&amp;", "&")
    nowhere = (F.coalesce(link, F.lit("")) == "") | link.startswith("#") | (link.rlike(SCHEME) & ~link.rlike(SCHEME + "//"))
    return F.when(~nowhere, resolve(F.when(host_of(url) != "", F.concat(F.lit("http://"), host_of(url), path_of(url))).otherwise(""), link))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; nulls if none fits."""
    name = verdict = None
    for r in sorted(rules, key=lambda r: -len(r.host + r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name = F.when(fits, r.host + r.path) if name is None else name.when(fits, r.host + r.path)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    return name if name is not None else F.lit(None).cast("string"), verdict if verdict is not None else F.lit(None).cast("string")


def rule_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    """The rules as ``RULE_COLUMNS``."""
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rules)], RULE_COLUMNS)


def find_rules(places: DataFrame, rules: DataFrame) -> DataFrame:
    """``host, path, rule, ruled`` of distinct ``places`` (host, path, never null) by any number of ``rules`` (``RULE_COLUMNS``).

    A place has as many domains as its host has labels, and as many beginnings of its
    path as the rules' paths have lengths, which are few; each pair of them is looked up
    by equality. So a domain with a million rules costs its pages no more than one with
    one. The longest rule wins, of equally long ones the first.
    """
    once = rules.groupBy("host", "path").agg(F.min_by("verdict", "ordinal").alias("verdict"), F.min("ordinal").alias("ordinal"))
    lengths = [r[0] for r in once.select(F.char_length("path").alias("n")).distinct().collect()]  # as many as a URL is long at most
    labels = F.split("host", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    begins = F.transform(F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.char_length("path")), lambda n: F.left("path", n))
    tried = places.select("host", "path", F.explode(domains).alias("domain"), begins.alias("begins")).select("host", "path", "domain", F.explode("begins").alias("begin"))
    met = tried.join(once.select(F.col("host").alias("domain"), F.col("path").alias("begin"), "verdict", "ordinal"), ["domain", "begin"])
    name = F.concat("domain", "begin")
    return met.groupBy("host", "path").agg(F.max_by(F.struct(name.alias("rule"), F.col("verdict").alias("ruled")), F.struct(F.char_length(name), -F.col("ordinal"))).alias("r")).select("host", "path", "r.*")


def _with_rules(rows: DataFrame, rules: DataFrame, host: str, path: str, rule: str, verdict: str) -> DataFrame:
    """``rows``, staged, with the rule and verdict of the place in ``host`` and ``path``; many rows of one place meet its rule by ``join_hot``."""
    place = F.concat_ws("/", host, path)  # no host holds a slash
    counts = rows.groupBy(place.alias("place"), F.col(host).alias("host"), F.col(path).alias("path")).agg(F.count("*").alias("n_rows"))
    counts = stage_table(counts)
    found = counts.join(find_rules(counts.select("host", "path"), rules), ["host", "path"]).select("place", F.col("rule").alias(rule), F.col("ruled").alias(verdict), "n_rows")
    return join_hot(rows.withColumn("place", place), stage_table(found), "place", "left").drop("place")


def judge(pages: DataFrame, rules: tuple[Rule, ...] | DataFrame = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every page.

    A page under a rule gets the longest rule's verdict. Any other page gets its
    aliases': URLs are linked to the targets of their canonical links and refresh
    redirects, and URLs that differ in scheme, fragment, tracking parameters or end
    slashes are one; in each connected component an allowed member allows the rest,
    else a blocked one blocks it, else all are allowed. Null URLs, and those without
    ``://``, have an empty host and path, no aliases, and are allowed. Repeated rows
    are judged each; an empty table gives no rows; other columns are not read.

    ``rules``: a tuple, or a table of ``RULE_COLUMNS``, of any number; up to
    ``MOST_RULES`` in a tuple are one expression, more are joined.
    """
    url, target = F.col("url"), link_target(F.col("html"), F.col("url"))
    places = pages.select("page_id", "url", target.alias("target"), host_of(url).alias("host"), path_of(url).alias("path"))
    if isinstance(rules, tuple) and len(rules) <= MOST_RULES:
        rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
        _, aim = rule_of(host_of(F.col("target")), path_of(F.col("target")), rules)
        marked = places.withColumns({"rule": rule, "ruled": ruled, "aim": aim})
    else:
        table = rule_table(pages.sparkSession, rules) if isinstance(rules, tuple) else rules
        aims = stage_table(places.withColumns({"aim_host": host_of(F.col("target")), "aim_path": path_of(F.col("target"))}))
        marked = _with_rules(stage_table(_with_rules(aims, table, "host", "path", "rule", "ruled")), table, "aim_host", "aim_path", "aim_rule", "aim")
    seen = stage_table(marked.select("page_id", "host", "path", "rule", "ruled", page_key(url).alias("key"), page_key(F.col("target")).alias("to"), "aim"))
    flags = [F.max(F.expr(f"ruled = '{v}'")).alias(v) for v in ("allow", "block")]
    keys = (
        seen.select("key", "ruled", F.expr("int(ruled is null)").alias("open"))
        .unionByName(seen.select(F.col("to").alias("key"), F.col("aim").alias("ruled"), F.lit(0).alias("open")))
        .where("key is not null").groupBy("key").agg(*flags, F.sum("open").alias("n_rows"))
    )
    links = seen.where("key <> to").select(F.col("key").alias("src"), F.col("to").alias("dst")).distinct()
    joined = connected_components(links).withColumnRenamed("node", "key") if links.take(1) else None
    keys = stage_table(keys.withColumn("component", F.col("key")) if joined is None else keys.join(joined, "key", "left").withColumn("component", F.coalesce("component", "key")))
    said = F.when(F.max("allow"), "allow").when(F.max("block"), "block")
    parts = stage_table(keys.groupBy("component").agg(said.alias("alias_verdict"), F.count("*").alias("n_rows")).where("alias_verdict is not null"))
    told = stage_table(join_hot(keys.where("n_rows > 0"), parts, "component").select("key", "alias_verdict", "n_rows"))
    return join_hot(seen.where("ruled is null"), told, "key", "left").select(
        "page_id", "host", "path", "rule", F.coalesce("alias_verdict", F.lit("allow")).alias("verdict")
    ).unionByName(seen.where("ruled is not null").select("page_id", "host", "path", "rule", F.col("ruled").alias("verdict")))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every URL of ``pages``."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def _sql_key(url: str) -> str:
    host = f"translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}')"
    path = f"regexp_replace(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '/+$', '')"
    kept = f"list_filter(string_split(regexp_extract({url}, '(?s)^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{TRACKING}'))"
    return f"CASE WHEN {host} <> '' THEN {host} || {path} || CASE WHEN len({kept}) > 0 THEN '?' || array_to_string({kept}, '&') ELSE '' END END"


def _sql_rule(host: str, path: str, verdict: bool) -> str:
    cases = " ".join(
        f"WHEN ({host} = '{r.host}' OR ends_with({host}, '.{r.host}')) AND starts_with({path}, '{r.path}') THEN '{r.verdict if verdict else r.host + r.path}'"
        for r in sorted(RULES, key=lambda r: -len(r.host + r.path))
    )
    return f"CASE {cases} END"


def _sql_host_path(url: str) -> str:
    return f"coalesce(translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host, coalesce(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path"


_SQL_ATTRIBUTE = """(?:"([^"]*)"|''([^'']*)''|([^\\s"''>]+))"""


def _sql_attribute(tag: str, name: str) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({tag}, '(?is)[\\s\"''/]{name}\\s*=\\s*{_SQL_ATTRIBUTE}', {k}), '')" for k in (1, 2, 3)) + ", '')"


def _sql_tag(tag: str, key: str, word: str) -> str:
    """The first tag with a word among those of an attribute."""
    every = f"""regexp_extract_all(html, '(?is)<{tag}\\b(?:"[^"]*"|''[^'']*''|[^''">])*>')"""
    return f"list_filter({every}, lambda t: list_contains(string_split_regex(lower({_sql_attribute('t', key)}), '\\s+'), '{word}'))[1]"


#: A path's segments, walked with a step back for each two dots.
_SQL_WALK = "list_reduce({0}, lambda a, s: CASE WHEN s = '.' THEN a WHEN s = '..' THEN regexp_replace(a, '/[^/]*$', '') ELSE a || '/' || s END, '') || CASE WHEN ({0})[-1] IN ('.', '..') THEN '/' ELSE '' END"
OP2_SQL = f"""
WITH RECURSIVE linked AS (
  SELECT page_id, url, {_sql_host_path("url")},
    regexp_replace(coalesce(nullif(trim({_sql_attribute(_sql_tag("link", "rel", "canonical"), "href")}), ''),
      regexp_extract({_sql_attribute(_sql_tag("meta", "http-equiv", "refresh"), "content")}, '(?is)(?:^|[\\s;,])url\\s*=\\s*["'']?([^"''\\s>]+)', 1)), '(?i)&amp;', '&', 'g') AS link
  FROM pages
), formed AS (
  SELECT *, regexp_matches(link, '{SCHEME}//') OR starts_with(link, '//') AS whole, regexp_extract(link, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1) AS to_host,
    regexp_extract(regexp_replace(link, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*', ''), '^[^?#]*') AS to_path, regexp_extract(link, '(?s)[?#].*$') AS tail, string_split(coalesce(nullif(regexp_replace(path, '[^/]*$', ''), ''), '/'), '/') AS above
  FROM linked
), walked AS (
  SELECT *, CASE WHEN whole OR starts_with(to_path, '/') THEN string_split(to_path, '/')[2:] ELSE list_concat(list_filter(list_concat(above[2:-2], string_split(to_path, '/')[:-2]), lambda s: s <> ''), string_split(to_path, '/')[-1:]) END AS parts FROM formed
), aimed AS (
  SELECT *, CASE WHEN link = '' OR starts_with(link, '#') OR (regexp_matches(link, '{SCHEME}') AND NOT whole) THEN NULL
    WHEN whole THEN 'http://' || to_host || CASE WHEN to_path = '' THEN '' ELSE {_SQL_WALK.format("parts")} END || tail
    WHEN host = '' THEN NULL WHEN to_path = '' THEN 'http://' || host || path || tail ELSE 'http://' || host || {_SQL_WALK.format("parts")} || tail END AS target FROM walked
), seen AS (
  SELECT page_id, host, path, {_sql_key("url")} AS key, {_sql_key("target")} AS aim, target,
    {_sql_rule("host", "path", False)} AS rule, {_sql_rule("host", "path", True)} AS ruled
  FROM aimed
), marks AS (
  SELECT key, ruled FROM seen WHERE key IS NOT NULL
  UNION SELECT aim, {_sql_rule("host", "path", True)} FROM (SELECT aim, {_sql_host_path("target")} FROM seen WHERE aim IS NOT NULL)
), links AS (
  SELECT key AS a, aim AS b FROM seen WHERE key <> aim UNION SELECT aim, key FROM seen WHERE key <> aim
), reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), around AS (
  SELECT key, ruled FROM marks UNION SELECT r.a, m.ruled FROM reach r JOIN marks m ON m.key = r.b
), told AS (
  SELECT key, CASE WHEN bool_or(ruled = 'allow') THEN 'allow' WHEN bool_or(ruled = 'block') THEN 'block' END AS verdict FROM around GROUP BY key
)
SELECT page_id, host, path, rule, coalesce(ruled, told.verdict, 'allow') AS verdict
FROM seen LEFT JOIN told ON told.key = seen.key
"""
