"""URL filtering: links of all forms against a plain resolver, and more rules than an expression takes."""

import random
from urllib.parse import urljoin, urlsplit

from pyspark.sql import functions as F

from rolecall.llm import privacy, url_filter
from tests.conftest import rows
from tests.llm.test_operators import _components

PAGES = "page_id long, url string, html string, rule string, place string, n_rows string"


def _pages(spark, given):
    return spark.createDataFrame([(*g, "r", "p", "n") for g in given], PAGES)


def _verdicts(df, rules=url_filter.RULES):
    return {r["page_id"]: r["verdict"] for r in url_filter.judge(df, rules).collect()}


FORMS = [
    ('<link rel="canonical" href="/out?to=http://b.example.com/en/q">', "allow"), ('<link rel="canonical" href="//b.example.com/x/../en/q">', "block"), ('<link rel="alternate canonical" href="http://b.example.com/en/q">', "block"),
    ('<link rel="canonicals" href="http://b.example.com/en/q">', "allow"), ('<link title="a > b" rel=\'CANONICAL\' href= http://b.example.com/en/q >', "block"), ('<link data-rel="canonical" href="http://b.example.com/en/q">', "allow"),
    ('<link rel="canonical" title=" href=x " href="http://b.example.com/en/q">', "block"), ('<link rel=canonical href="mailto:a@b"><meta http-equiv=refresh content="0;url=http://b.example.com/en/">', "allow"),
    ('<meta http-equiv="Refresh" content="5; URL=\'http://b.example.com/en/?a=1&amp;b=2\'">', "block"), ('<meta name="refresh" content="0;url=http://b.example.com/en/">', "allow"), ('<link rel=canonical href="HTTP://B.EXAMPLE.com/en/#x">', "block"),
]


def test_forms_of_links(spark):
    given = [(k, f"http://a.org/d/e/x{k}", html) for k, (html, _) in enumerate(FORMS)]
    assert _verdicts(_pages(spark, given)) == {k: verdict for k, (_, verdict) in enumerate(FORMS)}


def test_steps_up_reach_their_page(spark):
    given = [(1, "http://a.org/d/e/x", '<link rel=canonical href="../y">'), (2, "http://a.org/d/y", '<link rel=canonical href="http://b.example.com/en/">'), (3, "http://a.org/d/e/../y", None), (4, "http://a.org/e/x", '<link rel=canonical href="../../../d/./y?utm_source=x">')]
    assert _verdicts(_pages(spark, given)) == {1: "block", 2: "block", 3: "allow", 4: "block"}


def test_links_equal_a_plain_resolver(spark):
    """Verdicts of pages that name each other by references of all kinds, by the library's resolver and a plain search; and the SQL's."""
    import duckdb

    rng = random.Random(21)
    hosts = ("a.org", "b.org", "c.net", "s.example.com")
    path = lambda: "/" + "/".join(rng.choice(("en", "es", "x", "y")) for _ in range(rng.randrange(1, 4)))
    link = lambda: rng.choice((f"http://{rng.choice(hosts)}{path()}", f"//{rng.choice(hosts)}{path()}", path(), "../" + path()[1:], "./x/../y", "..", "?q=http://s.example.com/en/", "y?to=http://s.example.com/en/", "#top", "../../../../en/x"))
    given = [(i, f"http://{rng.choice(hosts)}{path()}", f'<p><link href="{link()}" rel="canonical nofollow">' if rng.random() < 0.7 else None) for i in range(300)]

    def key(url):
        at = urlsplit(url)
        return at.netloc + at.path.rstrip("/") + (f"?{at.query}" if at.query else "")

    def ruled(url):
        at = urlsplit(url)
        fits = [r for r in url_filter.RULES if (at.netloc == r.host or at.netloc.endswith("." + r.host)) and at.path.startswith(r.path)]
        return max(fits, key=lambda r: len(r.host + r.path)).verdict if fits else None

    aims = [(u, urljoin(u, h.split('"')[1])) for _, u, h in given if h and not h.split('"')[1].startswith("#")]
    urls = {u for _, u, _ in given} | {u for pair in aims for u in pair}
    parts = _components([(key(u), key(t)) for u, t in aims], {key(u) for u in urls})
    said = {}
    for u in urls:
        said.setdefault(parts[key(u)], set()).add(ruled(u))
    df = _pages(spark, given)
    want = {i: ruled(u) or ("allow" if "allow" in said[parts[key(u)]] else "block" if "block" in said[parts[key(u)]] else "allow") for i, u, _ in given}
    assert _verdicts(df) == want and {"block"} & {v for (i, u, _) in given if ruled(u) is None for v in [want[i]]}
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    assert rows(url_filter.judge(df)) == rows(con.sql(url_filter.OP2_SQL))


def test_a_thousand_rules(spark):
    """By expression, by join and by brute force; a domain with most of the rules, rules that repeat, and ties."""
    rng = random.Random(5)
    host = lambda: ".".join(rng.choice("abc") for _ in range(rng.randrange(1, 4)))
    path = lambda n: "/" + "".join(rng.choice("xy/") for _ in range(rng.randrange(n)))
    rules = tuple(url_filter.Rule("a" if k % 3 else host(), path(6), rng.choice(("allow", "block"))) for k in range(1000)) + (url_filter.Rule("", "/", "block"),)
    given = [(i, f"http://{host()}{path(9)}", rng.choice((None, f'<link rel=canonical href="http://{host()}{path(9)}">'))) for i in range(200)] + [(i, "http://a.b/xy", None) for i in range(200, 260)] + [(900, None, None), (901, "", "")]
    df = _pages(spark, given)

    def longest(url):
        at = urlsplit(url or "")
        fits = [r for r in rules if (at.netloc == r.host or at.netloc.endswith("." + r.host)) and at.path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.host + r.path), default=None)
        return best and (best.host + best.path, best.verdict)

    found = url_filter.judge(df, rules).collect()
    assert len(found) == len(given)
    by = {i: u for i, u, _ in given}
    assert all((r["rule"] and (r["rule"], r["verdict"])) == longest(by[r["page_id"]]) for r in found)
    few = rules[:300]
    assert rows(url_filter.judge(df, few)) == rows(url_filter.judge(df, url_filter.rule_table(spark, few)))
    assert url_filter.judge(df, url_filter.rule_table(spark, few).where("false")).where(F.col("rule").isNotNull()).count() == 0


def test_parts_of_addresses_of_any_length():
    """An ip's parts are numbers of any number of digits."""
    rng = random.Random(8)
    for _ in range(200):
        parts = ["0" * rng.choice((0, 1, 5000)) + rng.choice(("0", "7", "99", "255", "256", "1" * 5000)) for _ in range(4)]
        fits = all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in parts)
        text = "at " + ".".join(parts) + " now"
        assert [s for s in privacy.base_spans(text) if s[0] == "ip"] == ([("ip", 3, len(text) - 4)] if fits else [])
