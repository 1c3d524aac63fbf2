"""Operators that SQL can't stand in for, and the rules' own cases."""

import json

import pytest
from pyspark.sql import functions as F

from rolecall.functions import text as t
from rolecall.functions import windows
from rolecall.operators import dedupe, sync
from rolecall.operators.components import connected_components
from rolecall.plans import catalog
from tests.conftest import SMALL


@pytest.mark.parametrize(("title", "description", "years"), [
    ("Principal Data Engineer", "newcomers are welcome", 3), ("Lead Engineer 1", None, 3), ("Data Platform Trainee", "7+ years", 0), ("Database Developer 1", "5+ years", 0),
    ("Database Developer III", "", 3), ("Platform Engineer", "from 6 to 3 yrs with Linux", 3), ("Platform Engineer", "at least 4 + yrs with Linux", 4),
    ("Platform Engineer", "8 years relevant experience", 8), ("Platform Engineer", "a campus hire", 0), ("Platform Engineer", "a long history", None),
])
def test_yoe(spark, title, description, years):
    df = spark.createDataFrame([(title, description)], "title string, description string")
    assert df.select(t.extract_yoe(F.col("title"), F.col("description"))["min_yoe"]).first()[0] == years


@pytest.mark.parametrize(("text", "found"), [
    ("Stipend of INR 31,500 monthly", (31500, None, "INR", "month", "₹31,500/month")),
    ("Pay: $1,200 to $1,900 a month", (1200, 1900, "USD", "month", "$1,200-1,900/month")),
    ("₹18,000 per month as stipend", (18000, None, "INR", "month", "₹18,000/month")),
    ("CTC of 6.75 - 9 lakhs per annum", (600000, 900000, "INR", "year", "₹6.75-9 LPA")),
    ("Salary ₹7,50,000 per annum", (750000, None, "INR", "year", "₹7,50,000/year")),
    ("Salary 240 LPA", None), ("Pay: Rs 640 per month", None), ("Hosting costs $3,000 / month", None), ("Salary" + " " * 130 + "$2,500 per month", None),
    ("Our 40,000 members pay us a visit every month", None), ("", None), (None, None),
])
def test_pay(text, found):
    paid = windows.pay(text)
    assert (paid and tuple(paid[k] for k in ("pay_min", "pay_max", "currency", "period", "label"))) == found


@pytest.mark.parametrize(("text", "years"), [
    ("Open to the 2027/2028 batch", [2027, 2028]), ("Graduating between Nov 2026 and May 2027", [2026, 2027]), ("A cohort of fall 2028", [2028]),
    ("Fresher hiring 2027", [2027]), ("2026 trainee or 2026 fresher", [2026]), ("Founded in 2025 by two friends", []), ("Class of 2024", []),
    ("We welcome graduates. Since 2027", []), (None, None),
])
def test_graduation_years(spark, text, years):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(t.extract_grad_years(F.col("text"), 2026)).first()[0] == years


@pytest.mark.parametrize(("text", "fenced"), [
    ("Applicants must be a U.S. citizen.", True), ("Enrolled at an accredited American college", True), ("Eligible to work in the United States", True),
    ("Our US customers love citizen science", False), ("Enrolled at an Indian college", False), (None, False),
])
def test_eligibility(spark, text, fenced):
    assert spark.createDataFrame([(text,)], "text string").select(t.requires_us_eligibility(F.col("text"))).first()[0] is fenced


@pytest.mark.parametrize(("place", "text", "regions"), [
    ("Remote / international", None, ["worldwide"]), ("Remote: all locations", None, ["worldwide"]), (None, "This team is 100% remote.", ["worldwide"]),
    ("remote - nordics and international", None, ["worldwide"]), (None, "You may hire from anywhere", ["worldwide"]), ("Global, remote", "", ["worldwide"]),
    ("Remote (USA)", None, ["us"]), ("Chemnitz", None, ["europe"]), (None, "internationally minded, globally known", ["unknown"]), ("Remote", "", ["unknown"]),
])
def test_regions(spark, place, text, regions):
    df = spark.createDataFrame([(text, place, [])], "d string, l string, h array<string>")
    assert df.select(t.resolve_regions(F.col("d"), F.col("l"), F.col("h"))["regions"]).first()[0] == regions


@pytest.mark.parametrize(("title", "text", "asked"), [
    ("Doctoral Researcher", None, True), ("Researcher", "An M.Tech is required here", True), ("Researcher", "Pursuing a master's, or in the final year of a B.Tech", False),
    ("Researcher", "Undergraduates write to us." + " " * 170 + "A PhD comes first.", True), ("Researcher", "A PhD comes first." + " " * 130 + "Or a bachelor's.", False),
    ("Researcher", "é" * 400 + "PhD" + "é " * 60 + "bachelor's" + "é" * 200 + " doctorate", True), ("Researcher", "", False), (None, None, False),
])
def test_degrees(spark, title, text, asked):
    df = spark.createDataFrame([(title, text)], "title string, text string")
    assert df.select(windows.needs_advanced_degree(F.col("title"), F.col("text"))).first()[0] is asked


@pytest.mark.parametrize(("url", "stripped", "canonical"), [
    ("HTTPS://WWW.Acme.io:8443/Jobs//?b=2&a=1&b=3&UTM_x=9#top", "https://www.acme.io:8443/Jobs?b=2&b=3&a=1", "https://acme.io:8443/Jobs?a=1&b=2&b=3"),
    ("https://a.io/?q=C%2B%2B+dev&utm%5Fid=4&mode=x", "https://a.io/?q=C++ dev&mode=x", "https://a.io?q=C++ dev"),
    ("https://a.io/j?x=1=&y=&z&p=50%&n=%c3%a9", "https://a.io/j?x=1=&p=50%&n=é", "https://a.io/j?n=é&p=50%&x=1="), ("", "://", ""),
])
def test_stripped(spark, url, stripped, canonical):
    from rolecall.functions import urls

    row = spark.createDataFrame([(url,)], "url string").select(urls.strip_tracking(F.col("url")), urls.canonical_url(F.col("url"))).first()
    assert (row[0] if url else "://", row[1]) == (stripped, canonical)


def _openings(spark, rows):
    """Openings of one source and equal score from (url, company); an empty string is no key."""
    made = [(i, "lever", u, c, "dev" if c else "", "") for i, (u, c) in enumerate(rows)]
    return spark.createDataFrame(made, "ordinal long, source string, canonical_url string, company_normalized string, title_normalized string, description string")


def _sequential(rows):
    held, told = ({}, {}), {}
    for i, keys in enumerate(rows):
        told[i] = next((h[k] for h, k in zip(held, keys) if k in h), None)
        if told[i] is None:
            for h, k in zip(held, keys):
                if k:
                    h[k] = i
    return told


@pytest.mark.parametrize(("rounds", "most"), [(1, 1 << 17), (1, 6), (0, 1 << 17)])
def test_dedupe_by_components(spark, rounds, most):
    import random

    deal = random.Random(5)
    rows = [(deal.choice(["", *(f"u{k}" for k in range(40))]), deal.choice(["", *(f"c{k}" for k in range(40))])) for _ in range(90)]
    found = dedupe.dedupe(_openings(spark, rows), rounds=rounds, most=most).collect()
    assert {r["ordinal"]: r["incumbent"] for r in found} == _sequential(rows)


def test_dedupe_settles_a_chain(spark):
    rows = [(f"u{i // 2}", f"c{(i + 1) // 2}") for i in range(10_000)]
    found = {r["ordinal"]: r["incumbent"] for r in dedupe.dedupe(_openings(spark, rows)).select("ordinal", "incumbent").collect()}
    assert found == _sequential(rows) and sum(x is None for x in found.values()) == 5000


def test_dedupe_equals_sequential(spark):
    jobs = catalog._jobs(spark, SMALL)
    marked = dedupe.dedupe(jobs).select("ordinal", "source", "canonical_url", "company_normalized", "title_normalized", "description", "kept").collect()
    from rolecall import vocabulary as v

    order = sorted(marked, key=lambda r: (v.SOURCE_PRIORITY.get(r["source"], v.DEFAULT_PRIORITY), -len(r["description"] or ""), r["ordinal"]))
    seen, kept = set(), set()
    for r in order:
        keys = {k for k in (("u", r["canonical_url"]) if r["canonical_url"] else None, ("k", r["company_normalized"], r["title_normalized"]) if r["company_normalized"] and r["title_normalized"] else None) if k}
        if not keys & seen:
            seen |= keys
            kept.add(r["ordinal"])
    assert {r["ordinal"] for r in marked if r["kept"]} == kept


def test_sync_is_safe(spark):
    schema = "source string, source_job_id string, scope string, fingerprint string, missed_runs int, ordinal long"
    stored = spark.createDataFrame([("g", "1", "g:a", "x", 0, 1), ("g", "2", "g:a", "x", 1, 2), ("g", "3", "g:b", "x", 0, 3)], schema)
    none = stored.where("false")
    by = lambda df: {r["source_job_id"]: (r["action"], r["missed_runs"]) for r in df.collect()}
    assert by(sync.sync_actions(stored, none, None, ["g:a", "g:b"], True)) == {"1": ("uncovered", 0), "2": ("uncovered", 1), "3": ("uncovered", 0)}
    assert by(sync.sync_actions(stored, none, ["g:a"], ["g:a", "g:b"], False)) == {"1": ("miss", 1), "2": ("close", 1), "3": ("uncovered", 0)}
    assert by(sync.sync_actions(stored, stored, ["g:a"], ["g:a"], True)) == {"1": ("skip", 0), "2": ("update", 0), "3": ("skip", 0)}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 90), (5, 5), (200, 200), (None, 1)], "src long, dst long")
    found = {r["node"]: r["component"] for r in connected_components(edges).collect()}
    assert found == {i: 0 for i in range(61)} | {100: 90, 90: 90, 200: 200}
    assert connected_components(edges.where("false")).count() == 0


def test_snapshot_leaves_zero_out(spark):
    docs = [json.loads(r["doc"]) for r in catalog.queries()["export_snapshot"](spark, SMALL).collect()]
    assert docs and all("y" not in d or d["y"] for d in docs) and all("x" in d for d in docs)


def _stored(spark, tmp_path, runs, full):
    """Keys and misses after each run, given as (seen ids, covered scopes); an id's scope is ``g:a`` unless it names another."""
    from rolecall.streaming import sync as stream

    where, told = [f"file://{tmp_path}/{x}" for x in ("runs", "table", "progress")], []
    for seen, covered in runs:
        rows = [("g", i, f"g:{i[1:]}" if len(i) > 1 else "g:a", "x", k) for k, i in enumerate(seen)] + [(None, None, s, None, None) for s in covered]
        spark.createDataFrame(rows, stream.RUN).coalesce(1).write.mode("append").parquet(where[0])
        told.append({r["source_job_id"]: r["missed_runs"] for r in stream.sync_available(spark, *where, "2026-11-01 00:00:00", full).collect()})
    again = stream.sync_available(spark, *where, "2026-11-01 00:00:00", full)
    assert {r["source_job_id"]: r["missed_runs"] for r in again.collect()} == told[-1]
    return told


@pytest.mark.parametrize(("full", "runs", "told"), [
    # One run lists its board in full, the next only one of two boards, the last says nothing of any.
    (True, [(["p", "q", "rb"], ["g:a", "g:b"]), (["q"], ["g:a"]), (["q"], [])], [{"p": 0, "q": 0, "rb": 0}, {"q": 0, "rb": 0}, {"q": 0, "rb": 0}]),
    # Two misses close; a posting that is back, even outside what its run covers, starts anew.
    (False, [(["p", "q", "rb"], ["g:a", "g:b"]), (["q"], ["g:a", "g:b"]), (["q", "rb"], ["g:a"]), (["q"], ["g:a", "g:b"])],
     [{"p": 0, "q": 0, "rb": 0}, {"p": 1, "q": 0, "rb": 1}, {"q": 0, "rb": 0}, {"q": 0, "rb": 1}]),
    (True, [(["p", "sb"], ["g:a", "g:b"]), (["p"], ["g:c"]), (["p", "tb"], ["g:b"])], [{"p": 0, "sb": 0}, {"p": 0, "sb": 0}, {"p": 0, "tb": 0}]),
])
def test_synced_runs(spark, tmp_path, full, runs, told):
    assert _stored(spark, tmp_path, runs, full) == told


def test_retired_scopes(spark):
    schema = "source string, source_job_id string, scope string, fingerprint string, missed_runs int, ordinal long"
    stored = spark.createDataFrame([("g", "1", "g:acme", "x", 0, 1), ("g", "2", "g:gone", "x", 0, 2)], schema)
    known = spark.createDataFrame([("g:acme",)], "scope string")
    said = sync.sync_actions(stored, stored.where("source_job_id = '1'"), known, known, True).collect()
    assert {r["source_job_id"]: r["action"] for r in said} == {"1": "skip", "2": "retired"}


@pytest.mark.parametrize(("title", "text", "role"), [
    ("Backend Developer, Payments", None, "backend"), ("Full-Stack Fellow, AI Engineer Tools", None, "fullstack"), ("Machine Learning Fellow", None, "ml"), ("Data Scientist Trainee", None, "data"),
    ("Front End Apprentice", None, "frontend"), ("Android Developer", None, "swe"), ("Cloud Intern", None, "swe"), ("Campus API Trainee", None, "backend"), ("NLP Apprentice", None, "ml"), ("Analytics Fellow", None, "data"),
    ("Autumn Fellow", "Here you use Django and Postgres.", "backend"), ("Autumn Fellow", "React with Express, every day", "fullstack"), ("Autumn Fellow", "React, every day", "frontend"), ("Autumn Fellow", "Linux", "swe"),
    ("Autumn Fellow", None, "other"), ("Gardener", "Django", "other"), ("Graphic Designer Intern", "React", "other"), ("Firmware Trainee", None, "other"), ("Sourcing Analyst", None, "other"), ("Receptionist", None, "other"),
])
def test_roles(spark, title, text, role):
    df = spark.createDataFrame([(title, text, [])], "t string, d string, g array<string>")
    assert df.select(t.classify_role(F.col("t"), F.col("d"), F.col("g"))).first()[0] == role


def test_snapshot_holds_what_is_stored(spark):
    from rolecall.operators import export

    jobs = catalog._jobs(spark, SMALL).where("drop_reason is null")
    docs = {(r["source"], r["source_job_id"]): json.loads(r["doc"]) for r in export.snapshot(jobs, catalog.AS_OF).collect()}
    stored = {(r["source"], r["source_job_id"]): r.asDict(recursive=True) for r in jobs.collect()}
    assert docs and len({d["u"] for d in docs.values()}) == len(docs)
    for key, doc in docs.items():
        job = stored[key] | {"pay": (stored[key]["pay"] or {}).get("label"), "apply_deadline": stored[key]["deadline"]}
        for short, name in export.KEYS:
            value = job[name]
            if name in ("posted_at", "apply_deadline", "tech_stack", "pay", "is_new_grad") and not value:
                continue  # may be borrowed
            if name == "match_score":
                assert abs(doc.get(short, 0) - value) <= 0.05 + 1e-9
                continue
            value = value.isoformat() if hasattr(value, "isoformat") else value
            assert doc.get(short) == (value or None), (key, name)
    head = json.loads(export.header(export.snapshot(jobs, catalog.AS_OF), catalog.AS_OF).first()[0])
    assert head["total"] == len(docs) and head["fields"]["$"] == "pay" and head["fields"]["d"] == "apply_deadline"
