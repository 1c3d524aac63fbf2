"""The corpus operators against brute force, round trips and held-out accuracy."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolecall.llm import decontaminate, fingerprint, line_hash, line_join, near_dup, packing, privacy, quality, queries, toxicity, url_filter
from tests.conftest import SMALL, rows

SCHEMA = "doc_id long, text string, class string, node long, band string, score string, gone0 string, n_chars long"


def table(spark, texts):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, x, "c", 7, "b", "s", "g", len(x or "")) for i, x in texts], SCHEMA)


def texts(seed=3, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base = [[word() for _ in range(60)] for _ in range(4)]
    out = [(0, None), (1, ""), (2, " \n\t"), (3, "One two"), (4, "one TWO"), (5, "long " * 20000)]
    for i in range(6, n):
        words = list(rng.choice(base))
        for _ in range(rng.choice((0, 0, 1, 2, 4))):
            words[rng.randrange(60)] = word()
        out.append((i, "\n".join(" ".join(words[k : k + 12]) for k in range(0, 60, 12))))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, texts())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    assert rows(queries.queries()[name](spark, SMALL)) == rows(duck.sql(queries.oracle_sql()[name]))


def _components(links, ids):
    part = {i: i for i in ids}
    while True:
        before = dict(part)
        for a, b in links:
            part[a] = part[b] = min(part[a], part[b])
        if part == before:
            return part


def chains(seed=5):
    """Texts whose neighbours alone are similar, so that no member of a band is like all the others, beside looser groups."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    out = [(i, " ".join(words[6 * i : 6 * i + 120])) for i in range(40)]
    for i in range(40, 90):
        own = words[200:300]
        for _ in range(rng.randrange(5)):
            own[rng.randrange(100)] = f"x{rng.randrange(99)}"
        out.append((i, " ".join(own)))
    rng.shuffle(out)
    return [(i, x) for i, (_, x) in enumerate(out)]


@pytest.mark.parametrize(("given", "settings"), [(texts, near_dup.Settings()), (chains, near_dup.Settings()), (chains, near_dup.Settings(block=3, block_bytes=4096))])
def test_near_duplicates_equal_brute_force(spark, given, settings):
    texts, docs = given, table(spark, given())

    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
        return {tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set()

    sets = {i: shingles(x) for i, x in texts()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dup.near_duplicates(docs, settings).collect()}
    part = _components(links, sets)
    assert found == {i: (len(s), part[i]) for i, s in sets.items()}
    if settings == near_dup.Settings() and given == chains:
        assert near_dup.near_duplicates(docs.where("false")).count() == 0


@pytest.mark.parametrize("limits", [line_join.Limits(), line_join.Limits(hot=1, postings=4, sets=2, set_bytes=512), line_join.Limits(sparse=0, slot=10, sets=3, set_bytes=1024)])
def test_similar_lines_equal_brute_force(docs, limits):
    lines = {}
    for i, x in texts():
        for k, line in enumerate((x or "").split("\n")):
            s = frozenset(w for w in re.split(r"[\s!-/:-@\[-`{-~]+", line.lower()) if w)
            if len(s) >= 3:
                lines[i, k] = s
    want = set()
    for place, s in lines.items():
        like = {p for p, o in lines.items() if p != place and len(s & o) >= 0.8 * len(s | o) - 1e-9}
        if like:
            want.add((*place, any(p < place for p in like), len({lines[p] for p in like} - {s})))
    got = {(r["doc_id"], r["line"], r["removed"], r["n_links"]) for r in line_join.similar_lines(docs, limits=limits).collect()}
    assert got == want
    if limits != line_join.Limits():
        return
    kept = line_join.dedup_lines(docs, line_join.similar_lines(docs))
    assert kept.columns == docs.columns and {0, 1, 2, 3, 4} <= {r["doc_id"] for r in kept.collect()}


def test_packing_round_trip(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer, pieces = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json"))), packing.pack(docs).collect()
    by_doc, windows = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        windows[p["sequence_id"]].append(p)
    for i, x in texts():
        ids, at = [*tokenizer.encode(x or "", add_special_tokens=False).ids, 1], 0
        import zlib
        for p in sorted(by_doc[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(np.array(ids[at : at + p["length"]], "<u4").tobytes())
            at += p["length"]
        assert at == len(ids)
    for own in windows.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048
    assert packing.pack(docs.where("false")).count() == 0


def test_fingerprints(docs):
    given = [(i, x or "") for i, x in texts()]
    found = {r["doc_id"]: r for r in fingerprint.fingerprints(docs).collect()}
    for k, (i, x) in enumerate(given):
        after = given[(k + 1) % len(given)][1]
        edited = x[: len(x) - len(x) // 2] + after[: len(x) // 2]
        assert found[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and found[i]["n_chars"] == len(x)
        assert found[i]["common_next"] == next((n for n, (a, b) in enumerate(zip(x, after)) if a != b), min(len(x), len(after)))
    same = defaultdict(set)
    for i, x in given:
        same[x].add(found[i]["fingerprint"])
    assert all(len(s) == 1 for s in same.values()) and len({f for s in same.values() for f in s}) == len(same)


def test_likeness_is_the_share_of_equal_spans():
    rng = random.Random(5)
    long, other = ("".join(rng.choice("abcdefgh é") for _ in range(120000)) for _ in range(2))
    like = lambda x, y: fingerprint.likeness(*(fingerprint.fingerprint(fingerprint.Prefixes(t)) for t in (x, y)))
    assert like(long, long) == 1 and like(long, other) == 0 and like("", long) == 0
    assert 0.9 < like(long, "Z" + long[1:]) < 1
    assert 0.9 < like(long, "Z" + long) < 1 and 0.9 < like(long[1:], long) < 1
    assert 0.9 < like(long, long[:60000] + "ZZZ" + long[60000:]) < 1
    assert 0.4 < like(long, long[:60000]) <= 0.5 and 0.4 < like(long, long[60000:]) <= 0.5
    for x, y in ((long[:n], long[: n - k] + "Z" * j) for n in (1, 2, 33, 64, 65, 1000) for k in (0, 1) for j in (0, 1, 40)):
        assert (like(x, y) == 1) == (x == y) and 0 <= like(x, y) <= 1 and like(x, y) == like(y, x)


def test_privacy_spans(spark):
    text = "Mail a.b@x-y.org, 10.0.0.1 or 999.1.1.1; card 4111 1111 1111 1111, call +49 (30) 123-4567."
    assert [(k, text[a:b]) for k, a, b in privacy.base_spans(text)] == [("email", "a.b@x-y.org"), ("ip", "10.0.0.1"), ("card", "4111 1111 1111 1111"), ("phone", "+49 (30) 123-4567")]
    found = privacy.protect(table(spark, [(1, text), (2, None), (3, ""), (1, text)])).collect()
    assert sorted((r["doc_id"], len(r["base"])) for r in found) == [(1, 4), (1, 4), (2, 0), (3, 0)]
    many = [(i, f"case {i} word{i} Zorblatt wrote me@corp.example about item{i}") for i in range(4)] + [(9 + i, f"plain text {i}") for i in range(40)]
    assert all(r["added"] for r in privacy.protect(table(spark, many)).where("doc_id < 4").collect())


def test_decontamination(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("klmnopq") for _ in range(5))
    item = [word() for _ in range(30)]
    edited = [w if k % 9 else "other" for k, w in enumerate(item)]
    given = [(1, "x y z " + " ".join(item)), (2, "a b " + " ".join(edited) + " c"), (3, " ".join(word() for _ in range(90))), (4, None)]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "")], "item_id long, text string")
    found = decontaminate.contaminated(table(spark, given), bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(1, 7), (2, 7)} and next(r for r in found if r["doc_id"] == 1)["score"] == 1
    assert decontaminate.contaminated(table(spark, given), bench.where("false")).count() == 0


def test_privacy_terms_lie_outside_all_spans():
    text = " ".join(f"someone{i}@corp.example" for i in range(120)) + " call +49 (30) 123-4567 or 10.0.0.1 Zorblatt"
    spans = privacy.base_spans(text)
    near = {(term, a, b) for _, term, a, b in privacy._around(text, spans, 10)}
    assert len(spans) == 122 and {"call", "zorblatt"} == {term for term, _, _ in near}
    assert not any(a < y and x < b for _, x, y in near for _, a, b in spans)


def test_privacy_counts_terms_beyond_ascii(spark):
    many = [(i, f"case {i} \u201c\u00dcberling\u201d wrote me@corp.example, \u00d1and\u00fa{i} too") for i in range(4)]
    many += [(9 + i, "plain text" + (" \u00d1and\u00fa" if i == 0 else "")) for i in range(40)]
    kinds = {i: {many[i][1][s["start"] : s["end"]]: s["kind"] for s in added} for i, added in privacy.protect(table(spark, many)).where("doc_id < 4").select("doc_id", "added").collect()}
    assert all(k["\u00dcberling"] == "remove" and k["\u00d1and\u00fa"] == "term" for k in kinds.values()) and len(kinds) == 4


@pytest.mark.parametrize("exact", [0, 1, 10])
def test_decontamination_of_many_edited_copies(spark, exact):
    item = [f"w{k}" for k in range(30)]
    edited = [w if k % 9 else "other" for k, w in enumerate(item)]
    given = [(i, " ".join(item if i < exact else edited)) for i in range(exact + 1000)]
    bench = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    assert {r["doc_id"] for r in decontaminate.contaminated(table(spark, given), bench).collect()} == set(range(exact + 1000))


def _accuracy(spark, op, label):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", label)
    scored = op(spark, "/root/testdata/sf0.01").join(labels, "doc_id").where("held_out").select("score", label).collect()
    one, zero = ([r["score"] for r in scored if r[label] == k] for k in (1, 0))
    assert one and zero
    return np.mean([(a > b) + 0.5 * (a == b) for a in one for b in zero])


def test_held_out_accuracy(spark):
    assert _accuracy(spark, toxicity.op3_toxicity, "toxic") > 0.8
    assert _accuracy(spark, quality.op6_quality, "quality") > 0.8


def test_classifiers_take_anything(spark, docs):
    labels = spark.createDataFrame([(3, 1, 1), (4, None, 0)], "doc_id long, quality int, toxic int")
    for fit, score in ((toxicity.fit, toxicity.score), (quality.fit, quality.score)):
        found = score(docs, fit(docs, labels)).collect()
        assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
        assert score(docs.where("false"), fit(docs, labels.where("false"))).count() == 0
    assert toxicity.fold("аB1е") == toxicity.fold("ABie")


def test_url_aliases(spark):
    pages = [(1, "http://a.org/x", '<link rel="canonical" href="http://s.example.com/en/q">'), (2, "https://a.org/x/?utm_source=f#t", None),
             (3, "http://s.example.com/en/q", ""), (4, None, None), (5, "no scheme", None), (6, "http://b.net/es/1", "<p>"), (6, "http://b.net/es/1", "<p>")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, rule string")
    found = sorted((r["page_id"], r["rule"], r["verdict"]) for r in url_filter.judge(df).collect())
    assert [(a, c) for a, _, c in found] == [(1, "block"), (2, "block"), (3, "block"), (4, "allow"), (5, "allow"), (6, "block"), (6, "block")]
    assert url_filter.judge(df.where("false")).count() == 0


def test_planted_aliases_equal_sql(spark):
    """Chains, loops and relative links by rule: no table given has any."""
    import duckdb

    rng = random.Random(9)
    hosts, paths = ("example.com", "WWW.example.com", "a.net", "b.org", "c.org"), ("/en/a", "/es/b", "/fr/", "/x/y", "", "/x/z/")
    url = lambda: f"{rng.choice(('http', 'https'))}://{rng.choice(hosts)}{rng.choice(paths)}{rng.randrange(60)}{rng.choice(('', '', '?q=1', '?utm_a=2', '#f', '/'))}"
    mark = lambda x: rng.choice((f'<link rel="canonical" href="{x}">', f"<LINK href='{x}' rel=canonical>", f'<meta http-equiv="refresh" content="0; url={x}">', ""))
    given = [(i, rng.choice((url(), url(), url(), None, "none")), rng.choice((mark(url()), mark(rng.choice(("/en/q", "q.html", "?p=2", "#a", "mailto:x@y", "//d.org/es/"))), None))) for i in range(400)]
    df = spark.createDataFrame(given, "page_id long, url string, html string")
    con = duckdb.connect()
    con.register("pages", df.toPandas())
    found = url_filter.judge(df)
    assert rows(found) == rows(con.sql(url_filter.OP2_SQL))
    by_rule = {r["page_id"] for r in found.where("rule is not null").collect()}
    assert any(r["verdict"] == "block" and r["page_id"] not in by_rule for r in found.collect())


def test_line_hash_offsets(docs):
    by = dict(texts())
    for r in line_hash.repeated_units(docs).collect():
        unit, first = by[r["doc_id"]][r["start"] : r["end"]], by[r["first_doc_id"]][r["first_start"] :]
        assert line_hash.normalise(first[: len(unit)]) == line_hash.normalise(unit)


def test_pipeline_takes_effect(spark):
    import corpus_pipeline as c

    whole = spark.read.parquet(f"{SMALL}/documents.parquet")
    pieces = c.run(spark, SMALL)
    assert pieces.join(whole, "doc_id", "left_anti").count() == 0 and 0 < pieces.select("doc_id").distinct().count() < whole.count()
    tricky = table(spark, texts(n=12)).withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")})
    before = {r["doc_id"]: r for r in tricky.collect()}
    for _, stage in c.STAGES[:-1]:
        kept = stage(spark, tricky, SMALL)
        assert kept.schema.simpleString() == tricky.schema.simpleString()
        for r in kept.collect():
            assert all(r[k] == before[r["doc_id"]][k] for k in tricky.columns if k not in ("text", "n_chars"))
        assert stage(spark, tricky.where("false"), SMALL).count() == 0
