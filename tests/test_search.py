"""Paged searches: where they stop, what is tried again, and which posting of an id stays."""

import json

import pytest

from rolecall.sources import search
from rolecall.sources.search import Answer, Paging, Retry, pages_of


def _page(*ids, **more):
    return Answer(200, json.dumps({"d": {"jobs": [{"k": {"id": i}} for i in ids]}, **more}))


def _fetch(answers):
    """Answers by cursor; a list is one for each attempt. Notes what was asked."""
    asked = []

    def fetch(cursor, attempt):
        asked.append(cursor)
        got = answers.get(cursor, Answer(None, None))
        return got[attempt - 1] if isinstance(got, list) else got

    return fetch, asked


BY_PAGE, BY_OFFSET, BY_CURSOR = (Paging(kind, "d.jobs", "k.id", 2, 4, next="next") for kind in ("page", "offset", "cursor"))


@pytest.mark.parametrize(("paging", "answers", "asked"), [
    (BY_PAGE, {"1": _page(1, 2), "2": _page(3, 4), "3": _page(5)}, ["1", "2", "3"]),
    (BY_PAGE, {"1": _page(1, 2), "2": _page()}, ["1", "2"]),
    (BY_PAGE, {"1": _page(1, 2), "2": _page(2, 1), "3": _page(9, 10)}, ["1", "2"]),
    (BY_PAGE, {str(k): _page(2 * k, 2 * k + 1) for k in range(9)}, ["1", "2", "3", "4"]),
    (BY_OFFSET, {"0": _page(1, 2), "2": _page(2, 3), "4": _page(4)}, ["0", "2", "4"]),
    (BY_OFFSET._replace(total="n"), {"0": _page(1, 2, n=3), "2": _page(3, 4, n=3)}, ["0", "2"]),
    (BY_OFFSET._replace(total="n"), {"0": _page(1, n="4"), "2": _page(3, n="4")}, ["0", "2"]),
    (BY_CURSOR, {"": _page(1, next="x"), "x": _page(2, next="y"), "y": _page(3)}, ["", "x", "y"]),
])
def test_where_a_search_ends(paging, answers, asked):
    fetch, seen = _fetch(answers)
    found = pages_of(fetch, paging)
    assert seen == asked and [page for page, _, _ in found] == list(range(len(asked))) and all(a.code == 200 for _, a, _ in found)


@pytest.mark.parametrize(("answers", "retry", "tries", "code"), [
    ([Answer(503, None), Answer(429, None), _page(1)], Retry(), 3, 200), ([Answer(404, "gone"), _page(1)], Retry(), 1, 404), ([Answer(404, "gone"), _page(1)], Retry(any_error=True), 2, 200),
    ([Answer(None, None), Answer(500, None), Answer(502, None), _page(1)], Retry(), 3, 502), ([Answer(None, None)] * 3, Retry(), 3, None), ([Answer(200, "{broken")], Retry(), 1, 0), ([Answer(200, None)], Retry(), 1, 0),
])
def test_what_is_tried_again(answers, retry, tries, code):
    fetch, asked = _fetch({"1": answers})
    waits = []
    [(page, answer, attempts)] = pages_of(fetch, BY_PAGE, retry, waits.append)
    assert (page, answer.code, attempts, len(asked)) == (0, code, tries, tries) and waits == [retry.pause(k) for k in range(1, tries)]
    assert (answer.body is None) == (code != 200)


def test_a_later_failure_drops_the_query():
    fetch, _ = _fetch({"1": _page(1, 2), "2": Answer(500, None)})
    assert pages_of(fetch, BY_PAGE) == [(1, Answer(500, None), 3)]


def test_pauses_grow_between_bounds():
    assert [Retry().pause(k) for k in (1, 2, 3, 4, 5, 6, 9)] == [2, 2, 4, 8, 16, 20, 20]


def test_query_matrix():
    asked = search.query_matrix("avature", [("avature:a", "a"), ("avature:b", "b")], ["x", "y"], ["India", "Remote"])
    assert [q[0] for q in asked] == list(range(8)) and asked[5] == (5, "avature", "avature:b", "b", "x", "Remote")
    assert len(search.query_matrix("avature", [("avature:a", "a")], ["x", "y"], ["India", "Remote"], keywords_only=True)) == 2


def test_read_by_spark(spark, tmp_path):
    """A query that never landed fails; the first of equal ids stays; one search with one scope is covered wholly or not."""
    for number, ids in enumerate((("7", "8"), ("8", "9"))):
        (tmp_path / f"query={number}").mkdir()
        body = json.dumps({"jobs": [{"id_icims": i, "title": f"{number} {i}"} for i in ids]})
        (tmp_path / f"query={number}/a.json").write_text(json.dumps({"cursor": "1", "attempt": 1, "http_code": 200, "body": body}) + "\n")
    paging = Paging("page", "jobs", "id_icims", 20, 3)
    queries = search.query_matrix("amazon", [("amazon", "amazon")], ["x", "y"], ["India"])
    found = search.search(spark, f"file://{tmp_path}", queries, paging)
    assert found.schema.simpleString() == spark.createDataFrame([], search.RESPONSE).schema.simpleString()
    assert {r["source_job_id"]: r["title"] for r in search.read(found, "amazon", "2026-11-01 00:00:00").collect()} == {"7": "0 7", "8": "0 8", "9": "1 9"}
    assert [r[0] for r in search.covered_scopes(found, whole=True).collect()] == ["amazon"]
    three = search.search(spark, f"file://{tmp_path}", [*queries, (2, "amazon", "other", "o", "z", "India")], paging)
    assert [(r["query"], r["http_code"], r["body"]) for r in three.where("body is null").collect()] == [(2, None, None)]
    assert search.covered_scopes(three, whole=True).count() == 0 and [r[0] for r in search.covered_scopes(three).collect()] == ["amazon"]


def test_a_limited_rate_keeps_what_was_read():
    """A search that allows it ends with its pages and the failed one, so that nothing is judged closed."""
    fetch, _ = _fetch({"0": _page(1, 2), "2": [Answer(429, None)] * 3})
    found = pages_of(fetch, BY_OFFSET._replace(partial=(429,)))
    assert [(page, a.code, a.body is None) for page, a, _ in found] == [(0, 200, False), (1, 429, True)]
