"""Results don't depend on where an operator changes its way: broadcasts forced on and off, and counters of any number."""

import pytest

from rolecall.llm import line_join, near_dup, privacy
from tests.conftest import rows
from tests.llm.test_operators import chains, table, texts

RUNS = {
    "lines": (line_join, lambda df: line_join.similar_lines(df)), "near": (near_dup, lambda df: near_dup.near_duplicates(df)),
    "privacy": (privacy, lambda df: privacy.protect(df)),
}
NAMED = [(i, f"Mail anna.schmidt@corp{i % 3}.example or ask Anna Schmidt about project Zephyr {i} today") for i in range(1000, 1030)]


@pytest.mark.parametrize("name", sorted(RUNS))
def test_broadcast_or_shuffle(spark, monkeypatch, name):
    module, run = RUNS[name]
    df = table(spark, texts() + [(i + 100, x) for i, x in chains()] + NAMED)
    found = []
    for most in (0, 1 << 30):
        monkeypatch.setattr(module, "MOST_BROADCAST", most)
        found.append(rows(run(df)))
    assert found[0] == found[1] and found[0]


def test_counters_of_any_number(spark, monkeypatch):
    df = table(spark, texts() + [(i + 100, x) for i, x in chains()])
    want = rows(line_join.similar_lines(df))
    for least, most in ((1, 1), (1, 8), (1 << 20, 1 << 20)):
        monkeypatch.setattr(line_join, "LEAST_COUNTERS", least)
        monkeypatch.setattr(line_join, "MOST_COUNTERS", most)
        assert rows(line_join.similar_lines(df)) == want


def test_counters_follow_the_corpus():
    assert [line_join.counters(x) for x in (0, 10**9, (1 << 32) + (1 << 16), 10**11, 10**14)] == [1 << 17, 1 << 17, 1 << 18, 1 << 22, 1 << 22]
