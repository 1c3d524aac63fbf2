"""Odd input: empty tables, nulls, repeated rows, ties and single documents have a defined result."""

import pytest

from rolecall.llm import decontaminate, fingerprint, line_hash, line_join, near_dup, packing, privacy, quality, toxicity
from tests.llm.test_operators import table

LINE = "one two three four five six seven eight nine ten eleven twelve"
GIVEN = [(1, f"{LINE}\n{LINE}"), (1, f"{LINE}\n{LINE}"), (2, LINE), (3, None), (3, None), (4, ""), (5, " \n "), (6, "write to me@corp.example or 10.0.0.1")]


@pytest.fixture(scope="module")
def odd(spark):
    return table(spark, GIVEN)


def test_each_row_gets_its_result(spark, odd):
    ids = sorted(i for i, _ in GIVEN)
    model, lexicon = quality.fit(odd, _labels(spark)), toxicity.fit(odd, _labels(spark))
    for found in (near_dup.near_duplicates(odd), quality.score(odd, model), toxicity.score(odd, lexicon), privacy.protect(odd), fingerprint.fingerprints(odd)):
        assert sorted(r["doc_id"] for r in found.collect()) == ids
    pieces = packing.pack(odd).collect()
    assert sorted(p["doc_id"] for p in pieces if p["start"] == 0) == ids and all(p["doc_tokens"] == 1 for p in pieces if p["doc_id"] in (3, 4))


def _labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def test_equal_lines_and_units(odd):
    lines = {(r["doc_id"], r["line"]): (r["first_doc_id"], r["removed"]) for r in line_join.similar_lines(odd).collect()}
    assert lines == {(1, 0): (1, False), (1, 1): (1, True), (2, 0): (1, True)}
    kept = {(r["doc_id"], r["text"]) for r in line_join.dedup_lines(odd, line_join.similar_lines(odd)).collect()}
    assert kept == {(1, LINE), (3, None), (4, ""), (5, " \n "), (6, GIVEN[-1][1])}
    units = {(r["doc_id"], r["start"], r["first_doc_id"], r["first_start"]) for r in line_hash.repeated_units(odd).collect()}
    assert units == {(1, len(LINE) + 1, 1, 0), (2, 0, 1, 0)}


def test_ties_between_items(spark, odd):
    items = spark.createDataFrame([(7, LINE), (8, LINE), (9, None)], "item_id long, text string")
    found = sorted((r["doc_id"], r["item_id"], r["score"]) for r in decontaminate.contaminated(odd, items).collect())
    assert found == [(1, 7, 1.0), (1, 7, 1.0), (1, 8, 1.0), (1, 8, 1.0), (2, 7, 1.0), (2, 8, 1.0)]


def test_empty_tables(spark, odd):
    none, items = odd.where("false"), spark.createDataFrame([(7, LINE)], "item_id long, text string")
    for found in (near_dup.near_duplicates(none), line_join.similar_lines(none), line_hash.repeated_units(none), fingerprint.fingerprints(none), privacy.protect(none), packing.pack(none), decontaminate.contaminated(none, items)):
        assert found.count() == 0


def test_single_document(spark):
    found = fingerprint.fingerprints(table(spark, [(1, "only text")])).first()
    assert found["near_next"] == 1 and found["n_chars"] == 9
    assert near_dup.near_duplicates(table(spark, [(1, "only text")])).first()["component_id"] == 1


def test_rows_without_an_id_are_left_out_of_joins(spark):
    df = table(spark, [(1, LINE), (None, LINE)])
    assert [r["doc_id"] for r in near_dup.near_duplicates(df).collect()] == [1] and line_join.similar_lines(df).count() == 0


def test_long_texts(spark):
    """A line of seventy thousand words and a near copy; many lines and their copies."""
    long = " ".join(f"w{k}" for k in range(70_000))
    many = "\n".join(f"line {k} has words a{k} b{k} c{k}" for k in range(2000))
    df = table(spark, [(1, long), (2, long + " tail"), (3, many), (4, many + "\nline x")])
    assert {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 3}
    found = line_join.similar_lines(df)
    assert {(r["doc_id"], r["removed"], r["n_links"]) for r in found.where("doc_id < 3").collect()} == {(1, False, 1), (2, True, 1)}
    assert {r["doc_id"]: r["count"] for r in found.where("removed").groupBy("doc_id").count().collect()} == {2: 1, 4: 2000}
