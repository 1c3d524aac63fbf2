"""Rules that run once for each distinct value."""

import pyspark.sql.functions as F
import pytest

from rolecall.operators import normalize
from rolecall.operators.repeats import once_a_value
from rolecall.plans import catalog
from tests.conftest import SMALL


@pytest.mark.parametrize("most", (0, 1 << 20))
def test_each_value_is_read_once(spark, most):
    """Broadcast and joined by digests: every row gets its value's result, nulls and empty texts apart, and a value left out takes its rows along."""
    rows = spark.createDataFrame([(i, t, g) for i in range(2500) for t, g in ((None, ["a"]), ("", None), ("1:", []), ("a", ["b", None]), ("x", ["a"]))], "i int, text string, tags array<string>")
    calls = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def seen(text, tags):
        calls.add(1)
        return len(text or "") * 10 + len(tags or ())

    found = once_a_value(rows, ["text", "tags"], lambda values: values.where("text is null or text <> 'x'").withColumn("n", seen("text", "tags")), most=most)
    assert found.columns == ["i", "text", "tags", "n"]
    counted = {(r["text"], r["n"]): r["count"] for r in found.groupBy("text", "n").count().collect()}
    assert counted == {(None, 1): 2500, ("", 0): 2500, ("1:", 20): 2500, ("a", 12): 2500}
    assert calls.value == 4


def test_ingest_reads_each_text_once(spark, monkeypatch):
    """The rules of texts get a row for each title, description and tags, not one for each posting."""
    given, of_texts = [], normalize._of_texts
    monkeypatch.setattr(normalize, "_of_texts", lambda texts, *more: given.append(texts) or of_texts(texts, *more))
    found = catalog._normalized(spark, SMALL)
    raw = catalog.postings(spark, SMALL)
    assert given[0].count() == raw.select("title", "description", "tags").distinct().count() < raw.count()
    assert 0 < found.count() < raw.count()
