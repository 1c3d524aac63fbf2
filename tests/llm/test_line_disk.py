"""What the line join keeps from the disk: false candidates, squares of copies, whole texts, and shuffle files that were read."""

import time
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from rolecall import staging
from rolecall.llm import line_join
from tests.conftest import rows
from tests.llm.test_operators import table

RANDOM = np.random.default_rng(7)
#: Lines of 240 words of 2,500, hence with some in common but far from alike; the last is like the first.
LONG_LINES = [" ".join(f"w{x}" for x in RANDOM.choice(2500, 240, replace=False)) for _ in range(300)]
LONG_LINES.append(" ".join([*LONG_LINES[0].split()[:-4], "some", "other", "words", "here"]))


def candidates(parts: list[list[str]]) -> list[dict]:
    """Pairs and members that one slot gives for texts that were scattered by different tasks."""
    levels = SimpleNamespace(value=np.zeros(1 << 12, np.uint16))
    packed = []
    for part in parts:
        batch = pa.RecordBatch.from_arrays([pa.array(range(len(part)), pa.int64()), pa.array(part)], names=["doc_id", "text"])
        packed += line_join._scatter(levels, 500, 1, 3, 0.8)(iter([batch]))
    found = pa.Table.from_batches(line_join._candidates(4, 0.8)(iter(packed))).to_pylist()
    return [r for r in found if r["kind"] in (line_join.PAIR, line_join.DENSE)]


def test_long_lines_that_are_not_alike_give_no_pairs():
    found = candidates([LONG_LINES])
    assert {r["kind"] for r in found} == {line_join.PAIR}
    assert len({(r["x2"], r["x3"]) for r in found}) == 1


def test_copies_in_other_tasks_give_no_more_pairs():
    lines = ["one two three four five six seven eight nine ten", "one two three four five six seven eight nine eleven", LONG_LINES[0], LONG_LINES[-1]]
    once = candidates([lines])
    assert once and candidates([lines] * 9) == once


def test_wide_bits_flip_once_a_word():
    texts = [b" ".join(b"%d" % x for x in range(k, k + 200)) for k in (0, 10)] + [b"a short line"]
    lines = line_join.Lines(texts, None)
    bits, row = lines.wider()
    assert row.tolist() == [0, 1, -1] and 0 < np.bitwise_count(bits[0] ^ bits[1]).sum() <= 20


def test_only_wanted_lines_leave_their_texts(spark):
    texts = table(spark, [(i, "\n".join(f"line {j} of text {i}" for j in range(20))) for i in range(500)])
    wanted = {(i, i % 20) for i in range(0, 500, 7)}
    places = staging.stage_table(spark.createDataFrame(sorted(wanted), "doc_id long, line int"))
    levels, marks = SimpleNamespace(value=None), SimpleNamespace(value=line_join._wanted_filter(places))
    sent = {(r["doc_id"], r["line"]) for r in texts.select("doc_id", "text").mapInArrow(line_join._passing_sets(levels, marks), "ref long, tail int, doc_id long, line int, words binary").collect()}
    assert wanted <= sent and len(sent) < 2 * len(wanted)


def test_staging_deletes_its_shuffle_files(spark):
    def files() -> set[str]:
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for k in range(found.size()) if (f := found.apply(k).getName()).startswith("shuffle_")}

    setting = spark.conf.get(staging.CLEANUP)
    before = files()
    staged = staging.stage_table(spark.range(10000).selectExpr("id % 7 as k").groupBy("k").count())
    until = time.time() + 10
    while (left := files() - before) and time.time() < until:
        time.sleep(0.1)
    assert not left and spark.conf.get(staging.CLEANUP) == setting
    assert {tuple(r) for r in staged.collect()} == {(k, 1428 + (k < 4)) for k in range(7)}


def test_long_lines_alike_in_any_branch(spark, monkeypatch):
    df = table(spark, list(enumerate(LONG_LINES)) + [(i + 1000, x) for i, x in enumerate(LONG_LINES[:40])])
    found = []
    for most in (0, 1 << 30):
        monkeypatch.setattr(line_join, "MOST_BROADCAST", most)
        found.append(rows(line_join.similar_lines(df)))
    assert found[0] == found[1] and {tuple(r)[:2] for r in line_join.similar_lines(df).where("n_links > 0").collect()} == {(0, 0), (300, 0), (1000, 0)}
