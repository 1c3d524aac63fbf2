"""What each filter of a chain removes, in every order of the chain, from one CUBE over the filters' failure flags."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolecall.operators.joins import join_hot
from rolecall.staging import drop_stage, stage_table

WORD = r"[^\x20\x09-\x0D]+"
#: The subsets of the filters are all kept for each part, so there may be few.
MOST_FILTERS = 8


def text_failures(text: Column) -> dict[str, Column]:
    """The failure conditions that a text alone decides, by letter."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    return {
        "A": n < 100,
        "B": F.size(F.array_distinct(words)) * 100 < n * 80,
        "C": F.octet_length(F.regexp_replace(text, "[^A-Z]+", "")) * 100 > F.char_length(text) * 10,
        "D": text.rlike("[#$%&*|]"),
    }


def failures(docs: DataFrame) -> DataFrame:
    """``doc_id, part`` and a boolean for each filter A to E, a row for each row of ``docs``.

    ``part`` is ``lang``; a null one, like a null text, is empty. E fails if the text
    is that of any smaller doc_id: rows of one doc_id, and rows without a doc_id,
    don't make each other fail. Texts are compared by SHA-256 and leave no task; a
    group of copies is a minimum by partial aggregation, joined by ``join_hot``.
    """
    text = F.coalesce("text", F.lit(""))
    flags = text_failures(F.col("text"))
    facts = stage_table(
        docs.select(F.col("doc_id").cast("long"), F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"))
        .select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *(c.alias(k) for k, c in flags.items()))
    )
    first = stage_table(facts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n_rows")).where("n_rows > 1"))
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return join_hot(facts, first, "digest", "left").select("doc_id", "part", *flags, later.alias("E"))


def subset_survivors(cells: DataFrame, filters: str, counts: list[str]) -> DataFrame:
    """``part, subset`` and the sums of ``counts`` over the rows that fail no filter of the subset, zeros included.

    ``subset`` has bit k set if it holds the filter k. ``cells`` has ``part`` and a
    boolean for each filter. One CUBE over flags and part gives every subset: the
    grouping sets whose flags, where grouped by, are all false.
    """
    cube = cells.cube("part", *filters).agg(
        *(F.sum(c).alias(c) for c in counts), F.grouping("part").alias("no_part"),
        sum((1 - F.grouping(f)) * (1 << k) for k, f in enumerate(filters)).cast("int").alias("subset"),
    )
    clean = cube.where("no_part = 0").where(~F.coalesce(F.greatest(*filters), F.lit(False)) if len(filters) > 1 else ~F.coalesce(F.col(filters), F.lit(False)))
    every = cells.select("part").distinct().withColumn("subset", F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))))
    return every.join(clean.select("part", "subset", *counts), ["part", "subset"], "left").fillna(0, counts)


def _steps(spark: SparkSession, filters: str) -> DataFrame:
    """``filter_order, step, filter, before, after``: a row for each step of each order, with the subsets applied before and after it."""
    bit = {f: 1 << k for k, f in enumerate(filters)}
    rows = [
        ("".join(order), k + 1, f, sum(bit[x] for x in order[:k]), sum(bit[x] for x in order[: k + 1]))
        for order in permutations(filters) for k, f in enumerate(order)
    ]
    return spark.createDataFrame(rows, "filter_order string, step int, filter string, before int, after int")


def audit(cells: DataFrame, filters: str, lost: dict[str, str]) -> DataFrame:
    """Every step of every order of ``filters`` in each part: a row for each part, order and step.

    ``cells`` has ``part`` (not null), a boolean for each filter (a letter each; true
    if it fails), ``n`` (rows so counted) and the columns that ``lost`` names by
    result. Returns ``part, filter_order, step, kept, removed, redundant,
    unique_fails, shapley`` and the columns of ``lost``, all but the first three long.
    No cells, no rows. The steps grow as the factorial of the filters, whose number
    is bounded, and never with the data; so they are broadcast.
    """
    if not 1 <= len(filters) <= MOST_FILTERS:
        raise ValueError(f"{len(filters)} filters; 1 to {MOST_FILTERS} can be audited")
    n, whole = len(filters), (1 << len(filters)) - 1
    counts = ["n", *lost.values()]
    alive = stage_table(subset_survivors(cells, filters, counts))
    steps = _steps(cells.sparkSession, filters)
    pairs = F.broadcast(steps.select("filter", "before", "after").distinct())
    after = alive.select("part", F.col("subset").alias("after"), *(F.col(c).alias(f"{c}_after") for c in counts))
    size = F.bit_count("before")
    orders = F.element_at(F.array(*(F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n))), size.cast("int") + 1)
    own = Window.partitionBy("part", "filter")
    moves = (
        alive.withColumnRenamed("subset", "before").join(pairs, "before").join(after, ["part", "after"])
        .select("part", "filter", "before", "after", F.col("n_after").alias("kept"), *((F.col(c) - F.col(f"{c}_after")).alias(k) for k, c in {"removed": "n", **lost}.items()))
        .withColumn("fails", F.max(F.when(F.col("before") == 0, F.col("removed"))).over(own))
        .withColumn("unique_fails", F.max(F.when(F.col("after") == whole, F.col("removed"))).over(own))
        .withColumn("shapley", F.sum(F.col("removed") * orders).over(own))
    )
    return moves.join(F.broadcast(steps), ["filter", "before", "after"]).select(
        "part", "filter_order", "step", *(F.col(c).cast("long") for c in ("kept", "removed")), (F.col("fails") - F.col("removed")).cast("long").alias("redundant"),
        F.col("unique_fails").cast("long"), *(F.col(c).cast("long") for c in lost), F.col("shapley").cast("long"),
    )


def labelled_cells(found: DataFrame, labels: DataFrame, filters: str) -> DataFrame:
    """``part``, the flags, and ``n``, ``good``, ``toxic``: how many rows, and of them with a label quality = 1 and toxic = 1.

    A doc_id with several labels has any of them. Rows of one doc_id are added up
    before they meet its labels.
    """
    known = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.expr("int(quality = 1)")).alias("good"), F.max(F.expr("int(toxic = 1)")).alias("toxic"))
    rows = found.groupBy("doc_id", "part", *filters).agg(F.count("*").alias("n")).join(known, "doc_id", "left")
    count = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0)))
    return rows.groupBy("part", *filters).agg(F.sum("n").alias("n"), count("good").alias("good"), count("toxic").alias("toxic"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five filters over whole ``documents`` in all 120 orders, by language."""
    found = failures(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    cells = stage_table(labelled_cells(found, spark.read.parquet(f"{sf_dir}/labels.parquet"), "ABCDE"))
    drop_stage(found)
    return audit(cells, "ABCDE", {"good_lost": "good", "toxic_lost": "toxic"})


OP12_SQL = r"""
WITH RECURSIVE texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), first AS (
  SELECT text, min(doc_id) AS first FROM texts GROUP BY text
), judged AS (
  SELECT part, [len(words) < 100, 100 * len(list_distinct(words)) < 80 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
      regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > first, false)] AS fails,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = texts.doc_id AND quality = 1) AS good, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = texts.doc_id AND toxic = 1) AS toxic
  FROM texts JOIN first USING (text)
), cells AS (
  SELECT part, fails, good, toxic, count(*) AS n FROM judged GROUP BY ALL
), orders(o) AS (
  SELECT '' UNION ALL SELECT o || f FROM orders, unnest(['A', 'B', 'C', 'D', 'E']) t(f) WHERE NOT contains(o, f)
), steps AS (
  SELECT o, s, list_transform(string_split(o, ''), lambda f: ascii(f) - 64) AS by_place FROM orders, range(1, 6) t(s) WHERE length(o) = 5
), fates AS (
  SELECT c.*, o, s, by_place[s] AS f, coalesce(list_position(list_transform(by_place, lambda k: fails[k]), true), 6) AS gone FROM cells c, steps
), told AS (
  SELECT part, o, s, any_value(f) AS f,
    coalesce(sum(n) FILTER (gone > s), 0) AS kept, coalesce(sum(n) FILTER (gone = s), 0) AS removed, coalesce(sum(n) FILTER (gone < s AND fails[f]), 0) AS redundant,
    coalesce(sum(n) FILTER (fails[f] AND len(list_filter(fails, lambda x: x)) = 1), 0) AS unique_fails,
    coalesce(sum(n) FILTER (gone = s AND good), 0) AS good_lost, coalesce(sum(n) FILTER (gone = s AND toxic), 0) AS toxic_lost
  FROM fates GROUP BY part, o, s
)
SELECT part, o AS filter_order, s::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM told
"""
