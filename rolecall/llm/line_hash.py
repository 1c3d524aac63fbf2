"""Substring dedup by line hashing: repeated lines and sentences go, the earliest stays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.operators.joins import join_hot
from rolecall.staging import stage_table

LINE, SENTENCE = 0, 1
_UNITS = "doc_id long, level int, start long, end long, digest binary"
_FOLD = {c: c + 32 for c in range(65, 91)} | {c: 32 for c in (9, 11, 12, 13)}


def normalise(unit: str) -> str:
    """Lower-cases A-Z, makes ASCII white space single spaces and drops full stops at the end."""
    return " ".join(x for x in unit.translate(_FOLD).split(" ") if x).rstrip(".")


def _pieces(text: str, at: int, by: str) -> Iterator[tuple[str, int]]:
    for piece in text.split(by):
        yield piece, at
        at += len(piece) + len(by)


def _units(min_words: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for line, at in _pieces(text or "", 0, "\n"):
                    found = [(LINE, line, at), *((SENTENCE, x, i) for x, i in _pieces(line, at, ". "))]
                    for level, unit, start in found if len(found) > 2 else found[:1]:
                        plain = normalise(unit)
                        if plain.count(" ") + 1 < min_words[level]:
                            continue
                        row = (doc_id, level, start, start + len(unit), hashlib.md5(plain.encode(), usedforsecurity=False).digest())
                        for column, value in zip(rows, row, strict=True):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "level", "start", "end", "digest"])

    return run


def repeated_units(docs: DataFrame, min_line_words: int = 4, min_sentence_words: int = 8) -> DataFrame:
    """The spans to remove: every line or sentence that an earlier place already has.

    A unit is a line, or a sentence (split at ". ") of a line of several; units of
    fewer words than the minimum are left alone. Units are equal if their
    normalised forms are; a line's digest also meets that of an equal sentence.
    The earliest (doc_id, start) of a group stays, and a sentence inside a removed
    line isn't listed. Offsets count code points of the original text, end
    exclusive. Columns: doc_id, level, start, end, digest, first_doc_id,
    first_start. Null or empty texts have no units; repeated rows of one doc_id
    are texts at the same place, so equal places don't remove each other; other
    columns of ``docs`` are not read.
    """
    units = stage_table(docs.select("doc_id", "text").mapInArrow(_units((min_line_words, min_sentence_words)), _UNITS))
    first = (
        units.groupBy("digest").agg(F.min(F.struct("doc_id", "start", "level")).alias("first"), F.count("*").alias("n_rows"))
        .where("n_rows > 1")
        .select("digest", F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start"), "n_rows")
    )
    found = join_hot(units, stage_table(first), "digest").where("doc_id <> first_doc_id or start <> first_start")
    # A removed line covers its sentences: both lie in the line's own span, so the running end tells.
    covered = F.expr("max(case when level = 0 then end end) over (partition by doc_id order by start, level rows between unbounded preceding and 1 preceding)")
    return (
        found.dropDuplicates(["doc_id", "level", "start", "end", "digest"])
        .withColumn("covered", covered)
        .where("level = 0 or covered is null or covered < end").drop("covered")
    )


def op7_line_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every removed span of ``documents``, with the place that stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return repeated_units(docs).select("doc_id", "level", "start", "end", F.lower(F.hex("digest")).alias("digest"), "first_doc_id", "first_start")


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS unit, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS k
  FROM documents
), placed_lines AS (
  SELECT doc_id, k, unit, coalesce(sum(length(unit) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM lines
), sentences AS (
  SELECT doc_id, k, start AS line_start, unnest(string_split(unit, '. ')) AS unit, unnest(range(1, len(string_split(unit, '. ')) + 1)) AS j
  FROM placed_lines WHERE contains(unit, '. ')
), units AS (
  SELECT doc_id, 0 AS level, unit, start FROM placed_lines
  UNION ALL
  SELECT doc_id, 1, unit, line_start + coalesce(sum(length(unit) + 2) OVER (PARTITION BY doc_id, k ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  FROM sentences
), plain AS (
  SELECT doc_id, level, start, start + length(unit) AS "end",
         rtrim(trim(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(11) || chr(12) || chr(13), 'abcdefghijklmnopqrstuvwxyz    '), ' +', ' ', 'g'), ' '), '.') AS norm
  FROM units
), kept AS (
  SELECT doc_id, level, start, "end", md5(norm) AS digest FROM plain
  WHERE length(norm) - length(replace(norm, ' ', '')) + 1 >= CASE level WHEN 0 THEN 4 ELSE 8 END
), ranked AS (
  SELECT *, first_value(doc_id) OVER w AS first_doc_id, first_value(start) OVER w AS first_start
  FROM kept WINDOW w AS (PARTITION BY digest ORDER BY doc_id, start, level)
), removed AS (
  SELECT * FROM ranked WHERE doc_id <> first_doc_id OR start <> first_start
)
SELECT r.doc_id, r.level, CAST(r.start AS BIGINT) AS start, CAST(r."end" AS BIGINT) AS "end", r.digest, r.first_doc_id, CAST(r.first_start AS BIGINT) AS first_start
FROM removed r
WHERE r.level = 0 OR NOT EXISTS (
  SELECT 1 FROM removed l WHERE l.level = 0 AND l.doc_id = r.doc_id AND l.start <= r.start AND l."end" >= r."end")
"""
