"""Bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: SQL: every fifth document, by checksum of its id, is never learnt from.
HELD_OUT = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, true)"


def training_rows(docs: DataFrame, labels: DataFrame, label: str, sample: int) -> DataFrame:
    """``text, label`` of at most ``sample`` documents of each class (0 and 1) that aren't held out.

    The first by a hash of doc_id. Ids with labels of both kinds are left out, as are
    null labels; repeated rows count once. The ids are few, so they are broadcast.
    """
    known = labels.where(~F.expr(HELD_OUT) & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"), F.max(label).alias("other")).where("label = other").select("doc_id", "label")
    known = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    chosen = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select("text", "label")
