"""Rules applied once to each distinct value that they read."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecall.operators.joins import MOST_BYTES, join_hot
from rolecall.staging import stage_table


def once_a_value(rows: DataFrame, inputs: list[str], made: Callable[[DataFrame], DataFrame], among: DataFrame | None = None, most: int = MOST_BYTES) -> DataFrame:
    """Adds what ``made`` adds to a table of the columns ``inputs``, computed once for each of their distinct values.

    Feeds repeat titles, companies and whole texts, and patterns cost far more than a
    join. Nulls count as values. Rows whose value ``made`` leaves out go. ``among``: a
    table that holds all values of ``rows`` and is cheaper to read. Up to ``most`` bytes,
    by measure, what was made is broadcast; more is joined by digests of the values with
    ``join_hot``, so no task holds a frequent value's rows.
    """
    values = (rows if among is None else among).groupBy(*inputs).agg(F.count("*").alias("n_rows"))
    found = stage_table(made(values))
    size = found.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0] or 0
    if size <= most:
        own = {c: f"value_{c}" for c in inputs}
        few = F.broadcast(found.drop("n_rows").withColumnsRenamed(own))
        return rows.join(few, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(o)) for c, o in own.items()))).drop(*own.values())
    texts = [F.col(c) if kind == "string" else F.to_json(c) for c, kind in rows.select(*inputs).dtypes]
    digest = F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in texts)), 256)
    named = stage_table(found.withColumn("value_digest", digest).drop(*inputs))
    return join_hot(rows.withColumn("value_digest", digest), named, "value_digest").drop("value_digest")
