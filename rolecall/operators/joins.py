"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with at least this share of the rows counts as heavy; there are at most 1 / HEAVY of them.
HEAVY = 1 / 256
#: Bytes of the heavy keys' right rows up to which they are broadcast; more are copied to ``SALTS`` places.
MOST_BYTES = 8 << 20
SALTS = 64


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Joins ``left`` with ``right``, unique in ``key`` and with a column ``n_rows``: left's rows of the key.

    Keys with at least a ``HEAVY`` share of all counted rows are at most 256 by
    counting alone, whatever the size of the data. If their right rows hold no more
    than ``MOST_BYTES`` they are broadcast; else each is copied to ``SALTS`` places,
    among which left's rows are spread. All other keys are joined by a shuffle.
    ``how`` is inner or left. Null keys match nothing. ``right`` should be a staged
    table: it is read more than once.
    """
    total = right.agg(F.sum("n_rows")).first()[0] or 0
    heavy = right.where(F.col("n_rows") >= F.lit(max(1000, int(total * HEAVY))))
    ids = [r[0] for r in heavy.select(key).collect()]
    plain = right.drop("n_rows")
    if not ids:
        return left.join(plain, key, how)
    hot = F.coalesce(F.col(key).isin(ids), F.lit(False))
    few = plain.where(F.col(key).isin(ids))
    held = few.agg(F.sum(F.octet_length(F.to_json(F.struct("*")))) if _has_blobs(few) else F.lit(0)).first()[0] or 0
    if held <= MOST_BYTES:
        found = left.where(hot).join(F.broadcast(few), key, how)
    else:
        # Equal left rows share a salt, which a retried task gives them again.
        salt = next(s for k in range(99) if (s := f"salt{k}") not in {*left.columns, *right.columns})
        found = (
            left.where(hot).withColumn(salt, F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)))
            .join(few.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), [key, salt], how).drop(salt)
        )
    return found.unionByName(left.where(~hot).join(plain.where(~F.col(key).isin(ids)), key, how))


def _has_blobs(df: DataFrame) -> bool:
    """Whether rows may be of any length."""
    return any(x in kind for _, kind in df.dtypes for x in ("string", "binary", "array", "map"))
