"""The keyed sync with its table in Spark's state store: a run writes what it changes and nothing else."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rolecall.streaming.sync import RUN

#: What a key's state holds; times are texts, as they come.
_KEY, _VALUE = "source string, source_job_id string", "scope string, fingerprint string, ordinal long, missed_runs int, first_seen_at string, last_seen_at string"
_CHANGE = f"action string, {_KEY}, {_VALUE}"
CHANGES = _CHANGE.replace("seen_at string", "seen_at timestamp_ntz") + ", batch long"
#: Groups of keys; a group's keys of one run, and those it closes, are held by a task.
BUCKETS = 64
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Timers of processing time would ask for empty batches without end.
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


class KeyedSync(StatefulProcessor):
    """Judges a bucket's keys by a run's postings and covered scopes, by the rules of ``sync.sync_actions``."""

    def __init__(self, as_of: str, full: bool, known: frozenset[str] | None, ttl_ms: int | None):
        self.as_of, self.full, self.known, self.ttl_ms = as_of, full, known, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.jobs = handle.getMapState("jobs", _KEY, _VALUE, self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        wanted: dict[tuple, tuple] = {}
        covered: set[str] = set()
        for frame in rows:
            for source, own, scope, fingerprint, ordinal in frame[["source", "source_job_id", "scope", "fingerprint", "ordinal"]].itertuples(index=False, name=None):
                if own is None:
                    covered |= {scope} if scope is not None else set()
                elif (source, own) not in wanted or ordinal >= wanted[source, own][2]:
                    wanted[source, own] = (scope, fingerprint, ordinal)
        judged = self._judged(wanted, covered) if covered or self.known is not None else self._seen(wanted)
        yield pd.DataFrame([*judged], columns=[f.split()[0] for f in _CHANGE.split(", ")]).astype({"ordinal": "int64", "missed_runs": "int32"})

    def _changed(self, key: tuple, new: tuple, old: tuple | None) -> Iterator[tuple]:
        scope, fingerprint, ordinal = new
        if old is None or old[1] != fingerprint or old[3]:
            value = (scope, fingerprint, ordinal, 0, old[4] if old else self.as_of, self.as_of)
            self.jobs.updateValue(key, value)
            yield ("update" if old else "insert", *key, *value)

    def _seen(self, wanted: dict[tuple, tuple]) -> Iterator[tuple]:
        """Of a run that can close nothing: each key is looked up."""
        for key, new in wanted.items():
            yield from self._changed(key, new, self.jobs.getValue(key))

    def _judged(self, wanted: dict[tuple, tuple], covered: set[str]) -> Iterator[tuple]:
        """Of a run that may close any key: the state is read in one pass, as a call for each key takes far longer; what changes is written after it."""
        seen, found, known_keys = [], [], set()
        for key, old in self.jobs.iterator():
            key, old = tuple(key), tuple(old)
            if key in wanted:
                known_keys.add(key)
                if old[1] != wanted[key][1] or old[3]:
                    seen.append((key, old))
                continue
            scope = old[0] or ""
            if self.known is not None and scope and scope not in self.known:
                found.append(("retired", key, old))
            elif covered and (not scope or scope in covered):
                found.append(("close" if self.full or old[3] else "miss", key, (*old[:3], old[3] + 1, *old[4:])))
        for key, old in seen:
            yield from self._changed(key, wanted[key], old)
        for key, new in wanted.items():
            if key not in known_keys:
                yield from self._changed(key, new, None)
        for action, key, new in found:
            if action == "miss":
                self.jobs.updateValue(key, new)
            else:
                self.jobs.removeKey(key)
            yield (action, *key, *new)

    def close(self) -> None:
        pass


def sync_state(spark: SparkSession, landed: str, out: str, checkpoint: str, as_of: str, full: bool, known: list[str] | None = None, buckets: int = BUCKETS, ttl_ms: int | None = None) -> DataFrame:
    """Syncs the state with what has landed since the last call, and returns the table.

    As ``sync.sync_available``, but the table lives in the state store, by buckets of
    keys: a run reads the buckets that it reaches and writes the keys that it changes,
    to the state and, numbered as its micro-batch, to ``out``; a batch that is run again
    replaces its own changes. A row with a scope and no id covers the scope, and reaches
    every bucket, so a scope of any size is judged by all of them. ``known`` scopes, a
    list as long as the registry, are judged in the buckets that a run reaches; a row
    without scope and id reaches all. ``ttl_ms``: keys whose state wasn't written for so
    long, by the clock, are forgotten; they stay in ``out``. The number of buckets belongs
    to the checkpoint and can't change.
    """
    before = {k: spark.conf.get(k, None) for k in _STORE}
    rows = spark.readStream.schema(RUN).parquet(landed).withColumn("ordinal", F.coalesce("ordinal", F.lit(0).cast("long")))
    reached = F.when(F.col("source_job_id").isNull(), F.sequence(F.lit(0), F.lit(buckets - 1))).otherwise(F.array(F.pmod(F.xxhash64("source", "source_job_id"), F.lit(buckets)).cast("int")))
    processor = KeyedSync(as_of, full, None if known is None else frozenset(known), ttl_ms)
    changes = rows.withColumn("bucket", F.explode(reached)).groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=_CHANGE, outputMode="Update", timeMode="ProcessingTime" if ttl_ms else "None"
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first_seen_at", "last_seen_at")})
        kept.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    try:
        for name, value in _STORE.items():
            spark.conf.set(name, value)
        changes.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return table(spark, out)


def changes_of(spark: SparkSession, out: str) -> DataFrame:
    """Every change with the ``batch`` that made it."""
    return spark.read.schema(CHANGES).parquet(out)


def table(spark: SparkSession, out: str) -> DataFrame:
    """The stored rows: of each key the last change, unless it closed or retired it."""
    rows = changes_of(spark, out)
    kept = [c for c in rows.columns if c not in ("source", "source_job_id", "batch")]
    last = rows.groupBy("source", "source_job_id").agg(F.max_by(F.struct(*kept), "batch").alias("r")).select("source", "source_job_id", "r.*")
    return last.where("action not in ('close', 'retired')").drop("action")
