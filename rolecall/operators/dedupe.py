"""Priority-ordered two-key dedupe: greedy, and not transitive."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolecall import vocabulary as v
from rolecall.operators.components import connected_components
from rolecall.operators.joins import join_hot
from rolecall.staging import stage_table

_BORROWED = ("description", "tech_stack", "posted_at", "deadline", "grad_year", "pay", "team_size", "yc_batch", "vc")

#: Rounds after which what is open is settled by components, and the rows of a component that one task settles.
ROUNDS = 4
MOST_ROWS = 1 << 17


def priority(source: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in v.SOURCE_PRIORITY.items() for x in pair))
    return F.coalesce(F.try_element_at(table, source), F.lit(v.DEFAULT_PRIORITY))


def dedupe(jobs: DataFrame, score: Column | None = None, rounds: int = ROUNDS, most: int = MOST_ROWS) -> DataFrame:
    """Marks each job ``kept`` or gives the ``incumbent`` (its ordinal) that it repeats.

    Jobs are taken by (source priority, score descending, description length
    descending, ordinal). One is dropped if its canonical URL, or its company and
    title, are those of a job kept before; a dropped job hides nothing, so chains
    are not closed. Distributed as rounds: jobs first in both their groups are kept,
    those they hide go; each round settles every group's first open job. As long
    chains of alternating keys would take a round a link, what is open after
    ``rounds`` is cut into components of shared keys: those of up to ``most`` rows
    are each read in order by one task, larger ones go on in rounds. ``ordinal`` must be unique. Kept jobs without a URL hide others, but
    callers leave them out of results, see ``survivors``.
    """
    key = F.when((F.col("company_normalized") != "") & (F.col("title_normalized") != ""), F.concat_ws("\u0001", "company_normalized", "title_normalized"))
    rank = F.struct(priority(F.col("source")), -(score if score is not None else F.lit(0.0)), -F.length(F.coalesce("description", F.lit(""))), F.col("ordinal"))
    every = open_ = stage_table(jobs.select("ordinal", rank.alias("rank"), F.when(F.col("canonical_url") != "", F.col("canonical_url")).alias("by_url"), key.alias("by_key")))
    settled, done = None, 0
    while open_.take(1):
        done += 1
        if done == rounds + 1:
            part, open_ = _by_component(open_, most)
            settled = part if settled is None else settled.unionByName(part)
            continue
        first = open_
        for group in ("by_url", "by_key"):
            first = first.join(_firsts(open_, group), "ordinal", "left")
        kept = stage_table(first.where("(by_url is null or first_by_url) and (by_key is null or first_by_key)").select("ordinal", "rank", "by_url", "by_key"))
        hidden = open_.join(kept.select("ordinal"), "ordinal", "left_anti")
        for group in ("by_url", "by_key"):
            hidden = _with_least(hidden, kept, group, f"kept_{group}")
        hidden = stage_table(hidden.withColumn("incumbent", F.coalesce(F.when(F.col("kept_by_url") < F.col("rank"), F.col("kept_by_url.ordinal")), F.when(F.col("kept_by_key") < F.col("rank"), F.col("kept_by_key.ordinal")))))
        # The URL's own job may be kept in a later round, and then comes before the key's.
        unsure = F.col("by_url").isNotNull() & F.coalesce(F.col("kept_by_url") > F.col("rank"), F.lit(True))
        part = kept.select("ordinal", F.lit(None).cast("long").alias("incumbent"), F.lit(False).alias("unsure")).unionByName(
            hidden.where("incumbent is not null").select("ordinal", "incumbent", unsure.alias("unsure"))
        )
        settled = part if settled is None else settled.unionByName(part)
        open_ = hidden.where("incumbent is null").select("ordinal", "rank", "by_url", "by_key")
    if settled is None:
        settled = open_.select("ordinal", F.lit(None).cast("long").alias("incumbent"))
    elif done > 1:
        whole = stage_table(every.join(settled, "ordinal"))
        late = _with_least(whole.where("unsure"), whole.where("incumbent is null"), "by_url", "late")
        settled = whole.where("not unsure").select("ordinal", "incumbent").unionByName(
            late.select("ordinal", F.coalesce(F.when(F.col("late") < F.col("rank"), F.col("late.ordinal")), F.col("incumbent")).alias("incumbent"))
        )
    settled = settled.select("ordinal", "incumbent")
    return jobs.join(settled, "ordinal").withColumn("kept", F.col("incumbent").isNull())


def _by_component(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """``ordinal, incumbent`` of the open rows in components of up to ``most`` rows, and the other open rows.

    Keys are nodes by their hashes; two keys of one hash only put their components together.
    """
    url, key = (F.when(F.col(c).isNotNull(), F.xxhash64(F.lit(c), c)) for c in ("by_url", "by_key"))
    rows = stage_table(rows.withColumns({"node": F.coalesce(url, key, F.xxhash64("ordinal")), "other": F.coalesce(key, url, F.xxhash64("ordinal"))}))
    named = stage_table(connected_components(rows, "node", "other").join(rows.groupBy("node").agg(F.count("*").alias("n_rows")), "node"))
    sizes = stage_table(named.groupBy("component").agg(F.sum("n_rows").alias("n_rows")).withColumn("size", F.col("n_rows")))
    found = stage_table(join_hot(join_hot(rows, named, "node"), sizes, "component"))
    small = found.where(F.col("size") <= most).repartition("component").sortWithinPartitions("component", "rank")
    settled = small.select(F.col("ordinal").cast("long"), "component", "by_url", "by_key").mapInArrow(_in_order, "ordinal long, incumbent long")
    return stage_table(settled.withColumn("unsure", F.lit(False))), found.where(F.col("size") > most).select("ordinal", "rank", "by_url", "by_key")


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by component and rank; only the keys that kept rows of one component hold are in memory."""
    now, held = None, ({}, {})
    for batch in batches:
        told = []
        for ordinal, component, *keys in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if component != now:
                now, held = component, ({}, {})
            incumbent = next((h[k] for h, k in zip(held, keys, strict=True) if k in h), None)
            told.append(incumbent)
            if incumbent is None:
                for h, k in zip(held, keys, strict=True):
                    if k is not None:
                        h[k] = ordinal
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(told, pa.int64())], names=["ordinal", "incumbent"])


def _firsts(rows: DataFrame, group: str) -> DataFrame:
    """``ordinal`` of each group's first row, and a column that is true: rows find their mark by ``ordinal``, so no task gets a group, or all rows without one."""
    least = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.min("rank").alias("least"))
    return least.select(F.col("least.ordinal").alias("ordinal"), F.lit(True).alias(f"first_{group}"))


def _with_least(rows: DataFrame, among: DataFrame, group: str, name: str) -> DataFrame:
    """Adds the least rank of the group's rows in ``among``; null where there is none. Rows without a group are set apart, as a shuffle would put all of them into one task."""
    named = "struct<p:int,s:double,d:int,ordinal:bigint>"
    least = among.where(F.col(group).isNotNull()).groupBy(group).agg(F.min("rank").alias("least")).select(group, F.col("least").cast(named).alias(name))
    sizes = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n_rows"))
    rows = rows.withColumn("rank", F.col("rank").cast(named))
    found = join_hot(rows.where(F.col(group).isNotNull()), stage_table(least.join(sizes, group)), group, "left")
    return found.unionByName(rows.where(F.col(group).isNull()).withColumn(name, F.lit(None).cast(named)))


def survivors(marked: DataFrame, score: Column | None = None) -> DataFrame:
    """Kept jobs with a URL; what they lack they borrow from their duplicates, the best ranked first. ``score`` as for ``dedupe``."""
    rank = F.struct(priority(F.col("source")), -(score if score is not None else F.lit(0.0)), -F.length(F.coalesce("description", F.lit(""))), F.col("ordinal"))
    filled = {c: F.when(F.size(c) > 0, F.col(c)) if c == "tech_stack" else F.nullif(F.col(c), F.lit("")) if c == "description" else F.col(c) for c in _BORROWED if c in marked.columns}
    lent = marked.where("not kept").groupBy("incumbent").agg(
        F.max("is_new_grad").alias("lent_is_new_grad"), *(F.min_by(F.when(x.isNotNull(), x), F.when(x.isNotNull(), rank)).alias(f"lent_{c}") for c, x in filled.items())
    )
    found = marked.where("kept and canonical_url <> ''").drop("incumbent").join(lent, F.col("ordinal") == F.col("incumbent"), "left")
    own = {c: F.coalesce(x, F.col(f"lent_{c}"), F.col(c)) for c, x in filled.items()} | {"is_new_grad": F.col("is_new_grad") | F.coalesce("lent_is_new_grad", F.lit(False))}
    return found.withColumns(own).drop("incumbent", "kept", *(f"lent_{c}" for c in own))
