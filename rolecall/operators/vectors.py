"""Near duplicates by meaning: random hyperplanes find candidates, exact cosines decide."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolecall.operators.blocks import attend, blocks_by_size, meetings
from rolecall.operators.components import connected_components
from rolecall.operators.joins import join_hot
from rolecall.staging import stage_table


class Planes(NamedTuple):
    """``similarity``: least cosine of a link. ``bits`` of each of ``bands`` codes; ``room``: bytes of a block of vectors."""

    similarity: float = 0.9
    bits: int = 8
    bands: int = 40
    seed: int = 7
    room: int = 4 << 20

    def miss(self) -> float:
        """The chance that a pair just similar enough shares no code; more similar pairs are missed more seldom."""
        same = 1 - math.acos(self.similarity) / math.pi
        return (1 - same**self.bits) ** self.bands


def _codes(p: Planes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            ids, flat = batch.column(0), batch.column(1)
            sizes = np.diff(flat.offsets.to_numpy())
            values = flat.flatten().to_numpy(zero_copy_only=False)
            at = np.concatenate([[0], np.cumsum(sizes)])
            for n in np.unique(sizes):
                if n not in planes:
                    planes[n] = np.random.default_rng([p.seed, int(n)]).standard_normal((int(n), p.bits * p.bands))
                mine = np.flatnonzero(sizes == n)
                rows = values[at[mine][:, None] + np.arange(n)].astype(np.float64)
                code = ((rows @ planes[n] > 0).reshape(len(mine), p.bands, p.bits) << np.arange(p.bits)).sum(2)
                # Vectors of another length are other codes.
                code += (np.arange(p.bands) + int(n) * p.bands) << p.bits
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.repeat(mine, p.bands))), pa.array(code.reshape(-1).astype(np.int64))], names=["id", "code"])

    return run


def _links(similarity: float):
    """Of two blocks of a code, or of one, the similar pairs; each once a code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A meeting's vectors stay in Arrow's memory until its turn, and never become Python's numbers.
            for own, other, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                rows = held.values
                ids = rows.field("id").to_numpy()
                order = np.argsort(ids)
                ids, left = ids[order], rows.field("block").to_numpy()[order] == own
                unit = rows.field("vector").flatten().to_numpy().reshape(len(ids), -1)[order]
                unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
                right = np.ones(len(ids), bool) if own == other else ~left
                a, b = np.flatnonzero(left), np.flatnonzero(right)
                for k in range(0, len(a), 512):
                    i, j = np.nonzero(unit[a[k : k + 512]] @ unit[b].T >= similarity)
                    i, j = a[k + i], b[j]
                    if own == other:
                        i, j = i[i < j], j[i < j]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[np.minimum(i, j)]), pa.array(ids[np.maximum(i, j)])], names=["src", "dst"])

    return run


def vector_groups(vectors: DataFrame, id_: str, vector: str, planes: Planes = Planes()) -> DataFrame:
    """``id, class_id, n_links, component_id`` of each vector.

    Equal vectors are one class, named by its smallest id; classes with a cosine of
    ``similarity`` or more are linked, n_links counts a class's links, and component_id
    is the smallest id reachable. Candidates share one of ``bands`` codes of ``bits``
    signs, so a pair is missed with the chance ``Planes.miss`` at most; every candidate
    is decided by its exact cosine. A code's vectors meet in blocks, so no task holds a
    hot code whole; its meetings are quadratic, but spread. Null, empty and zero vectors,
    and those with a null, NaN or infinite item, are linked with nothing, not even their
    equals; rows without an id are left out; of repeated ids the least vector counts.
    """
    own = stage_table(vectors.select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).where("id is not null").groupBy("id").agg(F.min("vector").alias("vector")))
    sound = F.expr("size(vector) > 0 and forall(vector, x -> coalesce(abs(x) < double('infinity') and not isnan(x), false)) and exists(vector, x -> x <> 0)")
    digest = F.sha2(F.to_json(F.struct("vector")), 256)
    able = stage_table(own.where(F.coalesce(sound, F.lit(False))).withColumn("digest", digest))
    classes = stage_table(able.groupBy("digest").agg(F.min("id").alias("class_id"), F.count("*").alias("n_rows")))
    of = stage_table(join_hot(able.select("id", "digest"), classes, "digest").select("id", "class_id"))
    heads = stage_table(able.join(classes.select(F.col("class_id").alias("id")), "id", "left_semi").select("id", "vector"))
    coded = stage_table(heads.mapInArrow(_codes(planes), "id long, code long").withColumn("size", F.lit(0)))
    width = F.lit(8 * (heads.agg(F.max(F.size("vector"))).first()[0] or 1))
    # Rows of one size share a place in the order, so the id's hash deals them to the blocks.
    placed = stage_table(blocks_by_size(coded, "code", "id", width, planes.room))
    met = meetings(placed.groupBy("code", "block").agg(F.count("*").alias("n")), "code", "l.block < r.block or l.n > 1")
    at = attend(placed, met, "code").select("id", "code", "own", "other", "block")
    pairs = stage_table(at.join(heads, "id").groupBy("code", "own", "other").agg(F.collect_list(F.struct("id", "block", "vector")).alias("rows")).select("own", "other", "rows").mapInArrow(_links(planes.similarity), "src long, dst long").distinct())
    degree = pairs.select(F.explode(F.array("src", "dst")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    reach = connected_components(pairs).select(F.col("node").alias("class_id"), F.col("component").alias("component_id"))
    found = of.join(degree, "class_id", "left").join(reach, "class_id", "left")
    return own.select("id").join(found, "id", "left").select(
        "id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "class_id", "id").alias("component_id")
    )
