"""MinHash near-dedup with sequential Bayesian verification, then exact links and components."""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.llm.words import common_counts, mix, shingle_sets, utf8
from rolecall.operators.blocks import attend, blocks_by_size, meetings
from rolecall.operators.components import connected_components
from rolecall.operators.joins import join_hot
from rolecall.staging import drop_stage, stage_table

#: Up to so many ids (8 bytes each) are broadcast to pick candidates' texts; more are joined by a shuffle.
MOST_BROADCAST = 1 << 20
_SEEN = "doc_id long, n_shingles long, class binary, signature binary"


class Settings(NamedTuple):
    """``bands`` keys of ``rows`` hashes each; a pair of similarity s shares a key with probability 1 - (1 - s^rows)^bands.

    At 0.85 that misses 3 in 10 million pairs, at 0.8 (rows 4) 8 in 10 million. Posterior tests
    prune a pair whose chance of reaching the similarity falls below ``miss``.
    """

    words: int = 3
    similarity: tuple[int, int] = (85, 100)
    rows: int = 5
    bands: int = 26
    batch: int = 16
    miss: float = 1e-6
    block: int = 256
    block_bytes: int = 4 << 20


@functools.cache
def _salts(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def signature(shingles: np.ndarray, n: int) -> np.ndarray:
    """``n`` minima of a set, under hashes that differ by a salt and a mix; 32 bits of each."""
    out = np.empty(n, dtype="<u4")
    for k, salt in enumerate(_salts(n)):
        x = (shingles ^ salt) * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        out[k] = int(x.min()) >> 32
    return out


@functools.cache
def least_matches(settings: Settings) -> tuple[int, ...]:
    """Least matching hashes after each batch that keep a pair: with a flat prior the posterior chance of the similarity is a binomial tail."""
    a, b = settings.similarity
    s, out = a / b, []
    for n in range(settings.batch, settings.rows * settings.bands + 1, settings.batch):
        chance, m = 0.0, -1
        while chance < settings.miss:
            m += 1
            chance += math.comb(n + 1, m) * s**m * (1 - s) ** (n + 1 - m)
        out.append(m)
    return tuple(out)


def survivors(a: np.ndarray, b: np.ndarray, settings: Settings) -> np.ndarray:
    """Which pairs of signature rows stay possible, looking at one batch of hashes after the other."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
    for k, least in enumerate(least_matches(settings)):
        part = slice(k * settings.batch, (k + 1) * settings.batch)
        matches = matches + (a[alive, part] == b[alive, part]).sum(1)
        stay = matches >= least
        alive, matches = alive[stay], matches[stay]
    return alive


def _class(shingles: np.ndarray) -> bytes | None:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _sign(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = settings.rows * settings.bands
        for batch in batches:
            sizes, classes, signatures = [], [], []
            for x in shingle_sets(utf8(batch.column(1)), settings.words):
                sizes.append(len(x))
                classes.append(_class(x))
                signatures.append(signature(x, n).tobytes() if len(x) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(signatures, pa.binary())], names=["doc_id", "n_shingles", "class", "signature"])

    return run


def _band_keys(settings: Settings):
    """A signature's bands, each as one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u4").reshape(-1, settings.bands, settings.rows).astype(np.uint64)
            key = np.tile(np.arange(settings.bands, dtype=np.uint64), (len(rows), 1))
            for k in range(settings.rows):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
            ids = np.repeat(batch.column(0).to_numpy(), settings.bands)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(ids)], names=["band", "node"])

    return run


def _sets(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [*shingle_sets(utf8(batch.column(1)), settings.words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([_class(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "class", "members"])

    return run


def _signed(rows: list[dict]) -> np.ndarray:
    return np.frombuffer(b"".join(r["signature"] for r in rows), "<u4").reshape(len(rows), -1)


def _members(rows: list[dict]) -> list[np.ndarray]:
    return [np.frombuffer(r["members"], np.uint64) for r in rows]


def _verify_pairs(settings: Settings):
    """The pairs of two documents that stay possible by their signatures and reach the similarity on their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = settings.similarity
        for batch in batches:
            left, right = (batch.column(k).to_pylist() for k in range(2))
            found = []
            for k in survivors(_signed(left), _signed(right), settings) if left else ():
                x, y = np.frombuffer(left[k]["members"], np.uint64), np.frombuffer(right[k]["members"], np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if b * both >= a * (len(x) + len(y) - both):
                    found.append((left[k]["node"], right[k]["node"]))
            yield _pairs(found)

    return run


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in range(2)], names=["a", "b"])


def _verify_blocks(settings: Settings):
    """The components that similar members of two blocks of a band, or of one, join: as few pairs of components as connect them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = settings.similarity
        for batch in batches:
            for own, other, rows in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                signed, part, side = _signed(rows), np.array([m["component"] for m in rows]), np.array([m["block"] for m in rows])
                odd = part != np.array([m["top"] for m in rows])
                pairs = [np.zeros((0, 2), np.int64)]
                for i in np.flatnonzero(odd):
                    # Each pair once, though both ends may be odd.
                    to = np.flatnonzero((part != part[i]) & (~odd | (np.arange(len(rows)) > i)) & ((side != side[i]) | (own == other)))
                    near = to[survivors(np.broadcast_to(signed[i], (len(to), signed.shape[1])), signed[to], settings)]
                    pairs.append(np.stack([np.full(len(near), i), near], 1))
                one, two = np.concatenate(pairs).T
                (left, at), (right, to) = (np.unique(x, return_inverse=True) for x in (one, two))
                size = np.array([len(m["members"]) // 8 for m in rows])
                both = common_counts(_members([rows[i] for i in left]), _members([rows[j] for j in right]))[at, to]
                linked = b * both >= a * (size[one] + size[two] - both)
                root: dict[int, int] = {}

                def top(c: int) -> int:
                    while (up := root.get(c, c)) != c:
                        root[c] = root.get(up, up)
                        c = up
                    return c

                found = []
                for i, j in zip(one[linked].tolist(), two[linked].tolist(), strict=True):
                    c, d = top(rows[i]["component"]), top(rows[j]["component"])
                    if c != d:
                        root[max(c, d)] = min(c, d)
                        found.append((rows[i]["component"], rows[j]["component"]))
                yield _pairs(found)

    return run


def near_duplicates(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, n_shingles, component_id``: documents linked by the Jaccard similarity of their word shingles.

    Words are runs without ASCII white space, A-Z lower-cased; a text of fewer words
    than a shingle is one shingle; null and empty texts have none and link with
    nothing. Documents of equal sets form a class and are linked; classes stand for
    their members from there on. Classes that share a MinHash band are candidates:
    first each with its band's smallest and largest member only, then, where a band
    still spans several components, all members across components, in blocks of
    bounded bytes that meet two at a time. Batches of hashes prune candidates by their
    posterior chance; survivors are verified on their full sets where they meet, and
    only links leave. component_id is the smallest doc_id reachable. Repeated rows of
    one doc_id are returned each; if their texts differ, one of them is compared, and all
    take its component. Rows without a doc_id are left out. An empty table gives no rows; other columns are not
    read. A text takes about 60 bytes a word while it is read.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    seen = stage_table(given.mapInArrow(_sign(settings), _SEEN))
    classes = stage_table(
        seen.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("node"), F.count("*").alias("n_rows"))
    )
    nodes = stage_table(
        join_hot(seen.where("class is not null").select("doc_id", "class", "signature"), classes, "class").where("doc_id = node")
        .groupBy("node").agg(F.min(F.struct("class", "signature")).alias("one")).select("node", "one.*")
    )
    bands = nodes.select("node", "signature").mapInArrow(_band_keys(settings), "band long, node long")
    # The marks tell bands of other members apart.
    marks = [F.bit_xor(F.xxhash64("node", F.lit(k))).alias(f"mark{k}") for k in range(2)]
    groups = stage_table(bands.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n_rows"), *marks).where("n_rows > 1"))
    bands = stage_table(join_hot(bands, groups.select("band", "low", "high", "n_rows"), "band"))
    ids = stage_table(bands.select(F.col("node").alias("doc_id")).distinct())
    texts = given.join(F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids, "doc_id", "left_semi")
    sets = texts.mapInArrow(_sets(settings), "node long, class binary, members binary").dropDuplicates(["node", "class"])
    held = stage_table(nodes.join(sets, ["node", "class"]).select("node", "signature", "members"))
    drop_stage(nodes)
    spokes = bands.selectExpr("low as a", "node as b").where("a <> b").unionByName(bands.selectExpr("node as a", "high as b").where("a <> b and a <> low")).distinct()
    links = stage_table(_with(stage_table(spokes), held).mapInArrow(_verify_pairs(settings), "a long, b long"))
    parts = stage_table(connected_components(links, "a", "b"))
    more = stage_table(connected_components(stage_table(_across(bands, groups, parts, held, settings).distinct()), "a", "b"))
    final = stage_table(
        classes.join(parts, "node", "left").select("class", "n_rows", F.coalesce("component", "node").alias("component"))
        .join(more.select(F.col("node").alias("component"), F.col("component").alias("further")), "component", "left")
        .select("class", F.coalesce("further", "component").alias("component_id"), "n_rows")
    )
    alone = seen.where("class is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return join_hot(seen.where("class is not null").select("doc_id", "n_shingles", "class"), final, "class").select("doc_id", "n_shingles", "component_id").unionByName(alone)


def _with(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """Both ends' rows of ``held``: ``x, y``. An end with many pairs, such as a hub, is joined as a heavy key."""
    for end, name in (("a", "x"), ("b", "y")):
        count = pairs.groupBy(end).agg(F.count("*").alias("n_rows")).withColumnRenamed(end, "node")
        side = stage_table(count.join(held, "node").select(F.col("node").alias(end), F.struct("node", "signature", "members").alias(name), "n_rows"))
        pairs = join_hot(pairs, side, end)
    return pairs.select("x", "y")


def _across(bands: DataFrame, groups: DataFrame, parts: DataFrame, held: DataFrame, settings: Settings) -> DataFrame:
    """Pairs of components that similar members join, from the bands that span several.

    In each such band the members outside its largest component meet all members, block
    by block. Bands of three are compared already, and of bands of the same members one will do.
    """
    once = groups.where("n_rows > 3").groupBy("n_rows", "mark0", "mark1").agg(F.min("band").alias("band")).select("band", F.col("n_rows").cast("long").alias("n_rows"))
    members = stage_table(
        join_hot(bands.select("band", "node"), stage_table(once), "band").join(parts, "node", "left")
        .select("band", "node", F.coalesce("component", "node").alias("component"))
    )
    spans = stage_table(
        members.groupBy("band", "component").agg(F.count("*").alias("n"))
        .groupBy("band").agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("n_rows"), F.count("*").alias("parts"))
        .where("parts > 1").select("band", F.col("top.component").alias("top"), "n_rows")
    )
    sizes = held.select("node", (F.octet_length("members") / 8).cast("long").alias("size"))
    open_ = stage_table(join_hot(members, spans, "band").join(sizes, "node"))
    placed = stage_table(blocks_by_size(open_, "band", "node", F.greatest(8 * F.col("size"), F.lit(settings.block_bytes // settings.block)), settings.block_bytes))
    heads = placed.groupBy("band", "block").agg(F.min("size").alias("lo"), F.max("size").alias("hi"), F.max(F.expr("component <> top")).alias("odd"))
    a, b = settings.similarity
    meet = meetings(heads, "band", f"(l.odd or r.odd) and {b} * l.hi >= {a} * r.lo and {b} * r.hi >= {a} * l.lo")
    by_node = attend(placed, meet, "band").groupBy("node").agg(F.collect_list(F.struct("band", "own", "other", "block", "component", "top")).alias("meetings"))
    rows = held.join(by_node, "node").withColumn("at", F.explode("meetings")).select("at.*", "node", "signature", "members")
    return (
        rows.groupBy("band", "own", "other").agg(F.collect_list(F.struct("block", "component", "top", "signature", "members")).alias("rows"))
        .select("own", "other", "rows").mapInArrow(_verify_blocks(settings), "a long, b long")
    )


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all of ``documents``: three words, similarity 0.85."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_shingles", "component_id", F.expr("doc_id = component_id").alias("kept"))


OP8_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
  FROM words
), flat AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT x.doc_id AS a, y.doc_id AS b FROM flat x JOIN flat y ON x.g = y.g AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(a, b) AS (
  SELECT a, b FROM ways UNION SELECT r.a, l.b FROM reach r JOIN ways l ON r.b = l.a
), least AS (
  SELECT a, min(b) AS m FROM reach GROUP BY a
)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id <= coalesce(m, doc_id) AS kept
FROM sets LEFT JOIN least ON least.a = doc_id
"""
