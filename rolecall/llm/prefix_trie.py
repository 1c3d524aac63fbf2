"""The prefix trie of conversations: every shared beginning a node, with sums over its subtree."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rolecall.operators.joins import join_hot
from rolecall.staging import drop_stage, stage_table

#: The digest of the root; a child's is the hash of its parent's digest and its own turn's.
ROOT = hashlib.sha256(b"").digest()
WORD = r"[^\x20\x09-\x0D]+"
#: Ids of this many neighbouring numbers are listed as one text before they are hashed in order.
IDS_A_CHUNK = 4096
_PREFIX = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("digest", pa.binary()), ("words", pa.int64()), ("last", pa.bool_())])
_ENDS = pa.schema([("digest", pa.binary()), ("ends_sha256", pa.string())])


def turn_items(conversations: DataFrame) -> DataFrame:
    """``conv_id, rank, item, words``: each turn's place in its conversation from 1 on, the digest of its role and text, and its words.

    In order of ``turn``, null first; turns of one number by role, by the first 64
    characters of text and by digest. Null roles and texts are empty; rows without a
    conv_id are left out; repeated rows are turns of their own. Texts stay where they
    are read: digests alone are shuffled.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    item = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"), "turn", role.alias("role"), F.substring(text, 1, 64).alias("begin"), item.alias("item"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "begin", "item")
    return turns.select("conv_id", F.row_number().over(order).cast("long").alias("rank"), "item", "words")


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of all prefixes of conversations that come one after the other, each turn by turn; holds one batch and one digest."""
    conv = digest = pending = None
    depth = 0
    for batch in batches:
        out: list[tuple] = []
        for one, item, words in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "item", "words")), strict=True):
            if pending:
                out.append((*pending, one != conv))
            if one != conv or item is None:
                conv, digest, depth = one, ROOT, 0
            else:
                digest, depth = hashlib.sha256(digest + item).digest(), depth + 1
            pending = (conv, depth, digest, words)
        yield _batch(out, _PREFIX)
    if pending:
        yield _batch([(*pending, True)], _PREFIX)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's chunks, joined by commas, from chunks sorted by node and place; a node's hash runs on from batch to batch."""
    node = state = None
    for batch in batches:
        out = []
        for digest, ids in zip(batch.column("digest").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if digest == node:
                state.update(b"," + ids.encode())
                continue
            if state:
                out.append((node, state.hexdigest()))
            node, state = digest, hashlib.sha256(ids.encode())
        yield _batch(out, _ENDS)
    if state:
        yield _batch([(node, state.hexdigest())], _ENDS)


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.binary(): "binary", pa.bool_(): "boolean", pa.string(): "string"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def trie(items: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the conversations ``convs`` (conv_id, distinct) with the turns ``items`` (conv_id, rank, item, words).

    A conversation is a member of the node of each of its prefixes, from the textless
    root on; conversations without turns are members of the root alone. Returns
    ``digest, conv_id`` (smallest member), ``depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256``. Without conversations there
    are no nodes.

    A node belongs to its smallest member, so a conversation owns its nodes from some
    depth on. Exploding the prefixes of a conversation gives each of its nodes and all
    their ancestors; what it owns is summed from its end upwards before it is added to
    the ancestors. So an ancestor gets one row a conversation rather than one a node
    below it, and all work is in proportion to the turns, however deep the trie.
    """
    rows = convs.select("conv_id", F.lit(0).cast("long").alias("rank"), F.lit(None).cast("binary").alias("item"), F.lit(0).cast("long").alias("words")).unionByName(items.select("conv_id", "rank", "item", "words"))
    prefixes = stage_table(rows.repartition("conv_id").sortWithinPartitions("conv_id", "rank").drop("rank").mapInArrow(_chained, _ddl(_PREFIX)))
    stats = stage_table(prefixes.groupBy("depth", "digest").agg(
        F.min("conv_id").alias("top"), F.count("*").alias("n_rows"), (F.sum(F.col("last").cast("int")) == F.count("*")).alias("leaf")
    ).withColumn("n_convs", F.col("n_rows")).drop("depth"))
    own = F.col("top") == F.col("conv_id")
    upwards = Window.partitionBy("conv_id").orderBy(F.col("depth").desc())
    so_far = upwards.rowsBetween(Window.unboundedPreceding, 0)
    told = join_hot(prefixes, stats, "digest").select(
        "digest", "depth", "conv_id", "n_convs", own.alias("own"),
        F.sum(F.when(own, (F.col("n_convs") - 1) * F.col("words")).otherwise(0)).over(so_far).alias("saved"),
        F.sum((own & F.col("leaf")).cast("long")).over(so_far).alias("leaves"),
        F.lag(own.cast("long"), 1, 0).over(upwards).alias("child"),
        F.lead("top").over(upwards).alias("above"),
    )
    nodes = told.groupBy("depth", "digest").agg(
        F.min("conv_id").alias("conv_id"), F.max(F.when(F.col("own"), F.col("above"))).alias("parent_conv_id"), F.max("n_convs").alias("n_convs"),
        F.sum("child").alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
    )
    chunk = F.expr(f"conv_id div {IDS_A_CHUNK}")
    chunks = prefixes.where("last").groupBy("digest", chunk.alias("chunk")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))
    ends = chunks.repartition("digest").sortWithinPartitions("digest", "chunk").mapInArrow(_hashed, _ddl(_ENDS))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return nodes.join(ends, "digest", "left").select(
        "digest", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256")
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of ``conversations`` as they stand; see ``turn_items`` and ``trie``. Extra columns are not read."""
    items = stage_table(turn_items(conversations))
    return trie(items, items.select("conv_id").distinct())


def _taken(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % 4


def rebuilt(items: DataFrame) -> DataFrame:
    """The turns of conversations that begin with the first 0 to 3 of the first conversation of their twenty, in place of their own."""
    first = items.where((F.col("conv_id") % 20 == 0) & (F.col("rank") <= 3)).withColumnRenamed("conv_id", "base")
    convs = items.select("conv_id").distinct().withColumn("base", F.col("conv_id") - F.col("conv_id") % 20)
    heads = convs.join(first, "base").where(F.col("rank") <= _taken(F.col("conv_id")))
    return heads.select("conv_id", "rank", "item", "words").unionByName(items.where(F.col("rank") > _taken(F.col("conv_id"))).select("conv_id", "rank", "item", "words"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of all rebuilt ``conversations``. ``%`` of a negative id keeps its sign, as in SQL."""
    items = stage_table(turn_items(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    found = trie(rebuilt(items), items.select("conv_id").distinct()).drop("digest")
    drop_stage(items)
    return found


OP11_SQL = r"""
WITH RECURSIVE rounds(i, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM rounds WHERE k < 8
), crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM rounds WHERE k = 8
), ids AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 20 AS base FROM conversations WHERE conv_id IS NOT NULL
), taken AS (
  SELECT conv_id, base, xor(4294967295, list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1]), 4294967295)) % 4 AS h
  FROM ids, crc_table
), ranked AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL
), turns AS (
  SELECT t.conv_id, r.k, r.role, r.text FROM taken t JOIN ranked r ON r.conv_id = t.base AND r.k <= t.h
  UNION ALL SELECT t.conv_id, r.k, r.role, r.text FROM taken t JOIN ranked r ON r.conv_id = t.conv_id AND r.k > t.h
), whole AS (
  SELECT conv_id, coalesce(list({'role': role, 'text': text} ORDER BY k) FILTER (k IS NOT NULL), []) AS seq FROM ids LEFT JOIN turns USING (conv_id) GROUP BY conv_id
), prefixes AS (
  SELECT conv_id, len(seq) AS n, d, seq[:d] AS prefix FROM (SELECT conv_id, seq, unnest(range(len(seq) + 1)) AS d FROM whole)
), nodes AS (
  SELECT d, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, max(n) = d AS leaf,
    coalesce(len(regexp_extract_all(prefix[d].text, '[^\x20\x09-\x0D]+')), 0) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends
  FROM prefixes GROUP BY d, prefix
), below AS (
  SELECT d, prefix, unnest(range(d + 1)) AS up, (n_convs - 1) * words AS saved, leaf FROM nodes
), sums AS (
  SELECT up AS d, prefix[:up] AS prefix, sum(saved) AS saved, count(*) FILTER (leaf) AS leaves, count(*) FILTER (d = up + 1) AS children FROM below GROUP BY 1, 2
)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, s.children AS n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN sums s ON s.d = n.d AND s.prefix = n.prefix LEFT JOIN nodes p ON p.d = n.d - 1 AND p.prefix = n.prefix[:n.d - 1]
"""
