"""WARC archives: pages written as sharded, gzipped records in a fixed order, and read back.

An archive is a folder with ``part-<shard>-<file>.warc.gz`` files and ``manifest``, a
Parquet table that names them. Only files of the manifest belong to the archive, and
the manifest is written last.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.operators.joins import join_hot
from rolecall.staging import drop_stage, shared_dir, stage_table

#: Fixed values of the format: version, profile of a revisit, line end.
VERSION = b"WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The payload's type, and that of the record around it.
HTML, HTTP = "text/html; charset=utf-8", "application/http; msgtype=response"
#: The most tasks that read an archive; with more files, a task reads several.
MOST_TASKS = 20_000
_IDS = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the name space of URLs


class Settings(NamedTuple):
    """``shard_bytes``: payload a shard, which one task writes. ``file_bytes``: compressed bytes after which a file is closed.
    ``least_bytes``: payloads from this size on are written once, later ones as revisits. ``date``: of all records, as pages have none."""

    shard_bytes: int = 64 << 20
    file_bytes: int = 16 << 20
    least_bytes: int = 0
    date: str = "1970-01-01T00:00:00Z"
    level: int = 6


def keyed(pages: DataFrame) -> DataFrame:
    """``page_id, url, html`` with ``bytes`` and ``digest`` (SHA-1) of the payload; a null html is an empty one."""
    html = F.coalesce("html", F.lit(""))
    return pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), F.octet_length(html).cast("long").alias("bytes"), F.unhex(F.sha1(html)).alias("digest"))


def _qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with the scheme of its store, as Spark would take it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"file://{uri[5:]}" if uri.startswith("file:/") and not uri.startswith("file://") else uri


def shard_starts(sizes: DataFrame, shard_bytes: int) -> list[int]:
    """The first ``page_id`` of each shard but the first: where the bytes before it pass a multiple of ``shard_bytes``.

    ``sizes`` has ``page_id, bytes``. The cuts follow from the rows alone, so a shard is
    the same whatever the partitions. Running sums stay within sorted partitions; a sum
    a partition and a start a shard come to the driver.
    """
    summed = sizes.where("page_id is not null").groupBy("page_id").agg(F.sum("bytes").alias("bytes"))
    ranged = stage_table(summed.repartitionByRange("page_id").sortWithinPartitions("page_id").mapInArrow(_running, "page_id long, before long, part long, total long"))
    before, bases = 0, {}
    for part, total in sorted((r["part"], r["total"]) for r in ranged.groupBy("part").agg(F.max("total").alias("total")).collect()):
        bases[part], before = before, before + total
    if before <= shard_bytes:
        return []
    base = ranged.sparkSession.createDataFrame(list(bases.items()), "part long, base long")
    shard = F.floor((F.col("before") + F.col("base")) / F.lit(shard_bytes))
    starts = [r["start"] for r in ranged.join(F.broadcast(base), "part").groupBy(shard).agg(F.min("page_id").alias("start")).collect()]
    drop_stage(ranged)
    return sorted(starts)[1:]


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition's ids with the bytes before each and through it; ``part`` is its first id, so parts are in order."""
    part, before = None, 0
    for batch in batches:
        if batch.num_rows:
            ids, sizes = batch.column("page_id"), batch.column("bytes").to_numpy()
            part = ids[0].as_py() if part is None else part
            total = sizes.cumsum() + before
            yield pa.RecordBatch.from_arrays([ids, pa.array(total - sizes), pa.array([part] * len(ids), pa.int64()), pa.array(total)], names=["page_id", "before", "part", "total"])
            before = int(total[-1])


def _shard_of(page_id: Column, starts: list[int]) -> Column:
    """How many of the sorted ``starts`` aren't beyond ``page_id``; null ids come first."""

    @F.pandas_udf("int")
    def found(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(starts, np.int64), ids.to_numpy(), side="right").astype(np.int32))

    return found(F.coalesce(page_id, F.lit(-(1 << 63)))) if starts else F.lit(0)


def marked(pages: DataFrame, facts: DataFrame, least_bytes: int) -> DataFrame:
    """``pages`` as ``keyed`` with ``refers_to`` and ``refers_url``, both null in a response; a revisit has no html.

    ``facts`` is the staged ``keyed`` without html. Payloads that several rows share are
    found by partial aggregation and joined by ``join_hot``; where one payload's rows
    are a large share of all, they aren't shuffled for it.
    """
    shared = stage_table(
        facts.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("last"), F.count("*").alias("n_rows"))
        .where("n_rows > 1 and last.page_id is not null")
        .select("digest", F.col("last.page_id").alias("refers_to"), F.col("last.url").alias("refers_url"), "n_rows")
    )
    again = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    return join_hot(keyed(pages), shared, "digest", "left").select(
        "page_id", "url", F.when(~again, F.col("html")).alias("html"), "bytes", "digest", *(F.when(again, F.col(c)).alias(c) for c in ("refers_to", "refers_url"))
    )


def _uri(url: str | None) -> str:
    """``url`` without what would break a header line: blanks, controls and non-ASCII characters as percent codes of their UTF-8 bytes."""
    return quote(url or "", safe="".join(map(chr, range(33, 127))))


def record_id(page_id: int | None, url: str | None, digest: bytes, copy: int = 0) -> str:
    """The same for the same row in every run; ``copy`` numbers equal rows."""
    return f"<urn:uuid:{uuid.uuid5(_IDS, f'{page_id} {copy} {digest.hex()} {url}')}>"


def _sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def _record(kind: str, block: bytes, headers: dict[str, str | None], level: int) -> bytes:
    """One record as a gzip member of its own; the same bytes for the same record."""
    named = {"WARC-Type": kind, **headers, "WARC-Block-Digest": f"sha1:{_sha1(block)}", "Content-Length": str(len(block))}
    head = VERSION + "".join(f"{k}: {v}\r\n" for k, v in named.items() if v).encode() + b"\r\n"
    packer = zlib.compressobj(level, wbits=31)
    return packer.compress(head) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def _page_record(row: dict, copy: int, known: Settings) -> bytes:
    again, payload = row["refers_to"] is not None, (row["html"] or "").encode()
    headers = {
        "WARC-Record-ID": record_id(row["page_id"], row["url"], row["digest"], copy), "WARC-Date": known.date, "WARC-Target-URI": _uri(row["url"]),
        "Content-Type": HTTP, "WARC-Payload-Digest": f"sha1:{base64.b32encode(row['digest']).decode()}", "Page-ID": None if row["page_id"] is None else str(row["page_id"]),
    }
    if again:
        headers |= {
            "WARC-Profile": PROFILE, "WARC-Refers-To": record_id(row["refers_to"], row["refers_url"], row["digest"]), "WARC-Refers-To-Target-URI": _uri(row["refers_url"]),
            "WARC-Refers-To-Date": known.date, "Page-Refers-To": str(row["refers_to"]),
        }
    block = f"HTTP/1.1 200 OK\r\nContent-Type: {HTML}\r\nContent-Length: {row['bytes']}\r\n\r\n".encode() + (b"" if again else payload)
    return _record("revisit" if again else "response", block, headers, known.level)


class _Files:
    """The open file of a shard; closed files are listed in ``done``."""

    def __init__(self, folder: str, known: Settings):
        self.store, self.top = fs.FileSystem.from_uri(folder)
        self.known, self.attempt, self.done = known, uuid.uuid4().hex, []
        self.out, self.shard, self.file = None, -1, 0

    def _open(self) -> None:
        name = f"part-{self.shard:07d}-{self.file:05d}.warc.gz"
        self.store.create_dir(f"{self.top}/_temporary/{self.attempt}", recursive=True)
        self.temporary = f"_temporary/{self.attempt}/{name}"
        self.out, self.name, self.records, self.bytes, self.hash = self.store.open_output_stream(f"{self.top}/{self.temporary}", compression=None), name, 0, 0, hashlib.sha256()
        about = f"software: rolecall\r\nformat: WARC File Format 1.1\r\nisPartOf: shard {self.shard}\r\n".encode()
        self._put(_record("warcinfo", about, {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(_IDS, name)}>", "WARC-Date": self.known.date, "WARC-Filename": name, "Content-Type": "application/warc-fields"}, self.known.level))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.hash.update(data)
        self.bytes += len(data)

    def add(self, shard: int, data: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.file = shard, 0
        if self.out is None:
            self._open()
        self._put(data)
        self.records += 1
        if self.bytes >= self.known.file_bytes:
            self.close()
            self.file += 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.shard, self.name, self.temporary, self.records, self.bytes, self.hash.hexdigest()))
            self.out = None


_MANIFEST = pa.schema([("shard", pa.int64()), ("name", pa.string()), ("temporary", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
_WRITTEN = "shard long, name string, temporary string, records long, bytes long, sha256 string"


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def _write(folder: str, known: Settings):
    """Writes sorted rows to temporary files of this attempt; holds one batch and one record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, before, copy = _Files(folder, known), None, 0
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].as_py() for n in batch.schema.names}
                same = (row["page_id"], row["url"], row["digest"])
                copy = copy + 1 if same == before else 0
                before = same
                files.add(row["shard"], _page_record(row, copy, known))
        files.close()
        yield _batch(files.done, _MANIFEST)

    return run


def _publish(folder: str):
    """Gives files their last names. Run again, it finds them renamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, temporary in zip(batch.column("name").to_pylist(), batch.column("temporary").to_pylist(), strict=True):
                source, target = f"{top}/{temporary}", f"{top}/{name}"
                if store.get_file_info(source).type == fs.FileType.File:
                    store.move(source, target)
                elif store.get_file_info(target).type != fs.FileType.File:
                    raise FileNotFoundError(f"{name} was written but is gone")
            yield batch

    return run


def write_archive(pages: DataFrame, folder: str, known: Settings = Settings()) -> DataFrame:
    """Writes every row of ``pages`` (page_id, url, html) as a record below ``folder`` and returns the manifest.

    Records stand in order of page_id (null first), url and digest, in shards of about
    ``shard_bytes`` of payload, whose cuts follow from the rows alone; so the same
    rows give the same files, byte by byte, on any cluster. Of the rows with equal
    payloads of at least ``least_bytes`` those of the largest page_id are responses,
    the others revisits without payload; rows without a page_id refer to one that has
    it, and are responses among themselves. An empty table gives an empty manifest.

    A task writes below ``_temporary``, in a folder of its attempt; files of lost or
    repeated attempts are in no manifest. Files are then renamed and the manifest is
    written by Spark, whose commit is that of the archive. A folder that has a manifest
    is not written again; one without, left by a run that died, is.
    """
    spark = pages.sparkSession
    folder = _qualified(spark, folder)
    store, top = fs.FileSystem.from_uri(folder)
    if store.get_file_info(f"{top}/manifest").type != fs.FileType.NotFound:
        raise FileExistsError(f"{folder} already holds an archive")
    facts = stage_table(keyed(pages).drop("html"))
    starts = shard_starts(facts, known.shard_bytes)
    rows = marked(pages, facts, known.least_bytes).withColumn("shard", _shard_of(F.col("page_id"), starts))
    ranged = rows.repartitionById(len(starts) + 1, F.col("shard")).sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), F.col("url").asc_nulls_first(), "digest")
    written = stage_table(ranged.mapInArrow(_write(folder, known), _WRITTEN))
    written.mapInArrow(_publish(folder), _WRITTEN).drop("temporary").write.parquet(f"{folder}/manifest")
    if store.get_file_info(f"{top}/_temporary").type == fs.FileType.Directory:
        store.delete_dir(f"{top}/_temporary")
    drop_stage(facts)
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """``shard, name, records, bytes, sha256`` of each file of the archive."""
    return spark.read.schema("shard long, name string, records long, bytes long, sha256 string").parquet(f"{folder}/manifest")


def records_of(stream, most: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header (names in lower case) and block of each record of a gzipped file, a member at a time."""
    data = stream.read(most)
    while data:
        opened, parts = zlib.decompressobj(31), []
        while not opened.eof:
            if not data and not (data := stream.read(most)):
                raise ValueError("the file ends within a record")
            parts.append(opened.decompress(data))
            data = opened.unused_data if opened.eof else b""
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        named = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(named["content-length"])
        if first + "\r\n" != VERSION.decode() or rest[size:] != b"\r\n\r\n":
            raise ValueError(f"not a record: {first[:40]}")
        yield named, rest[:size]
        data = data or stream.read(most)


_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("html", pa.string())])


def _page(named: dict[str, str], block: bytes, payloads: bool) -> tuple:
    """A row of ``_READ``. Digests are taken anew of what was read and held against the header."""
    head, _, payload = block.partition(b"\r\n\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    again = named["warc-type"] == "revisit"
    told, size = named["warc-payload-digest"].removeprefix("sha1:"), int(fields["content-length"])
    if f"sha1:{_sha1(block)}" != named["warc-block-digest"] or not again and (_sha1(payload) != told or len(payload) != size):
        raise ValueError(f"{named['warc-record-id']} differs from its digests")
    number = lambda name: int(named[name]) if name in named else None
    return number("page-id"), named.get("warc-target-uri"), named["warc-type"], size, told, number("page-refers-to"), payload.decode() if payloads and not again else None


def _read(folder: str, payloads: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, there in zip(batch.column("name").to_pylist(), batch.column("records").to_pylist(), strict=True):
                out, held, n = [], 0, 0
                with store.open_input_stream(f"{top}/{name}", compression=None) as stream:
                    for named, block in records_of(stream):
                        if named["warc-type"] not in ("response", "revisit"):
                            continue
                        out.append(_page(named, block, payloads))
                        n, held = n + 1, held + len(block)
                        if held > 8 << 20:
                            yield _batch(out, _READ)
                            out, held = [], 0
                yield _batch(out, _READ)
                if n != there:
                    raise ValueError(f"{name} has {n} records, its manifest {there}")

    return run


def read_archive(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """``page_id, url, record_type, payload_bytes, payload_digest, refers_to, html`` of every record; html is null in revisits, and without ``payloads``.

    Files stream through tasks a record at a time. A block or payload that differs from
    its digest, a cut file and a wrong number of records raise an error.
    """
    files, folder = manifest(spark, folder), _qualified(spark, folder)
    tasks = max(1, min(files.count(), MOST_TASKS))
    return files.repartition(tasks, "name").mapInArrow(_read(folder, payloads), "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, html string")


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``pages`` as its record, read back from the archive that was written of them."""
    folder = f"{shared_dir(spark)}/warc/{uuid.uuid4().hex}"
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_archive(spark, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP13_SQL = """
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), bits AS (
  SELECT *, array_to_string(list_transform(string_split(hex, ''), lambda c: substr(bin(instr('0123456789abcdef', c) + 15), 2)), '') AS bits FROM payloads
), named AS (
  SELECT page_id, payload_bytes, hex, max(page_id) OVER (PARTITION BY hex) AS last,
    array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda j: substr(bits, 1 + 5 * k + j, 1)::INT << (4 - j)))::INT, 1)), '') AS payload_digest
  FROM bits
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM named
"""
