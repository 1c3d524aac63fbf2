"""Document fingerprints from prefix polynomial hashes."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.staging import stage_table

#: Two primes below 2 ** 31 and a base each; a span's hash is a pair.
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1664525013)
GRID = 32
_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_edited long, common_next long"
_powers = [np.ones(1, dtype=np.uint64) for _ in PRIMES]


def _power(k: int, n: int) -> np.ndarray:
    while len(_powers[k]) < n:
        have, p = _powers[k], PRIMES[k]
        _powers[k] = np.concatenate([have, have * np.uint64(pow(BASES[k], len(have), p)) % np.uint64(p)])
    return _powers[k][:n]


class Prefixes:
    """Prefix arrays of a text's code points: any span's equality in constant time."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64) + np.uint64(1)
        self.n = len(codes)
        self.sums = []
        for k, p in enumerate(PRIMES):
            sums = np.zeros(self.n + 1, dtype=np.uint64)
            # Terms are below 2 ** 31, so the sums of 2 ** 33 of them fit in 64 bits.
            np.cumsum(codes * _power(k, self.n) % np.uint64(p), out=sums[1:])
            self.sums.append(sums % np.uint64(p))

    def span(self, start: int, end: int, at: int) -> tuple[int, int]:
        """The hash of [start, end), as if it began at ``at`` >= start."""
        return tuple(
            (int(s[end]) - int(s[start])) % p * pow(BASES[k], at - start, p) % p
            for k, (s, p) in enumerate(zip(self.sums, PRIMES, strict=True))
        )

    def prefix(self, end: int) -> int:
        return int(self.sums[0][end]) << 32 | int(self.sums[1][end])


def same(a: Prefixes, i: int, b: Prefixes, j: int, length: int) -> bool:
    """Whether a[i:i+length] and b[j:j+length] are equal."""
    at = max(i, j)
    return a.span(i, i + length, at) == b.span(j, j + length, at)


def common(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """Length of the longest common extension of a from i and b from j, by binary search."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if same(a, i, b, j, middle) else (low, middle - 1)
    return low


def _step(n: int) -> int:
    step = 1
    while n // step > GRID:
        step *= 2
    return step


def fingerprint(text: Prefixes) -> str:
    """Length, hash of the whole, the prefix hashes at the multiples of a power of two, 32 at most, and as many hashes of the suffixes.

    Marks are written in base 64, four bytes each. A suffix's hash is that of the same text on its own, so it doesn't depend on where the suffix begins.
    """
    step, p = _step(text.n), np.uint64(PRIMES[1])
    places, sums = np.arange(step, text.n + 1, step), text.sums[1]
    shift = _power(1, text.n + 1)[places] * np.uint64(pow(BASES[1], -text.n, PRIMES[1])) % p
    tails = (sums[text.n] + p - sums[text.n - places]) % p * shift % p
    return f"{text.n:x}:{text.prefix(text.n):016x}:{_written(sums[places])}:{_written(tails)}"


def _written(marks: np.ndarray) -> str:
    return base64.b64encode(marks.astype(">u4").tobytes()).decode()


def _numbers(marks: str, every: int) -> list[int]:
    return np.frombuffer(base64.b64decode(marks), ">u4")[every - 1 :: every].tolist()


def likeness(a: str, b: str) -> float:
    """Share of the longer of two fingerprinted texts that lies in equal spans; 1 only if equal.

    Spans are those between the coarser marks of the two. They are compared at the
    same place from the start, by the differences of neighbouring prefix hashes, and at
    the same place from the end, so an edit costs the spans it touches and what moved
    against both ends.
    """
    (n, whole_a, marks_a, tails_a), (m, whole_b, marks_b, tails_b) = a.split(":"), b.split(":")
    if (n, whole_a) == (m, whole_b):
        return 1.0
    n, m = int(n, 16), int(m, 16)
    step, p = max(_step(n), _step(m)), PRIMES[1]
    own = step // _step(n), step // _step(m)
    ahead = [[0, *_numbers(x, k)] for x, k in zip((marks_a, marks_b), own, strict=True)]
    back = [[0, *_numbers(x, k)] for x, k in zip((tails_a, tails_b), own, strict=True)]
    count = range(1, min(n, m) // step + 1)
    first = [k for k in count if (ahead[0][k] - ahead[0][k - 1] - ahead[1][k] + ahead[1][k - 1]) % p == 0]
    # One step more from the end puts the next span before the ones so far.
    after = pow(BASES[1], step, p)
    last = [k for k in count if (back[0][k] - back[0][k - 1] * after - back[1][k] + back[1][k - 1] * after) % p == 0]
    return min(_covered(size, step, first, last) for size in (n, m)) / max(n, m)


def _covered(n: int, step: int, first: list[int], last: list[int]) -> int:
    """Code points of a text of ``n`` in the spans numbered from its start or from its end."""
    done = found = 0
    for start in sorted([(k - 1) * step for k in first] + [n - k * step for k in last]):
        found += max(0, start + step - max(start, done))
        done = max(done, start + step)
    return found


def _judge(doc_id: int, text: str, following: str) -> tuple:
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    own, other, after = Prefixes(text), Prefixes(edited), Prefixes(following)
    marks, edited_marks = fingerprint(own), fingerprint(other)
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, own.n, sha, marks, edited_marks, likeness(marks, edited_marks), likeness(marks, fingerprint(after)), common(own, 0, other, 0), common(own, 0, after, 0)


_FIELDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
_NAMES = [f.split()[0] for f in _RESULT.split(", ")]


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Judges a sorted partition's neighbours; its first and last row are handed on with their texts."""
    names, kinds = [*_NAMES, "edge", "text"], [*_FIELDS, pa.string(), pa.string()]
    blank = (None,) * (len(_NAMES) - 1)
    before = None
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or ""
            rows.append((*_judge(*before, text), None, None) if before else (doc_id, *blank, "first", text))
            before = doc_id, text
            if len(rows) >= 500:
                yield _batch(rows, names, kinds)
                rows = []
        yield _batch(rows, names, kinds)
    if before:
        yield _batch([(before[0], *blank, "last", before[1])], names, kinds)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _batch([_judge(*row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)], _NAMES, _FIELDS)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, which ends in the next document's beginning.

    Texts are put in order by one range shuffle; neighbours within a partition meet
    there, and only each partition's first and last rows are joined afterwards, by
    their ranks. Null texts are empty; equal doc_ids follow in text order; a single
    document is its own next; an empty table gives no rows. Columns: doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next
    and the exact common prefixes common_edited and common_next.
    """
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    found = stage_table(ordered.mapInArrow(_ordered, f"{_RESULT}, edge string, text string").withColumn("part", F.spark_partition_id()))
    # Two rows a partition: their order needs the ids and part numbers alone.
    edges = found.where("edge is not null").select("part", "edge", "doc_id", "text")
    firsts = edges.where("edge = 'first'").select(F.expr("row_number() over (order by part) - 1").alias("k"), F.col("part").alias("first_part"))
    n = firsts.count()
    after = firsts.select(((F.col("k") + n - 1) % F.lit(max(1, n))).alias("k"), F.col("first_part").alias("next_part"))
    meet = (
        firsts.join(after, "k")
        .join(edges.where("edge = 'last'").select(F.col("part").alias("first_part"), "doc_id", "text"), "first_part")
        .join(edges.where("edge = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("following")), "next_part")
    )
    return found.where("edge is null").select(*_NAMES).unionByName(meet.select("doc_id", "text", "following").mapInArrow(_pairs, _RESULT))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all of ``documents``."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
