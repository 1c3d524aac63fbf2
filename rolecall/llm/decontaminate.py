"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.llm.words import PUNCTUATION, chunks, shingles, utf8, word_hashes

#: Benchmark bytes that one pass over the documents broadcasts; larger benchmarks take several passes.
SLICE_BYTES = 16 << 20
_FOUND = "doc_id long, item_id long, score double, start long, end long, seeds long"


class _Items:
    """One slice of the benchmark: words, and seeds by hash."""

    def __init__(self, rows: list[tuple[int, str]], n: int):
        self.ids = [r[0] for r in rows]
        hashes, _, _, at = word_hashes([(r[1] or "").encode() for r in rows], PUNCTUATION)
        self.words = [hashes[at[i] : at[i + 1]] for i in range(len(rows))]
        # Items shorter than n words are one seed of their own length.
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}
        grams: dict[int, list] = defaultdict(list)
        for i, w in enumerate(self.words):
            if len(w):
                size = min(n, len(w))
                grams[size] += [(g, i, k) for k, g in enumerate(shingles(w, size).tolist())]
        for size, rows in grams.items():
            rows.sort()
            self.by_length[size] = np.array([r[0] for r in rows], np.uint64), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])


def align(doc: np.ndarray, item: np.ndarray, match: int = 2, other: int = -1, gap: int = -1) -> tuple[int, int, int]:
    """Best local alignment of two word sequences: score, first and end word in ``doc``."""
    n = len(doc)
    steps = np.arange(n + 1) * -gap
    above, from_above = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best = (0, 0, 0)
    for word in item:
        diagonal = above[:-1] + np.where(doc == word, match, other)
        down = above[1:] + gap
        now, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
        now[1:] = np.maximum(np.maximum(diagonal, down), 0)
        start[1:] = np.where(now[1:] == 0, start[1:], np.where(now[1:] == diagonal, from_above[:-1], from_above[1:]))
        # A gap along the document: the best of all places to the left, less the steps between.
        left = np.maximum.accumulate(now + steps)
        source = np.maximum.accumulate(np.where(now + steps == left, np.arange(n + 1), 0))
        now, start = left - steps, start[source]
        at = int(now.argmax())
        if now[at] > best[0]:
            best = int(now[at]), int(start[at]), at
        above, from_above = now, start
    return best


def _hits(hashes: np.ndarray, items: _Items) -> Iterator[tuple[int, int, int, int]]:
    """Seed, item, place in item and place in text of each seed in a text's words."""
    for size, (seeds, owner, place) in items.by_length.items():
        if len(hashes) < size:
            continue
        grams = shingles(hashes, size)
        low = np.searchsorted(seeds, grams)
        for at in np.flatnonzero(seeds[np.minimum(low, len(seeds) - 1)] == grams):
            k = low[at]
            while k < len(seeds) and seeds[k] == grams[at]:
                yield int(seeds[k]), int(owner[k]), int(place[k]), int(at)
                k += 1


def _find(items, least: float, slack: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = items.value
        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), utf8(batch.column(1))
            rows = []
            for a, b in chunks(texts):
                hashes, begin, end, at = word_hashes(texts[a:b], PUNCTUATION)
                for i in range(b - a):
                    words = hashes[at[i] : at[i + 1]]
                    places: dict[int, set[int]] = defaultdict(set)
                    for _, item, place, k in _hits(words, known):
                        places[item].add(k - place)
                    for item, offsets in places.items():
                        size, best = len(known.words[item]), (0.0, 0, 0)
                        for low, high in _regions(sorted(offsets), size + slack):
                            low, high = max(0, low - slack), min(len(words), high + size + slack)
                            # No alignment matches more than the item's words that stand here at all.
                            if np.isin(known.words[item], words[low:high]).sum() / size < least:
                                continue
                            score, x, y = align(words[low:high], known.words[item])
                            best = max(best, (score / (2 * size), low + x, low + y))
                        if best[0] >= least:
                            text, first = texts[a + i], at[i]
                            x, y = (len(text[: int(k)].decode()) for k in (begin[first + best[1]], end[first + best[2] - 1]))
                            rows.append((doc_ids[a + i], known.ids[item], best[0], x, y, len(offsets)))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in _FOUND.split(", ")])

    return run


def _regions(offsets: list[int], near: int) -> Iterator[tuple[int, int]]:
    low = high = offsets[0]
    for x in offsets[1:]:
        if x - high > near:
            yield low, high
            low = x
        high = x
    yield low, high


def contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 5, least: float = 0.6, slack: int = 8) -> DataFrame:
    """Each document and test item whose best alignment reaches ``least``.

    Words are split at ASCII white space and punctuation, A-Z lower-cased. An
    item's seeds are all its word n-grams: leaving out frequent ones would lose the
    copies that hold no others. Where a seed occurs, the item is aligned with the
    words around (match 2, mismatch and gap -1), unless too few of its words stand
    there to reach ``least``; score is the alignment's over a perfect one's, start
    and end its place in the text in code points. Items shorter than n words are one seed; items without words match
    nothing; null and empty texts have no words. Repeated rows are judged each; an
    empty table gives no rows. Items are broadcast in slices of ``SLICE_BYTES``:
    a larger benchmark means more passes, not a larger broadcast.
    """
    spark = docs.sparkSession
    items = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    held = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    slices = int(held // SLICE_BYTES) + 1
    found = None
    for k in range(slices):
        rows = [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k).distinct().collect()]
        known = spark.sparkContext.broadcast(_Items(sorted(rows), n))
        part = docs.select("doc_id", "text").mapInArrow(_find(known, least, slack), _FOUND)
        found = part if found is None else found.unionByName(part)
    return found


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every passage of ``documents`` that copies an item of ``benchmark``."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
