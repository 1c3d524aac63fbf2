"""Toxicity by a weighted lexicon, matched in folded text by Aho-Corasick."""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.llm.labelled import HELD_OUT, training_rows
from rolecall.staging import stage_table

#: Labelled documents of each class that the lexicon is learnt from, at most.
SAMPLE = 4000

# Letters that look like Latin ones, and digits and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ѕ": "s", "ј": "j",
    "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ԁ": "d", "ӏ": "i", "α": "a", "ο": "o", "ρ": "p",
    "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "χ": "x", "ε": "e", "ı": "i", "ɡ": "g", "ⅼ": "i",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "|": "i", "l": "i"}
_HIDDEN = {0x00AD: None, 0x200B: None, 0x200C: None, 0x200D: None, 0x2060: None, 0xFEFF: None}
_FOLD = {ord(a): b for a, b in (HOMOGLYPHS | SUBSTITUTES).items()} | _HIDDEN | {c: " " for c in range(128) if not chr(c).isalnum() and chr(c) not in SUBSTITUTES}


def fold(text: str) -> str:
    """The text in lower case, with look-alikes, digit substitutes and hidden characters resolved; words stand between spaces.

    ``l``, ``1`` and ``|`` all become ``i``, since each is used for the others.
    """
    return " " + unicodedata.normalize("NFKC", text).casefold().translate(_FOLD) + " "


def features(word: str) -> set[str]:
    """What the lexicon may hold of a folded word: the whole word, and its beginnings of 4 to 7 letters, for inflected forms."""
    return {f" {word} "} | {f" {word[:k]}" for k in range(4, min(8, len(word)))}


class Lexicon(NamedTuple):
    """Weights of terms, exception phrases, and the score's intercept and slopes."""

    weights: dict[str, float]
    exceptions: list[str]
    scale: tuple[float, float, float]


class Matcher:
    """Finds a lexicon's terms in folded text in one pass."""

    def __init__(self, lexicon: Lexicon):
        import ahocorasick

        self._scale = lexicon.scale
        self._automaton = ahocorasick.Automaton()
        for term, weight in lexicon.weights.items():
            self._automaton.add_word(term, (len(term), weight))
        for phrase in lexicon.exceptions:
            self._automaton.add_word(f" {phrase} ", (len(phrase) + 2, None))
        self._automaton.make_automaton()

    def matches(self, folded: str) -> dict[int, float]:
        """Weight by the place of a word's first letter; a place inside an exception phrase has none."""
        found: dict[int, float] = {}
        excused: list[tuple[int, int]] = []
        if len(self._automaton):
            for end, (length, weight) in self._automaton.iter(folded):
                start = end - length + 2
                if weight is None:
                    excused.append((start, end))
                else:
                    found[start] = max(weight, found.get(start, 0.0))
        covered = 0
        excused.sort(reverse=True)
        for place in sorted(found) if excused else ():
            while excused and excused[-1][0] <= place:
                covered = max(covered, excused.pop()[1])
            if place < covered:
                del found[place]
        return found

    def evidence(self, text: str) -> tuple[float, float]:
        """The weights' sum, as its logarithm, and the same for a thousand characters."""
        folded = fold(text)
        total = sum(self.matches(folded).values())
        return math.log1p(total), math.log1p(1000 * total / len(folded))

    def score(self, text: str) -> float:
        total, density = self.evidence(text)
        a, b, c = self._scale
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * total + c * density))))


def _emit(of_text, *kinds: pa.DataType, names: list[str]):
    """Rows ``of_text(text)`` gives, each with the document's label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for row in of_text(text or ""):
                    for column, value in zip(columns, (label, *row), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), *kinds), strict=True)], names=names)

    return run


def _terms_of(text: str) -> list[tuple[str, int]]:
    """Each term once, with one of 64 bits by the word before its first place."""
    found, before = {}, ""
    for word in fold(text).split():
        if word not in found:
            found[word] = 1 << (zlib.crc32(before.encode()) & 63)
        before = word
    terms: dict[str, int] = {}
    for word, bit in found.items():
        for f in features(word):
            terms.setdefault(f, bit)
    return [(f, bit - (1 << 64) * (bit >> 63)) for f, bit in terms.items()]


def _neighbours(folded: str, place: int) -> tuple[str, str, str]:
    """The word before, the word that begins at ``place``, and the word after; empty at an end of the text."""
    a = place - 1
    while a >= 0 and folded[a] == " ":
        a -= 1
    end = folded.find(" ", place)
    b = end
    while b < len(folded) and folded[b] == " ":
        b += 1
    return folded[folded.rfind(" ", 0, a + 1) + 1 : a + 1], folded[place:end], folded[b : folded.find(" ", b)] if b < len(folded) else ""


def _phrases_of(lexicon: Lexicon):
    matcher = None

    def run(text: str) -> set[tuple[str, int]]:
        nonlocal matcher
        matcher = matcher or Matcher(lexicon)
        folded, out = fold(text), set()
        for place in matcher.matches(folded):
            before, word, after = _neighbours(folded, place)
            out |= {(f"{before} {word}", 1)} if before else set()
            out |= {(f"{word} {after}", 1)} if after else set()
        return out

    return run


def _counted(rows: DataFrame, of_text, least: int) -> DataFrame:
    """Documents of each class by term, and the number of different bits among the toxic ones."""
    return (
        rows.mapInArrow(_emit(of_text, pa.string(), pa.int64(), names=["label", "term", "bit"]), "label int, term string, bit long").groupBy("term")
        .agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"), F.bit_count(F.bit_or(F.expr("if(label = 1, bit, 0L)"))).alias("contexts"))
        .where(F.col("toxic") + F.col("clean") >= least)
    )


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, least: int = 8, lift: float = 20.0) -> Lexicon:
    """Learns the lexicon from labelled documents outside the held-out fifth.

    ``sample`` documents of each class at most, the first by a hash of doc_id. A term
    enters if at least ``least`` toxic documents hold it, after different words (so
    that copies of one text don't make its words terms), and its share among them is
    ``lift`` times that among clean ones; its weight is that log ratio. Phrases of
    a term and a neighbour that clean documents hold more often than toxic ones
    are exceptions. Both are bounded by what the sampled documents hold. Score: logistic in the summed weights and their density.
    Without labels of both classes the lexicon is empty and scores are the base rate.
    """
    rows = stage_table(training_rows(docs, labels, "toxic", sample).select("text", "label"))
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Lexicon({}, [], (4.0 if toxic else -4.0, 0.0, 0.0))
    ratio = (F.col("toxic") + 0.5) / (toxic + 1) / ((F.col("clean") + 0.5) / (clean + 1))
    terms = _counted(rows, _terms_of, least).where((F.col("toxic") >= least) & (F.col("contexts") >= 0.7 * least) & (ratio >= lift)).select("term", F.log(ratio).alias("w"))
    weights = {r["term"]: r["w"] for r in terms.orderBy(F.desc("w"), "term").collect()}
    plain = Lexicon(_pruned(weights), [], (0.0, 1.0, 0.0))
    phrases = _counted(rows, _phrases_of(plain), 3).where("clean >= 3 and clean > toxic")
    found = plain._replace(exceptions=[r["term"] for r in phrases.orderBy(F.desc("clean"), "term").collect()])
    matcher = None

    def evidence(text: str) -> list[tuple[float, float]]:
        nonlocal matcher
        matcher = matcher or Matcher(found)
        return [matcher.evidence(text)]

    seen = np.array(rows.mapInArrow(_emit(evidence, pa.float64(), pa.float64(), names=["label", "total", "density"]), "label int, total double, density double").collect(), float)
    return found._replace(scale=_logistic(seen[:, 1:], seen[:, 0]))


def _pruned(weights: dict[str, float]) -> dict[str, float]:
    """The terms without those that begin a term of a weight more than 1 above theirs: such a beginning only borrows from it.

    Whole words end with a space, so only beginnings can begin others; these have few
    lengths, and the work grows with the terms, not with their pairs.
    """
    lengths = sorted({len(t) for t in weights if not t.endswith(" ")})
    most: dict[str, float] = {}
    for term, weight in weights.items():
        for n in lengths:
            if n < len(term):
                begin = term[:n]
                most[begin] = max(weight, most.get(begin, weight))
    return {t: w for t, w in weights.items() if most.get(t, w) <= w + 1}


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> tuple[float, float, float]:
    """Logistic regression by Newton steps, both classes weighing the same."""
    x = np.column_stack([np.ones(len(x)), x])
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * b * [0, *[1] * (len(b) - 1)]
        bend = x.T @ (x * (weight * p * (1 - p))[:, None]) + ridge * np.eye(len(b))
        step = np.linalg.solve(bend, slope)
        b -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in b)


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """``doc_id, score`` of every whole text; null and empty texts score as texts without a match. Repeated rows are scored each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            scores = [matcher.score(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lexicon = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, lexicon).select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", F.expr("int(score >= 0.5)").alias("predicted"))
