"""Personal data: pattern spans, and terms that give protected entities away."""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.operators.joins import join_hot
from rolecall.staging import stage_table

KINDS = ("email", "ip", "card", "phone")
#: So many candidate terms at most are broadcast (about 80 bytes each in a worker); beyond, their counts are joined by a shuffle.
MOST_BROADCAST = 1 << 18

# Each matches as the pattern in the docstring of base_spans does, in time linear in the text.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")


def luhn(digits: str) -> bool:
    """Whether the digits end in their check digit."""
    twice = [(0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2]]
    return (sum(twice) + sum(map(int, digits[-1::-2]))) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            done = m.end()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Personal data by pattern: (kind, start, end) by kind, then start.

    email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``; ip
    ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)`` with parts of 255 at most; card
    ``[0-9]([ -]?[0-9])+`` of 16 to 19 digits that pass Luhn; phone
    ``\\+[0-9][ ().0-9-]+[0-9]`` of 8 to 15 digits. Matches are leftmost and don't
    overlap within a kind; one that fails its test is dropped without a retry.
    """
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(x) <= 3 and int(x or "0") <= 255 for x in (part.lstrip("0") for part in m.group().split("."))):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append(("phone", *m.span()))
    return found


def _merged(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the places that any span covers, in order."""
    starts, ends = [], []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _around(text: str, spans: list[tuple[str, int, int]], window: int) -> Iterator[tuple[str, str, int, int]]:
    """Entity, term, start and end of the terms within ``window`` terms of each span."""
    terms = [*_TERM.finditer(text)]
    begins = [m.start() for m in terms]
    starts, ends = _merged(spans)
    for kind, start, end in spans:
        entity = hashlib.md5(f"{kind}:{text[start:end].lower()}".encode(), usedforsecurity=False).hexdigest()
        before, after = bisect_left(begins, start), bisect_left(begins, end)
        for m in (*terms[max(0, before - window) : before], *terms[after : after + window]):
            k = bisect_left(starts, m.end())
            if not k or ends[k - 1] <= m.start():
                yield entity, m.group().lower(), *m.span()


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_NEAR = pa.struct([("entity", pa.string()), ("term", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_SEEN = "doc_id long, base array<struct<kind:string,start:long,end:long>>, near array<struct<entity:string,term:string,start:long,end:long>>, digest long"


def _scan(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, near, digests = [], [], []
            for text in batch.column(1).to_pylist():
                text = text or ""
                spans = base_spans(text)
                base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans])
                near.append([dict(zip(("entity", "term", "start", "end"), s, strict=True)) for s in _around(text, spans, window)] if spans else [])
                digests.append(int.from_bytes(hashlib.md5(text.encode(), usedforsecurity=False).digest()[:8], "big", signed=True) if spans else 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, pa.list_(_SPAN)), pa.array(near, pa.list_(_NEAR)), pa.array(digests, pa.int64())], names=["doc_id", "base", "near", "digest"])

    return run


def _term_counts(keep):
    """Documents by term, of the terms in ``keep`` or of all; terms are found and lower-cased as in ``_around``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = None if keep is None else keep.value
        for batch in batches:
            counts: Counter[str] = Counter()
            for text in batch.column(0).to_pylist() if wanted is None or wanted else []:
                found = {t.lower() for t in set(_TERM.findall(text or ""))}
                counts.update(found if wanted is None else found & wanted)
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    return run


def protect(docs: DataFrame, window: int = 10, least_documents: int = 2, threshold: float = 0.8) -> DataFrame:
    """Every document's spans of personal data, by pattern and by disclosure.

    Protected entities are the values of ``base_spans``. A term (three letters or
    more, within ``window`` terms of an entity) discloses it if, counted over all
    documents, it shares at least ``threshold`` of the entity's information:
    PMI(term, entity) / IC(entity), that is log(n_both N / (n_term n_entity)) /
    log(N / n_entity). Both must meet in ``least_documents`` different texts, so a
    word that chance puts beside an entity once, and copies of one text, give no
    evidence. A disclosing term is removed ("remove") where it stands for the
    entity alone, else generalised ("term").

    Columns: doc_id, base and added (arrays of kind, start, end in code points, end
    exclusive; base ordered by kind as listed, then start; added by start). Null and
    empty texts have no spans; repeated rows are judged each; an empty table gives no
    rows; other columns are not read.
    """
    spark = docs.sparkSession
    seen = stage_table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scan(window), _SEEN).withColumn("row", F.monotonically_increasing_id()))
    near = seen.where("size(near) > 0").select("row", "digest", F.explode("near").alias("x")).select("row", "digest", "x.*").withColumn("pair", F.concat_ws(" ", "entity", "term"))
    pairs = stage_table(
        near.select("pair", "entity", "term", "row", "digest").distinct().groupBy("pair", "entity", "term")
        .agg(F.count_distinct("digest").alias("texts"), F.count_distinct("row").alias("n_rows"))
        .where(F.col("texts") >= least_documents)
    )
    terms = stage_table(pairs.select("term").distinct())
    few = terms.count() <= MOST_BROADCAST
    wanted = spark.sparkContext.broadcast({r[0] for r in terms.collect()}) if few else None
    counts = docs.select("text").mapInArrow(_term_counts(wanted), "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    entities = near.select("entity", "row").distinct().groupBy("entity").agg(F.count("*").alias("n_entity"))
    total = seen.count()
    share = F.log(F.col("n_rows") * F.lit(float(max(total, 1))) / (F.greatest("n_term", "n_rows") * F.col("n_entity"))) / F.log(F.lit(float(max(total, 1))) / F.col("n_entity"))
    telling = stage_table(
        pairs.join(counts, "term").join(entities, "entity").withColumn("share", share)
        .where(F.col("share") >= threshold)
        .select("pair", F.when(F.col("n_term") <= F.col("n_rows"), "remove").otherwise("term").alias("kind"), "n_rows")
    )
    added = (
        join_hot(near.select("row", "pair", "start", "end"), telling, "pair").groupBy("row", "start", "end").agg(F.min("kind").alias("kind"))
        .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("added"))
        .select("row", F.transform("added", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("added"))
    )
    empty = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return seen.join(added, "row", "left").select("doc_id", "base", F.coalesce("added", empty).alias("added"))


def redact(text: str, base: list, added: list) -> str:
    """The text with each base span and generalised term named by its kind, and removed terms left out."""
    out, at = [], 0
    spans = sorted((s["start"], s["end"], "" if s["kind"] == "remove" else f"[{s['kind'].upper()}]") for s in [*base, *added])
    for start, end, instead in spans:
        if end > at:
            out += [text[at : max(at, start)], instead]
            at = end
    return "".join(out) + text[at:]


def _joined(spans: str):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans of personal data in all of ``documents``."""
    found = protect(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, KINDS), F.sha2(_joined("base"), 256).alias("base_sha256"),
        F.concat_ws(",", F.when(F.size("base") > 0, _joined("base")), F.when(F.size("added") > 0, _joined("added"))).alias("spans"),
        (F.size("base") + F.size("added")).cast("long").alias("n_spans"),
    )

