"""Paged searches as a Spark data source: one partition a query, which follows its pages and retries them.

``spark.read.format("paged_search")`` reads landed pages; whoever fetches live gives
``pages_of`` another fetch. Each row is a response as the board readers take it.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from typing import Any, NamedTuple

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rolecall.sources import boards

#: One search: where it stands among all, what it asks, and of whom.
QUERY = "query int, connector string, scope string, slug string, term string, location string"
RESPONSE = f"{QUERY}, page int, ordinal long, http_code int, attempts int, body string, host string, name string"


class Retry(NamedTuple):
    """``attempts`` in all; pauses double from ``least`` to ``most`` seconds. ``any_error``: codes like 404 are tried again too."""

    attempts: int = 3
    least: float = 2
    most: float = 20
    any_error: bool = False

    def again(self, code: int | None) -> bool:
        """Whether an answer that failed may be other next time. No code means that none came."""
        return code != 200 and (self.any_error or code is None or code >= 500 or code == 429)

    def pause(self, attempt: int) -> float:
        """Seconds to wait after the failed ``attempt``, counted from 1."""
        return max(self.least, min(self.most, 2.0 ** (attempt - 1)))


class Paging(NamedTuple):
    """How a search goes on. ``kind``: page (1, 2, ..), offset (0, size, ..) or cursor (null, then what ``next`` holds).

    ``items``, ``id``, ``total`` and ``next`` are dotted paths in the payload and the
    item; without ``total`` a page of fewer than ``size`` items is the last. ``partial``:
    codes after which a query ends with the pages that it has, beside the failed one.
    """

    kind: str
    items: str
    id: str
    size: int
    max_pages: int
    total: str = ""
    next: str = ""
    partial: tuple[int, ...] = ()


class Answer(NamedTuple):
    code: int | None
    body: str | None


def _at(value: Any, path: str) -> Any:
    for name in path.split(".") if path else ():
        value = value.get(name) if isinstance(value, dict) else None
    return value


def fetched(fetch: Callable[[str, int], Answer], cursor: str, retry: Retry, wait: Callable[[float], None]) -> tuple[Answer, int]:
    """The last answer for ``cursor`` and how many were asked for."""
    for attempt in range(1, retry.attempts + 1):
        answer = fetch(cursor, attempt)
        if attempt == retry.attempts or not retry.again(answer.code):
            return answer, attempt
        wait(retry.pause(attempt))
    raise ValueError("a retry needs an attempt at least")


def pages_of(fetch: Callable[[str, int], Answer], paging: Paging, retry: Retry = Retry(), wait: Callable[[float], None] = lambda s: None) -> list[tuple[int, Answer, int]]:
    """``page, answer, attempts`` of a query's pages, in order; of a query that fails, the failed answer alone.

    A query goes on until a page is empty or holds no id that an earlier page lacks, the
    total is reached, a page isn't full, no cursor follows, or ``max_pages`` are read. A
    page that isn't JSON fails the query, as a code other than 200 does.
    """
    found, seen = [], set()
    cursor = {"page": "1", "offset": "0", "cursor": ""}[paging.kind]
    for page in range(paging.max_pages):
        answer, attempts = fetched(fetch, cursor, retry, wait)
        try:
            payload = json.loads(answer.body or "") if answer.code == 200 else None
        except ValueError:
            payload = None
        if payload is None:
            failed = (page, Answer(answer.code if answer.code != 200 else 0, None), attempts)
            return [*found, failed] if answer.code in paging.partial else [failed]
        found.append((page, answer, attempts))
        items = _at(payload, paging.items)
        items = items if isinstance(items, list) else []
        ids = {str(_at(i, paging.id)) for i in items}
        total = _at(payload, paging.total) if paging.total else None
        last = len(items) < paging.size if total is None and paging.kind != "cursor" else total is not None and (page + 1) * paging.size >= int(total)
        cursor = str(page + 2) if paging.kind == "page" else str((page + 1) * paging.size) if paging.kind == "offset" else _at(payload, paging.next)
        if not ids - seen or last or not cursor:
            break
        seen |= ids
    return found


class Query(InputPartition):
    def __init__(self, asked: tuple):
        self.asked = asked


class PagedSearch(DataSource):
    """Options: ``folder`` with landed pages as ``query=<number>/*.json`` (lines with cursor, attempt, http_code, body), ``queries`` and ``paging`` as JSON, ``any_error``."""

    @classmethod
    def name(cls) -> str:
        return "paged_search"

    def schema(self) -> str:
        return RESPONSE

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder, self.queries = options["folder"], json.loads(options["queries"])
        self.paging, self.retry = Paging(**json.loads(options["paging"])), Retry(any_error=options.get("any_error", "false") == "true")

    def partitions(self) -> list[InputPartition]:
        return [Query(tuple(q)) for q in self.queries]

    def read(self, partition: Query) -> Iterator[tuple]:
        number = partition.asked[0]
        for page, answer, attempts in pages_of(landed(f"{self.folder}/query={number}"), self.paging, self.retry):
            yield (*partition.asked, page, number * (1 << 32) + page, answer.code, attempts, answer.body, None, None)


def landed(folder: str) -> Callable[[str, int], Answer]:
    """A fetch that gives what landed for each cursor and attempt, and no answer for what didn't."""
    store, top = fs.FileSystem.from_uri(folder)
    told: dict[tuple[str, int], Answer] = {}
    if store.get_file_info(top).type == fs.FileType.Directory:
        for info in store.get_file_info(fs.FileSelector(top)):
            if info.path.endswith(".json"):
                with store.open_input_stream(info.path) as stream:
                    for line in stream.read().splitlines():
                        row = json.loads(line)
                        told[row["cursor"], row["attempt"]] = Answer(row.get("http_code"), row.get("body"))
    return lambda cursor, attempt: told.get((cursor, attempt), Answer(None, None))


def query_matrix(connector: str, companies: Iterable[tuple[str, str]], terms: list[str], locations: list[str], keywords_only: bool = False) -> list[tuple]:
    """The queries of a search: each term at each location, of each company (scope, slug); a search by keywords alone takes the first location."""
    asked = [(scope, slug, t, place) for scope, slug in companies for t in terms for place in locations[: 1 if keywords_only else None]]
    return [(k, connector, *q) for k, q in enumerate(asked)]


def search(spark: SparkSession, folder: str, queries: list[tuple], paging: Paging, any_error: bool = False) -> DataFrame:
    """The responses of all queries, as ``RESPONSE``; a query that failed has one row with its code and no body."""
    spark.dataSource.register(PagedSearch)
    options = {"folder": folder, "queries": json.dumps(queries), "paging": json.dumps(paging._asdict()), "any_error": str(any_error).lower()}
    return spark.read.format("paged_search").options(**options).load()


def covered_scopes(responses: DataFrame, whole: bool = False) -> DataFrame:
    """``scope`` of which every query succeeded; ``whole``: nothing is covered once any query failed, as one search has one scope."""
    bad = F.coalesce(F.col("http_code"), F.lit(0)) != 200
    told = responses.groupBy("scope").agg(F.max(bad).alias("failed")).where("not failed").select("scope")
    return told.where("false") if whole and not responses.where(bad).isEmpty() else told


def first_wins(postings: DataFrame) -> DataFrame:
    """Of postings with one id the first by ``place``; a partial minimum before the shuffle."""
    kept = [c for c in postings.columns if c not in ("source", "source_job_id", "place")]
    return postings.groupBy("source", "source_job_id").agg(F.min_by(F.struct(*kept), "place").alias("p")).select("source", "source_job_id", "p.*")


def read(responses: DataFrame, connector: str, as_of: str) -> DataFrame:
    """The postings of a search's responses, each id once: the one that the first query found first."""
    return first_wins(boards.read_source(responses, connector, boards.SOURCES[connector], as_of, connector in ("workday", "oracle"), carry=("ordinal",)))
