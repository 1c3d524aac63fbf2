"""Sum-of-squares online packing of tokenised documents into fixed windows."""

from __future__ import annotations

import base64
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from rolecall.llm.words import chunks

WINDOW = 2048
END_ID = 1
CACHED_WORDS = 400_000  # of one task's tokenizer, about 80 MB
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordTokenizer:
    """Ids of byte-level BPE texts by way of their words.

    This kind of tokenizer never merges across a single space between two other
    characters, so a text's ids are those of its pieces, each with the space
    before it. Pieces are encoded once, by the same vocabulary's ranks, and kept in
    a bounded cache. Texts with other white space beside a space, or with the
    string of a special token, go to ``tokenizers`` whole.
    """

    def __init__(self, vocabulary: str, ranks: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(vocabulary)
        special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._special = re.compile("|".join(map(re.escape, special)) or "(?!)").search
        with open(ranks, "rb") as f:
            known = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
        self._ranks = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=known, special_tokens={})
        self._ids: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        split = [t.split(" ") for t in texts]
        used = set().union(*(x[1:] for x in split))
        fresh = used.difference(self._ids)  # words in the cache are good ones
        bad = {w for w in fresh if self._bad(w)}
        new = fresh - bad
        if len(self._ids) + len(new) > CACHED_WORDS:
            self._ids = {w: i for w, i in self._ids.items() if w in used}
        one = self._ranks.encode_ordinary
        for w in new:
            ids = one(" " + w)
            self._ids[w] = struct.pack(f"<{len(ids)}I", *ids)
        get = self._ids.__getitem__
        for text, words in zip(texts, split, strict=True):
            if not text:
                yield b""
            elif self._bad(words[0]) or bad and not bad.isdisjoint(words[1:]):
                yield np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
            else:
                yield np.array(one(words[0]), dtype="<u4").tobytes() + b"".join(map(get, words[1:]))

    def _bad(self, word: str) -> bool:
        return not word or word[0].isspace() or word[-1].isspace() or self._special(word) is not None


class SumOfSquares:
    """Windows under way. ``levels[f]`` counts the open windows filled to ``f``.

    An item goes where the sum of the squared counts grows least, a new window
    among the choices; a full window leaves the array. Ties go to the fullest.
    """

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.levels = np.zeros(window + 1, dtype=np.int64)
        self._open: dict[int, list[int]] = defaultdict(list)
        self.items: dict[int, list[tuple]] = {}
        self._next = 0

    def new(self) -> int:
        self._next += 1
        return self._next - 1

    def place(self, size: int, item: tuple) -> tuple[int, list[tuple]] | None:
        """Places the item; gives a window and its items once it is full."""
        n = self.levels
        fill = np.arange(self.window - size + 1)
        growth = 2 * (n[size:] - n[: self.window - size + 1] + 1)
        growth[-1] -= 2 * n[self.window] + 1  # a full window counts no more
        growth[0] += 2 * n[0] - 1 if size < self.window else 0
        growth = np.where((n[fill] > 0) | (fill == 0), growth, np.iinfo(np.int64).max)
        at = int(len(growth) - 1 - np.argmin(growth[::-1]))
        if at:
            where = self._open[at].pop()
            n[at] -= 1
        else:
            where = self.new()
            self.items[where] = []
        self.items[where].append(item)
        if at + size == self.window:
            return where, self.items.pop(where)
        self._open[at + size].append(where)
        n[at + size] += 1
        return None


def _pack(vocabulary: str, ranks: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, packer = WordTokenizer(vocabulary, ranks), SumOfSquares(window)
        task = TaskContext.get().partitionId() << 40
        out: list[tuple] = []

        def close(where: int, items: list[tuple]) -> None:
            at = 0
            for doc_id, start, ids, total in items:
                length = len(ids) // 4
                out.append((doc_id, start, length, zlib.crc32(ids), total, task + where, at))
                at += length

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * 7
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in _PIECES.split(", ")])

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in chunks(texts, 1 << 21):
                for doc_id, ids in zip(doc_ids[a:b], tokenizer.encode(texts[a:b]), strict=True):
                    ids += END_ID.to_bytes(4, "little")
                    total, start = len(ids) // 4, 0
                    while total - start >= window:
                        close(packer.new(), [(doc_id, start, ids[4 * start : 4 * (start + window)], total)])
                        start += window
                    if start < total and (full := packer.place(total - start, (doc_id, start, ids[4 * start :], total))):
                        close(*full)
                yield flush()
        # What is still open is dealt into full windows; at most one stays partial.
        room, items = window, []
        for _, left in sorted(packer.items.items()):
            for doc_id, start, ids, total in left:
                while ids:
                    cut = ids[: 4 * room]
                    items.append((doc_id, start, cut, total))
                    room, start, ids = room - len(cut) // 4, start + len(cut) // 4, ids[4 * room :]
                    if not room:
                        close(packer.new(), items)
                        room, items = window, []
        if items:
            close(packer.new(), items)
        yield flush()

    return run


def pack(docs: DataFrame, vocabulary: str | None = None, ranks: str | None = None, window: int = WINDOW) -> DataFrame:
    """Packs every document into windows of ``window`` ids.

    A document is its ids and the id 1; a null or empty text is that id alone.
    What fills whole windows is cut off first; the rest is placed whole by the
    sum-of-squares rule over one level array per task. At a task's end the windows
    still open are dealt into full ones, so each task leaves at most one partial
    window, to be padded (unless its length is a power of two). Repeated rows are
    packed each; columns other than doc_id and text are not read; an empty table
    gives no pieces. ``sequence_id`` is the task's number and a count: the same
    rows in the same partitions give the same windows when a task runs again.
    """
    import public_tokenizers

    names = vocabulary or public_tokenizers.path("byte_bpe_50k.json"), ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    return docs.select("doc_id", "text").mapInArrow(_pack(*map(str, names), window), _PIECES)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all of ``documents`` into windows of 2048."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
