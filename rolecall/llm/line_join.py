"""Line dedup by an exact set-similarity join over the words of lines."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolecall.llm.words import PUNCTUATION, chunks, common_counts, mix, utf8, word_hashes
from rolecall.operators.blocks import attend, blocks_by_size, meetings
from rolecall.operators.joins import join_hot
from rolecall.staging import drop_stage, stage_table

#: Counters of word frequency, as few and as many, and the bytes of text for which there is one between. Rarity only
#: orders the words, so words that share a counter cost time, not results.
LEAST_COUNTERS, MOST_COUNTERS, COUNTED = 1 << 17, 1 << 22, 1 << 15
#: Words of a line from which a group's sets are compared pair by pair, as each has so many prefix words.
LONG = 4096
#: Words of a line up to which a pair is compared by Python's sets, and links that leave a task at once.
SHORT, SENT = 512, 1 << 16
#: Classes a task remembers so as to send a repeated line's prefix once, and postings it gathers before it sends them.
REMEMBERED = 1 << 18
GATHERED = 1 << 19
#: Meetings and words of them, about 50 bytes each, that are broadcast with the lines that attend; more are joined by a shuffle.
MOST_BROADCAST = 1 << 20
#: Words of a line from which its postings carry 256 further bits, as 96 tell long lines no longer apart.
WIDE = 128
#: Words of 64 bits of the filter of wanted lines, at most. Beyond some 30 million lines more pass than are wanted, which costs shuffle, not results.
MOST_FILTER = 1 << 24

#: Kinds of rows: places, packed postings, postings of frequent words, pairs, members of dense groups.
PLACE, PACKED, POSTING, PAIR, DENSE = range(5)
_RECORD = np.dtype([("doc_id", "<i8"), ("line", "<i4"), ("ref", "<i8"), ("tail", "<i4")])
#: Of a packed posting: the word's code, the class, the parity's two parts, the size and the place.
_FIELDS = ("<u4", "<i8", "<u8", "<u4", "<u2", "<u2")
_MIXED = "kind int, x1 long, x2 long, x3 long, x4 long, x5 long, x6 long"
_ZSTD = pa.Codec("zstd", 1)


class Limits(NamedTuple):
    """Where the join changes its way; no result depends on them.

    ``hot``: occurrences from which a word's lines are counted before they are compared.
    ``slot``: postings packed together, about. ``sparse``: pairs for each line of a
    word's group up to which they go as pairs; beyond, as the lines they hold.
    ``postings``; ``sets`` and ``set_bytes``: of one of two blocks that meet.
    """

    hot: int = 1 << 15
    slot: int = 250_000
    sparse: int = 4
    postings: int = 8192
    sets: int = 256
    set_bytes: int = 4 << 20


class Lines:
    """Distinct words of each line of some texts, rarest first, in flat arrays."""

    def __init__(self, texts: list[bytes], levels: np.ndarray | None):
        hashes, begin, _, at = word_hashes(texts, PUNCTUATION)
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        ends = np.cumsum(sizes) - 1
        breaks = np.flatnonzero(np.frombuffer(b"\n".join(texts) + b"\n", np.uint8) == 10)
        self.doc = np.searchsorted(ends, breaks)
        self.number = np.arange(len(breaks)) - np.searchsorted(self.doc, np.arange(len(texts)))[self.doc]
        line = np.searchsorted(breaks, begin + np.repeat(ends + 1 - sizes, np.diff(at)))
        rarity = np.zeros(len(hashes), np.uint64) if levels is None else levels[_counter(hashes, len(levels))].astype(np.uint64)
        # One number to sort by: the line, the level, and as much of the hash as has room.
        bits = len(breaks).bit_length()
        key = line.astype(np.uint64) << np.uint64(64 - bits) | rarity << np.uint64(55 - bits) | hashes >> np.uint64(9 + bits)
        order = np.argsort(key)
        key, hashes = key[order], hashes[order]
        same = hashes[1:] == hashes[:-1]
        if ((key[1:] == key[:-1]) & ~same).any():
            hashes = hashes[(order := np.lexsort((hashes, rarity[order], line)))]
            same = hashes[1:] == hashes[:-1]
        fresh = np.ones(len(line), bool)
        fresh[1:] = (line[1:] != line[:-1]) | ~same
        self.words, self.line = hashes[fresh], line[fresh]
        self.size = np.bincount(self.line, minlength=len(breaks))
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self._mixed = mix(self.words)

    def _sums(self, values: np.ndarray) -> np.ndarray:
        """Sums modulo 2 ** 64 of the words' values, by line."""
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values, out=total[1:])
        return total[self.first[1:]] - total[self.first[:-1]]

    def classes(self) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of each line's set, as a long and an int: equal for equal sets."""
        return self._sums(self._mixed).view(np.int64), (self._sums(mix(self.words ^ np.uint64(0xA5A5A5A5A5A5A5A5))) >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def parity(self) -> tuple[np.ndarray, np.ndarray]:
        """96 bits of each line, as 64 and 32: a word flips one, so as many differ as words do, at most."""
        out = np.zeros(len(self.size), np.uint64), np.zeros(len(self.size), np.uint64)
        some = np.flatnonzero(self.size)
        if len(some):
            bit = (self._mixed >> np.uint64(32)) * np.uint64(96) >> np.uint64(32)
            one = np.uint64(1) << bit % np.uint64(64)
            for part, mine in zip(out, (bit < 64, bit >= 64), strict=True):
                part[some] = np.bitwise_xor.reduceat(np.where(mine, one, np.uint64(0)), self.first[some])
        return out

    def wider(self) -> tuple[np.ndarray, np.ndarray]:
        """256 further bits of each line of ``WIDE`` words or more, flipped likewise, and each line's row in them, or -1."""
        wide = self.size >= WIDE
        row = np.where(wide, np.cumsum(wide) - 1, -1)
        mine = wide[self.line]
        flips = np.bincount(row[self.line[mine]] << 8 | (self._mixed[mine] & np.uint64(255)).astype(np.int64), minlength=int(wide.sum()) << 8)
        return np.packbits((flips & 1).astype(np.uint8)).view(np.uint64).reshape(-1, 4), row


def overlap_needed(x, y, t: float = 0.8):
    """Least common words of sets of sizes x and y with a Jaccard similarity of t."""
    return np.ceil(t / (1 + t) * (x + y) - 1e-9)


def prefix_length(n, t: float = 0.8):
    """So many of a set's rarest words hold one of any similar set's."""
    return n - np.ceil(t * n - 1e-9) + 1


def counters(size: int) -> int:
    """How many counters a corpus of so many bytes gets: a power of two, so that a counter stands for as many words in any corpus up to 128 GB."""
    return min(MOST_COUNTERS, max(LEAST_COUNTERS, 1 << max(0, size // COUNTED - 1).bit_length()))


def _counter(hashes: np.ndarray, n: int) -> np.ndarray:
    return (hashes & np.uint64(n - 1)).astype(np.int64)


def _count(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n, np.int64)
        for batch in batches:
            texts = utf8(batch.column(0))
            for a, b in chunks(texts):
                found = _counter(word_hashes(texts[a:b], PUNCTUATION)[0], n)
                if n <= LEAST_COUNTERS:
                    counts += np.bincount(found, minlength=n)
                else:  # a large table isn't gone through for each chunk
                    used, times = np.unique(found, return_counts=True)
                    counts[used] += times
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used])], names=["counter", "n"])

    return run


def word_key(words: np.ndarray, slots: int) -> np.ndarray:
    """What postings keep of a word: 32 bits, and the slot above them. Words that share it cost time, not results."""
    return (words % np.uint64(1 << 32) % np.uint64(slots) << np.uint64(32) | words >> np.uint64(32)).view(np.int64)


def _pack(columns: list[np.ndarray], wider: np.ndarray) -> bytes:
    """Postings, by code, as compressed bytes: the codes' differences, the sizes' and places' bytes in planes of their own, and the further bits of wide lines."""
    columns = [np.diff(columns[0], prepend=0), *columns[1:]]
    parts = [c.astype(f) for c, f in zip(columns, _FIELDS, strict=True)]
    held = b"".join([*(c.tobytes() for c in parts[:4]), *(c.view(np.uint8).reshape(-1, 2).T.tobytes() for c in parts[4:]), wider.tobytes()])
    return len(parts[0]).to_bytes(4, "little") + len(wider).to_bytes(4, "little") + _ZSTD.compress(held, asbytes=True)


def _unpack(raw: bytes) -> list[np.ndarray]:
    n, n_wide, at, parts = int.from_bytes(raw[:4], "little"), int.from_bytes(raw[4:8], "little"), 0, []
    data = _ZSTD.decompress(raw[8:], n * sum(np.dtype(f).itemsize for f in _FIELDS) + 32 * n_wide, asbytes=True)
    for k, f in enumerate(map(np.dtype, _FIELDS)):
        parts.append(np.frombuffer(data, f, n, at) if k < 4 else np.ascontiguousarray(np.frombuffer(data, np.uint8, 2 * n, at).reshape(2, n).T).view(f)[:, 0])
        at += n * f.itemsize
    return [np.cumsum(parts[0], dtype=np.uint64), *parts[1:], np.frombuffer(data, np.uint64, 4 * n_wide, at).reshape(-1, 4)]


def _scatter(levels, hot_level: int, slots: int, least: int, t: float):
    """Places of all lines, and the postings of each class once: the prefix words of its line, packed by slot.

    Postings of frequent words and of very long lines are packed apart, spread over the slots.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        held: list[list[np.ndarray]] = []
        spread = 0

        def packed(slot: list[int], kind: list[int], data: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary())], names=["slot", "kind", "data"])

        def flush() -> Iterator[pa.RecordBatch]:
            *columns, wider = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            if not len(columns[0]):
                return
            order = np.argsort(columns[0])
            wide = columns[4] >= WIDE
            wider = wider[(np.cumsum(wide) - 1)[order[wide[order]]]]
            upto = np.concatenate([[0], np.cumsum(wide[order])])
            columns = [c[order] for c in columns]
            slot = columns[0] >> 32
            cuts = [0, *(np.flatnonzero(np.diff(slot)) + 1), len(slot)]
            columns[0] &= 0xFFFFFFFF
            data = [_pack([c[x:y] for c in columns], wider[upto[x] : upto[y]]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            yield packed([int(slot[x]) for x in cuts[:-1]], [PACKED] * len(data), data)

        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), utf8(batch.column(1))
            for a, b in chunks(texts):
                spread += 1
                lines = Lines(texts[a:b], levels.value)
                ref, tail = lines.classes()
                record = np.zeros(len(ref), _RECORD)
                record["doc_id"], record["line"], record["ref"], record["tail"] = ids[a:b][lines.doc], lines.number, ref, tail
                yield packed([spread % slots], [PLACE], [record[lines.size >= least].tobytes()])
                # Up to three words, only equal sets are similar.
                able = lines.size >= max(least, 4)
                keys = record[["ref", "tail"]].astype([("ref", "<i8"), ("tail", "<i4")]).view("V12").tolist()
                for i in np.flatnonzero(able):
                    if keys[i] in sent:
                        able[i] = False
                    else:
                        sent.add(keys[i])
                if len(sent) > REMEMBERED:
                    sent.clear()
                place = np.arange(len(lines.words)) - lines.first[lines.line]
                use = able[lines.line] & (place < prefix_length(lines.size, t)[lines.line])
                of, words = lines.line[use], lines.words[use]
                rows = [word_key(words, slots), ref[of], *(part[of] for part in lines.parity()), lines.size[of], place[use]]
                hot = (levels.value[_counter(words, len(levels.value))] >= hot_level) | (rows[4] > 0xFFFF)
                if hot.any():
                    yield packed([spread % slots], [POSTING], [np.stack([c[hot].astype(np.uint64).view(np.int64) for c in rows]).tobytes()])
                wider, row = lines.wider()
                held.append([*(c[~hot] for c in rows), wider[row[of[~hot & (rows[4] >= WIDE)]]]])
                if sum(len(h[0]) for h in held) > GATHERED:
                    yield from flush()
        if held:
            yield from flush()

    return run


def _alike(word, size, place, parity, rest, ref, t: float, side=None, wider=None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of postings of a word that pass the length, position and parity filters; they come by word and size. side: pairs of one side are left out. wider: the further bits of wide lines, and each posting's row in them."""
    left, right = [], []
    active = np.arange(len(word))
    k = 0
    while True:
        k += 1
        active = active[active + k < len(word)]
        j = active + k
        near = (word[active] == word[j]) & (size[active] >= t * size[j] - 1e-9)
        active, j = active[near], j[near]
        if not len(active):
            break
        need = overlap_needed(size[active], size[j], t)
        # A pair counts at its rarest common word alone, so all it shares lies from there on in both.
        ok = (np.minimum(size[active] - place[active], size[j] - place[j]) >= need) & (np.bitwise_count(parity[active] ^ parity[j]) + np.bitwise_count(rest[active] ^ rest[j]) <= size[active] + size[j] - 2 * need)
        i, j = active[ok], j[ok]
        need = need[ok]
        ok = ref[i] != ref[j]
        if side is not None:
            ok &= side[i] != side[j]
        if wider is not None:
            bits, row = wider
            both = np.flatnonzero(ok & (row[i] >= 0) & (row[j] >= 0))
            ok[both] = np.bitwise_count(bits[row[i[both]]] ^ bits[row[j[both]]]).sum(1) <= size[i[both]] + size[j[both]] - 2 * need[both]
        left.append(i[ok])
        right.append(j[ok])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))


def _mixed(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    n = len(columns[0])
    full = [pa.array(np.ascontiguousarray(c).astype(np.int64, copy=False)) for c in columns] + [pa.nulls(n, pa.int64())] * (6 - len(columns))
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *full], names=["kind", "x1", "x2", "x3", "x4", "x5", "x6"])


def _candidates(sparse: int, t: float):
    """Reads packed rows by slot. Gives places and postings of frequent words as they are, and pairs of postings or, of dense groups, their members."""

    def judge(slot: int, data: list[bytes]) -> Iterator[pa.RecordBatch]:
        *columns, bits = (np.concatenate(x) for x in zip(*map(_unpack, data), strict=True))
        code, ref, _, _, size, _ = columns
        wide = size >= WIDE
        row = np.where(wide, np.cumsum(wide) - 1, -1)
        order = np.argsort(code << np.uint64(32) | size.astype(np.uint64) << np.uint64(16) | ref.view(np.uint64) & np.uint64(0xFFFF))
        # Each task that met a class sent its postings; one of equal ones stays, else copies would count as their square.
        fresh = np.ones(len(order), bool)
        fresh[1:] = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
        order = order[fresh]
        code, ref, parity, rest, size, place = (c[order] for c in columns)
        size, place = size.astype(np.int64), place.astype(np.int64)
        left, right = _alike(code, size, place, parity, rest, ref, t, wider=(bits, row[order]))
        group = np.cumsum(np.concatenate([[0], (code[1:] != code[:-1]).astype(np.int64)]))
        dense = np.bincount(group[left], minlength=len(code)) > sparse * np.bincount(group, minlength=len(code))
        word = code.astype(np.int64) | slot << 32
        pairs = ~dense[group[left]]
        a, b = left[pairs], right[pairs]
        a, b = np.where(ref[a] < ref[b], (a, b), (b, a))
        yield _mixed(PAIR, word[a], ref[a], ref[b], size[a], size[b])
        alone = np.unique(np.concatenate([left[~pairs], right[~pairs]]))
        yield _mixed(DENSE, word[alone], ref[alone], size[alone])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, data = None, []
        for batch in batches:
            for slot, kind, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if kind == PLACE:
                    record = np.frombuffer(raw, _RECORD)
                    yield _mixed(PLACE, *(record[f] for f in _RECORD.names))
                elif kind == POSTING:
                    yield _mixed(POSTING, *np.frombuffer(raw, np.int64).reshape(6, -1))
                else:
                    if slot != now and data:
                        yield from judge(now, data)
                        data = []
                    now = slot
                    data.append(raw)
        if data:
            yield from judge(now, data)

    return run


def _hot_members(t: float):
    """Of two blocks of a frequent word's postings, or of one, the members of pairs that pass the filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word, own, other, rows in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                rows.sort(key=lambda r: r["size"])
                ref, parity, rest, size, place = (np.array([r[c] for r in rows], np.int64) for c in ("ref", "parity", "rest", "size", "place"))
                side = None if own == other else np.array([r["block"] == own for r in rows])
                pairs = _alike(np.zeros(len(rows)), size, place, parity.view(np.uint64), rest.view(np.uint64), ref, t, side)
                found = np.unique(np.concatenate(pairs))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), word)), pa.array(ref[found]), pa.array(size[found])], names=["word", "ref", "size"])

    return run


def _sets(levels):
    """The ordered sets of some lines of texts, ``doc_id, text, lines``, for each meeting that a line's class attends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, wanted = batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2).to_pylist()
            for a, b in chunks(texts):
                lines, out = Lines(texts[a:b], levels.value), []
                ref, tail = lines.classes()
                base = np.searchsorted(lines.doc, np.arange(b - a + 1))
                for i, own in enumerate(wanted[a:b]):
                    for w in own:
                        k = base[i] + w["line"]
                        # A repeated row of a document may hold another text.
                        if k < base[i + 1] and (ref[k], tail[k]) == (w["ref"], w["tail"]):
                            held = (w["ref"], w["tail"], ids[a + i], w["line"], lines.words[lines.first[k] : lines.first[k + 1]].tobytes())
                            out += [(*(m[c] for c in _MEETING), m["block"], m["by"], *held) for m in w["meetings"]]
                columns = list(zip(*out, strict=True)) or [[]] * len(_ATTENDS)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _ATTENDS.values(), strict=True)], names=list(_ATTENDS))

    return run


def _keys(ids: np.ndarray, line: np.ndarray | None = None) -> np.ndarray:
    """What the filter holds of a document or of a line of it."""
    doc = mix(ids.astype(np.int64).view(np.uint64) ^ np.uint64(0x5A5A5A5A5A5A5A5A))
    return doc if line is None else mix(doc + line.astype(np.uint64) + np.uint64(1))


def _spots(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of a filter's ``n`` words a key has, and its five bits there."""
    bits = np.zeros(len(keys), np.uint64)
    for k in range(5):
        bits |= np.uint64(1) << (keys >> np.uint64(6 * k) & np.uint64(63))
    return ((keys >> np.uint64(30)) % np.uint64(n)).astype(np.int64), bits


def _marks(n: int):
    """The filter's words that a task's wanted lines, ``doc_id, line``, and their documents mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(n, np.uint64)
        for batch in batches:
            ids, line = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            for keys in (_keys(ids), _keys(ids, line)):
                np.bitwise_or.at(marks, *_spots(keys, n))
        used = np.flatnonzero(marks)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(marks[used].view(np.int64))], names=["at", "bits"])

    return run


def _wanted_filter(places: DataFrame) -> np.ndarray:
    """A Bloom filter of the lines ``doc_id, line`` of a staged table and of their documents: 32 bits for each line while it fits ``MOST_FILTER``."""
    n = min(MOST_FILTER, places.count() // 2 + 1)
    found = places.select("doc_id", "line").mapInArrow(_marks(n), "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    marks = np.zeros(n, np.uint64)
    marks[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return marks


def _passing_sets(levels, marks):
    """The ordered sets of the lines of texts, ``doc_id, text``, that pass the filter of wanted lines."""

    def passes(keys: np.ndarray) -> np.ndarray:
        at, bits = _spots(keys, len(marks.value))
        return marks.value[at] & bits == bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            some = np.flatnonzero(passes(_keys(ids)))
            ids, texts = ids[some], utf8(batch.column(1).take(pa.array(some)))
            for a, b in chunks(texts):
                lines = Lines(texts[a:b], levels.value)
                ref, tail = lines.classes()
                doc = ids[a:b][lines.doc]
                k = np.flatnonzero(passes(_keys(doc, lines.number)))
                words = [lines.words[lines.first[i] : lines.first[i + 1]].tobytes() for i in k]
                yield pa.RecordBatch.from_arrays([pa.array(ref[k]), pa.array(tail[k]), pa.array(doc[k]), pa.array(lines.number[k].astype(np.int32)), pa.array(words, pa.binary())], names=["ref", "tail", "doc_id", "line", "words"])

    return run


_MEETING = ["dense", "word", "own", "other"]
_ATTENDS = {
    "dense": pa.bool_(), "word": pa.int64(), "own": pa.int64(), "other": pa.int64(), "block": pa.int64(), "by": pa.list_(pa.int64()),
    "ref": pa.int64(), "tail": pa.int32(), "doc_id": pa.int64(), "line": pa.int32(), "words": pa.binary(),
}
_ATTENDS_SCHEMA = "dense boolean, word long, own long, other long, block long, by array<long>, ref long, tail int, doc_id long, line int, words binary"
_LINKS = "ref long, tail int, n_links long, doc_id long, line int"


def _links(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) or [[]] * 5
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in _LINKS.split(", ")])


def _verified_pairs(rows: list[dict], pairs: list[dict], slots: int, t: float) -> Iterator[tuple]:
    """Counts a pair if it is similar and the rarest word that both have is one that it was found by as a pair."""
    sets: dict[int, list] = defaultdict(list)
    for r in rows:
        words = np.frombuffer(r["words"], np.uint64)
        # Sets of Python's are the faster way for a few words; long ones would take too much memory.
        sets[r["ref"]].append((words, frozenset(words.tolist()) if len(words) <= SHORT else None, r))
    for pair in pairs:
        for a, of_a, x in sets[pair["a"]]:
            for b, of_b, y in sets[pair["b"]]:
                short = of_a is not None and of_b is not None
                both = of_a & of_b if short else a[np.isin(a, b)].tolist()
                if len(both) >= overlap_needed(len(a), len(b), t):
                    rarest = next(w for w in a.tolist() if w in both) if short else both[0]
                    if (rarest % (1 << 32) % slots << 32 | rarest >> 32) in pair["words"]:
                        yield x["ref"], x["tail"], 1, y["doc_id"], y["line"]
                        yield y["ref"], y["tail"], 1, x["doc_id"], x["line"]


def _verified_blocks(word: int, left: list[dict], right: list[dict] | None, slots: int, t: float) -> Iterator[tuple]:
    """Counts the similar pairs of two blocks of one word's group, or of one, that have no rarer word in common."""
    rows = left + (right or [])
    sets = [np.frombuffer(r["words"], np.uint64) for r in rows]
    rarer = [s[: int((word_key(s, slots) == word).argmax())] for s in sets]
    k = 0 if right is None else len(left)
    size = np.array([len(s) for s in sets])
    links = common_counts(sets[: len(left)], sets[k:]) >= overlap_needed(size[: len(left), None], size[None, k:], t)
    links &= common_counts(rarer[: len(left)], rarer[k:]) == 0
    if right is None:
        np.fill_diagonal(links, False)
    ranks = [(r["doc_id"], r["line"]) for r in rows]
    for own, others, hits in ((0, k, links), *(() if right is None else ((k, 0, links.T),))):
        for i in np.flatnonzero(hits.any(1)):
            yield rows[own + i]["ref"], rows[own + i]["tail"], int(hits[i].sum()), *min(ranks[others + j] for j in np.flatnonzero(hits[i]))


def _verified_singly(rows: list[dict], within: bool, slots: int, t: float) -> Iterator[tuple]:
    """The same for long lines, pair by pair: a similar pair's rarest common word is in both prefixes."""
    held = [(np.frombuffer(r["words"], np.uint64), set(r["by"]), r) for r in rows]
    heads = [a[: int(prefix_length(len(a), t))] for a, _, _ in held]
    for i, (a, by, x) in enumerate(held):
        for j in range(i + 1, len(held)):
            b, also, y = held[j]
            if not within and x["block"] == y["block"] or min(len(a), len(b)) < t * max(len(a), len(b)) - 1e-9:
                continue
            common = heads[i][np.isin(heads[i], heads[j])][:1]
            if len(common) and int(word_key(common, slots)[0]) in by & also and len(np.intersect1d(a, b, assume_unique=True)) >= overlap_needed(len(a), len(b), t):
                yield x["ref"], x["tail"], 1, y["doc_id"], y["line"]
                yield y["ref"], y["tail"], 1, x["doc_id"], x["line"]


def _verify(slots: int, t: float):
    """Links by whole sets, of the listed pairs of a meeting, or of all its pairs where none are listed."""

    def links(own: int, other: int, rows: list[dict], pairs: list[dict] | None) -> Iterator[tuple]:
        # A repeated row of a document gives a class's set again.
        rows = list({(r["ref"], r["tail"]): r for r in rows}.values())
        if pairs is not None:
            yield from _verified_pairs(rows, pairs, slots, t)
            return
        if any(len(r["words"]) > 8 * LONG for r in rows):
            yield from _verified_singly(rows, own == other, slots, t)
            return
        by_word: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
        for r in rows:
            for word in r["by"]:
                by_word[word][r["block"] != own].append(r)
        for word, (left, right) in by_word.items():
            if own == other or left and right:
                yield from _verified_blocks(word, left, None if own == other else right, slots, t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple] = []
            for meeting in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                for link in links(*meeting):
                    found.append(link)
                    if len(found) == SENT:
                        yield _links(found)
                        found = []
            if found:
                yield _links(found)

    return run


def similar_lines(docs: DataFrame, t: float = 0.8, least: int = 3, limits: Limits = Limits()) -> DataFrame:
    """``doc_id, line, first_doc_id, first_line, n_links, removed`` of each line that has an equal or a similar one.

    A line's set is its distinct words (split at ASCII white space and punctuation,
    A-Z lower-cased); lines of fewer than ``least`` are left alone. Lines of equal
    sets form a class, whose first place in (doc_id, line) order is given; n_links
    counts the other classes with a Jaccard similarity of ``t``. A line is removed
    if an earlier line is equal or similar. The join is exact: words are ordered by
    rarity, classes that share a prefix word pass length, position and parity
    filters, and whole sets decide. Postings are packed into slots of bounded size;
    those of words that are frequent in the corpus are counted first and meet in
    blocks. A word's sparse groups give pairs; of dense ones only counts and earliest
    partners leave the blocks that compare them. Null and empty texts have no lines; repeated
    rows of a doc_id are at the same places and don't remove each other (with different
    texts, a place has several lines, and goes if one of them does); rows without a doc_id
    are left out; an empty table gives no rows; other columns are not read. A text takes
    about 100 bytes a word while it is read.
    """
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    n = counters(given.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    table = np.zeros(n, np.int64)
    for r in given.select("text").mapInArrow(_count(n), "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n")).collect():
        table[r["counter"]] = r["n"]
    level = lambda n: np.minimum(511, np.round(8 * np.log2(np.maximum(n, 1)))).astype(np.uint16)
    levels = spark.sparkContext.broadcast(level(table))
    slots = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), int(table.sum() / 4 / limits.slot))
    mixed = stage_table(
        given.mapInArrow(_scatter(levels, int(level(limits.hot)), slots, least, t), "slot int, kind int, data binary")
        .repartition("slot").sortWithinPartitions("slot").mapInArrow(_candidates(limits.sparse, t), _MIXED), by="kind"
    )
    lines = mixed.where(f"kind = {PLACE}").select(F.col("x1").alias("doc_id"), F.col("x2").cast("int").alias("line"), F.col("x3").alias("ref"), F.col("x4").cast("int").alias("tail"))
    classes = stage_table(
        lines.groupBy("ref", "tail").agg(F.min(F.struct("doc_id", "line")).alias("first"), F.count("*").alias("n_rows"))
        .select("ref", "tail", F.col("first.doc_id").alias("first_doc_id"), F.col("first.line").alias("first_line"), "n_rows")
    )
    links = stage_table(
        _verified(mixed, classes, given, levels, slots, t, limits).groupBy("ref", "tail")
        .agg(F.sum("n_links").alias("n_links"), F.min(F.struct("doc_id", "line")).alias("partner"))
    )
    info = stage_table(
        classes.join(links, ["ref", "tail"], "left").where("n_rows > 1 or n_links is not null")
        .select("ref", F.col("tail").alias("own_tail"), "first_doc_id", "first_line", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.expr("coalesce(partner < struct(first_doc_id as doc_id, first_line as line), false)").alias("later"), "n_rows")
    )
    drop_stage(classes)
    drop_stage(links)
    return join_hot(lines, info, "ref").where("tail = own_tail").select(
        "doc_id", "line", "first_doc_id", "first_line", "n_links", F.expr("later or doc_id <> first_doc_id or line <> first_line").alias("removed")
    ).distinct()


def _verified(mixed: DataFrame, classes: DataFrame, texts: DataFrame, levels, slots: int, t: float, limits: Limits) -> DataFrame:
    """Links of classes by their whole sets, each pair once: by the rarest word it shares.

    A pair is verified in the group of the smallest class that its first end was found
    with, and a dense word's group in that of its smallest class, with the other words
    of which that is so: a set goes to few groups, whatever the number of its pairs and words.
    """
    kind = lambda k, *names: mixed.where(f"kind = {k}").select(*(F.col(f"x{i}").alias(c) for i, c in enumerate(names, 1)))
    close = f"l.hi >= {t} * r.lo - 1e-9"
    heads = lambda rows: rows.groupBy("word", "block").agg(F.min("size").alias("lo"), F.max("size").alias("hi"))
    postings = stage_table(kind(POSTING, "word", "ref", "parity", "rest", "size", "place").distinct())
    drop_stage(mixed, f"kind={POSTING}")
    placed = stage_table(blocks_by_size(postings, "word", "ref", F.lit(1), limits.postings))
    drop_stage(postings)
    hot = attend(placed, meetings(heads(placed), "word", close), "word").groupBy("word", "own", "other").agg(F.collect_list(F.struct("block", "ref", "parity", "rest", "size", "place")).alias("rows"))
    found = hot.mapInArrow(_hot_members(t), "word long, ref long, size long")
    weight = F.greatest(8 * F.col("size"), F.lit(limits.set_bytes // limits.sets))
    members = stage_table(kind(DENSE, "word", "ref", "size").unionByName(found).distinct())
    drop_stage(mixed, f"kind={DENSE}")
    drop_stage(placed)
    smallest = stage_table(members.groupBy("word").agg(F.min("ref").alias("least"), F.count("*").alias("n_rows")))
    grouped = stage_table(join_hot(members, smallest, "word").groupBy(F.col("least").alias("word"), "ref", "size").agg(F.collect_list("word").alias("by")))
    drop_stage(members)
    dense = stage_table(blocks_by_size(grouped, "word", "ref", weight, limits.set_bytes))
    drop_stage(grouped)
    dense_meetings = meetings(heads(dense), "word", close)

    pairs = stage_table(kind(PAIR, "word", "a", "b", "size_a", "size_b").groupBy("a", "b", "size_a", "size_b").agg(F.collect_set("word").alias("words")))
    drop_stage(mixed, f"kind={PAIR}")
    least_of = pairs.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("least"))
    keyed = stage_table(pairs.join(least_of, "a", "left").withColumn("word", F.coalesce("least", "a")).drop("least"))
    drop_stage(pairs)
    ends = keyed.select("word", F.explode(F.array(F.struct(F.col("a").alias("ref"), F.col("size_a").alias("size")), F.struct(F.col("b").alias("ref"), F.col("size_b").alias("size")))).alias("end")).select("word", "end.*").distinct()
    spread = stage_table(ends.groupBy("word").agg(F.ceil(F.sum(weight) / limits.set_bytes).cast("long").alias("n")))
    block = lambda c: F.pmod(F.xxhash64(c), "n")
    listed = stage_table(
        keyed.join(spread, "word").withColumns({"x": block("a"), "y": block("b")})
        .groupBy("word", F.least("x", "y").alias("own"), F.greatest("x", "y").alias("other")).agg(F.collect_list(F.struct("a", "b", "words")).alias("pairs"))
    )
    end_rows = ends.join(spread, "word").select("word", "ref", block("ref").alias("block"), F.array().cast("array<long>").alias("by"))

    at = lambda rows, of, flag: attend(rows, of, "word").select("ref", F.struct(F.lit(flag).alias("dense"), "word", "own", "other", "block", "by").alias("at"))
    members = at(end_rows, listed, False).unionByName(at(dense, dense_meetings, True))
    by_ref = stage_table(members.groupBy("ref").agg(F.collect_list("at").alias("meetings")))
    few = (by_ref.agg(F.sum(F.size("meetings") + F.aggregate("meetings", F.lit(0), lambda n, m: n + F.size(m["by"])))).first()[0] or 0) <= MOST_BROADCAST
    places = classes.join(by_ref, "ref").select("ref", "tail", F.col("first_doc_id").alias("doc_id"), F.col("first_line").alias("line"), "meetings")
    if few:
        wanted = places.groupBy("doc_id").agg(F.collect_list(F.struct("line", "ref", "tail", "meetings")).alias("lines"))
        rows = texts.join(F.broadcast(wanted), "doc_id").select("doc_id", "text", "lines").mapInArrow(_sets(levels), _ATTENDS_SCHEMA)
    else:  # texts stay where they are: only the sets of wanted lines, and the few others that pass a filter, are shuffled
        places = stage_table(places)
        marks = texts.sparkSession.sparkContext.broadcast(_wanted_filter(places))
        sets = texts.mapInArrow(_passing_sets(levels, marks), "ref long, tail int, doc_id long, line int, words binary")
        rows = sets.join(places, ["ref", "tail", "doc_id", "line"]).select("ref", "tail", "doc_id", "line", "words", F.inline("meetings"))
    # Sets and pairs go to their meeting in one shuffle: joining the pairs to the gathered sets would shuffle those again.
    row = F.struct("block", "by", "ref", "tail", "doc_id", "line", "words").alias("row")
    both = rows.select(*_MEETING, row).unionByName(listed.withColumn("dense", F.lit(False)), allowMissingColumns=True)
    return (
        both.groupBy(*_MEETING).agg(F.collect_list("row").alias("rows"), F.first("pairs", ignorenulls=True).alias("pairs"))
        .select("own", "other", "rows", "pairs").mapInArrow(_verify(slots, t), _LINKS)
    )


def _without_lines(names: list[str]):
    """Texts, in a column ``text``, without the lines whose numbers the last column lists, and their ``n_chars``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(names, batch.columns, strict=False))
            texts, gone = columns["text"].to_pylist(), batch.columns[-1].to_pylist()
            keep = np.ones(len(texts), bool)
            for i, lines in enumerate(gone):
                if lines is not None:
                    out = set(lines)
                    texts[i] = "\n".join(x for k, x in enumerate((texts[i] or "").split("\n")) if k not in out)
                    keep[i] = bool(texts[i].strip(" \t\n\x0b\f\r"))
            columns["text"] = pa.array(texts, columns["text"].type)
            if "n_chars" in columns:
                before = columns["n_chars"].to_pylist()
                columns["n_chars"] = pa.array([n if lines is None else len(x) for n, x, lines in zip(before, texts, gone, strict=True)], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names).filter(pa.array(keep))

    return run


def dedup_lines(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` without the removed lines of ``found``: new ``text`` and, where lines went, ``n_chars``; all other columns and rows as they were.

    A document loses its row only if it had lines and all that hold more than white space are removed.
    """
    key = next(name for k in range(len(docs.columns) + 1) if (name := f"gone{k}") not in docs.columns)
    gone = found.where("removed").groupBy("doc_id").agg(F.collect_set("line").alias(key))
    return docs.join(gone, "doc_id", "left").select(*docs.columns, key).mapInArrow(_without_lines(docs.columns), docs.schema)


def op4_line_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` with its removed lines, links and the first document it repeats.

    class_id is the smallest doc_id that first has one of its lines' classes, its own
    if it shares none; matches lists its lines that have an equal or a similar one.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = similar_lines(docs).groupBy("doc_id").agg(
        F.count_if("removed").alias("n_removed"), F.sum("n_links").alias("n_links"), F.min("first_doc_id").alias("class_id"),
        F.array_sort(F.collect_list(F.struct("line", "first_doc_id", "first_line", "n_links", "removed"))).alias("matches"),
    )
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long")
    return docs.select("doc_id", lines.alias("n_lines")).join(found, "doc_id", "left").select(
        "doc_id", "n_lines", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.least(F.coalesce("class_id", "doc_id"), "doc_id").alias("class_id"),
        F.transform(F.coalesce("matches", F.array().cast("array<struct<line:int,first_doc_id:bigint,first_line:int,n_links:bigint,removed:boolean>>")), lambda m: F.concat_ws(":", m["line"], m["first_doc_id"], m["first_line"], m["n_links"], m["removed"].cast("int"))).alias("matches"),
    )
