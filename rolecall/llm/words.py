"""Word and shingle hashes of whole Arrow batches, without a Python loop over words.

A word's 64-bit hash is a span of one polynomial prefix sum over the batch's
bytes, so it depends on the word's bytes alone, not on its place, batch or task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Also splits words at ASCII punctuation.
PUNCTUATION = _SPACE.copy()
PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
#: Bytes of text that are hashed at once: what this takes fits a core's cache, and a long text takes no more.
SEGMENT = 1 << 16
_powers = {b: np.ones(1, dtype=np.uint64) for b in (_BASE, _INVERSE)}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 to base ** (n - 1), modulo 2 ** 64."""
    have = _powers[base]
    if len(have) < n:
        steps = np.full(max(n, 2 * len(have)), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: list[bytes], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``most`` bytes each; a longer text stands alone."""
    start = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > most:
            yield start, i
            start, held = i, 0
        held += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _segments(buf: np.ndarray, between: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about ``SEGMENT`` bytes that don't cut words."""
    start = 0
    while start < len(buf):
        end = start + SEGMENT
        while end < len(buf) and not (gap := between[buf[end : end + SEGMENT]]).any():
            end += SEGMENT
        end = len(buf) if end >= len(buf) else end + int(gap.argmax())
        yield start, end
        start = end


def word_hashes(texts: list[bytes], between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte (in its text) of each word, and where each text's words begin.

    Words are runs without ASCII white space, or the bytes named by ``between``, with A-Z lower-cased.
    Beside 24 bytes a word of the result it takes about 40 bytes for each byte of a
    segment or of a longer word, and twice the texts.
    """
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    parts = []
    for a, b in _segments(buf, between):
        low = _LOWER[buf[a:b]]
        edge = np.flatnonzero(np.diff((~between[low]).astype(np.int8), prepend=0, append=0))
        start, end = edge[0::2], edge[1::2]
        prefix = np.zeros(len(low) + 1, dtype=np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(low)), out=prefix[1:])
        parts.append((mix((prefix[end] - prefix[start]) * _power(_INVERSE, len(low))[start]), start + a, end + a))
    hashes, start, end = (np.concatenate(x) for x in zip(*parts, strict=True))
    first = np.zeros(len(texts), dtype=np.int64)
    np.cumsum([len(t) + 1 for t in texts[:-1]], out=first[1:])
    at = np.append(np.searchsorted(start, first), len(start))
    shift = np.repeat(first, np.diff(at))
    return hashes, start - shift, end - shift, at


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of ``n`` words; with fewer words, of the whole sequence; none without words."""
    if not len(hashes):
        return hashes
    n_here = min(n, len(hashes))
    out = np.full(len(hashes) - n_here + 1, n_here, dtype=np.uint64)
    for k in range(n_here):
        out = mix(out * np.uint64(_BASE) + hashes[k : len(hashes) - n_here + 1 + k])
    return out


def shingle_sets(texts: list[bytes], n: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, sorted."""
    for a, b in chunks(texts):
        hashes, _, _, at = word_hashes(texts[a:b])
        for i in range(b - a):
            yield np.unique(shingles(hashes[at[i] : at[i + 1]], n))


def common_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 1 << 12) -> np.ndarray:
    """Sizes of the intersections of each set of hashes on the left with each on the right, by products of incidence matrices.

    The matrices are made for ``columns`` hashes at a time, so long sets take no more memory.
    """
    out = np.zeros((len(left), len(right)), np.float32)
    one, other = (np.concatenate([*side, np.zeros(0, np.uint64)]) for side in (left, right))
    shared = np.intersect1d(one, other)
    for k in range(0, len(shared), columns):
        part = shared[k : k + columns]
        incidence = []
        for side, flat in ((left, one), (right, other)):
            of = np.repeat(np.arange(len(side)), [len(s) for s in side])
            at = np.searchsorted(part, flat)
            hit = part[np.minimum(at, len(part) - 1)] == flat
            matrix = np.zeros((len(side), len(part)), np.float32)
            matrix[of[hit], at[hit]] = 1
            incidence.append(matrix)
        out += incidence[0] @ incidence[1].T
    return out.astype(np.int64)
