"""Words, lines and n-grams of whole Arrow batches as 64-bit hashes.

All texts of a slice are handled together by numpy, without a Python step for
each word. A word is a run of bytes other than space and U+0009 to U+000D; in
UTF-8 that is the pattern ``[^\\x20\\x09-\\x0D]+``. Hashes are the same on every
machine. A run of bytes is hashed by tabulation: every byte and place in a piece
of 32 bytes has a random 64-bit value, these are added, and the mixed sums of
the pieces are added again. Unlike a polynomial, whose terms are powers of one
base, that has no texts of regular shape which collide for every table. Two
different runs have one hash with a chance of about 2**-64; where an answer
rests on equal runs within a text, :func:`same_runs` compares their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .store import worker_cache

SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on an array that may be overwritten."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def constants(seed: int, n: int) -> np.ndarray:
    """``n`` odd 64-bit values that depend on ``seed`` only."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * _BASE + np.uint64(seed)) | np.uint64(1)


_PIECE = 32


def _table(lower: bool) -> np.ndarray:
    """A value for each place in a piece and byte; ``lower`` folds A-Z."""

    def build() -> np.ndarray:
        table = constants(7, _PIECE * 256).reshape(_PIECE, 256)
        if lower:
            table = table.copy()
            table[:, 65:91] = table[:, 97:123]
        return np.ascontiguousarray(table).reshape(-1)

    return worker_cache(("bytes", lower), build)


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """Hashes of runs of bytes, none of them empty."""
    if not len(start):
        return np.empty(0, np.uint64)
    size = end - start
    pieces = (size + (_PIECE - 1)) // _PIECE
    last = np.cumsum(pieces)
    number = np.arange(last[-1]) - np.repeat(last - pieces, pieces)
    at = np.repeat(start, pieces) + _PIECE * number
    held = np.minimum(np.repeat(end, pieces) - at, _PIECE)
    stop = np.cumsum(held)
    place = np.arange(stop[-1]) - np.repeat(stop - held, held)
    byte = data[place + np.repeat(at, held)]
    place <<= 8
    place |= byte
    h = np.add.reduceat(_table(lower)[place], stop - held)
    h = mix(h + number.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    h = np.add.reduceat(h, last - pieces)
    return mix(h + size.astype(np.uint64) * _BASE)


def same_runs(data: np.ndarray, start: np.ndarray, end: np.ndarray, start2: np.ndarray, end2: np.ndarray) -> np.ndarray:
    """For pairs of runs whether they have the same bytes."""
    size = end - start
    same = size == end2 - start2
    at = np.flatnonzero(same & (size > 0) & (start != start2))
    n = size[at]
    if len(at):
        stop = np.cumsum(n)
        place = np.arange(stop[-1]) - np.repeat(stop - n, n)
        differ = data[place + np.repeat(start[at], n)] != data[place + np.repeat(start2[at], n)]
        same[at] = ~np.logical_or.reduceat(differ, stop - n)
    return same


@dataclass
class Texts:
    """The bytes of some texts, end to end, and where each text begins."""

    data: np.ndarray
    at: np.ndarray

    @property
    def n(self) -> int:
        return len(self.at) - 1


@dataclass
class Words:
    """Words in order: the text they are in, where they begin and end, hashes."""

    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """Rows ``[i, j)`` and their texts, ``most`` bytes or one text at a time.

    Nulls are empty texts.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, where, held = column.buffers()
    n = len(column)
    if not n:
        return
    at = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(held, np.uint8) if held is not None else np.empty(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, Texts(data[at[i] : at[j]], at[i : j + 1] - at[i])
        i = j


def white(data: np.ndarray) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[32, *range(9, 14)]] = True
    return table[data]


def words(texts: Texts, lower: bool = False) -> Words:
    """All words of the slice; ``lower`` folds A-Z before hashing."""
    ink = ~white(texts.data)
    n = len(ink)
    if not n:
        none = np.empty(0, np.int64)
        return Words(none, none, none, np.empty(0, np.uint64))
    edge = texts.at[:-1][texts.at[:-1] < n]
    begins = ink.copy()
    begins[1:] &= ~ink[:-1]
    begins[edge] = ink[edge]
    ends = ink.copy()
    ends[:-1] &= ~ink[1:]
    stop = texts.at[1:][texts.at[1:] > 0] - 1
    ends[stop] = ink[stop]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc = np.searchsorted(texts.at, start, "right") - 1
    return Words(doc, start, end, run_hashes(texts.data, start, end, lower))


def windows(w: Words, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """First word's place and hash of each run of ``k`` words within a text."""
    n = len(w.doc) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    c = constants(seed * 1000 + k, k)
    h = mix(w.hash[:n] + c[0])
    for i in range(1, k):
        h += mix(w.hash[i : i + n] + c[i])
    at = np.flatnonzero(w.doc[:n] == w.doc[k - 1 :])
    return at, mix(h[at])


def counts(doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, minlength=n).astype(np.int64)


def within(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


def salted(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that differ from text to text."""
    return mix(hashes ^ mix((doc.astype(np.uint64) + np.uint64(1)) * _BASE))


def shingles(texts: Texts, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every run of ``k`` lower-cased words, repeats included.

    A text of one to ``k - 1`` words gives its whole sequence as one shingle;
    a text without words gives none.
    """
    w = words(texts, lower=True)
    at, h = windows(w, k)
    doc = w.doc[at]
    n = counts(w.doc, texts.n)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        first = np.searchsorted(w.doc, short)
        extra = []
        for d, i in zip(short, first, strict=True):
            m = int(n[d])
            c = constants(1000 + k + 50 * m, m)
            extra.append(mix(w.hash[i : i + m] + c).sum(dtype=np.uint64))
        doc = np.concatenate([doc, short])
        h = np.concatenate([h, mix(np.array(extra, np.uint64))])
    return doc, h


def characters(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the slice, and where each text begins among them."""
    points = np.frombuffer(texts.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    sums = np.zeros(len(texts.data) + 1, np.int64)
    np.cumsum((texts.data & 0xC0) != 0x80, out=sums[1:])
    return points, sums[texts.at]


def buckets(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def features(texts: Texts, bits: int, chars: tuple[int, ...] = (2, 4)) -> list[tuple[np.ndarray, np.ndarray]]:
    """Families of hashed n-grams as (text, bucket): words, then characters.

    The word family holds words, pairs of words and a mark for a word that
    repeats the one before it; each order of characters is a family.
    """
    w = words(texts)
    at, pair = windows(w, 2, seed=3)
    same = at[w.hash[at] == w.hash[at + 1]]
    mark = np.full(len(same), np.uint64(0x5EED) << np.uint64(48))
    doc = np.concatenate([w.doc, w.doc[at], w.doc[same]])
    out = [(doc, buckets(np.concatenate([mix(w.hash + np.uint64(1)), pair, mark]), bits))]
    points, begin = characters(texts)
    owner = np.repeat(np.arange(texts.n), np.diff(begin))
    wide = points.astype(np.uint64)
    for k in chars:
        n = len(points) - k + 1
        if n <= 0:
            out.append((np.empty(0, np.int64), np.empty(0, np.int64)))
            continue
        c = constants(5000 + k, k)
        h = wide[:n] * c[0]
        for i in range(1, k):
            h += wide[i : i + n] * c[i]
        here = owner[:n] == owner[k - 1 :]
        out.append((owner[:n][here], buckets(mix(h)[here], bits)))
    return out
