"""Wavelet matrix: token ids as bit-planes with rank and select.

Plane 0 holds the highest bit of every id in order; each next plane holds the
next bit, with the ids that had a 0 moved, in order, before those that had a 1.
Any id is read, counted up to a place, or found by its occurrence number without
decoding the rest: the file holds each plane in pieces that are compressed
apart, and a directory with the ones before each piece and, inside it, before
each block of 512 bits. A look-up opens one piece of each plane at most for each
place that it asks for; pieces that were opened last are kept.

File: magic, length of the head, head (JSON), directory (for all planes: ends of
the pieces, ones before the pieces, ones before the blocks within their piece),
pieces of the planes, arrays that go along.
"""

from __future__ import annotations

import json
import struct
from collections import OrderedDict

import numpy as np
import zstandard

_MAGIC = b"PMWM0002"
_BLOCK = 512
_PIECE = 1 << 18  # bits


def build(ids: np.ndarray, n_bits: int, extra: dict[str, np.ndarray] | None = None) -> bytes:
    """The file of one shard. ``extra`` holds arrays that go along, by name."""
    squeeze = zstandard.ZstdCompressor(level=1)
    current = np.ascontiguousarray(ids, np.uint16 if n_bits <= 16 else np.uint32)
    n_pieces = -(-len(ids) // _PIECE)
    pieces, ends, before, inside, zeros = [], [], [], [], []
    at = 0
    for level in range(n_bits):
        bit = (current & current.dtype.type(1 << (n_bits - 1 - level))) != 0
        plane = np.zeros(n_pieces * _PIECE // 8, np.uint8)
        packed = np.packbits(bit, bitorder="little")
        plane[: len(packed)] = packed
        ones = np.bitwise_count(plane.view(np.uint64)).reshape(n_pieces, _PIECE // _BLOCK, _BLOCK // 64).sum(2, dtype=np.int64)
        inside.append((np.cumsum(ones, 1) - ones).astype("<u4"))
        whole = ones.sum(1)
        before.append((np.cumsum(whole) - whole).astype("<u8"))
        for k in range(n_pieces):
            pieces.append(squeeze.compress(packed[k * _PIECE // 8 : (k + 1) * _PIECE // 8].tobytes()))
            at += len(pieces[-1])
            ends.append(at)
        low = current[np.flatnonzero(~bit)]
        zeros.append(len(low))
        current = np.concatenate([low, current[np.flatnonzero(bit)]])
    more = {k: squeeze.compress(np.ascontiguousarray(v).tobytes()) for k, v in (extra or {}).items()}
    head = {"n": len(ids), "n_bits": n_bits, "zeros": zeros, "pieces": n_pieces, "extra": {k: [str(extra[k].dtype), len(v)] for k, v in more.items()}}
    text = json.dumps(head).encode()
    directory = np.array(ends, "<u8").tobytes() + b"".join(x.tobytes() for x in before) + b"".join(x.tobytes() for x in inside)
    return _MAGIC + struct.pack("<Q", len(text)) + text + directory + b"".join(pieces) + b"".join(more.values())


class WaveletMatrix:
    """A shard's file: bytes, or a memory map of them.

    Places count from 0; ranks count occurrences before a place. ``opened``
    tells how many pieces have been decompressed, ``keep`` how many are kept.
    """

    def __init__(self, content: bytes | memoryview, keep: int = 64):
        self.content = memoryview(content)
        if bytes(self.content[:8]) != _MAGIC:
            raise ValueError("not a wavelet matrix file")
        (size,) = struct.unpack_from("<Q", self.content, 8)
        head = json.loads(bytes(self.content[16 : 16 + size]))
        self.n, self.n_bits, self.zeros, p = head["n"], head["n_bits"], head["zeros"], head["pieces"]
        at = 16 + size

        def table(kind: str, shape: tuple) -> np.ndarray:
            nonlocal at
            n = int(np.prod(shape))
            out = np.frombuffer(self.content[at : at + n * np.dtype(kind).itemsize], kind).reshape(shape)
            at += out.nbytes
            return out

        ends = table("<u8", (self.n_bits * p,)).astype(np.int64)
        self.before = table("<u8", (self.n_bits, p))
        self.inside = table("<u4", (self.n_bits, p, _PIECE // _BLOCK))
        self._from = at + np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        self._to = at + ends
        at += int(ends[-1]) if len(ends) else 0
        self._extra = {}
        for name, (kind, length) in head["extra"].items():
            self._extra[name] = (kind, at, at + length)
            at += length
        self.n_pieces, self.keep, self.opened = p, keep, 0
        self._held: OrderedDict[int, np.ndarray] = OrderedDict()
        self._open = zstandard.ZstdDecompressor()

    def extra(self, name: str) -> np.ndarray:
        """An array that goes along."""
        kind, i, j = self._extra[name]
        return np.frombuffer(self._open.decompress(self.content[i:j]), kind)

    def _piece(self, level: int, k: int) -> np.ndarray:
        key = level * self.n_pieces + k
        if key in self._held:
            self._held.move_to_end(key)
            return self._held[key]
        raw = self._open.decompress(self.content[int(self._from[key]) : int(self._to[key])])
        out = np.zeros(_PIECE // 8, np.uint8)
        out[: len(raw)] = np.frombuffer(raw, np.uint8)
        self.opened += 1
        self._held[key] = out
        if len(self._held) > self.keep:
            self._held.popitem(last=False)
        return out

    def _ones(self, level: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ones of a plane before each place, and the bits there (0 at the end)."""
        at = np.asarray(at, np.int64)
        out, bits = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        if not self.n_pieces:
            return out, bits
        out[at >= self.n] = self.n - self.zeros[level]
        within = at < self.n
        for k in np.unique(at[within] // _PIECE):
            here = np.flatnonzero(within & (at // _PIECE == k))
            place = at[here] - k * _PIECE
            block = place // _BLOCK
            words = self._piece(level, int(k)).view("<u8").reshape(-1, _BLOCK // 64)[block]
            left = np.clip((place % _BLOCK)[:, None] - 64 * np.arange(_BLOCK // 64)[None, :], 0, 64)
            mask = np.where(left == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(left, 63).astype(np.uint64)) - np.uint64(1))
            out[here] = self.before[level, k].astype(np.int64) + self.inside[level, k, block] + np.bitwise_count(words & mask).sum(1, dtype=np.int64)
            word = words[np.arange(len(here)), place % _BLOCK // 64]
            bits[here] = (word >> (place % 64).astype(np.uint64) & np.uint64(1)).astype(np.int64)
        return out, bits

    def access(self, places: np.ndarray) -> np.ndarray:
        """The ids at some places."""
        at = np.asarray(places, np.int64)
        out = np.zeros(len(at), np.uint32)
        for level in range(self.n_bits):
            ones, bit = self._ones(level, at)
            out = out << np.uint32(1) | bit.astype(np.uint32)
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return out

    def _range(self, token: int, end: int) -> tuple[int, int]:
        begin = 0
        for level in range(self.n_bits):
            ones, _ = self._ones(level, np.array([begin, end]))
            if token >> (self.n_bits - 1 - level) & 1:
                begin, end = self.zeros[level] + int(ones[0]), self.zeros[level] + int(ones[1])
            else:
                begin, end = begin - int(ones[0]), end - int(ones[1])
        return begin, end

    def rank(self, token: int, place: int) -> int:
        """Occurrences of a token before a place."""
        if token >> self.n_bits:
            return 0
        begin, end = self._range(token, min(place, self.n))
        return end - begin

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _bit_place(self, level: int, want: int, one: int) -> int:
        """The place in a plane of its bit number ``want`` that is ``one``.

        The directory tells the piece and the block; one piece is opened.
        """
        start = np.arange(self.n_pieces, dtype=np.int64) * _PIECE
        before = self.before[level].astype(np.int64)
        k = int(np.searchsorted(before if one else start - before, want, "right")) - 1
        want -= int(before[k] if one else start[k] - before[k])
        start = np.arange(_PIECE // _BLOCK, dtype=np.int64) * _BLOCK
        inside = self.inside[level, k].astype(np.int64)
        block = int(np.searchsorted(inside if one else start - inside, want, "right")) - 1
        want -= int(inside[block] if one else start[block] - inside[block])
        held = self._piece(level, k)[block * _BLOCK // 8 : (block + 1) * _BLOCK // 8]
        bit = np.unpackbits(held, bitorder="little")
        return k * _PIECE + block * _BLOCK + int(np.flatnonzero(bit == one)[want])

    def select(self, token: int, k: int) -> int:
        """The place of the occurrence number ``k``, from 0; -1 if there are fewer."""
        if token >> self.n_bits or k < 0:
            return -1
        begin, end = self._range(token, self.n)
        if k >= end - begin:
            return -1
        at = begin + k
        for level in reversed(range(self.n_bits)):
            one = token >> (self.n_bits - 1 - level) & 1
            at = self._bit_place(level, at - self.zeros[level] if one else at, one)
        return at

    def decode(self) -> np.ndarray:
        """All ids in order, from the lowest plane up."""
        out = np.zeros(self.n, np.uint16 if self.n_bits <= 16 else np.uint32)
        for level in reversed(range(self.n_bits)):
            first = level * self.n_pieces
            raw = b"".join(self._open.decompress(self.content[int(i) : int(j)]) for i, j in zip(self._from[first : first + self.n_pieces], self._to[first : first + self.n_pieces], strict=True))
            bit = np.unpackbits(np.frombuffer(raw, np.uint8), count=self.n, bitorder="little").view(bool)
            up = np.empty_like(out)
            z = self.zeros[level]
            up[np.flatnonzero(~bit)] = out[:z]
            up[np.flatnonzero(bit)] = out[z:] | out.dtype.type(1 << (self.n_bits - 1 - level))
            out = up
        return out
