"""A minimal acyclic transducer from words to token ids, in one flat file.

States with equal futures are one state, so common suffixes are stored once.
Every arc carries how many words of the automaton come before those below it;
the sum along a word's path is the word's number, and the number finds the
word's ids. The file is read by memory map. Lookups walk many words at once.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Sequence

import numpy as np

_MAGIC = b"PMLX0001"


def build(entries: Iterable[tuple[bytes, Sequence[int]]]) -> bytes:
    """The file for words with their ids. Words are distinct; any order.

    Incremental construction from sorted words: when a word leaves a branch,
    the states behind are complete and are replaced by an equal state that is
    registered already, or are registered themselves.
    """
    items = sorted(entries)
    arcs: list[dict[int, int] | None] = [{}]
    final: list[bool] = [False]
    register: dict[tuple, int] = {}
    path: list[tuple[int, int]] = []  # (state, label) down the last word

    def settle(depth: int) -> None:
        while len(path) > depth:
            state, label = path.pop()
            child = arcs[state][label]
            key = (final[child], tuple(arcs[child].items()))
            known = register.setdefault(key, child)
            arcs[state][label] = known
            if known != child:
                arcs[child] = None  # an equal state stands for it

    last = b""
    for word, _ in items:
        same = 0
        while same < min(len(last), len(word)) and last[same] == word[same]:
            same += 1
        settle(same)
        state = arcs[path[-1][0]][path[-1][1]] if path else 0
        for b in word[same:]:
            arcs.append({})
            final.append(False)
            arcs[state][b] = len(arcs) - 1
            path.append((state, b))
            state = len(arcs) - 1
        final[state] = True
        last = word
    settle(0)

    number, below, stack = {}, {}, [(0, False)]
    while stack:  # children first; how many words each state leads to
        state, done = stack.pop()
        if done:
            below[state] = int(final[state]) + sum(below[c] for c in arcs[state].values())
        elif state not in number:
            number[state] = len(number)
            stack.append((state, True))
            stack += [(c, False) for c in arcs[state].values()]
    keys, to, add = [], [], []
    for state in number:
        before = int(final[state])
        for label, child in arcs[state].items():
            keys.append(number[state] << 8 | label)
            to.append(number[child])
            add.append(before)
            before += below[child]
    order = np.argsort(np.array(keys, np.int64), kind="stable")
    end = np.zeros(len(number), np.uint8)
    end[[number[s] for s in number if final[s]]] = 1
    at = np.cumsum([0, *(len(ids) for _, ids in items)])
    parts = [
        np.array(keys, np.int64)[order],
        np.array(to, np.uint32)[order],
        np.array(add, np.uint32)[order],
        end,
        at.astype(np.uint32),
        np.array([x for _, ids in items for x in ids], np.uint32),
    ]
    raw = [p.tobytes() for p in parts]
    head = _MAGIC + struct.pack("<6Q", *(len(p) for p in parts))
    return head + b"".join(x + b"\0" * (-len(x) % 8) for x in raw)


class Lexicon:
    """A lexicon file, opened by memory map or from bytes."""

    def __init__(self, where: str | bytes):
        whole = np.frombuffer(where, np.uint8) if isinstance(where, bytes) else np.memmap(where, np.uint8, "r")
        if whole[:8].tobytes() != _MAGIC:
            raise ValueError("not a lexicon file")
        sizes, place, parts = struct.unpack("<6Q", whole[8:56].tobytes()), 56, []
        for n, kind in zip(sizes, (np.int64, np.uint32, np.uint32, np.uint8, np.uint32, np.uint32), strict=True):
            size = n * np.dtype(kind).itemsize
            parts.append(whole[place : place + size].view(kind))
            place += size + -size % 8
        self.keys, self.to, self.add, self.end, self.at, self.ids = parts

    def __len__(self) -> int:
        return len(self.at) - 1

    @property
    def n_states(self) -> int:
        return len(self.end)

    def numbers(self, words: Sequence[bytes]) -> np.ndarray:
        """The number of each word, -1 for those that aren't in the lexicon."""
        n = len(words)
        length = np.fromiter(map(len, words), np.int64, n)
        begin = np.cumsum(length) - length
        data = np.frombuffer(b"".join(words), np.uint8)
        state, value = np.zeros(n, np.int64), np.zeros(n, np.int64)
        live = np.arange(n)
        found = np.full(n, -1, np.int64)
        step = 0
        while len(live):
            done = length[live] == step
            ends = live[done]
            ends = ends[self.end[state[ends]] == 1]
            found[ends] = value[ends]
            live = live[~done]
            if not len(live) or not len(self.keys):
                break
            key = state[live] << 8 | data[begin[live] + step]
            i = np.searchsorted(self.keys, key)
            ok = i < len(self.keys)
            ok[ok] = self.keys[i[ok]] == key[ok]
            live, i = live[ok], i[ok]
            state[live] = self.to[i]
            value[live] += self.add[i]
            step += 1
        return found

    def lookup(self, words: Sequence[bytes]) -> list[bytes | None]:
        """The ids of each word as little-endian 32-bit values, or None."""
        return [None if k < 0 else self.ids[self.at[k] : self.at[k + 1]].tobytes() for k in self.numbers(words)]
