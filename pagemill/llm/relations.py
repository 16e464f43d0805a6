"""Set relations: lists that are skipped by blocks, answers got from other answers.

Pure functions over numpy arrays, used by :mod:`pagemill.llm.jaccard`.

An entry of an index list stands for a set X and for those that are highly
similar to it, its followers. ``lo`` and ``hi`` are the sizes of the smallest
and the largest of them, ``slack`` is the most shingles that one of them has and
X has not, and ``left`` is how many shingles of X stand at or behind the place
of the token in the global order. If members Y of X and Z of X' link, then

    |X & X'| >= |Y & Z| - slack - slack' >= need(lo + lo') - slack - slack'

and the first token that X and X' have in common leaves at least as many in
both, so both have it in the part that is indexed, with ``left`` as large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Lists up to this length are compared without blocks.
SHORT = 16
_GRID = 1 << 21


def need(total: np.ndarray, percent: int) -> np.ndarray:
    """Shingles in common of two linked sets whose sizes add up to ``total``."""
    return -(-total * percent // (100 + percent))


def common(small: np.ndarray, large: np.ndarray) -> int:
    """How many values two sorted arrays have in common."""
    if len(small) > len(large):
        small, large = large, small
    if not len(small):
        return 0
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    return int((large[at] == small).sum())


def linked(both: int, a: int, b: int, percent: int) -> bool:
    return both > 0 and 100 * both >= percent * (a + b - both)


def _fit(lo, hi, slack, left, component, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    fits = np.minimum(left[x], left[y]) >= need(lo[x] + lo[y], percent) - slack[x] - slack[y]
    fits &= (100 * hi[x] >= percent * lo[y]) & (100 * hi[y] >= percent * lo[x])
    return fits & (component[x] != component[y])


def block_pairs(lo: np.ndarray, hi: np.ndarray, slack: np.ndarray, left: np.ndarray, component: np.ndarray, percent: int, side: np.ndarray | None = None, seen: dict | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of entries of one list that can belong to linked sets.

    Entries of equal size and position are a block, with one header. Blocks are
    in the order of size, so that all behind a size that is too large are
    skipped at once; others are skipped by their positions, or where both hold
    one component only. No entry of a skipped block is looked at. With ``side``
    only pairs of different sides are made. ``seen`` counts blocks.
    """
    order = np.lexsort((left, lo))
    s_lo, s_left = lo[order], left[order]
    first = np.flatnonzero(np.concatenate([[True], (s_lo[1:] != s_lo[:-1]) | (s_left[1:] != s_left[:-1])]))
    size = np.diff(np.append(first, len(order)))
    b_lo, b_left = s_lo[first], s_left[first]
    b_hi = np.maximum.reduceat(hi[order], first)
    b_slack = np.maximum.reduceat(slack[order], first)
    c_low, c_high = np.minimum.reduceat(component[order], first), np.maximum.reduceat(component[order], first)
    single = c_low == c_high
    n = len(first)
    one, two = [], []
    for i in range(n):
        end = int(np.searchsorted(b_lo, 100 * b_hi[i] // percent, "right"))
        j = np.arange(i, max(i, end))
        ok = np.minimum(b_left[i], b_left[j]) >= need(b_lo[i] + b_lo[j], percent) - b_slack[i] - b_slack[j]
        ok &= ~(single[i] & single[j] & (c_low[i] == c_low[j]))
        j = j[ok]
        one.append(np.full(len(j), i))
        two.append(j)
    one, two = np.concatenate(one), np.concatenate(two)
    if seen is not None:
        seen["blocks"] = seen.get("blocks", 0) + n * (n + 1) // 2
        seen["visited"] = seen.get("visited", 0) + len(one)
    grid = size[one] * size[two]
    at = 0
    while at < len(one):
        # some pairs of blocks together, or one whose grid is large in parts
        upto = max(at + 1, int(np.searchsorted(np.cumsum(grid[at:]), _GRID, "right")) + at)
        a, b, g = one[at:upto], two[at:upto], grid[at:upto]
        at = upto
        for begin in range(0, int(g.sum()), _GRID):
            stop = np.cumsum(g)
            cell = np.arange(begin, min(begin + _GRID, int(stop[-1])))
            pair = np.searchsorted(stop, cell, "right")
            cell = cell - (stop - g)[pair]
            x = order[first[a[pair]] + cell // size[b[pair]]]
            y = order[first[b[pair]] + cell % size[b[pair]]]
            keep = (a[pair] != b[pair]) | (cell // size[b[pair]] < cell % size[b[pair]])
            if side is not None:
                keep &= side[x] != side[y]
            x, y = x[keep], y[keep]
            keep = _fit(lo, hi, slack, left, component, x, y, percent)
            if keep.any():
                yield x[keep], y[keep]


def short_pairs(start: np.ndarray, length: np.ndarray, lo, hi, slack, left, component, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for many short lists at once, given where each begins."""
    xs, ys = [], []
    for d in range(1, int(length.max(initial=0))):
        some = length > d
        if not some.any():
            break
        n = length[some] - d
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[some], n)
        keep = _fit(lo, hi, slack, left, component, at, at + d, percent)
        xs.append(at[keep])
        ys.append(at[keep] + d)
    none = np.empty(0, np.int64)
    return (np.concatenate(xs), np.concatenate(ys)) if xs else (none, none)


class Group:
    """A set and its followers, each as (minus, plus): what it lacks and adds."""

    def __init__(self, host: np.ndarray, followers: list[tuple[np.ndarray, np.ndarray]]):
        none = np.empty(0, np.uint64)
        self.host = host
        self.members = [(none, none), *followers]
        self.minus = np.array([len(m) for m, _ in self.members])
        self.plus = np.array([len(p) for _, p in self.members])
        self.n = len(host) - self.minus + self.plus

    def shared(self, k: int, s: np.ndarray) -> int:
        """What member ``k`` has in common with a set, from the host's answer and the difference."""
        minus, plus = self.members[k]
        return common(s, self.host) - common(s, minus) + common(s, plus)


def groups_link(a: Group, b: Group, percent: int, seen: dict | None = None) -> bool:
    """Whether any member of one group links with any of the other.

    Only the hosts are compared. The answer of a member is the hosts' overlap,
    repaired with the differences of the member and its host; most members are
    out by the sizes of these alone.
    """
    both = common(a.host, b.host)
    if seen is not None:
        seen["compared"] = seen.get("compared", 0) + 1
    if linked(both, len(a.host), len(b.host), percent):
        return True
    bound = both + a.plus[:, None] + b.plus[None, :]
    maybe = bound >= need(a.n[:, None] + b.n[None, :], percent)
    maybe[0, 0] = False
    for i in np.flatnonzero(maybe.any(1)):
        minus, plus = a.members[i]
        # member i against the other host
        base = both - common(minus, b.host) + common(plus, b.host)
        for j in np.flatnonzero(maybe[i]):
            if seen is not None:
                seen["derived"] = seen.get("derived", 0) + 1
            lacks, adds = b.members[j]
            if linked(base - a.shared(i, lacks) + a.shared(i, adds), int(a.n[i]), int(b.n[j]), percent):
                return True
    return False
