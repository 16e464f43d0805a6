from itertools import combinations

import numpy as np
import pytest

from pagemill.llm import relations as r


def entries(seed, n, percent=75):
    rng = np.random.default_rng(seed)
    lo = rng.integers(4, 400, n)
    slack = rng.integers(0, 2, n) * (lo // 20)
    hi = lo + rng.integers(0, 3, n) * slack
    left = np.maximum(1, (lo * rng.uniform(0.3, 1.0, n)).astype(int))
    return lo, hi, slack, left, rng.integers(0, max(2, n // 4), n)


def allowed(e, percent):
    lo, hi, slack, left, c = e
    out = set()
    for x, y in combinations(range(len(lo)), 2):
        least = r.need(lo[x] + lo[y], percent) - slack[x] - slack[y]
        if c[x] != c[y] and min(left[x], left[y]) >= least and 100 * hi[x] >= percent * lo[y] and 100 * hi[y] >= percent * lo[x]:
            out.add((x, y))
    return out


def as_set(pairs):
    return {(min(a, b), max(a, b)) for x, y in pairs for a, b in zip(x.tolist(), y.tolist(), strict=True)}


@pytest.mark.parametrize(("seed", "n"), [(1, 2), (2, 40), (3, 300), (4, 700)])
def test_blocks_lose_no_pair_and_are_skipped(seed, n, monkeypatch):
    e, seen = entries(seed, n), {}
    got = list(r.block_pairs(*e, 75, seen=seen))
    assert as_set(got) == allowed(e, 75)
    assert sum(len(x) for x, _ in got) == len(as_set(got))
    if n >= 40:
        assert seen["visited"] < 0.25 * seen["blocks"]
    monkeypatch.setattr(r, "_GRID", 7)
    assert as_set(r.block_pairs(*e, 75)) == allowed(e, 75)
    side = np.arange(n) % 2
    assert as_set(r.block_pairs(*e, 75, side)) == {(a, b) for a, b in allowed(e, 75) if a % 2 != b % 2}


def test_large_blocks_are_skipped_whole():
    # 2,000 entries in two blocks that cannot meet, and one block of one component
    lo = np.repeat([100, 200, 100], [1000, 1000, 500])
    left = np.repeat([90, 190, 91], [1000, 1000, 500])
    c = np.concatenate([np.full(1000, 1), np.arange(1000) + 10, np.full(500, 1)])
    seen = {}
    got = list(r.block_pairs(lo, lo, lo * 0, left, np.where(lo == 200, 5, c), 75, seen=seen))
    assert got == [] and seen == {"blocks": 6, "visited": 0}


def test_short_lists():
    made = [entries(s, n) for s, n in enumerate([1, 2, 3, 9, 16, 1, 5])]
    whole = [np.concatenate([e[k] for e in made]) for k in range(5)]
    length = np.array([len(e[0]) for e in made])
    start = np.cumsum(length) - length
    expected = {(x + s, y + s) for e, s in zip(made, start, strict=True) for x, y in allowed(e, 75)}
    x, y = r.short_pairs(start, length, *whole, 75)
    assert set(zip(x.tolist(), y.tolist(), strict=True)) == expected
    none = np.empty(0, np.int64)
    assert len(r.short_pairs(none, none, none, none, none, none, none, 75)[0]) == 0


def group(rng, host, n, edits, towards):
    """A host and followers, which are nearer to another set than the host is."""
    members, out = [], [host]
    for _ in range(n):
        lacks = rng.choice(np.setdiff1d(host, towards), edits, replace=False)
        adds = np.unique(rng.choice(np.setdiff1d(towards, host), edits))
        members.append((np.sort(lacks), adds))
        out.append(np.union1d(np.setdiff1d(host, lacks), adds))
    return r.Group(host, members), out


def test_answers_are_derived_from_the_hosts():
    rng = np.random.default_rng(7)
    said, links = 0, {True: 0, False: 0}
    for _ in range(400):
        base = np.unique(rng.integers(0, 1000, 80).astype(np.uint64))
        other = np.union1d(rng.choice(base, int(len(base) * rng.uniform(0.66, 0.9)), replace=False), rng.integers(1000, 2000, rng.integers(8, 12)).astype(np.uint64))
        a, left = group(rng, base, 4, 3, other)
        b, right = group(rng, other, 3, 3, base)
        truth = any(r.linked(len(np.intersect1d(x, y)), len(x), len(y), 75) for x in left for y in right)
        hosts = r.linked(len(np.intersect1d(base, other)), len(base), len(other), 75)
        seen = {}
        assert r.groups_link(a, b, 75, seen) == truth
        assert seen["compared"] == 1  # nothing but the hosts
        links[truth] += 1
        if truth and not hosts:
            assert seen["derived"] >= 1
            said += 1
    assert min(links.values()) > 20 and said > 20


def test_common_and_need():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 60, rng.integers(0, 40))).astype(np.uint64) for _ in range(2))
        both = len(set(a.tolist()) & set(b.tolist()))
        assert r.common(a, b) == r.common(b, a) == both
        assert r.linked(both, len(a), len(b), 75) == (both > 0 and both >= r.need(np.int64(len(a) + len(b)), 75))
