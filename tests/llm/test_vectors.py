import itertools
import math
from fractions import Fraction

import numpy as np
import pytest

from pagemill.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def data(seed):
    rng = np.random.default_rng(seed)
    out = [rng.normal(size=8) for _ in range(60)]
    for _ in range(6):
        c = rng.normal(size=8)
        out += [c + rng.normal(size=8) * s for s in rng.uniform(0, 0.35, 15)]
    out += [out[3]] * 12 + [out[70] * 5, -out[3]]
    out = [x.astype(np.float32).tolist() for x in out]
    order = rng.permutation(len(out))
    return [(int(i) * 3, out[k], int(k) % 4) for i, k in enumerate(order)]


def linked(a, b):
    """Cosine >= 9/10 in whole numbers; floats are fractions of powers of two."""
    a, b = ([Fraction(float(x)) for x in v] for v in (a, b))
    dot, aa, bb = (sum(x * y for x, y in zip(p, q, strict=True)) for p, q in ((a, b), (a, a), (b, b)))
    return dot > 0 and 100 * dot * dot >= 81 * aa * bb


def brute(rows):
    x = np.array([r[1] for r in rows], float)
    n = len(x)
    dots = (x @ x.T) / np.sqrt((x * x).sum(1)[:, None] * (x * x).sum(1)[None, :])
    hit = dots >= 0.9
    for i, j in zip(*np.nonzero(abs(dots - 0.9) < 1e-6), strict=True):
        hit[i, j] = linked(x[i], x[j])
    hit[np.arange(n), np.arange(n)] = False
    label = np.array([r[0] for r in rows])
    while True:
        new = np.array([min([label[i], *label[hit[i]]]) for i in range(len(rows))])
        if (new == label).all():
            return {r[0]: (int(hit[i].sum()), int(label[i])) for i, r in enumerate(rows)}
        label = new


@pytest.mark.parametrize("p", [vectors.Range(), vectors.Range(block_bytes=8 * 8 * 7, least_cell=20, alone=0), vectors.Range(least_cell=9, least_pivots=16, alone=0), vectors.Range(block_bytes=8 * 8 * 40, alone=0)])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, p, seed):
    rows = data(seed)
    out = vectors.near_copies(spark.createDataFrame(rows, SCHEMA).repartition(3), p).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in out} == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [0.0, -0.0], 0), (3, [nan, 1.0], 0), (4, [inf, 1.0], 0), (5, [None, 1.0], 0), (6, [], 0), (7, [1.0, 0.0], 0), (8, [1e-30, 0.0], 1), (9, [1e30, -0.0], 2), (10, [1.0, 0.0, 0.0], 0), (None, [1.0, 0.0], 0), (11, [-1.0, 0.0], 0)]
    out = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vectors.near_copies(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {k: out[k] for k in (7, 8, 9)} == {7: (2, 7, True), 8: (2, 7, False), 9: (2, 7, False)}
    assert all(out[k] == (0, k, True) for k in (1, 2, 3, 4, 5, 6, 10, 11))
    assert out[None] == (0, None, False)


def test_empty_and_none_usable(spark):
    df = spark.createDataFrame([(1, None, 0)], SCHEMA)
    assert [tuple(r) for r in vectors.near_copies(df).collect()] == [(1, 0, 1, True)]
    assert vectors.near_copies(df.limit(0)).collect() == []


def test_visits_lose_no_pair():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 5))
    x /= np.linalg.norm(x, axis=1)[:, None]
    pivots = vectors.choose_pivots(x, 12, 0.9)
    home = (x @ pivots.T).argmax(1)
    angle = np.arccos(np.clip((x @ pivots.T)[np.arange(400), home], -1, 1))
    reach = np.array([angle[home == c].max(initial=-10) for c in range(len(pivots))])
    least = np.array([angle[home == c].min(initial=10) for c in range(len(pivots))])
    home, near = vectors.visits(x, pivots, reach, least, 0.9)
    assert near.mean() < 0.4
    for a, b in zip(*np.nonzero(x @ x.T >= 0.9), strict=True):
        if home[a] > home[b]:
            assert near[a, home[b]]


def ties():
    """Pairs of whole numbers with cosine 9/10 exactly: both lengths are whole."""
    whole = [v for v in itertools.product(range(-1, 10), repeat=4) if any(v) and math.isqrt(n := sum(x * x for x in v)) ** 2 == n]
    out = [(a, b) for a, b in itertools.combinations(whole[:: max(1, len(whole) // 400)], 2) if linked(a, b) and not linked_above(a, b)]
    return [(np.array(a) * k, np.array(b) * m) for a, b in out[:40] for k, m in ((1, 1), (1000, 13))] + [((9, 3, 3, 1), (1, 0, 0, 0))]


def linked_above(a, b):
    return 100 * int(np.dot(a, b)) ** 2 > 81 * int(np.dot(a, a)) * int(np.dot(b, b))


@pytest.mark.parametrize("p", [vectors.Range(), vectors.Range(block_bytes=8 * 4 * 9, least_cell=5, alone=0)])
def test_pairs_at_the_threshold_link(spark, p):
    pairs = ties()
    assert len(pairs) >= 12 and all(linked(a, b) for a, b in pairs)
    rows = [(2 * i + k, [float(x) for x in v], 0) for i, pair in enumerate(pairs) for k, v in enumerate(pair)]
    # a little less than the threshold: no link
    rows += [(10_000, [9.0, 3.0, 3.0, float(np.nextafter(np.float32(1), np.float32(2)))], 0)]
    out = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_copies(spark.createDataFrame(rows, SCHEMA), p).collect()}
    assert out == brute(rows)
    assert all(out[2 * i][0] > 0 for i in range(len(pairs)))


def test_cosine_of_extreme_vectors():
    a, b = np.array([9.0, 3, 3, 1]), np.array([1.0, 0, 0, 0])
    for scale in (2.0**-500, 1.0, 2.0**500):
        assert vectors.cosine(a * scale, b) == vectors.cosine(b, a * scale) >= 0.9


def test_many_lengths_and_a_large_group(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=16)
    rows = [(i, (base + rng.normal(size=16) * 0.05).tolist(), 0) for i in range(3000)]
    rows += [(5000 + i, rng.normal(size=1 + i % 40).tolist(), 0) for i in range(400)]
    out = {r.vec_id: r for r in vectors.near_copies(spark.createDataFrame(rows, SCHEMA), vectors.Range(alone=500)).collect()}
    assert all(out[i].component_id == 0 and out[i].n_links == 2999 for i in range(3000))
    for n in range(1, 41):
        part = [(i, np.array(v, np.float32).tolist(), 0) for i, v, _ in rows if len(v) == n and i >= 5000]
        if n != 16:
            assert {i: (out[i].n_links, out[i].component_id) for i, _, _ in part} == brute(part)


def test_other_columns_are_ignored(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 9, "a"), (1, [1.0, 2.0], 9, "b"), (2, [2.0, 4.0], 9, "c")], "vec_id long, embedding array<float>, n_links int, h1 string")
    assert sorted(tuple(r) for r in vectors.near_copies(df).collect()) == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
