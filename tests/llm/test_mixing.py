import random
import re

import numpy as np
import pytest

from pagemill.llm import mixing


def test_targets():
    got = mixing.targets([("b", 100), ("a", 100), (None, 100), ("c", 100)])
    # weights a 5, b 2, c 1, null 5 of 13
    assert {k: round(v, 6) for k, v in got.items()} == {"a": round(2000 / 13, 6), "b": round(800 / 13, 6), "c": round(400 / 13, 6), None: round(2000 / 13, 6)}
    got = mixing.targets([("a", 10), ("b", 1000), ("c", 1000)])
    assert got["a"] == 30
    assert got["b"] == pytest.approx(2 * got["c"])
    assert sum(got.values()) == pytest.approx(2010)
    assert mixing.targets([]) == {}
    assert mixing.targets([("a", 0)]) == {"a": 0}


def test_fill_against_all_subsets():
    rng = random.Random(5)
    for _ in range(200):
        lengths = np.array(sorted(rng.sample(range(1, 15), 4)))
        free = np.array([rng.randint(0, 3) for _ in lengths])
        budget = rng.randint(0, 60)
        reach = {0}
        for n, f in zip(lengths, free, strict=True):
            reach = {r + k * int(n) for r in reach for k in range(f + 1)}
        taken, best = mixing.fill(lengths, free, budget)
        assert best == max(r for r in reach if r <= budget)
        assert (taken * lengths).sum() == best
        assert (taken <= free).all()


def test_plan_meets_the_target():
    rng = np.random.default_rng(2)
    for _ in range(50):
        lengths = np.unique(rng.integers(1, 3000, 400))
        n = rng.integers(1, 50, len(lengths))
        total = int((lengths * n).sum())
        target = float(rng.uniform(0, 3.2)) * total
        base, extra = mixing.plan_source(lengths, n, target, mixing.Mix())
        got = base * total + int((extra * lengths).sum())
        assert (extra >= 0).all()
        assert (extra <= n).all()
        assert base + (extra.max() > 0) <= 3
        assert abs(got - min(target, 3 * total)) <= 1


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(600)]
    rows += [(600, None, "a"), (601, " \t", "b"), (None, "x y", "c"), (5, rows[5][1], rows[5][2]), (602, "only", "d"), (603, "q\x0bw\x85e r", "a")]
    rows += [(1000 + i, "same text here", "a") for i in range(500)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)


def test_mix(docs):
    out = mixing.mixed(docs).collect()
    assert len(out) == docs.count()
    size = {r.doc_id: len(re.findall("[^\x20\x09-\x0d]+", r.text or "")) for r in docs.collect()}
    sums = {}
    for r in out:
        assert r["size"] == size[r.doc_id]
        assert r.taken == r["size"] * r.copies
        assert 0 <= r.copies <= 3
        s = sums.setdefault(r.source, [0, 0, r.target, r.source_size])
        s[0] += r.taken
        s[1] += r["size"]
    for taken, total, target, claimed in sums.values():
        assert total == claimed
        assert abs(taken - target) <= 1
    wanted = mixing.targets([(k, v[1]) for k, v in sums.items()])
    assert {k: v[2] for k, v in sums.items()} == pytest.approx(wanted)


def test_rerun_agrees(docs):
    pick = lambda d: sorted((r.doc_id is None, r.doc_id or 0, r.copies) for r in mixing.mixed(d).collect())
    assert pick(docs) == pick(docs.repartition(9))


def test_apply_repeats_rows(docs):
    extra = docs.selectExpr("*", "1 as copies", "'s' as size")
    out = mixing.apply(extra)
    assert out.schema.simpleString() == extra.schema.simpleString()
    counts = {r.doc_id: r.n for r in out.groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
    plan = {}
    for r in mixing.mixed(docs).collect():
        plan[r.doc_id] = plan.get(r.doc_id, 0) + r.copies
    assert counts == {k: v for k, v in plan.items() if v}


def test_empty(docs):
    assert mixing.mixed(docs.limit(0)).count() == 0
    assert mixing.apply(docs.limit(0)).count() == 0


def sums(lengths, most) -> set[int]:
    reach = {0}
    for n, f in zip(lengths, most, strict=True):
        reach = {r + k * int(n) for r in reach for k in range(int(f) + 1)}
    return reach


def test_nearest_against_all_subsets():
    rng = random.Random(6)
    for _ in range(200):
        lengths = np.array(sorted(rng.sample(range(1, 30), 4))) * rng.choice([1, 1, 7])
        free = np.array([rng.randint(0, 3) for _ in lengths])
        budget = rng.randint(0, 150)
        taken, got = mixing.nearest(lengths, free, budget)
        assert abs(got - budget) == min(abs(r - budget) for r in sums(lengths, free))
        assert (taken * lengths).sum() == got
        assert (taken <= free).all()


@pytest.mark.parametrize("longest", [50, 33_000, 90_000])
def test_plan_is_the_nearest_of_all_choices(longest):
    rng = random.Random(longest)
    for _ in range(60):
        lengths = np.array(sorted(rng.sample(range(longest // 2, longest), rng.randint(1, 3))))
        n = np.array([rng.randint(1, 3) for _ in lengths])
        total = int((lengths * n).sum())
        target = rng.uniform(0, 3) * total
        base, extra = mixing.plan_source(lengths, n, target, mixing.Mix())
        got = base * total + int((extra * lengths).sum())
        assert (base * n + extra <= 3 * n).all()
        assert abs(got - round(target)) == min(abs(r - round(target)) for r in sums(lengths, 3 * n))


def test_long_documents():
    mix = mixing.Mix()
    assert (mixing.plan_source(np.array([40_000]), np.array([3]), 50_000.0, mix)[1] * 40_000).sum() == 40_000
    assert (mixing.plan_source(np.array([33_000]), np.array([10]), 49_000.0, mix)[1] * 33_000).sum() == 33_000
    base, extra = mixing.plan_source(np.array([8, 60_000]), np.array([1, 1]), 58_832.0, mix)
    assert base * 60_008 + (extra * np.array([8, 60_000])).sum() == 60_000 - 0


def test_selection_is_a_plain_sort(spark, docs):
    """Of each source and length the first documents by part and seeded hash get one copy more."""
    from pyspark.sql import functions as F

    mix = mixing.Mix(buckets=4)
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64(F.lit(mix.seed), F.col("doc_id")).alias("h")).collect()}
    by: dict = {}
    for r in mixing.mixed(docs, mix).collect():
        if r.size:
            by.setdefault((r.source, r.size), []).append((hashes[r.doc_id] % 4, hashes[r.doc_id], r.doc_id is not None, r.doc_id or 0, r.copies))
    for rows in by.values():
        copies = [x[-1] for x in sorted(rows)]
        assert copies == sorted(copies, reverse=True)
        assert copies[0] - copies[-1] <= 1
