import random
import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from pagemill.llm import graph, jaccard, store


def sets(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute(rows, percent=75):
    """component of each row index, by all pairs."""
    found = [sets(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        both = len(found[a] & found[b])
        if both and 100 * both >= percent * (len(found[a]) + len(found[b]) - both):
            up[find(b)] = find(a)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return [(r[0], len(found[i]), least.get(find(i))) for i, r in enumerate(rows)]


def corpus(seed, bases=12):
    """Groups of near copies around the threshold, copies, shared passages."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(40)]
    rows = []
    for b in range(bases):
        base = [rng.choice(words) for _ in range(rng.choice([3, 4, 5, 9, 40, 80]))]
        for _ in range(rng.choice([1, 2, 8, 25])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            if rng.random() < 0.2:
                copy = copy + passage
            rows.append(" ".join(w.upper() if rng.random() < 0.1 else w for w in copy))
    rows += [" ".join(passage)] * 3 + [None, "", " \n", "One", "one", "two"]
    ids = rng.sample(range(10_000), len(rows))
    return list(zip(ids, rows, strict=True))


@pytest.mark.parametrize(("seed", "small"), [(1, False), (2, True), (3, True)])
def test_against_all_pairs(spark, seed, small):
    rows = corpus(seed)
    p = jaccard.Join(group=3, cell_tokens=500, permutations=1, tries=2, close=80, list_part=5, dense=0) if small else jaccard.Join()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted(tuple(r) for r in jaccard.components(df, p).select("doc_id", "n_shingles", "component_id").collect())
    assert got == sorted(brute(rows))


def test_links_that_only_followers_have(spark):
    """x, its follower y, and z, which links with y and not with x."""
    rng = random.Random(5)
    rows = []
    for k in range(12):
        x = [f"w{rng.randrange(10**6)}" for _ in range(204)]
        y = list(x)
        y[20] = f"y{k}"
        z = list(y)
        n = 0
        while True:  # edits far from each other, until one more would break the link with y
            more = list(z)
            more[40 + 12 * n] = f"z{k}.{n}"
            if len(sets(" ".join(more)) & sets(" ".join(y))) * 100 < 75 * len(sets(" ".join(more)) | sets(" ".join(y))):
                break
            z, n = more, n + 1
        rows += [(3 * k, " ".join(x)), (3 * k + 1, " ".join(y)), (3 * k + 2, " ".join(z))]
        assert len(sets(rows[-1][1]) & sets(rows[-3][1])) * 100 < 75 * len(sets(rows[-1][1]) | sets(rows[-3][1]))
    expected = sorted(brute(rows))
    assert all(c == 3 * (i // 3) for i, _, c in expected)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for p in (jaccard.Join(), jaccard.Join(permutations=1, rounds=0, list_part=2)):
        assert sorted(map(tuple, jaccard.components(df, p).collect())) == expected


def test_tables_are_dropped(spark):
    from pagemill.llm import store

    before = set(store._OPEN)
    out = jaccard.components(spark.createDataFrame([(a, b, 1, 2) for a, b in corpus(6, 4)], "doc_id long, text string, s1 long, component long"))
    assert len(set(store._OPEN) - before) <= 2 and out.count() == len(corpus(6, 4))
    with pytest.raises(RuntimeError), store.scope():
        store.written(spark.range(3), "x")
        raise RuntimeError
    assert len(set(store._OPEN) - before) <= 2


def test_hot_keys_are_joined_by_broadcast(spark):
    left = spark.range(4000).selectExpr("if(id % 2 = 0, 7, id) as k", "id as v").union(spark.createDataFrame([(None, 1)], "k long, v long"))
    right = spark.range(3000).selectExpr("id as k", "id * 10 as w")
    for how in ("inner", "left"):
        key = lambda df: sorted(map(tuple, df.select("k", "v", "w").collect()), key=repr)
        met = jaccard._met(left, right, "k", how)
        assert key(met) == key(left.join(right, "k", how))
        assert "Union" in met._jdf.queryExecution().optimizedPlan().toString()


def test_other_thresholds(spark):
    rows = corpus(4, 6)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in jaccard.components(df, jaccard.Join(percent=60)).collect())
    assert got == sorted(brute(rows, 60))


def test_nulls_and_repeats(spark):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (3, "x y"), (None, "only here now"), (3, "q r s")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert got == sorted([(None, 2, 7), (7, 2, 7), (7, 2, 7), (3, 1, 3), (None, 1, None), (3, 1, 3)], key=repr)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.components(df).collect() == []
    assert jaccard.keep_first(df).collect() == []
    none = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.components(none).collect())) == [(1, 0, 1), (2, 0, 2)]


def test_keep_first(spark):
    rows = [(4, "a b c d e f", "x", 1), (2, "A b c d e f", "y", 2), (9, "z", "x", 3), (None, "a b c d e f", "x", 4), (5, None, "x", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n string, component_id int")
    out = jaccard.keep_first(df)
    assert out.columns == df.columns
    assert sorted(r.component_id for r in out.collect()) == [2, 3, 4, 5]


def test_components(spark):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(1, None), (5, 5)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in up}


def test_hot_keys_beyond_the_broadcast_bound(spark, monkeypatch):
    left = spark.range(6000).selectExpr("id", "if(id % 3 = 0, 7, id) as key")
    right = spark.range(0, 6000, 2).selectExpr("id as key", "cast(repeat('x', 50) as binary) as payload").unionByName(spark.createDataFrame([(7, b"hot")], "key long, payload binary"))
    expected = {how: sorted(map(repr, left.join(right, "key", how).collect())) for how in ("inner", "left")}
    for bound in (jaccard.MOST_BROADCAST, 0):
        monkeypatch.setattr(jaccard, "MOST_BROADCAST", bound)
        for how, rows in expected.items():
            assert sorted(map(repr, jaccard._met(left, right, "key", how).select("key", "id", "payload").collect())) == rows


def test_small_tasks_give_back_together(monkeypatch):
    given = []
    monkeypatch.setattr(store, "give_back", lambda: given.append(1))
    task = store.worker_task("small")(lambda batches: batches)
    small, large = (pa.record_batch({"x": pa.array(np.zeros(n))}) for n in (1000, 1 << 20))
    list(task(iter([small])))
    given.clear()
    for _ in range(20):
        assert list(task(iter([small]))) == [small]
    assert given == []
    list(task(iter([large])))
    assert given == [1]


def test_components_of_small_and_large_graphs(spark, monkeypatch):
    edges = [(i, i + 1) for i in range(30)] + [(40, 35), (35, 50), (None, 1), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    expected = {i: 0 for i in range(31)} | {35: 35, 40: 35, 50: 35}
    for few in (graph.FEW_EDGES, 0):
        monkeypatch.setattr(graph, "FEW_EDGES", few)
        assert {r.node: r.component for r in graph.components(df).collect()} == expected
