"""What the corpus teaches about periods, against the formulas in plain Python."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from pagemill.operators import pages as pg
from pagemill.operators import punkt

TEXTS = [f"Dr. Fox met prof. {n} at noon. He saw {n} birds. The cat. A 3. Mai came twice." for n in ("two", "red", "old", "new", "odd", "shy")] + ["", None, "e.g. this, e.g. that! \"Why?\" No. 7 is 3. Mai", "..."] + ["birds and noon and cat are here and red here"] * 4


def log(k, n, p):
    return (k * math.log(p) if k else 0.0) + ((n - k) * math.log(1 - p) if n - k else 0.0)


def kind(t):
    return re.sub(r"\.$", "", re.sub(r"^[^a-z0-9]+", "", t.lower()))


def learned():
    words = [[t for t in (x or "").split(" ") if t] for x in TEXTS]
    dots, bare = Counter(), Counter()
    for w in words:
        for t in w:
            (dots if t.endswith(".") else bare)[kind(t)] += 1
    total = sum(dots.values()) + sum(bare.values())
    p = sum(dots.values()) / total
    stats = {}
    for t, k in dots.items():
        n, size = k + bare[t], len(t.replace(".", ""))
        stats[t] = 0.0 if not size else 2 * (log(k, n, 0.99) - log(k, n, p)) * math.exp(-size) * (len(t) - size + 1) * size ** -bare[t]
    first = Counter(kind(t) for w in words for t in w if re.search(r"^[^A-Za-z0-9]*([A-Za-z]|[0-9]+)\.$", t))
    pairs = Counter((kind(a), kind(b)) for w in words for a, b in zip(w, w[1:]) if re.search(r"^[^A-Za-z0-9]*([A-Za-z]|[0-9]+)\.$", a))
    found = {}
    for (x, y), k in pairs.items():
        a, b = first[x], dots[y] + bare[y]
        score = -2 * (log(k, a, b / total) + log(b - k, total - a, b / total) - log(k, a, k / a) - log(b - k, total - a, (b - k) / (total - a)))
        if k / a > b / total and score >= punkt.COLLOCATION:
            found[x, y] = score
    return words, stats, found


def test_statistics_collocations_and_sentences(spark):
    words, stats, found = learned()
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "k int, text string")
    got = {r.type: r for r in punkt.statistics(rows).collect()}
    assert got.keys() == stats.keys()
    assert all(math.isclose(got[t].score, s, rel_tol=1e-9, abs_tol=1e-9) for t, s in stats.items())
    short = {t for t, s in stats.items() if s >= punkt.ABBREVIATION and re.search("[a-z]", t)}
    assert {t for t in got if got[t].abbreviation} == short
    assert {"dr", "e.g"} <= short and "birds" not in short
    pairs = {(r.type, r.following): r.score for r in punkt.collocations(rows).collect()}
    assert pairs.keys() == found.keys() and ("3", "mai") in pairs
    expected = []
    for k, w in enumerate(words):
        no, held = 0, []
        for i, t in enumerate(w):
            held.append(t)
            last = i + 1 == len(w)
            ends = re.search(r"[.!?]+[\"')]*$", t) and not (t.endswith(".") and (kind(t) in short or (not last and (kind(t), kind(w[i + 1])) in found)))
            if ends or last:
                no += 1
                expected.append((k, no, " ".join(held)))
                held = []
    assert sorted(map(tuple, punkt.sentence_rows(rows, "k").collect())) == sorted(expected)


def test_empty(spark):
    none = spark.createDataFrame([], "k int, text string")
    assert punkt.statistics(none).collect() == []
    assert punkt.collocations(none).collect() == []
    assert punkt.sentence_rows(none, "k").collect() == []


def test_text_of_a_file_in_parts(spark):
    pages = [(f, i, f"{f}{i}" * (i % 5)) for f in ("a", "b") for i in range(1, 60)] + [(None, 1, "x")]
    rows = pg.file_text(spark.createDataFrame(pages, "file_path string, page_no int, text string"), size=40).collect()
    for f in ("a", "b", None):
        parts = [r.text for r in sorted((r for r in rows if r.file_path == f), key=lambda r: r.part)]
        assert " ".join(parts) == " ".join(t for g, _, t in pages if g == f)
        assert f is None or len(parts) > 5


def test_texts_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def text(x):
        made.add(1)
        return x

    rows = spark.createDataFrame(list(enumerate(TEXTS)), "k int, text string").withColumn("text", F.udf(text)("text"))
    assert punkt.sentence_rows(rows, "k").count() > 0
    assert made.value == len(TEXTS)
    made.value = 0
    assert punkt.collocations(rows).count() > 0
    assert made.value == len(TEXTS)


def test_text_of_a_file_is_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def text(x):
        made.add(1)
        return x

    pages = spark.createDataFrame([("f", i, "x" * i) for i in range(1, 40)], "file_path string, page_no int, text string").withColumn("text", F.udf(text)("text"))
    rows = pg.file_text(pages, size=50).collect()
    assert " ".join(r.text for r in sorted(rows, key=lambda r: r.part)) == " ".join("x" * i for i in range(1, 40))
    assert made.value == 39
