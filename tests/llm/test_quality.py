import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pagemill.llm import grams, labelled, quality_model, quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, n_words int"


def base(t):
    w = re.findall("[^\x20\x09-\x0d]+", t or "")
    lines, seen, dup = (t or "").split("\n"), set(), 0
    for line in lines:
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    n = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {k for i in range(len(w) - 7) if n[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t or "")), dup, len(cover)


def corpus(seed=1, n=240):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(25, 90))]
        rows.append((i, " ".join(x + "***" for x in w) if i % 4 == 0 else " ".join(w), i % 4 != 0))
    return rows


@pytest.fixture(scope="module")
def tables(spark):
    rows = corpus()
    odd = [
        (1000, None), (1001, ""), (1002, " \n\t"), (1003, "short"), (1004, "a b c d e f g h " * 12), (1005, "same line\nsame line\n\nsame line \nsame line"), (1006, "é#ß | x" + " word" * 5000), (None, "no id " * 30), (1003, "short"), (1007, "x\n" * 9 + "　y"),
    ]
    docs = [(i, t, "en", "s", 1, "clash", 7) for i, t, _ in rows] + [(i, t, "en", "s", 1, "clash", 7) for i, t in odd]
    labels = [(i, int(q), 0) for i, _, q in rows] + [(None, 1, 0), (3, None, 0), (99999, 1, 0), (5, 1, 0)]
    return spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rules_against_brute_force(tables):
    docs, labels = tables
    out = quality_rules.score(docs, labels).collect()
    assert len(out) == docs.count()
    for r in out:
        expected = base(r.text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected
        assert r.base_failed == (expected[0] < 20 or 100 * expected[4] > 30 * expected[0])
        assert not (r.base_failed and r.kept)
    verdict = {r.doc_id: r.kept for r in out if r.doc_id is not None and r.doc_id < 1000}
    right = [verdict[i] == q for i, _, q in corpus()]
    assert sum(right) > 0.97 * len(right)


def test_regular_lines_and_equal_hashes(spark, monkeypatch):
    a, b = "a", "b"
    for _ in range(10):
        a, b = a + b, b + a
    text = f"{a}\n{b}\nplain"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_rules.score(docs, labels).first().n_dup_lines == 0
    # where hashes are equal, bytes decide
    monkeypatch.setattr(grams, "salted", lambda h, doc: doc.astype(np.uint64))
    rng = random.Random(3)
    texts = ["\n".join(" ".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(20)) for _ in range(5)]
    (_, _, t), = grams.slices(pa.array(texts))
    got = quality_rules.base_features(t)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert [tuple(int(got[k][i]) for k in names) for i in range(5)] == [base(x) for x in texts]


def test_the_sample_is_of_present_documents(spark):
    docs = spark.range(1000).selectExpr("id as doc_id", "concat('text ', id) as text")
    docs = docs.union(spark.createDataFrame([(5, "a"), (5, "b"), (None, "c")], "doc_id long, text string"))
    labels = spark.range(1_000_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality", "0 as toxic")
    assert labelled.sample(docs, labels, "quality", 4000).count() == 1000
    assert labelled.sample(docs, labels, "quality", 300).count() == 300
    assert labelled.sample(docs.where("doc_id < 0"), labels, "quality", 4000).count() == 0


def test_rules_rerun_and_division_agree(tables):
    docs, labels = tables
    a = {(r.doc_id, r.text): r.quality for r in quality_rules.score(docs, labels).collect()}
    b = {(r.doc_id, r.text): r.quality for r in quality_rules.score(docs.repartition(7), labels.repartition(2)).collect()}
    assert a == b


def test_rules_without_labels_or_rows(tables):
    docs, labels = tables
    out = quality_rules.score(docs, labels.limit(0)).collect()
    assert all(r.quality is None and r.kept == (not r.base_failed) for r in out)
    assert quality_rules.score(docs.limit(0), labels).count() == 0


def test_keep_returns_the_input_columns(tables):
    docs, labels = tables
    out = quality_rules.keep(docs, labels)
    assert out.schema.simpleString() == docs.schema.simpleString()
    rows = out.collect()
    assert rows
    assert {(r.kept, r.n_words) for r in rows} == {("clash", 7)}


def test_columns_of_any_name(tables):
    docs, labels = tables
    odd = docs.limit(20).select("*", docs.n_words.alias("a b.c"), docs.lang.alias("x`y"), docs.lang.alias("text2"))
    out = quality_rules.score(odd, labels)
    assert [c for c in out.columns if c in ("a b.c", "x`y", "text2")] == ["a b.c", "x`y", "text2"]
    assert {r["a b.c"] for r in out.collect()} == {7}


def test_calibration_is_monotone():
    import numpy as np

    z = np.linspace(-3, 3, 200)
    slope, shift = quality_rules.platt(z, (z > 0.5).astype(float))
    p = quality_rules.sigmoid(slope * z + shift)
    assert (np.diff(p) > 0).all()
    assert abs(z[np.argmin(abs(p - 0.5))] - 0.5) < 0.3


def test_classifier(tables):
    docs, labels = tables
    out = quality_model.score(docs, labels).collect()
    assert len(out) == docs.count()
    for r in out:
        assert 0 <= r.score <= 1
        assert r.predicted == (r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    truth = {i: q for i, _, q in corpus()}
    held = [r.predicted == truth[r.doc_id] for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 20
    assert sum(held) > 0.95 * len(held)


def test_classifier_never_reads_held_labels(tables):
    docs, labels = tables
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 4 = 2 then 1 - quality else quality end as quality", "toxic")
    a = {(r.doc_id, r.score) for r in quality_model.score(docs, labels).collect()}
    assert a == {(r.doc_id, r.score) for r in quality_model.score(docs, flipped).collect()}


def test_classifier_without_labels_or_rows(tables):
    docs, labels = tables
    assert {r.score for r in quality_model.score(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_model.score(docs.limit(0), labels).count() == 0
