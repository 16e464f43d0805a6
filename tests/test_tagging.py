"""Tags in context and rows beside their raw text, against plain Python."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.operators import pages as pg
from pagemill.operators import tagging


def brute(tokens, base, lexicon):
    tags = [lexicon.get(t.lower(), "NN") if g == "NN" else g for t, g in zip(tokens, base)]
    for old, new, places, near in tagging.RULES:
        seen = list(tags)
        for i, g in enumerate(seen):
            if g == old and any(0 <= i + p < len(seen) and seen[i + p] in near for p in places):
                tags[i] = new
    return tags


WORDS = ["to", "glim", "the", "must", "walked", "she", "Rome", "has", "are", "that", "cats", "plod", "brisk", "of", "is"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(WORDS), min_size=1, max_size=25), min_size=1, max_size=12))
def test_rules_as_a_plain_loop(spark, texts):
    lexicon = {"glim": "VB", "plod": "VB", "brisk": "JJ"}
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, text string")
    table = spark.createDataFrame(list(lexicon.items()), "word string, pos string")
    base = {r.w: r.g for r in spark.createDataFrame([(w,) for w in WORDS], "w string").select("w", tagging.tag(F.col("w")).alias("g")).collect()}
    found = {r.id: (r.tokens, r.tags) for r in tagging.context_tags(rows, "id", table).collect()}
    assert found == {i: (t, brute(t, [base[w] for w in t], lexicon)) for i, t in enumerate(texts)}


def test_learned_lexicon(spark):
    words = [("plod", 3), ("plodded", 0), ("ploding", 4), ("ploded", 1), ("plods", 2), ("brisk", 1), ("briskly", 5), ("door", 9), ("doors", 7), ("glide", 2), ("gliding", 2), ("tie", 1), ("ties", 2), ("tied", 2), ("rare", 1), ("rared", 1), ("the", 8)]
    found = tagging.learned(spark.createDataFrame(words, "word string, freq long")).collect()
    # "tie" has two votes each way, "rare" one vote only
    assert sorted(map(tuple, found)) == [("brisk", "JJ"), ("glide", "VB"), ("plod", "VB")]


def test_odd_texts(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "  , "), (4, "to glim"), (None, "x")], "id long, text string")
    empty = spark.createDataFrame([], "word string, pos string")
    assert sorted((r.id or 0, r.pos) for r in tagging.tag_rows(rows, "id", empty).collect()) == [(0, "NN"), (4, "TO"), (4, "VB")]
    assert tagging.tag_rows(rows.limit(0), "id", empty).count() == 0
    long = spark.createDataFrame([(1, "to glim the " * 20_000)], "id long, text string")
    assert [(r.pos, r["count"]) for r in tagging.tag_rows(long, "id", empty).groupBy("pos").count().orderBy("pos").collect()] == [("DT", 20_000), ("NN", 19_999), ("TO", 20_000), ("VB", 1)]  # a determiner two before


@pytest.mark.parametrize(("text", "raw", "words", "sentences"), [
    ("a c", "a b c", [("a", "a"), ("c", "b")], [("a c", "a b c")]),
    ("a b c", "a", [("a", "a"), ("b", None), ("c", None)], [("a b c", "a")]),
    ("", "a. b", [], []),
    (None, None, [], []),
    ("One. Two.", "One.", [("One", "One"), ("Two", None)], [("One.", "One."), ("Two.", None)]),
])
def test_rows_beside_raw(spark, text, raw, words, sentences):
    pages = spark.createDataFrame([("f", 1, raw, text)], "file_path string, page_no int, raw_text string, text string")
    assert [(r.word, r.raw) for r in pg.word_rows_raw(pages).orderBy("word_no").collect()] == words
    assert [(r.sentence, r.raw) for r in pg.sentence_rows_raw(pages).orderBy("sentence_no").collect()] == sentences
    assert pg.word_rows_raw(pages).drop("raw").collect() == pg.word_rows(pages).collect()


def test_words_beside_raw_are_rows_where_they_are_cut(spark):
    rows = [("f", i, "one two " * i, "two " * (i % 3)) for i in range(3)] + [(None, 3, None, "x y"), ("f", 4, "a", None)]
    out = pg.word_rows_raw(spark.createDataFrame(rows, "file_path string, page_no int, raw_text string, text string"))
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in out.orderBy("page_no", "word_no").collect()] == [("f", 1, 1, 3, "two", "one"), ("f", 2, 1, 3, "two", "one"), ("f", 2, 2, 3, "two", "two"), (None, 3, 1, 1, "x", None), (None, 3, 2, 1, "y", None)]


def test_tokens_are_tagged_and_words_counted_once(spark):
    made = spark.sparkContext.accumulator(0)

    def word(x):
        made.add(1)
        return x

    words = spark.createDataFrame([("walking", 3), ("walk", 2), ("walked", 1)], "w string, freq long").select(F.udf(word)("w").alias("word"), "freq")
    assert [tuple(r) for r in tagging.learned(words).collect()] == [("walk", "VB")]
    assert made.value == 3
    pages = spark.createDataFrame([("The the walk",), ("the Walk",)], "text string")
    tagged = tagging.tagged_frequency(pages)
    assert {tuple(r) for r in tagged.collect()} == {("the", "DT", 3), ("walk", "NN", 1), ("walk", "NNP", 1)}
    assert "keys=[token" in tagged._jdf.queryExecution().executedPlan().toString()
