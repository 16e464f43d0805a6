import random

import pytest
from pyspark.sql import functions as F

from pagemill.functions import process, text


def apply(spark, function, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in rows.select("i", function(F.col("t")).alias("x")).orderBy("i").collect()]


CLEANED = {
    "w o r d s here": "words here",
    "a b c d": "abc d",
    "that's a test": "that'sa test",
    "x.a b c e": "x.abc e",
    "T H E": "The",
    "THE": "The",
    "a n d": "and",
    "1- 2": "12",
    "it , is": "it, is",
    "Straße ÉTÉ ñandú œuvre": "Strasse ETE nandu oeuvre",
    "aa\x1cbb cc\u3000dd  ": "aa bb cc dd",
    "50% #tag *x* +y:z": "50 tag x yz",
    "“don’t” `x`": "\"don't\" 'x'",
    None: "",
    "": "",
}


def test_clean(spark):
    assert apply(spark, text.clean, list(CLEANED)) == list(CLEANED.values())


def test_steps_are_prefixes(spark):
    with pytest.raises(ValueError, match="no cleaning step"):
        text.clean(F.col("t"), "nothing")
    assert apply(spark, lambda c: text.clean(c, "fold"), ["é\n"]) == ["e "]


WORDS = {
    "I cannot go": ["I", "can", "not", "go"],
    "a non-machine thing": ["a", "non-machine", "thing"],
    "Can't": ["Ca", "n't"],
    "Let's go.": ["Let", "'s", "go"],
    "(yes), no! ... --": ["yes", "no"],
    "'": [],
    "": [],
}


def test_words(spark):
    assert apply(spark, text.words, list(WORDS)) == list(WORDS.values())


def test_counted(spark):
    assert apply(spark, lambda c: text.counted(text.words(c)), ["Let's The the THE."]) == [["let", "s", "the", "the", "the"]]


ODD = ["T h e a n d tHe anD", "a-- b- - c", "中- x 😀 y z", "é́ Þorn ß`s", " .a ,b ; c", "t he e th  e", "_cannot' cannot. CANNOT-", "'s. n't! x.y. .z (a.) --w--", "\x1c\x85\u2003q\x00r", "a'", "''b''", None]


def test_whole_cleaning_equals_its_steps(spark):
    stepwise = lambda c: F.trim(text.clean(c, "common_splits"))
    assert apply(spark, text.clean, ODD) == apply(spark, stepwise, ODD)


def test_cleaning_and_tokens_pass_over_a_text_by_arrow(spark):
    # as regular expressions of Spark these took 40 s of 8 cores for 168 MB of text
    rows = spark.createDataFrame([("a",)], "t string")
    for cut in (text.words, text.counted_words, text.tokens):
        plan = rows.select(cut(text.clean(F.col("t")))).alias("x")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1
        assert "regexp_replace" not in plan


def test_counted_words(spark):
    counted = lambda c: text.counted_words(text.clean(c))
    assert apply(spark, counted, ODD) == apply(spark, lambda c: text.counted(text.words(text.clean(c))), ODD)


def test_tokens_keep_every_sign(spark):
    value = ["(It's) a-b. --x-- don't, \"cannot\"!?"]
    assert apply(spark, text.tokens, value) == [["(", "It", "'s", ")", "a-b", ".", "--", "x", "--", "do", "n't", ",", '"', "can", "not", '"', "!", "?"]]


def test_sentences(spark):
    assert apply(spark, text.sentences, ['One. Two! "Three?" four', "", "no end"]) == [["One.", "Two!", '"Three?"', "four"], [], ["no end"]]


def test_natural_order(spark):
    names = ["src10", "src2", "a1b2", "a1b10", "x"]
    keys = apply(spark, text.natural_key, names)
    assert [n for _, n in sorted(zip(keys, names, strict=True))] == ["a1b2", "a1b10", "src2", "src10", "x"]


def test_processing(spark):
    value = ["The cat, and the dog's 2nd x_y don't!"]
    assert apply(spark, process.strip_punctuation, value) == ["The cat and the dog 's 2nd xy do n't"]
    assert apply(spark, process.strip_digits, value) == ["The cat, and the dog's nd x_y don't!"]
    assert apply(spark, process.drop_numeric_words, ["one 2nd 3 four"]) == ["one four"]
    assert apply(spark, lambda c: process.only(c, ["the", "cat"]), value) == ["The the cat"]
    assert apply(spark, lambda c: process.only(c, []), ["a, b"]) == ["a b"]
    assert apply(spark, lambda c: process.ignore(c, ["the", "and"]), value) == ["cat, dog's 2nd x_y don't!"]
    assert apply(spark, lambda c: process.only(c, ["a.c"]), ["abc a.c"]) == ["a.c"]
    assert apply(spark, lambda c: process.only(c, ["a.c"], regex=True), ["abc a.c"]) == ["abc a.c"]


def test_sequential_ignore(spark):
    # the second phrase only appears once the first is gone
    assert apply(spark, lambda c: process.ignore(c, ["x", "a b"]), ["a x b c"]) == ["a b c"]
    assert apply(spark, lambda c: process.ignore(c, ["x ", "a b"], regex=True), ["a x b c"]) == ["c"]


def test_case(spark):
    rows = spark.createDataFrame([("word", "WROD"), ("word", "Wrod"), ("word", "wrod")], "w string, m string")
    assert [r.x for r in rows.select(process.like_case(F.col("w"), F.col("m")).alias("x")).collect()] == ["WORD", "Word", "word"]


def test_sentences_are_cut_and_counted_in_one_pass(spark):
    values = ['One. Two! "Three?" four can\'t', "", None, "no end", " .  . x", "...", "a.b c.) d"]
    rows = spark.createDataFrame([(v,) for v in values], "t string")
    for r in rows.select(text.counted_sentences(F.col("t")).alias("new"), text.sentences(F.col("t")).alias("old")).collect():
        assert [x.sentence for x in r.new] == (r.old or [])
    counts = [[x.word_count for x in r.x] for r in rows.select(text.counted_sentences(F.col("t")).alias("x")).collect()]
    assert counts[0] == [1, 1, 1, 3] and counts[3] == [2] and counts[5] == [0]


def test_words_met_once_are_not_remembered():
    for cut, shown in ((text._WORDS, "one Two three"), (text._COUNTED, "one two three"), (text._TOKENS, "one Two , three .")):
        before = len(cut)
        assert cut.text("one Two, three.") == shown
        assert len(cut) == before


def test_whole_texts_are_cut_as_their_parts_are():
    rng = random.Random(1)
    parts = ["cannot", "Cannot's", "'cannot", "xcannot", "can't", "I'M", "a", "B2b", ".", ",", "'", '"', "-", "_", "n't", "'s", "\t", "\x01", "é", "?!", "(", "3.5", " ", " "]
    values = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    for cut in (text._WORDS, text._COUNTED, text._TOKENS):
        each = text.Cut(cut.cut)
        assert [cut.text(v) for v in values] == [each.text(v) for v in values]


def test_letters_are_folded_alike_however_many_there_are():
    many = "".join(map(chr, range(0xA1, 0x180)))
    one_by_one = "".join(text._folded(c) for c in f"a1_{many}z")
    assert text._folded(f"a1_{many}z") == one_by_one and one_by_one.startswith("a1_") and one_by_one.isascii()
