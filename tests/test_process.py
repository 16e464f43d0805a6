"""Word lists in few passes give what one pass for each pattern gives."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from pagemill.functions import process
from pagemill.sources.lists import stop_words

WORDS = ["a", "b", "can", "can't", "t", "a b", "b a", "a b a", "the", "of the", "don't", "-a", "a--b", "a  b", "A-b", "x.y"]


def one_by_one(text: str, patterns: list[str]) -> str:
    for p in patterns:
        text = re.sub(rf"(?ia)\b{re.escape(p)}\b", "", text)
    return re.sub(" {2,}", " ", text).strip(" ")


def in_passes(text: str, patterns: list[str]) -> str:
    for some in process.passes(patterns):
        text = re.sub(f"(?a){process.automaton(some)}".replace("(?a)(?i)", "(?ia)"), "", text)
    return re.sub(" {2,}", " ", text).strip(" ")


@given(st.lists(st.sampled_from(WORDS), max_size=8), st.lists(st.sampled_from([*WORDS, " ", "-", "'", "can", "xa", "  "]), max_size=14).map("".join))
@settings(max_examples=1500, deadline=None)
def test_passes_equal_sequential_deletion(patterns, text):
    assert in_passes(text, patterns) == one_by_one(text, patterns)


def test_a_usual_list_needs_few_passes():
    words = stop_words()
    assert len(process.passes(words)) == 4  # 181 words; s and t are among them, behind contractions
    assert sum(map(len, process.passes(words))) == len(words)


def test_only_and_ignore(spark):
    patterns = ["the", "of the", "and", "cannot", "can", "x"]
    texts = ["The end of the day and the Can cannot canned", "", "x.x the-and", "of  the", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").select("id", process.ignore("t", patterns).alias("out"), process.only("t", patterns).alias("kept")).orderBy("id").collect()
    for text, r in zip(texts, rows, strict=True):
        if text is not None:
            assert r.out == one_by_one(text, patterns)
            assert r.kept == " ".join(m for p in patterns for m in re.findall(rf"(?i)\b{p}\b", text))
