"""Part-of-speech tags and lemmas by rule; approximations, without a model."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text
from ..plans.tables import ensure_checkpoint_dir
from . import positions

#: Closed-class words and their tags.
LEXICON = {
    "DT": ["the", "a", "an", "this", "that", "these", "those", "every", "each", "some", "any", "no"],
    "IN": ["of", "in", "on", "at", "by", "for", "with", "from", "into", "over", "under", "about", "as", "if", "than", "because"],
    "CC": ["and", "or", "but", "nor"],
    "TO": ["to"],
    "PRP": ["i", "you", "he", "she", "it", "we", "they", "me", "him", "them", "us"],
    "MD": ["can", "could", "will", "would", "shall", "should", "may", "might", "must"],
    "VBZ": ["is", "has", "does"],
    "VBD": ["was", "were", "had", "did"],
    "VBP": ["are", "am", "have", "do"],
    "RB": ["not", "n't", "very", "too", "also", "never", "always"],
    "WP": ["what", "who", "whom"],
    "WDT": ["which"],
}
#: Endings and their tags, the first that fits.
ENDINGS = [("ing", "VBG"), ("ed", "VBD"), ("ly", "RB"), ("ness", "NN"), ("ment", "NN"), ("tion", "NN"), ("able", "JJ"), ("ful", "JJ"), ("ous", "JJ"), ("ive", "JJ"), ("est", "JJS"), ("s", "NNS")]

#: Published detachment rules by word class, (ending, replacement).
DETACHMENT = {
    "n": [("s", ""), ("ses", "s"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y")],
    "v": [("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", "")],
    "a": [("er", ""), ("est", ""), ("er", "e"), ("est", "e")],
    "r": [],
}

#: Published rules of a transformation-based tagger, in their
#: order: (tag, new tag, places beside it, tags of which one stands there).
RULES = [
    ("NN", "VB", (-1,), ("TO",)), ("VBP", "VB", (-1, -2, -3), ("MD",)), ("NN", "VB", (-1, -2), ("MD",)), ("VB", "NN", (-1, -2), ("DT",)), ("VBD", "VBN", (-1, -2, -3), ("VBZ",)),
    ("VBN", "VBD", (-1,), ("PRP",)), ("VBN", "VBD", (-1,), ("NNP",)), ("VBD", "VBN", (-1,), ("VBD",)), ("VBP", "VB", (-1,), ("TO",)), ("VB", "VBP", (-1,), ("NNS",)),
    ("VBD", "VBN", (-1, -2, -3), ("VBP",)), ("IN", "WDT", (1,), ("VB",)), ("VB", "VBP", (-1,), ("PRP",)), ("IN", "WDT", (1,), ("VBZ",)), ("JJ", "NNP", (1,), ("NNP",)), ("IN", "WDT", (1,), ("VBD",)),
]
#: Endings that tell the class of the word they are put to.
VOTES = {"VB": ("ing", "ed"), "JJ": ("est", "ly"), "NN": ("s",)}


def tag(word: Column) -> Column:
    """Penn tag of a token: lexicon, digits, endings, capitals, else noun."""
    low, out = F.lower(word), F.when(word.rlike("^[0-9][0-9.,]*$"), "CD")
    for name, members in LEXICON.items():
        out = out.when(low.isin(members), name)
    for ending, name in ENDINGS:
        out = out.when(low.endswith(ending) & (F.length(low) > len(ending) + 2), name)
    return out.when(word.rlike("^[A-Z]"), "NNP").otherwise("NN")


def word_class(tags: Column) -> Column:
    return F.when(tags.startswith("JJ"), "a").when(tags.contains("RB"), "r").when(tags.startswith("VB"), "v").otherwise("n")


def tagged_frequency(pages: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, word, pos, freq) over the corpus, or over each page or file that the keys tell apart."""
    each = pages.select(*keys, F.explode_outer(text.words(F.col("text"))).alias("token")).where("token is not null")
    counts = each.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("freq"))  # a token is tagged once
    each = counts.select(*keys, F.btrim(F.lower("token"), F.lit(text.PUNCTUATION)).alias("word"), tag(F.col("token")).alias("pos"), "freq").where("word <> ''")
    return each.groupBy(*keys, "word", "pos").agg(F.sum("freq").alias("freq"))


def lemmas(tokens: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(word, class, lemma) of distinct (word, class).

    The first detachment rule whose result the dictionary knows gives the
    lemma; a word that none applies to is its own lemma.
    """
    tries = []
    for c, rules in DETACHMENT.items():
        for i, (ending, new) in enumerate(rules):
            stem = F.concat(F.expr(f"substr(word, 1, length(word) - {len(ending)})"), F.lit(new))
            tries.append(F.when((F.col("class") == c) & F.col("word").endswith(ending) & (F.length("word") > len(ending)), F.struct(F.lit(i).alias("i"), stem.alias("lemma"))))
    distinct = tokens.select("word", "class").distinct()
    each = distinct.select("word", "class", F.explode(F.array_compact(F.array(*tries))).alias("t")).select("word", "class", "t.i", F.col("t.lemma").alias("lemma"))
    known = each.join(dictionary.select(F.col("word").alias("lemma")), "lemma", "left_semi")
    best = known.groupBy("word", "class").agg(F.min_by("lemma", "i").alias("lemma"))
    return distinct.join(best, ["word", "class"], "left").withColumn("lemma", F.coalesce("lemma", "word"))


def lemmatized(rows: DataFrame, key: str, dictionary: DataFrame, column: str = "text") -> DataFrame:
    """(key, text) with every token replaced by its lemma, in lower case.

    Lemmas are found for distinct words and come back to the texts that have
    them. Punctuation stays, glued to the token before it.
    """
    # a token's class does not depend on its case
    texts = positions.cut(rows, key, column, lambda c: F.lower(text.token_text(c)))
    words = positions.distinct(texts).select(F.col("token").alias("word"), word_class(tag(F.col("token"))).alias("class")).checkpoint()
    found = lemmas(words, dictionary).where("lemma <> word")  # most words are their own lemma
    return positions.replaced(texts, key, found.select(F.col("word").alias("token"), F.col("lemma").alias("value")))


def learned(words: DataFrame, least: int = 2) -> DataFrame:
    """(word, pos): plain words that their inflected forms in the corpus tell to be verbs or adjectives.

    ``words`` is (word, freq). A form in -ing or -ed votes for a verb, one in
    -est or -ly for an adjective, one in -s for a noun, each as often as it
    occurs, for what stands before the ending, with and without a mute e. The
    class with the most votes, at least ``least``, wins; ties and nouns have no
    row, nor have words that the lexicon or an ending tags already.
    """
    ensure_checkpoint_dir(words.sparkSession)
    words = words.checkpoint()  # a row for each word; votes and plain words are read from it
    low, forms = F.col("word"), []
    for name, endings in VOTES.items():
        for ending in endings:
            stem = F.expr(f"substr(word, 1, length(word) - {len(ending)})")
            stems = [stem, F.concat(stem, F.lit("e"))] if ending[0] in "aeiou" else [stem]
            votes = F.array(*(F.struct(x.alias("word"), F.lit(name).alias("pos")) for x in stems))
            forms.append(F.when(low.endswith(ending) & (F.length(low) > len(ending) + 1), votes))
    each = words.select("freq", F.explode(F.flatten(F.array_compact(F.array(*forms)))).alias("f")).select("f.word", "f.pos", "freq")
    votes = each.groupBy("word").agg(*(F.sum(F.when(F.col("pos") == name, F.col("freq")).otherwise(0)).alias(name) for name in VOTES))
    best = F.when((F.col("VB") > F.col("JJ")) & (F.col("VB") > F.col("NN")), "VB").when((F.col("JJ") > F.col("VB")) & (F.col("JJ") > F.col("NN")), "JJ")
    found = votes.select("word", best.alias("pos"), F.greatest("VB", "JJ").alias("n")).where((F.col("n") >= least) & F.col("pos").isNotNull())
    plain = words.where((tag(low) == "NN") & (F.length(low) > 1)).select("word")
    return plain.join(found, "word").select("word", "pos")


_CLOSED = {w: name for name, members in LEXICON.items() for w in members}
_TAGS = sorted({*LEXICON, *(x for _, x in ENDINGS), *(x for rule in RULES for x in (*rule[:2], *rule[3])), *VOTES, "CD", "NNP"})
_CODES = {x: i for i, x in enumerate(_TAGS, 1)}
_GAP = max(abs(p) for rule in RULES for p in rule[2])


def _first_code(word: str) -> int:
    """The tag of :func:`tag`, as its number."""
    low = word.lower()
    if re.fullmatch("[0-9][0-9.,]*", word):
        return _CODES["CD"]
    ending = next((x for e, x in ENDINGS if low.endswith(e) and len(low) > len(e) + 2), None)
    return _CODES[_CLOSED.get(low) or ending or ("NNP" if re.match("[A-Z]", word) else "NN")]


_FIRST = text.Cut(_first_code)


def _in_context(tokens: pa.Array, changes: pa.Array) -> pa.Array:
    """The rules over all texts of a batch at once; between texts stand tags that no rule looks for."""
    codes, ends = [0] * _GAP, []
    for t, lines in zip(tokens.to_pylist(), changes.to_pylist(), strict=True):
        first, learned_tags = map(_FIRST.__getitem__, t.split(" ")), positions.changed(lines)
        codes += [_CODES[learned_tags[w]] if w in learned_tags else c for w, c in zip(t.split(" "), first, strict=True)] if learned_tags else first
        ends.append(len(codes))
        codes += [0] * _GAP
    tags = np.array(codes, np.int8)
    for old, new, places, near in RULES:
        wanted = np.isin(tags, [_CODES[x] for x in near])
        beside = np.zeros(len(tags), bool)
        for p in places:
            beside |= np.roll(wanted, -p)
        tags[(tags == _CODES[old]) & beside] = _CODES[new]
    names, starts = np.array(["", *_TAGS], object)[tags], [_GAP, *(e + _GAP for e in ends)]
    return pa.array([" ".join(names[a:b]) for a, b in zip(starts, ends, strict=False)], pa.string())


def context_tags(rows: DataFrame, key: str, lexicon: DataFrame, column: str = "text") -> DataFrame:
    """(key, tokens, tags): the words of each text and their tags, by what stands beside them.

    A word's first tag is that of :func:`tag`, for plain nouns that of the
    learned lexicon, where it has one. The rules then go over the tags one
    after another; a rule sees the tags as they were before it. The lexicon
    meets the distinct words of the corpus, and what it has comes back to the
    texts. Texts without a word, null ones among them, have no row.
    """
    texts = positions.cut(rows, key, column, text.word_text).where("tokens <> ''")
    plain = positions.distinct(texts).where(tag(F.col("token")) == "NN").withColumn("word", F.lower("token"))
    known = plain.join(lexicon.select("word", F.col("pos").alias("value")), "word").select("token", "value")
    tags = F.arrow_udf(_in_context, StringType())("tokens", "changes")
    return positions.with_changes(texts, key, known).select(key, F.split("tokens", " ").alias("tokens"), F.split(tags, " ").alias("tags"))


def tag_rows(rows: DataFrame, key: str, lexicon: DataFrame, column: str = "text") -> DataFrame:
    """(key, word_no, token, pos): a row for each word, numbered from 1, with its tag in context."""
    each = context_tags(rows, key, lexicon, column).select(key, F.posexplode(F.arrays_zip("tokens", "tags")).alias("__pos", "x"))
    return each.select(key, (F.col("__pos") + 1).alias("word_no"), F.col("x.tokens").alias("token"), F.col("x.tags").alias("pos"))


def context_frequency(tagged: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, word, pos, freq) of rows with ``token`` and ``pos``."""
    each = tagged.select(*keys, F.btrim(F.lower("token"), F.lit(text.PUNCTUATION)).alias("word"), "pos").where("word <> ''")
    return each.groupBy(*keys, "word", "pos").agg(F.count(F.lit(1)).alias("freq"))
