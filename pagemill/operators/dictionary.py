"""Spelling dictionaries: train, merge, shrink, cap, add, remove; wiki pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CAP = 70_000


def train(rows: DataFrame, column: str = "text") -> DataFrame:
    """(word, freq): runs of a-z in the lower-cased text."""
    each = rows.select(F.explode_outer(F.regexp_extract_all(F.lower(F.coalesce(column, F.lit(""))), F.lit("[a-z]+"), F.lit(0))).alias("word")).where("word is not null")
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))


def merge(*dictionaries: DataFrame) -> DataFrame:
    """Counts added up; words with a total of 0 or less go."""
    out = dictionaries[0].select("word", "freq")
    for d in dictionaries[1:]:
        out = out.unionByName(d.select("word", "freq"))
    return out.groupBy("word").agg(F.sum("freq").alias("freq")).where("freq > 0")


def shrink(dictionary: DataFrame, limit: int) -> DataFrame:
    """Words that occur more often than ``limit``."""
    return dictionary.where(F.col("freq") > limit)


def cap(dictionary: DataFrame, most: int = CAP) -> DataFrame:
    """Shrink by the least limit that leaves ``most`` words or fewer.

    The limit is read from a table of how many words have which frequency.
    """
    sizes = dictionary.groupBy("freq").agg(F.count(F.lit(1)).alias("n"))
    above = F.sum("n").over(W.orderBy(F.desc("freq")))  # words of this frequency or more
    edge = sizes.withColumn("upto", above).where(F.col("upto") > most).agg(F.max("freq")).first()[0]
    return dictionary if edge is None else shrink(dictionary, edge)


def add(dictionary: DataFrame, words: str) -> DataFrame:
    """Add the words of a text, each as often as it occurs there."""
    spark = dictionary.sparkSession
    return merge(dictionary, train(spark.range(1).select(F.lit(words).alias("text"))))


def remove(dictionary: DataFrame, words: Sequence[str]) -> DataFrame:
    """Without the listed words; of a line only the first word counts."""
    listed = sorted({w.split()[0].lower() for w in words if w.split()})
    return dictionary.where(~F.col("word").isin(listed)) if listed else dictionary


def remove_all(dictionary: DataFrame, words: DataFrame) -> DataFrame:
    """Without the words of another table, of any size."""
    return dictionary.join(words.select("word"), "word", "left_anti")


def wiki_pages(exports: DataFrame, column: str = "xml") -> DataFrame:
    """(title, body) of the pages in MediaWiki export documents."""
    page = exports.select(F.explode(F.regexp_extract_all(column, F.lit("(?s)<page>(.*?)</page>"), F.lit(1))).alias("page"))
    return page.select(F.regexp_extract("page", "(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("page", "(?s)<text[^>]*>(.*?)</text>", 1).alias("body"))


def wiki_links(body: Column) -> Column:
    """Targets of links without a namespace, cut at | and #."""
    found = F.regexp_extract_all(body, F.lit(r"\[\[([^\]]*)\]\]"), F.lit(1))
    plain = F.filter(found, lambda x: ~x.contains(":"))
    return F.filter(F.transform(plain, lambda x: F.regexp_replace(x, "[|#].*", "")), lambda x: x != "")


def wiki_text(body: Column) -> Column:
    """Letters of the body without its markup, single spaces between words.

    References, templates, links with their text, tables, headings, tags,
    entities and words with an underscore go; letters of any script stay.
    """
    c = body
    for pattern in (r"(?s)&lt;ref.*?/(?:ref)?&gt;", r"(?s)<ref.*?/(?:ref)?>", r"(?s)\{\{[^{}]*\}\}", r"(?s)\{\{[^{}]*\}\}", r"(?s)\[\[.*?\]\]", r"(?s)\{[^{}]*\}", r"(?s)\[[^\[\]]*\]", r"==+[^=\n]*==+", r"(?s)&lt;.*?&gt;", r"<[^>]*>", r"&[a-z]+;", r"\S*_\S*", r"[^\p{L}]"):
        c = F.regexp_replace(c, pattern, " ")
    return F.trim(F.regexp_replace(c, " +", " "))


def wiki_redirects(pages: DataFrame) -> DataFrame:
    """(title, target, body): redirects have the body of the page they lead to.

    One hop is followed, as a join of the pages with themselves by title.
    """
    is_redirect = F.upper(F.substring(F.ltrim("body"), 1, 9)) == "#REDIRECT"
    target = F.when(is_redirect, F.try_element_at(wiki_links(F.col("body")), F.lit(1)))
    a = pages.select("title", target.alias("target"), "body")
    b = pages.select(F.col("title").alias("__title"), F.col("body").alias("__body"))
    out = a.join(b, F.col("target") == F.col("__title"), "left")
    return out.select("title", "target", F.coalesce("__body", "body").alias("body"))
