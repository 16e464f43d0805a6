"""Word lists, dictionaries, and their defaults."""

from __future__ import annotations

import zipfile
from pathlib import Path

import pyspark
from pyspark import SparkContext
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def word_list(spark: SparkSession, path: str) -> list[str]:
    """Patterns of a list file: one a line, lower case; # begins a comment line.

    A list is written by hand and goes to the driver.
    """
    lines = spark.read.text(path).select(F.lower(F.trim("value")).alias("w")).where("w <> '' and not w like '#%'")
    return [r.w for r in lines.collect()]


def stop_words() -> list[str]:
    """The English stop words that Spark ML has, with or without a session."""
    if SparkContext._active_spark_context:
        return sorted(StopWordsRemover.loadDefaultStopWords("english"))
    for jar in Path(pyspark.__file__).parent.glob("jars/spark-mllib_*.jar"):
        with zipfile.ZipFile(jar) as z:
            return sorted(z.read("org/apache/spark/ml/feature/stopwords/english.txt").decode().split("\n"))
    raise RuntimeError("stop words need a Spark session here")


def patterns(spark: SparkSession, path: str | None, stop: bool = False) -> list[str]:
    """The list at ``path``, else the stop words if ``stop``, else none."""
    found = word_list(spark, path) if path else []
    return found or (stop_words() if stop else [])


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(word, freq) from lines ``word count``; other lines count 1 for their first word."""
    line = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "")
    count = F.try_element_at(line, F.lit(2))
    return rows.select(line[0].alias("word"), F.when(count.rlike(r"^\d{1,18}$") & (F.size(line) == 2), count.cast("long")).otherwise(F.lit(1)).alias("freq"))


def write_dictionary(words: DataFrame, path: str) -> None:
    """Lines ``word count``."""
    words.select(F.concat_ws(" ", "word", F.col("freq").cast("string"))).write.mode("overwrite").text(path)
