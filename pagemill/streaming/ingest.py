"""Page and word counts over files that arrive; beyond batch runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources import pdf
from ..sources.adapters import shaped


def pdf_pages(spark: SparkSession, path: str, **options) -> DataFrame:
    """A stream of cleaned pages of PDF files under a path."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][dD][fF]").load(path)
    return shaped(pdf.pages(files, **options))


def word_counts(pages: DataFrame) -> DataFrame:
    """Running word frequencies of a stream of pages (complete or update mode)."""
    each = pages.select(F.explode(text.counted_words(F.col("raw_text"))).alias("word"))
    return each.groupBy("word").agg(F.count(F.lit(1)).alias("freq"))
