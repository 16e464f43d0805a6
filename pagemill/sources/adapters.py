"""Tables as collections of files with pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..plans.tables import numbered


def pages_from_documents(documents: DataFrame) -> DataFrame:
    """``source`` is the file, its documents by id are the pages."""
    rows = documents.select(F.col("source").alias("file_path"), F.col("doc_id").alias("__id"), F.col("text").alias("raw_extract"))
    return shaped(numbered(rows, "file_path", "__id", "page_no").drop("__id"), dense=True)


def pages_from_conversations(turns: DataFrame) -> DataFrame:
    """A conversation is a file, its turns are the pages."""
    return shaped(turns.select(F.col("conv_id").cast("string").alias("file_path"), (F.col("turn") + 1).cast("int").alias("page_no"), F.col("text").alias("raw_extract")))


def shaped(pages: DataFrame, dense: bool = False) -> DataFrame:
    """Pages (file_path, page_no, raw_extract) with the columns that all have.

    ``dense`` says that a file's page numbers are 1, 2, 3, ...; its pages then
    need no numbering of their own.
    """
    pages = pages if "method" in pages.columns else pages.withColumn("method", F.lit("text"))
    pages = pages if "skipped" in pages.columns else pages.withColumn("skipped", F.lit(False))
    name = F.regexp_extract("file_path", r"([^/]*)$", 1)
    more = [c for c in ("duration_s",) if c in pages.columns]
    return pages.select("file_path", name.alias("file_name"), F.col("page_no").cast("int"), "method", "skipped", F.coalesce("raw_extract", F.lit("")).alias("raw_extract"), text.clean(F.col("raw_extract")).alias("raw_text"), *more, *([F.col("page_no").alias("__place")] if dense else []))
