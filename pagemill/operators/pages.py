"""Pages, sentences and words as rows; fields; statistics by file and corpus."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..plans.tables import ensure_checkpoint_dir, numbered, ranked

#: Output columns by their letters.
FIELDS = {
    "p": "Source File Path",
    "n": "Source File Name",
    "f": "Page Number (File)",
    "o": "Page Number (Overall)",
    "w": "Word Count",
    "d": "Page Processing Duration (s)",
    "t": "Text",
    "s": "Process Timestamp",
    "r": "Raw Text",
    "c": "Custom Text",
}
DEFAULT_FIELDS = "pfwtr"


def processed(pages: DataFrame, step=None) -> DataFrame:
    """Add ``text``, by default the cleaned text; a step maps Column to Column."""
    raw = F.col("raw_text")
    return pages.withColumn("text", step(raw) if step else raw)


def selected(pages: DataFrame, spec: str | None) -> DataFrame:
    """Pages of a list like ``1 2 11-14``, counted from 1; all without a list."""
    if not spec:
        return pages
    pages = pages.drop("__place")  # the pages left have other places
    keep = F.lit(False)
    for part in spec.split():
        if not (m := re.fullmatch(r"(\d+)(?:-(\d+))?", part)):
            raise ValueError(f"not a page or range of pages: {part}")
        low, high = int(m[1]), int(m[2] or m[1])
        keep = keep | F.col("page_no").between(min(low, high), max(low, high))
    return pages.where(keep)


def with_overall(pages: DataFrame) -> DataFrame:
    """Add ``page_no_overall``: files in natural order, pages within.

    Files are ranked, one row each, and the pages of earlier files are added to
    the page's own place; no task sorts the pages of the corpus. The place is
    ``__place`` where pages carry it, else it is counted by ranges of page
    numbers, so that no task sorts a file, either.
    """
    if "__place" not in pages.columns:
        pages = numbered(pages, "file_path", "page_no", "__place")
    files = pages.groupBy("file_path").agg(F.count(F.lit(1)).alias("__n"))
    order = ranked(files.withColumn("__key", text.natural_key(F.col("file_path"))), ["__key", "file_path"], "__file")
    before = F.coalesce(F.sum("__n").over(W.orderBy("__file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    order = order.select(F.col("file_path").alias("__path"), "__file", before.alias("__before"))
    out = pages.join(order, F.col("file_path").eqNullSafe(F.col("__path")))
    return out.withColumn("page_no_overall", (F.col("__place") + F.col("__before")).cast("long")).withColumnRenamed("__file", "file_ord").drop("__path", "__before", "__place")


def file_order(pages: DataFrame) -> DataFrame:
    """(file_ord, file_path, n_pages): the files in natural order, from 1."""
    files = pages.groupBy("file_path").agg(F.count(F.lit(1)).alias("n_pages"))
    return ranked(files.withColumn("__key", text.natural_key(F.col("file_path"))), ["__key", "file_path"], "file_ord").select("file_ord", "file_path", "n_pages")


def n_words(column: str = "raw_text") -> Column:
    return F.size(text.words(F.col(column)))


def custom(template: str) -> Column:
    """A text with # for the page in its file, $ for the overall page, @ for the name.

    All marks are replaced in one pass, so that one in a file name stays.
    """
    marks = {"#": F.col("page_no").cast("string"), "@": F.col("file_name")}
    if "$" in template:
        marks["$"] = F.col("page_no_overall").cast("string")
    parts = [marks.get(x, F.lit(x)) for x in re.split(r"([#$@])", template) if x]
    return F.concat(*parts) if parts else F.lit("")


def fields(pages: DataFrame, letters: str = DEFAULT_FIELDS, template: str | None = None, raw: bool = True, more: Sequence[Column] = ()) -> DataFrame:
    """Output columns in the order of the letters; repeats get a number behind.

    Unknown letters are dropped, and without a known one the default holds.
    ``more`` are columns that go behind them.
    """
    known = [x for x in letters.lower() if x in FIELDS and (x != "c" or template is not None)] or list(DEFAULT_FIELDS)
    if not raw:
        known = [x for x in known if x != "r"]
    values = {
        "p": F.col("file_path"), "n": F.col("file_name"), "f": F.col("page_no"), "o": F.col("page_no_overall") if "page_no_overall" in pages.columns else None,
        "w": n_words(), "d": F.format_number(F.col("duration_s"), 3) if "duration_s" in pages.columns else F.lit(None).cast("string"), "t": F.col("text"), "s": F.date_format(F.current_timestamp(), "EEE MMM d HH:mm:ss yyyy"), "r": F.col("raw_text"), "c": custom(template) if template is not None else None,
    }
    out, seen = [], {}
    for x in known:
        seen[x] = seen.get(x, 0) + 1
        out.append(values[x].alias(FIELDS[x] if seen[x] == 1 else f"{FIELDS[x]} {seen[x]}"))
    return pages.select(*out, *more)


def sentence_rows(pages: DataFrame) -> DataFrame:
    """One row a sentence, with its number in the page and its own word count."""
    out = pages.select("file_path", "page_no", F.posexplode(text.counted_sentences(F.col("text"))).alias("__pos", "__s"))
    return out.select("file_path", "page_no", (F.col("__pos") + 1).alias("sentence_no"), "__s.word_count", "__s.sentence")


def word_rows(pages: DataFrame) -> DataFrame:
    """One row a word, with its number in the page and its length."""
    out = pages.select("file_path", "page_no", F.posexplode_outer(text.words(F.col("text"))).alias("__pos", "word")).where("word is not null")
    return out.select("file_path", "page_no", (F.col("__pos") + 1).alias("word_no"), F.length("word").alias("word_length"), "word")


def sentence_rows_raw(pages: DataFrame) -> DataFrame:
    """The rows of :func:`sentence_rows`, each with the raw text's sentence of the same number in ``raw``.

    The processed text says how many rows there are; where the raw text has
    fewer sentences, they are null.
    """
    rows = pages.select("file_path", "page_no", F.posexplode(text.sentences_beside(F.col("text"), F.col("raw_text"))).alias("__pos", "__x"))
    return rows.select("file_path", "page_no", (F.col("__pos") + 1).alias("sentence_no"), F.size(text.words(F.col("__x.text"))).alias("word_count"), F.col("__x.text").alias("sentence"), F.col("__x.raw").alias("raw"))


def word_rows_raw(pages: DataFrame) -> DataFrame:
    """The rows of :func:`word_rows`, each with the raw text's word of the same number in ``raw``, or null."""
    names = ["file_path", "page_no", "word_no", "word_length", "word", "raw"]
    kinds = [*(pages.schema[c].dataType.simpleString() for c in names[:2]), "int", "int", "string", "string"]
    rows = pages.select("file_path", "page_no", "text", "raw_text")
    return rows.mapInArrow(lambda batches: text.word_batches(batches, names), ", ".join(f"{c} {kind}" for c, kind in zip(names, kinds, strict=True)))


def counted_columns() -> dict[str, Column]:
    """What a page adds to the counts of its file and corpus, besides itself."""
    return {"page_count_skipped": F.coalesce(F.col("skipped"), F.lit(False)).cast("int"), "page_count_ocr": F.coalesce(F.col("method") == "ocr", F.lit(False)).cast("int"), "page_count_text": F.coalesce(F.col("method") != "ocr", F.lit(False)).cast("int"), "word_count": n_words()}


def file_stats(pages: DataFrame) -> DataFrame:
    """Pages, skipped, read by OCR and as text, and words of each file."""
    return pages.groupBy("file_path").agg(F.count(F.lit(1)).alias("page_count"), *(F.sum(c.cast("long")).alias(x) for x, c in counted_columns().items()))


def corpus_stats(pages: DataFrame) -> DataFrame:
    """The same over all files, with the pages that were not skipped."""
    files = file_stats(pages)
    total = files.agg(F.count(F.lit(1)).alias("file_count"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("page_count", *counted_columns())))
    return total.withColumn("page_count_active", F.col("page_count") - F.col("page_count_skipped"))


def with_active(totals: dict[str, int]) -> dict[str, int]:
    """Totals that were counted elsewhere, with the pages that were not skipped."""
    return totals | {"page_count_active": totals["page_count"] - totals["page_count_skipped"]}


#: Characters that a part of a file's text has, but for the page that it ends with.
PART = 1 << 20


def file_text(pages: DataFrame, size: int = PART) -> DataFrame:
    """(file_path, part, text): a file's pages in order, joined by a space, in bounded parts.

    A page belongs to the part in which it begins, counted in characters from
    the file's beginning; parts in order, joined by a space, are the file's
    text. Parts may be missing where a page is longer than one. No task holds a
    file: lengths are added up by ranges of pages, and only lengths are sorted.
    Pages are made once, and kept as a checkpoint for both passes.
    """
    ensure_checkpoint_dir(pages.sparkSession)
    pages = pages.select("file_path", "page_no", "text").checkpoint()
    lengths = pages.select("file_path", "page_no", (F.length("text") + 1).cast("long").alias("__n")).checkpoint()
    by = W.partitionBy("file_path", "__range")
    lengths = lengths.withColumn("__range", F.floor(F.col("page_no") / F.lit(10_000)))
    sums = lengths.groupBy("file_path", "__range").agg(F.sum("__n").alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(W.partitionBy("file_path").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(F.col("file_path").alias("__path"), F.col("__range").alias("__r"), before.alias("__start"))
    own = F.coalesce(F.sum("__n").over(by.orderBy("page_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at = lengths.withColumn("__own", own).join(starts, F.col("file_path").eqNullSafe(F.col("__path")) & (F.col("__range") == F.col("__r")))
    at = at.select("__path", F.col("page_no").alias("__page"), F.floor((F.col("__start") + F.col("__own")) / F.lit(size)).cast("long").alias("part"))
    met = pages.join(at, F.col("file_path").eqNullSafe(F.col("__path")) & (F.col("page_no") == F.col("__page")))
    rows = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    return met.groupBy("file_path", "part").agg(F.array_join(F.transform(rows, lambda r: r["text"]), " ").alias("text"))


def joined_text(pages: DataFrame, letters: Sequence[str] = ("file_path",)) -> DataFrame:
    """The text of each file, its pages in order joined by a space.

    A file's whole text is one value and so has to fit one task.
    """
    rows = F.array_sort(F.collect_list(F.struct("page_no", "text")))
    return pages.groupBy(*letters).agg(F.array_join(F.transform(rows, lambda r: r["text"]), " ").alias("text"))
