"""A whole run by options: read, process, report, write."""

from __future__ import annotations

import sys
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import process, text
from ..operators import dictionary as dic
from ..operators import pages as pg
from ..operators import report, spelling, tagging
from ..options import Options, parse
from ..sources import lists, pdf, sinks, wiki
from . import dictionaries
from .tables import ensure_checkpoint_dir


def page_numbers(spec: str | None) -> set[int] | None:
    """The numbers of a list like ``1 2 11-14``."""
    if not spec:
        return None
    out: set[int] = set()
    for part in spec.split():
        low, _, high = part.partition("-")
        a, b = int(low), int(high or low)
        out.update(range(min(a, b), max(a, b) + 1))
    return out


def text_step(spark: SparkSession, o: Options) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """The steps before a report is taken, and those after it."""
    before: list[Callable[[Column], Column]] = []
    after: list[Callable[[Column], Column]] = []
    if o.punctuation:
        before.append(process.strip_punctuation)
    if o.numbers:
        before.append(process.strip_digits)
    if o.lowercase:
        before.append(F.lower)
    if o.only is not None:
        words = lists.patterns(spark, o.only or None)
        after.append(lambda c: process.only(c, words))
    if o.ignore is not None:
        words_out = lists.patterns(spark, o.ignore or None, stop=True)
        after.append(lambda c: process.ignore(c, words_out))

    def chained(steps: list) -> Callable[[Column], Column]:
        def run(c: Column) -> Column:
            for step in steps:
                c = step(c)
            return c

        return run

    return chained(before), chained(after)


def processed(pages: DataFrame, o: Options, dictionary: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pages as reports see them, and as they are written, both with ``text``.

    Order: correct or drop unknown words, lemmatise, punctuation, numbers, case,
    then (after the report) only and ignored words.
    """
    pages = pages.withColumn("text", F.col("raw_text"))
    if (o.autocorrect or o.known_words or o.lemmatize or o.corrections) and dictionary is None:
        raise ValueError("a dictionary is needed to correct or lemmatise")
    if o.autocorrect or o.known_words or o.lemmatize:
        pages = pages.withColumn("__key", F.concat_ws("\u0001", "file_path", F.col("page_no").cast("string")))
        rows = pages.select("__key", "text")
        if o.autocorrect:
            rows = spelling.autocorrected(rows, "__key", dictionary, remove=o.known_words)
        elif o.known_words:
            rows = spelling.known_only(rows, "__key", dictionary)
        if o.lemmatize:
            rows = tagging.lemmatized(rows, "__key", dictionary)
        pages = pages.drop("text").join(rows, "__key").drop("__key")
    before, after = text_step(pages.sparkSession, o)
    pages = pages.withColumn("text", before(F.col("text")))
    return pages, pages.withColumn("text", after(F.col("text")))


def content(pages: DataFrame, o: Options) -> DataFrame:
    """The content table: pages, or a row for each sentence or word.

    Behind the columns asked for come ``__file``, ``__page`` and ``__unit``,
    the places by which the rows are ordered, and with pages as rows what their
    totals are counted from.
    """
    letters = o.fields
    if "file_ord" not in pages.columns:
        pages = pg.with_overall(pages)
    places = [F.col("file_ord").cast("int").alias("__file"), F.col("page_no_overall").alias("__page")]
    if not (o.sentences or o.words):
        counts = [c.alias(f"__{x}") for x, c in pg.counted_columns().items()] if {"skipped", "method"} <= set(pages.columns) else []
        return pg.fields(pages, letters, o.custom_text, raw=o.show_raw, more=[*places, F.lit(0).alias("__unit"), *counts])
    unit = "sentence" if o.sentences else "word"
    rows = (pg.sentence_rows_raw if o.sentences else pg.word_rows_raw)(pages)
    extra = pages.drop("text", "raw_text")
    rows = rows.join(extra, ["file_path", "page_no"])
    number = {"sentence": "Sentence Number", "word": "Word Number"}[unit]
    values = {
        "p": F.col("file_path").alias("Source File Path"), "n": F.col("file_name").alias("Source File Name"), "f": F.col("page_no").alias("Page Number (File)"),
        "o": F.col("page_no_overall").alias("Page Number (Overall)"), "w": (F.col("word_count").alias("Word Count") if o.sentences else F.col("word_length").alias("Word Length")),
        "t": F.col(unit).alias("Text"), "r": F.col("raw").alias("Raw Text"), "c": pg.custom(o.custom_text).alias("Custom Text") if o.custom_text is not None else None,
    }
    known = [x for x in letters.lower() if values.get(x) is not None and (x != "r" or o.show_raw)]
    at = max([i for i, x in enumerate(known) if x in "fo"], default=-1) + 1
    columns = [values[x] for x in known]
    columns.insert(at, F.col(f"{unit}_no").alias(number))
    return rows.select(*columns, *places, F.col(f"{unit}_no").alias("__unit"))


def shown_columns(rows: DataFrame) -> list[str]:
    return [c for c in rows.columns if not c.startswith("__")]


def watched(rows: DataFrame, totals: Observation | None) -> DataFrame:
    """Content rows whose totals are counted while they are written.

    To be put behind the last exchange: there a task counts once, however often
    it or an earlier stage is run again, and whatever a sort samples. Files have
    numbers without gaps, so the largest is their count.
    """
    if totals is None:
        return rows
    of = lambda x: F.coalesce(F.sum(F.col(f"__{x}").cast("long")), F.lit(0).cast("long")).alias(x)
    return rows.observe(totals, F.coalesce(F.max("__file").cast("long"), F.lit(0).cast("long")).alias("file_count"), F.count(F.lit(1)).alias("page_count"), *map(of, pg.counted_columns()))


def targets(pages: DataFrame, ending: str) -> DataFrame:
    """(file, target): for each source file, by its place, the file next to it with another ending."""
    spark = pages.sparkSession
    root = sinks.qualified(spark, "/").removesuffix("/")
    path = F.col("file_path")
    whole = F.when(path.rlike("^[a-z][a-z0-9]*://"), path).otherwise(F.concat(F.lit(root), F.regexp_replace(path, "^file:/+|^/+", "/")))
    return pages.select(F.col("file_ord").cast("int").alias("file"), F.concat(F.regexp_replace(whole, "(?i)[.]pdf$", ""), F.lit(ending)).alias("target")).distinct()


def sections(pages: DataFrame, o: Options, name: str) -> DataFrame:
    """The sections of a report by page or file: keys, ``file``, ``section`` and ``title``.

    Without split, all are of file 0 behind a title of the whole; with split,
    each file's are of its own, and a file's own report needs one title only.
    """
    own = F.col("file_ord").cast("int") if o.split else F.lit(0)
    if o.scope == "page":
        last = pages.groupBy(F.col("file_path").alias("__path")).agg(F.count(F.lit(1)).alias("__n"))
        title = F.concat(F.lit("Frequency Report for "), "file_name", F.lit(" Page "), F.col("page_no").cast("string"), F.lit("/"), F.col("__n").cast("string"))
        active = pages.where("not coalesce(skipped, false)") if "skipped" in pages.columns else pages
        return active.join(last, F.col("file_path") == F.col("__path")).select("file_path", "page_no", own.alias("file"), F.col("page_no_overall").alias("section"), title.alias("title"))
    title = F.concat(F.lit("Frequency Report for "), "file_name") if not o.split else F.lit(None).cast("string")
    return pages.select("file_path", own.alias("file"), F.col("file_ord").cast("long").alias("section"), title.alias("title")).distinct()


def write_report(seen: DataFrame, o: Options, name: str) -> None:
    """The report's file, in sections by page or file; with split one for each source, next to it."""
    whole = f"Frequency Report for {sinks.base_name(o.path)}"
    if o.split and o.scope != "page":
        o = replace(o, report=False, report_file=True)
    found = reports(seen, o)
    if o.scope not in ("page", "file"):
        order = [F.desc("freq"), "word"] if o.report_sort else ["word"]
        return sinks.write_one(sinks.report_lines(found, name, order), f"{name}-FR.csv", whole)
    pages = seen if "file_ord" in seen.columns else pg.with_overall(seen)
    parts = sections(pages, o, name)
    lines = sinks.section_lines(found, parts, report.SCOPES[o.scope], o.report_sort)
    if not o.split:
        return sinks.write_one(lines.orderBy(*sinks.SECTION_ORDER).select("line"), f"{name}-FR.csv", whole, raw=True)
    path = F.regexp_replace(F.regexp_extract("file_path", "([^/]*)/*$", 1), "(?i)[.]pdf$", "")
    first = pages.select(F.col("file_ord").cast("int").alias("file"), F.concat(F.lit("Frequency Report for "), path).alias("title")).distinct()
    first = first.select("file", F.lit(-1).cast("long").alias("section"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("least"), F.lit("").alias("word"), sinks.line(first, ["title"]).alias("line"))
    return sinks.write_each(lines.unionByName(first), targets(pages, "-FR.csv"), sinks.SECTION_ORDER)


def reports(pages: DataFrame, o: Options) -> DataFrame:
    """The frequency report of the options: scope, lists, limit and order.

    Reports of pages and files carry their keys; the limit holds in each.
    """
    spark = pages.sparkSession
    keys = report.SCOPES[o.scope or "corpus"]
    if o.report_pos:
        rows = pages.select(F.struct("file_path", "page_no").alias("__page"), "text")
        words = pages.select(F.explode_outer(text.counted_words(F.col("text"))).alias("word")).where("word is not null")
        lexicon = tagging.learned(words.groupBy("word").agg(F.count(F.lit(1)).alias("freq")))
        tagged = tagging.tag_rows(rows, "__page", lexicon).select("__page.*", "token", "pos")
        found, ties = tagging.context_frequency(tagged, keys), ["word", "pos"]
    else:
        counts = report.page_counts(pg.with_overall(pages) if o.scope == "corpus" and "file_ord" not in pages.columns else pages)
        found, ties = (report.first_seen(counts), []) if o.scope == "corpus" else (report.frequency(counts, o.scope, first=True), ["first_seen"])
    if o.report_only is not None:
        found = report.only(found, lists.patterns(spark, o.report_only or None))
    if o.report_ignore is not None:
        found = report.ignored(found, lists.patterns(spark, o.report_ignore or None, stop=True))
    if not ties:
        return report.limited(found, o.report_limit)
    if report.parse_limit(o.report_limit)[0] != "least":
        ensure_checkpoint_dir(spark)
        found = found.checkpoint()  # read twice by a limit
    if keys:
        return report.limited_within(found, keys, o.report_limit, ties)
    return report.limited_within(found.withColumn("__all", F.lit(0)), ["__all"], o.report_limit, ties).drop("__all")


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Command line: read PDF files, write the CSV files the options ask for."""
    o = parse(sys.argv[1:] if arguments is None else arguments)
    spark = spark or SparkSession.builder.appName("pagemill").getOrCreate()
    ocr = pdf.tesseract(o.tesseract or "tesseract", o.language)
    try:
        pages = pdf.read(spark, o.path, o.mode, ocr=ocr, selection=page_numbers(o.pages))
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return 1
    name = o.path.rstrip("/")
    name = name[: -len(".pdf")] if name.lower().endswith(".pdf") else name
    dictionary = None
    if o.dictionary and any(sinks.exists(spark, x) for x in (o.dictionary, o.dictionary.rstrip("/") + dictionaries.KEPT)):
        base = lists.dictionary(spark, o.dictionary) if sinks.exists(spark, o.dictionary) else None
        dictionary = dictionaries.edited(spark, o.dictionary, base, o.dictionary_add, o.dictionary_remove, o.dictionary_revert)
    elif o.dictionary:  # topics, parted by commas; edits hold for this run
        topics = [t.strip() for t in o.dictionary.split(",") if t.strip()]
        dictionary = wiki.topic_dictionary(spark, topics, wiki.http_fetch(), large=True)
        dictionary = dic.add(dictionary, o.dictionary_add) if o.dictionary_add else dictionary
        dictionary = dic.remove(dictionary, o.dictionary_remove.split()) if o.dictionary_remove else dictionary
    if dictionary is not None and not o.dictionary_large:
        dictionary = dic.cap(dictionary)
    ensure_checkpoint_dir(spark)
    pages = pg.with_overall(pages).checkpoint()  # files are opened and recognised once, for all outputs
    seen, shown = processed(pages, o, dictionary)
    rows = content(shown, o)
    columns = shown_columns(rows)
    totals = None if o.quiet or "__word_count" not in rows.columns else Observation()
    if o.split:
        hidden = [c for c in rows.columns if c.startswith("__")]
        lines = rows.select(F.col("__file").alias("file"), *hidden, sinks.line(rows, columns).alias("line"))
        sinks.write_each(lines, targets(shown, ".csv"), ["__page", "__unit"], sinks.quoted(columns) + "\r\n", watch=lambda x: watched(x, totals))
    else:
        sinks.write_one(watched(rows.orderBy("__page", "__unit"), totals).select(*(F.col(f"`{c}`") for c in columns)), f"{name}.csv")
    if o.scope or o.report_pos:
        write_report(seen, o, name)
    if o.corrections:
        keyed = pages.withColumn("text", F.col("raw_text")).withColumn("__key", F.concat_ws("\u0001", "file_path", F.col("page_no").cast("string")))
        log = spelling.correction_log(keyed.select("__key", "text"), "__key", dictionary)
        # pages in their order by number, not as text
        places = pages.select(F.concat_ws("\u0001", "file_path", F.col("page_no").cast("string")).alias("__key"), "page_no_overall")
        log = log.join(places, "__key").orderBy("page_no_overall", "pos").select(F.col("word").alias("Unknown Word"), F.col("attempted").alias("Correction Attempted"), F.col("correction").alias("Correction"), F.col("confidence").alias("Confidence"))
        sinks.write_one(log, f"{name}-corrections.csv")
    if not o.quiet:
        print(pg.with_active(totals.get) if totals else pg.corpus_stats(shown).first().asDict())
    return 0
