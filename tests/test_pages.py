import pytest
from pyspark.sql import functions as F

from pagemill.operators import pages as pg
from pagemill.options import Options, parse
from pagemill.plans.run import page_numbers
from pagemill.sources.adapters import pages_from_documents, shaped


@pytest.fixture(scope="module")
def pages(spark):
    rows = [("d/Jan10.pdf", 1, "One two. Three"), ("d/Jan2.pdf", 1, "cannot"), ("d/Jan2.pdf", 2, "x, y"), ("d/Jan2.pdf", 12, None)]
    return pg.processed(shaped(spark.createDataFrame(rows, "file_path string, page_no int, raw_extract string"))).cache()


def test_fields(pages):
    assert pg.fields(pages).columns == ["Source File Path", "Page Number (File)", "Word Count", "Text", "Raw Text"]
    assert pg.fields(pages, "NPzq").columns == ["Source File Name", "Source File Path"]
    assert pg.fields(pages, "zz", raw=False).columns == ["Source File Path", "Page Number (File)", "Word Count", "Text"]
    assert pg.fields(pages, "tt").columns == ["Text", "Text 2"]
    assert [r["Word Count"] for r in pg.fields(pages, "pfw").orderBy("Source File Path", "Page Number (File)").collect()] == [3, 2, 2, 0]


def test_selection(pages):
    assert page_numbers("1 2 11-14") == {1, 2, 11, 12, 13, 14}
    assert sorted(r.page_no for r in pg.selected(pages, "1 11-14").collect()) == [1, 1, 12]
    assert pg.selected(pages, None) is pages
    with pytest.raises(ValueError, match="not a page"):
        pg.selected(pages, "a-b")


def test_overall_and_custom(pages):
    rows = pg.with_overall(pages).select("page_no_overall", pg.custom("Project-7-File-@-p#").alias("c")).orderBy("page_no_overall").collect()
    assert [tuple(r) for r in rows] == [(1, "Project-7-File-Jan2.pdf-p1"), (2, "Project-7-File-Jan2.pdf-p2"), (3, "Project-7-File-Jan2.pdf-p12"), (4, "Project-7-File-Jan10.pdf-p1")]


def test_rows(pages):
    assert [(r.sentence_no, r.word_count, r.sentence) for r in pg.sentence_rows(pages).where(F.col("file_path").contains("Jan10")).orderBy("sentence_no").collect()] == [(1, 2, "One two."), (2, 1, "Three")]
    assert [(r.word_no, r.word_length, r.word) for r in pg.word_rows(pages).where("page_no = 1 and file_path like '%Jan2%'").orderBy("word_no").collect()] == [(1, 3, "can"), (2, 3, "not")]


def test_stats_add_up(pages):
    files, corpus = pg.file_stats(pages).collect(), pg.corpus_stats(pages).first()
    assert sum(r.page_count for r in files) == corpus.page_count == corpus.page_count_active == 4
    assert sum(r.word_count for r in files) == corpus.word_count == 7
    assert {r.file_path: r.text for r in pg.joined_text(pages).collect()}["d/Jan2.pdf"] == "cannot x, y "


def test_adapter(spark):
    docs = spark.createDataFrame([(5, "b", "s"), (1, "a", "s"), (2, None, "t")], "doc_id long, text string, source string")
    assert sorted((r.file_path, r.page_no, r.raw_text) for r in pages_from_documents(docs).collect()) == [("s", 1, "a"), ("s", 2, "b"), ("t", 1, "")]
    assert pages_from_documents(docs.limit(0)).count() == 0


def test_options():
    o = parse(["x.pdf", "-a", "-p", "1", "3-4", "-r", "-ri", "-ts"])
    assert (o.mode, o.pages, o.scope, o.report_ignore, o.sentences) == ("accelerated", "1 3-4", "corpus", "", True)
    for wrong in (["-a", "-t"], ["-r", "-rp"], ["-ts", "-tw"], ["-po", "-pi"], ["-f", "pc"]):
        with pytest.raises(SystemExit):
            parse(["x.pdf", *wrong])
    with pytest.raises(ValueError, match="exclude"):
        Options("x", quiet=True, verbose=True)
