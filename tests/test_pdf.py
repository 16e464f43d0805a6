import ast
import csv
import zlib

import pytest
from pyspark.sql import functions as F

from pagemill.operators import pages as pg
from pagemill.plans.run import main
from pagemill.sources import pdf, sinks
from pagemill.streaming import ingest


def made(pages, flate=True):
    """A small PDF file with one line of text on each page."""
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(len(pages))) + b"] /Count %d /Resources << /Font << /F1 3 0 R >> >> >>" % len(pages), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    for i, t in enumerate(pages):
        data = b"BT /F1 12 Tf 72 700 Td (" + t.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)").encode("cp1252") + b") Tj ET" if t else b""
        data = zlib.compress(data) if flate else data
        objects.append(b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (5 + 2 * i))
        objects.append(b"<< /Length %d %s>>\nstream\n" % (len(data), b"/Filter /FlateDecode " if flate else b"") + data + b"\nendstream")
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (i, o) for i, o in enumerate(objects, 1)) + b"trailer << /Root 1 0 R >>\n%%EOF"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("pdfs")
    (at / "sub").mkdir()
    (at / "b10.pdf").write_bytes(made(["Page (one) here.", "", "Third, page"]))
    (at / "sub" / "b2.PDF").write_bytes(made(["Été deux"], flate=False))
    (at / ".hidden.pdf").write_bytes(made(["no"]))
    (at / "broken.pdf").write_bytes(b"not a pdf")
    (at / "note.txt").write_text("no")
    return at


def test_reader():
    assert pdf.read_pages(made(["a (b) \\ c", "", "d"])) == ["a (b) \\ c", "", "d"]
    with pytest.raises(pdf.PdfError):
        pdf.read_pages(b"x")
    moved = b"BT /F1 9 Tf (one) Tj 0 -12 Td [(tw) 20 (o) -300 (three)] TJ T* <414243> Tj ET"
    assert pdf.content_text(moved, {}) == "one\ntwo three\nABC"
    names = pdf.to_unicode(b"1 beginbfchar <0001> <0041> endbfchar 1 beginbfrange <0002> <0003> <0042> endbfrange")
    assert pdf.content_text(b"/F Tf <000100020003> Tj", {b"F": (2, names)}) == "ABC"


def test_modes(spark, folder):
    def rows(**options):
        return {(r.file_name, r.page_no): (r.method, r.skipped, r.raw_text) for r in pdf.read(spark, str(folder), **options).collect()}

    whole = rows()
    assert whole[("b10.pdf", 1)] == ("text", False, "Page (one) here.")
    assert whole[("b10.pdf", 2)] == ("ocr", False, "")
    assert whole[("b2.PDF", 1)] == ("text", False, "Ete deux")
    assert len(whole) == 4
    assert rows(mode="accelerated")[("b10.pdf", 2)] == ("ocr", True, "")
    assert rows(mode="thorough", ocr=lambda raw, n: f"seen {n}")[("b10.pdf", 3)] == ("ocr", False, "seen 3")
    assert set(rows(selection={2, 3})) == {("b10.pdf", 2), ("b10.pdf", 3)}

    def fails(raw, n):
        raise OSError

    assert rows(ocr=fails)[("b10.pdf", 2)] == ("ocr", False, "")


def test_wrong_paths(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        pdf.read(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        pdf.read(spark, str(tmp_path))
    assert main([str(tmp_path), "-q"], spark) == 1


def test_run(spark, folder):
    assert main([str(folder), "-r", "-rs", "-st", "-q"], spark) == 0
    raw = folder.with_name(folder.name + ".csv").read_bytes()
    assert raw.count(b"\r\n") == 5
    rows = list(csv.DictReader(raw.decode().splitlines()))
    assert {r["Text"] for r in rows} == {"Page (one) here.", "", "Third, page", "Ete deux"}
    report = folder.with_name(folder.name + "-FR.csv").read_text().splitlines()
    assert report[0] == f"Frequency Report for {folder.name}"
    assert report[1:3] == ["Word,Frequency", "page,2"]


def test_a_file_for_each_source(spark, folder):
    assert main([str(folder), "-tw", "-s", "-q", "-f", "nftr", "-st", "-pn", "-r"], spark) == 0
    head = b"Source File Name,Page Number (File),Word Number,Text,Raw Text\r\n"
    assert (folder / "b10.csv").read_bytes() == head + b"b10.pdf,1,1,Page,Page\r\nb10.pdf,1,2,one,one\r\nb10.pdf,1,3,here,here\r\nb10.pdf,3,1,Third,Third\r\nb10.pdf,3,2,page,page\r\n"
    assert (folder / "sub" / "b2.csv").read_bytes() == head + b"b2.PDF,1,1,Ete,Ete\r\nb2.PDF,1,2,deux,deux\r\n"
    assert (folder / "b10-FR.csv").read_bytes() == b"Frequency Report for b10\r\nWord,Frequency\r\nhere,1\r\none,1\r\npage,2\r\nthird,1\r\n"
    assert (folder / "sub" / "b2-FR.csv").read_bytes() == b"Frequency Report for b2\r\nWord,Frequency\r\ndeux,1\r\nete,1\r\n"
    assert not [p for p in folder.rglob(".*") if p.name != ".hidden.pdf"]  # no stages or attempts stay


def test_totals_without_a_pass_of_their_own(spark, folder, capsys, monkeypatch):
    """Counted behind the last exchange of the written rows; equal to the counts of the pages read again."""
    printed = lambda *a: (capsys.readouterr(), main([str(folder), *a], spark), ast.literal_eval(capsys.readouterr().out))[2]
    expected = pg.corpus_stats(pdf.read(spark, str(folder)).withColumn("text", F.col("raw_text"))).first().asDict()
    assert expected["file_count"] == 2 and expected["page_count"] == 4 and expected["word_count"] == 7
    assert printed("-tw") == expected  # rows of words know nothing of pages without any
    monkeypatch.setattr(pg, "corpus_stats", None)
    assert printed() == expected
    assert printed("-s", "-f", "n", "-st") == expected  # what is not written is counted too
    assert printed("-a")["page_count_skipped"] == 1
    assert printed("-p", "9") == dict.fromkeys(expected, 0)


def test_sections(spark, folder):
    out = folder.with_name(folder.name + "-FR.csv")
    top = f"Frequency Report for {folder.name}"
    b10, b2 = ["here,1", "one,1", "page,2", "third,1"], ["deux,1", "ete,1"]
    assert main([str(folder), "-rf", "-q"], spark) == 0
    assert out.read_bytes() == "".join(f"{x}\r\n" for x in [top, "Frequency Report for b10.pdf", "Word,Frequency", *b10, "Frequency Report for b2.PDF", "Word,Frequency", *b2]).encode()
    assert main([str(folder), "-rf", "-rs", "-rl", "1", "-q"], spark) == 0
    assert out.read_text(newline="").split("\r\n") == [top, "Frequency Report for b10.pdf", "Word,Frequency", "page,2", "Frequency Report for b2.PDF", "Word,Frequency", "ete,1", ""]
    assert main([str(folder), "-rp", "-q"], spark) == 0
    pages = [["Frequency Report for b10.pdf Page 1/3", "Word,Frequency", "here,1", "one,1", "page,1"], ["Frequency Report for b10.pdf Page 2/3", "Word,Frequency"], ["Frequency Report for b10.pdf Page 3/3", "Word,Frequency", "page,1", "third,1"], ["Frequency Report for b2.PDF Page 1/1", "Word,Frequency", *b2]]
    assert out.read_text(newline="").split("\r\n") == [top, *(x for page in pages for x in page), ""]
    assert main([str(folder), "-rp", "-s", "-a", "-q"], spark) == 0  # the page that OCR would read is skipped
    assert (folder / "b10-FR.csv").read_text(newline="").split("\r\n") == ["Frequency Report for b10", *pages[0], *pages[2], ""]


def test_tags_and_kept_edits(spark, folder, tmp_path):
    out = folder.with_name(folder.name + "-FR.csv")
    assert main([str(folder), "-rf", "-rpos", "-q"], spark) == 0
    assert out.read_text(newline="").split("\r\n")[1:5] == ["Frequency Report for b10.pdf", "Word,POS,Frequency", "here,NN,1", "one,NN,1"]
    (tmp_path / "words").write_text("page 4\none 2\nthird 1\n")
    lines = lambda *a: (main([str(folder), "-d", str(tmp_path / "words"), "-pw", "-q", "-f", "t", *a], spark), folder.with_name(folder.name + ".csv").read_text(newline="").split("\r\n"))
    assert lines()[1] == ["Text", "Page( one).", "", '"Third, page"', "", ""]
    assert lines("-daw", "here")[1][1] == "Page( one) here."
    assert lines()[1][1] == "Page( one) here."  # kept by the run before
    assert lines("-dr")[1][1] == "Page( one)."


def test_a_large_file_in_order(spark, tmp_path):
    """One target has nearly all lines, one none; names have signs a URI cannot have."""
    rows = spark.range(40_000).select(F.when(F.col("id") % 1000 == 0, 2).otherwise(1).cast("int").alias("file"), "id", F.format_string("%d,é \u2028\n", "id").alias("line"))
    names = {1: "a b%20#1.csv", 2: "ü?.csv", 3: "none.csv"}
    targets = spark.createDataFrame([(k, f"file://{tmp_path}/{v}") for k, v in names.items()], "file int, target string")
    for _ in range(2):  # again over what is there
        sinks.write_each(rows, targets, ["id"], "h\r\n")
    made = {k: (tmp_path / v).read_bytes() for k, v in names.items()}
    lines = {k: [i for i in range(40_000) if (i % 1000 == 0) == (k == 2)] for k in (1, 2)} | {3: []}
    assert made == {k: ("h\r\n" + "".join(f"{i},é \u2028\n\r\n" for i in lines[k])).encode() for k in names}
    assert sorted(p.name for p in tmp_path.iterdir()) == sorted(names.values())
    sinks.write_each(rows.limit(0), targets.limit(0), ["id"])


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([('a "b", c', 1), (None, 2)], "t string, n int").orderBy("n")
    sinks.write_one(df, str(tmp_path / "x.csv"), "Title, here")
    assert (tmp_path / "x.csv").read_bytes() == b'"Title, here"\r\nt,n\r\n"a ""b"", c",1\r\n,2\r\n'
    sinks.write_csv(df.coalesce(1), str(tmp_path / "y"))
    assert next((tmp_path / "y").glob("part*")).read_bytes().startswith(b't,n\r\n"a ""b"", c",1\r\n')
    assert [sinks.base_name(x) for x in ("a/b.pdf", "a/b/", "c")] == ["b", "b", "c"]


def test_stream(spark, folder, tmp_path):
    counts = ingest.word_counts(ingest.pdf_pages(spark, str(folder)))
    query = counts.writeStream.outputMode("complete").format("memory").queryName("stream_words").option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {r.word: r.freq for r in spark.table("stream_words").collect()}["page"] == 2


def test_thorough_keeps_text_where_ocr_gives_nothing(spark, folder):
    def rows(**options):
        return {(r.file_name, r.page_no): (r.method, r.raw_text) for r in pdf.read(spark, str(folder), mode="thorough", **options).collect()}

    for options in ({}, {"ocr": pdf.tesseract()}, {"ocr": lambda raw, n: " \n"}):
        assert rows(**options)[("b10.pdf", 1)] == ("text", "Page (one) here.")
        assert rows(**options)[("b10.pdf", 2)][0] == "ocr"
