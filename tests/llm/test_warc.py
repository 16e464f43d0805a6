import base64
import hashlib
import struct

import pytest
import zstandard

from pagemill.llm import warc

SCHEMA = "page_id long, url string, html string, record_type string"
ROWS = [(i, f"http://x/{i}", "<p>common</p>" if i % 3 == 0 else f"<p>page {i}</p>" + "common words " * (i % 7), "clash") for i in range(300)]
ROWS += [(900, None, None, "c"), (901, "http://a b\r\nc", "", "c"), (902, "u", "é" * 70_000, "c"), (903, "u", "WARC/1.1\r\n\r\n", "c"), (None, "n", "<p>common</p>", "c"), (None, "n", "alone", "c"), (904, "u", "dup", "c"), (904, "u", "dup", "c")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def expected(least=0):
    by = {}
    for page_id, _, html, _ in ROWS:
        by.setdefault(html or "", []).append(page_id)
    out = []
    for page_id, _, html, _ in ROWS:
        raw = (html or "").encode()
        same = by[html or ""]
        owner = max((x for x in same if x is not None), default=None)
        revisit = len(same) > 1 and owner is not None and page_id != owner and len(raw) >= least
        out.append((page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", owner if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("how", [warc.Archive(), warc.Archive(file_bytes=2000, least_bytes=20), warc.Archive(sample_bytes=0), warc.Archive(broadcast_rows=0)])
def test_round_trip(pages, how):
    assert sorted((tuple(r) for r in warc.round_trip(pages, how).collect()), key=repr) == expected(how.least_bytes)


def test_file_layout(pages):
    files = warc.write(pages).collect()
    assert sum(f.n_records for f in files) == len(ROWS)
    for f in files:
        magic, size = struct.unpack_from("<II", f.content)
        assert magic == warc.MAGIC
        held = zstandard.ZstdCompressionDict(f.content[8 : 8 + size])
        first = zstandard.ZstdDecompressor(dict_data=held).decompressobj()
        text = first.decompress(f.content[8 + size :])
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        assert first.unused_data  # every record is a frame of its own


def test_damage_is_seen():
    good = warc.record(1, "u", b"payload", None, False, "1970-01-01T00:00:00Z")
    content = zstandard.ZstdCompressor().compress(good)
    ((head, block),) = warc.read(content)
    assert warc.page(head, block)[:2] == (1, 7)
    with pytest.raises(ValueError, match="does not have the payload"):
        warc.page(head, block.replace(b"payload", b"pAyload"))
    with pytest.raises(ValueError, match="no record begins"):
        list(warc.read(zstandard.ZstdCompressor().compress(b"x\r\n" + good)))


def test_export_and_empty(pages, tmp_path):
    warc.export(warc.write(pages), str(tmp_path))
    names = list(tmp_path.glob("*.warc.zst"))
    assert sum(1 for n in names for h, _ in warc.read(n.read_bytes()) if h["WARC-Type"] != "warcinfo") == len(ROWS)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_html_moves_for_no_page_that_stands_alone(pages):
    plan = warc.decided(pages)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_samples_are_whole_records(pages):
    how = warc.Archive(sample_bytes=20_000)
    held = warc.samples(pages, how)
    assert 10_000 <= sum(map(len, held)) < 24_000
    assert all(b"\r\n\r\n" in x for x in held)
    assert warc.samples(pages, warc.Archive(sample_bytes=0)) == [] or sum(map(len, warc.samples(pages, warc.Archive(sample_bytes=0)))) < 1000
