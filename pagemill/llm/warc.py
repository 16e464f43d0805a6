"""WARC archives, compressed record by record with a shared dictionary.

A file begins with a skippable frame (magic number 0x184D2A5D) that holds the
dictionary; a warcinfo record and the page records follow, each a Zstandard
frame of its own. The dictionary is built from a bounded sample of the records.
Pages with equal payloads become one response and revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .store import worker_task

MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:pagemill:page:"


@dataclass(frozen=True)
class Archive:
    """Whole records of ``sample_bytes`` in all, about, make the dictionary of
    ``dictionary_bytes``, a hundred times as many as it holds; a page of more
    than an eighth of that is no sample, though it is archived like all others.

    Payloads of fewer than ``least_bytes`` are never revisits. A file is closed
    when it has ``file_bytes``. Up to ``broadcast_rows`` repeated digests are
    broadcast, of 28 bytes each.
    """

    least_bytes: int = 0
    dictionary_bytes: int = 1 << 16
    sample_bytes: int = 100 << 16
    broadcast_rows: int = 200_000
    file_bytes: int = 8 << 20
    level: int = 3
    date: str = "1970-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record. A revisit has the HTTP head, with the full length, and no body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {uri}"] if uri else []),
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def info(date: str) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    return f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <{URN}info>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def dictionary(samples: list[bytes], most: int) -> bytes:
    """A trained dictionary; the samples themselves where they are too few."""
    whole = b"".join(samples)
    if not whole:
        return b""
    try:
        return zstandard.train_dictionary(min(most, max(1024, len(whole) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return whole[-most:]


def frame(payload: bytes) -> bytes:
    return struct.pack("<II", MAGIC, len(payload)) + payload if payload else b""


def read(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Heads and blocks of the records of one file."""
    begin, held = 0, b""
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == MAGIC:
        begin = 8 + struct.unpack_from("<I", content, 4)[0]
        held = content[8:begin]
    how = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held) if held else None)
    with how.stream_reader(io.BytesIO(memoryview(content)[begin:]), read_across_frames=True) as stream:
        text = io.BufferedReader(stream, 1 << 20)
        while line := text.readline():
            if line != b"WARC/1.1\r\n":
                raise ValueError(f"no record begins with {line[:40]!r}")
            head: dict[str, str] = {}
            while (line := text.readline()) != b"\r\n":
                key, _, value = line.decode().partition(":")
                head[key] = value.strip()
            block = text.read(int(head["Content-Length"]))
            if text.read(4) != b"\r\n\r\n":
                raise ValueError("a record does not end where it should")
            yield head, block


def _id(urn: str | None) -> int | None:
    return int(urn[len(URN) + 1 : -1]) if urn and urn != f"<{URN}>" else None


def page(head: dict[str, str], block: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of a record."""
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    claimed = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if head["WARC-Type"] == "response" and (len(payload) != length or digest(payload) != claimed):
        raise ValueError(f"{head['WARC-Record-ID']} does not have the payload that its head tells")
    return _id(head["WARC-Record-ID"]), length, claimed, head["WARC-Type"], _id(head.get("WARC-Refers-To"))


def decided(pages: DataFrame, how: Archive = Archive()) -> DataFrame:
    """Add ``revisit`` and ``refers_to`` to page_id, url and html.

    Payloads are compared by digest and id alone. Where few digests repeat, they
    are broadcast and no html moves. Beyond that, the revisits are told by a
    join of ids and digests, and pages meet them by both, so that a digest with
    very many pages is dealt over all tasks.
    """
    own = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    own = own.withColumn("digest", F.unhex(F.sha1(F.col("html").cast("binary"))))
    narrow = own.where(F.octet_length("html") >= how.least_bytes).select("page_id", "digest")
    many = narrow.groupBy("digest").agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("n"))
    many = store.written(many.where("n > 1 and owner is not null").select("digest", "owner"), "digests")
    other = ~F.col("page_id").eqNullSafe(F.col("owner"))
    if many.count() <= how.broadcast_rows:
        out = own.join(F.broadcast(many), "digest", "left")
    else:
        again = narrow.join(many, "digest").where(other).distinct()
        again = again.select(F.col("page_id").alias("__id"), F.col("digest").alias("__digest"), "owner")
        out = own.join(again, F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("digest") == F.col("__digest")), "left")
    revisit = F.col("owner").isNotNull() & other & (F.octet_length("html") >= how.least_bytes)
    return out.select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("owner")).alias("refers_to"))


def samples(pages: DataFrame, how: Archive) -> list[bytes]:
    """Whole records of distinct payloads, those with the least digests."""
    size = F.octet_length(F.coalesce("html", F.lit("")))
    narrow = pages.where(size <= how.sample_bytes // 8).select("page_id", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("d"), size.alias("size"))
    once = narrow.groupBy("d").agg(F.max("page_id").alias("id"), F.max("size").alias("size"))
    mean = once.agg(F.avg("size")).first()[0] or 0
    picked = once.orderBy("d").limit(int(how.sample_bytes / (mean + 512)) + 1)
    found = pages.select(F.col("page_id").alias("id"), "url", F.coalesce("html", F.lit("")).alias("html")).where(F.octet_length("html") <= how.sample_bytes // 8)
    found = found.join(F.broadcast(picked.select("id", "d")), "id").where(F.sha1(F.col("html").cast("binary")) == F.col("d"))
    found = found.groupBy("id", "d").agg(F.min(F.struct("html", "url")).alias("r")).orderBy("d")
    out, total = [], 0
    for r in found.toLocalIterator():
        out.append(record(r.id, r.r.url, r.r.html.encode(), None, False, how.date))
        total += len(out[-1])
        if total >= how.sample_bytes:
            break
    return out


def write(pages: DataFrame, how: Archive = Archive()) -> DataFrame:
    """Archive all pages; one row (name, n_records, content) for each file.

    ``content`` is the file as it is on disk (see :func:`export`). A null html
    is an empty payload. Pages that share payload and page_id, being the
    response both, are both written whole; a null page_id revisits another
    page's payload but is referred to by none, and pages of a payload that only
    null ids have are all written whole. A page of many megabytes is one record
    in one batch. An empty table gives no files. Other columns are ignored,
    whatever their names.
    """
    spark = pages.sparkSession
    held = dictionary(samples(pages, how), how.dictionary_bytes)
    shared = spark.sparkContext.broadcast(held)

    @worker_task("warc")
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n_files = TaskContext.get().partitionId(), 0
        words = zstandard.ZstdCompressionDict(shared.value) if shared.value else None
        squeeze = zstandard.ZstdCompressor(level=how.level, dict_data=words)
        begin = frame(shared.value) + squeeze.compress(info(how.date))
        frames, size, n = [begin], len(begin), 0

        def closed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}-{n_files:04d}.warc.zst"]), pa.array([n], pa.int64()), pa.array([b"".join(frames)], pa.binary())], names=["name", "n_records", "content"])

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, revisit, refers_to = (c[i].as_py() for c in batch.columns)
                x = squeeze.compress(record(page_id, url, html.encode(), refers_to, revisit, how.date))
                frames.append(x)
                size, n = size + len(x), n + 1
                if size >= how.file_bytes:
                    yield closed()
                    frames, size, n, n_files = [begin], len(begin), 0, n_files + 1
        if n:
            yield closed()

    return decided(pages, how).mapInArrow(task, "name string, n_records long, content binary")


def read_pages(files: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of archives.

    A file that is damaged raises.
    """
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    @worker_task("warc")
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = [page(h, b) for h, b in read(content.as_py()) if h["WARC-Type"] != "warcinfo"]
                for k in range(0, len(rows), 10_000):
                    columns = zip(*rows[k : k + 10_000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return files.select("content").mapInArrow(task, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def export(files: DataFrame, folder: str) -> None:
    """Write each archive of :func:`write` as a file, from the executors.

    ``folder`` is a path or an address that pyarrow's file systems reach from
    all of them. A file gets its name when it is whole, so that a task that runs
    again leaves none behind that is cut.
    """

    @worker_task("warc")
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(base, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = f"{base}/.{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(content.as_buffer())
                system.move(part, f"{base}/{name}")
            yield batch.select([0])

    files.select("name", "content").mapInArrow(task, "name string").write.format("noop").mode("overwrite").save()


def round_trip(pages: DataFrame, how: Archive = Archive()) -> DataFrame:
    """Write the archives to the shared folder, then read the pages from them."""
    return read_pages(store.written(write(pages, how), "warc", "uncompressed"))
