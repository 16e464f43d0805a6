"""SentencePiece encoding and decoding through a table of distinct chunks.

No piece of the vocabulary has a space behind another character, so no merge
crosses from a word to the space before the next one. A text is cut there: each
chunk is a run of spaces with the word behind it. Documents are dealt over
blocks; a block lists its distinct chunks, the lists of all blocks are dealt
over buckets by the chunk, and a bucket segments each of its chunks once for
the whole corpus. Ids go back to the blocks in the order in which the block
listed its chunks, and there each place of a text gets the ids of its chunk.

Texts cross the network once, chunks and ids once for each block that has them,
all of them in packs that Zstandard has compressed.
All of a block's steps but the segmentation are vectorised.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams
from .store import worker_cache, worker_task

#: SentencePiece's marker of a space, which stands for one in a text, too.
MARKER = "▁"


@dataclass(frozen=True)
class Cut:
    """``block_bytes`` of text make a block; a slice of ``slice_bytes`` is worked on at a time.

    A bucket is a row of each block that has chunks of it; ``most_buckets``
    bounds their number, and with it the number of tasks and of rows.
    """

    block_bytes: int = 16 << 20
    slice_bytes: int = 3 << 20
    bucket_bytes: int = 8 << 20
    most_buckets: int = 20_000
    most_blocks: int = 20_000_000


class Model:
    """The vocabulary, and the segmentation of single chunks."""

    def __init__(self, content: bytes):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=content)
        n = self.sp.get_piece_size()
        names = [self.sp.id_to_piece(i) for i in range(n)]
        for i, name in enumerate(names):
            if not self.sp.is_control(i) and not self.sp.is_byte(i) and MARKER in name.lstrip(MARKER):
                raise ValueError(f"piece {name!r} crosses a space; chunks of this vocabulary are not independent")
        self.space = self.sp.piece_to_id(MARKER)
        plain = lambda i, x: bytes([int(x[3:5], 16)]) if self.sp.is_byte(i) else b"" if self.sp.is_control(i) else x.replace(MARKER, " ").encode()
        #: What each id decodes to, and its decimal text.
        self.bytes = pa.array([plain(i, x) for i, x in enumerate(names)], pa.binary())
        self.decimal = pa.array([str(i) for i in range(n)], pa.string())

    def segment(self, chunks: list[str]) -> list[list[int]]:
        """Ids of chunks, each a run of spaces and a word.

        The library puts a space before every text; so the chunk goes without
        its first one. A single space alone is a piece of its own.
        """
        found = self.sp.encode([c[1:] for c in chunks], num_threads=1)
        return [ids if c != " " else [self.space] for c, ids in zip(chunks, found, strict=True)]


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Chunks of all texts in order, without a copy, and how many each text has.

    Each text but the empty one gets a space before it. Spaces and markers are
    the same to the model.
    """
    texts = pc.replace_substring(texts.cast(pa.large_string()).fill_null(""), MARKER, " ")
    some = pc.binary_length(texts).to_numpy(zero_copy_only=False) > 0
    whole = pc.binary_join_element_wise(pa.array(np.where(some, " ", ""), pa.large_string()), texts, pa.scalar("", pa.large_string()))
    _, where, held = whole.buffers()
    at = np.frombuffer(where, np.int64)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(held, np.uint8)[: at[-1]] if held is not None else np.empty(0, np.uint8)
    space = data == 32
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    begins[at[:-1][some]] = True
    starts = np.flatnonzero(begins)
    counts = np.diff(np.searchsorted(starts, at))
    if not len(starts):
        return pa.array([], pa.large_string()), counts
    ends = np.append(starts, len(data)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(ends), held]), counts


def listed(chunks: list[pa.Array], buckets: int) -> tuple[pa.Array, np.ndarray]:
    """The distinct chunks of a block, by bucket and then by themselves; and their buckets."""
    unique = pa.chunked_array(chunks, pa.large_string()).unique()
    bucket = np.fromiter((zlib.crc32(x.encode()) for x in unique.to_pylist()), np.int64, len(unique)) % buckets
    order = pc.sort_indices(pa.table({"bucket": bucket, "chunk": unique}), sort_keys=[("bucket", "ascending"), ("chunk", "ascending")])
    return unique.take(order), bucket[order.to_numpy()]


def _rows(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each bucket's run of chunks begins, and the ends."""
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    return starts, np.append(starts[1:], len(bucket))


def _blocks(documents: DataFrame, text: str, p: Cut) -> tuple[int, int]:
    """The number of blocks and of buckets, from the bytes of all texts."""
    total = documents.agg(F.sum(F.octet_length(F.col(text)).cast("long"))).first()[0] or 0
    return max(1, min(p.most_blocks, -(-total // p.block_bytes))), max(1, min(p.most_buckets, total // p.bucket_bytes))


def encoded(documents: DataFrame, model_path: str, p: Cut = Cut(), key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every document.

    ``ids`` are little-endian unsigned 32-bit values. With ``digest``,
    ``ids_sha256`` (of the decimal ids, joined by commas) and
    ``decoded_sha256`` stand for the last two. Whole texts are encoded, however
    long; null is the empty text and has no ids. Repeated and null keys give a
    row each. Other columns are not looked at. A table without rows gives none.
    """
    with open(model_path, "rb") as file:
        content = file.read()
    Model(content)  # refuses a vocabulary whose chunks are not independent
    model_of = lambda: worker_cache(("pieces", hashlib.sha1(content).hexdigest()), lambda: Model(content))
    docs = documents.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    blocks, buckets = _blocks(docs, "text", p)
    tasks = min(blocks, 20_000)
    # rows that share an id are dealt by their texts
    dealt = docs.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int")).mapInArrow(worker_task("pieces")(_pack_rows), "block int, pack binary").repartition(tasks, "block")

    @worker_task("pieces")
    def list_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(block: int, parts: list[pa.Array]) -> pa.RecordBatch:
            chunks, bucket = listed(parts, buckets)
            start, end = _rows(bucket)
            size = pc.binary_length(chunks).to_numpy().astype("<u4")
            packed = [_squeezed(size[i:j].tobytes(), b"".join(chunks[i:j].cast(pa.large_binary()).to_pylist())) for i, j in zip(start, end, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array([block] * len(start), pa.int32()), pa.array(bucket[start], pa.int32()), pa.array(packed, pa.binary())], ["block", "bucket", "chunks"])

        held: dict[int, list[pa.Array]] = {}  # a task has few blocks
        waiting: dict[int, int] = {}
        for batch in batches:
            for block, pack in zip(batch.column("block").to_pylist(), batch.column("pack"), strict=True):
                texts = _unpack_rows([pack]).column("text").combine_chunks()
                for i, j, _ in grams.slices(texts, p.slice_bytes):
                    found = cut(texts[i:j])[0].unique()
                    held.setdefault(block, []).append(found)
                    waiting[block] = waiting.get(block, 0) + found.nbytes
                    if waiting[block] > p.block_bytes:  # repeats of earlier slices go
                        held[block] = [pa.chunked_array(held[block]).unique()]
                        waiting[block] = 0
        for block in list(held):
            if any(len(x) for x in held[block]):
                yield rows(block, held.pop(block))

    @worker_task("pieces")
    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of()
        memo: dict[bytes, bytes] = {}  # the distinct chunks of this task's buckets
        for batch in batches:
            each = []
            for sizes, chunks in map(_stretched, batch.column("chunks").to_pylist()):
                ends = np.frombuffer(sizes, "<u4").cumsum().tolist()
                each.append([chunks[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)])
            new = list(dict.fromkeys(c for words in each for c in words if c not in memo))
            for begin in range(0, len(new), 20_000):
                some = new[begin : begin + 20_000]
                memo.update(zip(some, map(_packed, model.segment([c.decode() for c in some])), strict=True))
            found = [[memo[c] for c in words] for words in each]
            yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("bucket"), pa.array([_squeezed(np.fromiter(map(len, x), "<u4", len(x)).tobytes(), b"".join(x)) for x in found], pa.binary())], ["block", "bucket", "ids"])

    def place(texts: pa.Table, answers: pa.Table) -> pa.Table:
        model = model_of()
        texts = _unpack_rows(texts.column("pack"))
        column = texts.column("text").combine_chunks()
        cuts = [(i, j, *cut(column[i:j])) for i, j, _ in grams.slices(column, p.slice_bytes)]
        chunks, _ = listed([c.unique() for _, _, c, _ in cuts], buckets)
        told = [_stretched(x) for x in answers.sort_by("bucket").column("ids").to_pylist()]
        flat, n = _unpacked(b"".join(x for _, x in told), np.frombuffer(b"".join(x for x, _ in told), "<u4").astype(np.int64))
        if len(n) != len(chunks):
            raise ValueError(f"{len(chunks)} chunks have {len(n)} answers")
        ends = np.append(0, n.cumsum()).astype(np.int64)
        of = lambda values: pc.binary_join(pa.LargeListArray.from_arrays(ends, values.take(pa.array(flat))), "," if values is model.decimal else b"")
        decimal, back = of(model.decimal) if digest else None, of(model.bytes)
        out = []
        for i, j, found, counts in cuts:
            code = pc.index_in(found, value_set=chunks).to_numpy(zero_copy_only=False).astype(np.int64)
            at = np.append(0, counts.cumsum()).astype(np.int64)
            sums = np.append(0, n[code].cumsum())
            per_text = lambda values, sep: pc.binary_join(pa.LargeListArray.from_arrays(at, values.take(pa.array(code))), sep)
            decoded = [x[1:] for x in per_text(back, b"").to_pylist()]  # without the space put before the text
            size = pa.array(sums[at[1:]] - sums[at[:-1]], pa.int64())
            if digest:
                new = [pa.array([hashlib.sha256(x).hexdigest() for x in per_text(decimal, ",").cast(pa.large_binary()).to_pylist()], pa.string()), pa.array([hashlib.sha256(x).hexdigest() for x in decoded], pa.string())]
            else:
                ids = [np.concatenate([flat[ends[c] : ends[c + 1]] for c in code[a:b]] or [flat[:0]]).astype("<u4").tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
                new = [pa.array(ids, pa.binary()), pa.array([x.decode("utf-8", "replace") for x in decoded], pa.string())]
            out.append(pa.Table.from_arrays([texts.column("doc_id")[i:j], size, *new], names=names))
        return pa.concat_tables(out)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["doc_id", "n_tokens", "ids", "decoded"]
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string" if digest else "ids binary, decoded string")
    lists = dealt.mapInArrow(list_chunks, "block int, bucket int, chunks binary")
    answers = lists.repartition(min(buckets, 20_000), "bucket").mapInArrow(segment, "block int, bucket int, ids binary")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(place, schema)


def _pack_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, pack) of the rows of each block in a batch or several, compressed."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")

    def packs(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.set_column(rows.schema.get_field_index("text"), "text", rows.column("text").cast(pa.large_string()))
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("block", "ascending")])).combine_chunks()
        block = rows.column("block").to_numpy()
        starts, ends = _rows(block)
        out = []
        for i, j in zip(starts.tolist(), ends.tolist(), strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.drop_columns(["block"]).schema, options=options) as writer:
                writer.write_table(rows.slice(i, j - i).drop_columns(["block"]))
            out.append(sink.getvalue().to_pybytes())
        return pa.RecordBatch.from_arrays([pa.array(block[starts], pa.int32()), pa.array(out, pa.binary())], ["block", "pack"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) > 32 << 20:
            yield packs(pa.Table.from_batches(held))
            held = []
    if any(b.num_rows for b in held):
        yield packs(pa.Table.from_batches(held))


def _unpack_rows(packs) -> pa.Table:
    """The rows of packs; texts are large strings, so that they are one array."""
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in packs])


def _squeezed(lengths: bytes, values: bytes) -> bytes:
    """Lengths of 32 bits and the values behind them, compressed."""
    return len(lengths).to_bytes(4, "little") + zstandard.ZstdCompressor().compress(lengths + values)


def _stretched(data: bytes) -> tuple[bytes, bytes]:
    n, whole = int.from_bytes(data[:4], "little"), zstandard.ZstdDecompressor().decompress(data[4:])
    return whole[:n], whole[n:]


def _packed(ids: list[int]) -> bytes:
    """Ids of a chunk in 16 bits each, or where one needs it 32 bits and a mark."""
    return np.array(ids, "<u2").tobytes() if max(ids) < 65_536 else np.array(ids, "<u4").tobytes() + b"\1"


def _unpacked(data: bytes, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids, and how many each chunk has; odd lengths hold 32-bit values and a mark behind."""
    wide = length % 2 == 1
    if not wide.any():
        return np.frombuffer(data, "<u2").astype(np.int32), length // 2
    ends = length.cumsum()
    parts = [np.frombuffer(data[e - m : e - 1] if w else data[e - m : e], "<u4" if w else "<u2") for e, m, w in zip(ends.tolist(), length.tolist(), wide.tolist(), strict=True)]
    return np.concatenate(parts).astype(np.int32), np.array([len(x) for x in parts], np.int64)


def digests(documents: DataFrame, model_path: str, p: Cut = Cut()) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    return encoded(documents, model_path, p, digest=True)
