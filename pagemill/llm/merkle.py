"""A Merkle manifest of a data set: every row can be proved to belong to one root.

Rows are hashed where they are read, by SQL functions alone; only digests move.
Leaves get their places in a range sort. A tree is cut into aligned blocks of
``ARITY ** height`` nodes, each of which one task walks in postorder: the
recursion returns the digest of a subtree and, while it unwinds, appends the
digests of the subtree's siblings to every leaf inside. The roots of the blocks
are the nodes of the next distributed walk, until a key has one node left.
No task sees more than a block, and a walk has a ``ARITY ** height``-th of the
rows of the walk before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from . import store

ARITY = 3
#: Levels that one task walks: blocks of 3 ** 7 = 2,187 nodes.
HEIGHT = 7
#: What of a row is hashed, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def _part(c: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(text: Column) -> Column:
    """The digest of a row of documents, with this text, as 32 bytes."""
    parts = [_part(text if c == "text" else F.col(c)) for c in COLUMNS]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, source, leaf, tampered): ``tampered`` is null where a row stays as it is.

    Where 2 divides the crc32 of the decimal id, tampering deletes the text's
    line feeds. Rows without an id are not tampered with.
    """
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.col("text").contains("\n")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", leaf(F.col("text")).alias("digest"), F.when(hit, leaf(F.replace("text", F.lit("\n"), F.lit("")))).alias("tampered"))


def placed(nodes: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Add ``pos``, the place within the key from 0, and ``n``, the key's number of nodes.

    A range sort by key and order deals a frequent key over many tasks; nodes of
    a key are counted by task, and those of earlier tasks are added.
    """
    mask = (1 << 33) - 1
    sort = [F.col(c).asc_nulls_first() for c in (key, *order)]
    held = nodes.repartitionByRange(*sort).sortWithinPartitions(*sort)
    held = store.written(held.select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().bitwiseAND(F.lit(mask)).alias("__i")), name)
    by = W.partitionBy("__key")
    runs = held.groupBy(F.col(key).alias("__key"), F.col("__p").alias("__q")).agg(F.count(F.lit(1)).alias("__n"), F.min("__i").alias("__first"))
    before = F.coalesce(F.sum("__n").over(by.orderBy("__q").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("__key", "__q", (before - F.col("__first")).alias("__shift"), F.sum("__n").over(by).alias("n"))
    out = held.join(runs, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__p") == F.col("__q")))
    return out.withColumn("pos", F.col("__i") + F.col("__shift")).drop("__p", "__i", "__q", "__key", "__shift")


def joined(run: list[bytes]) -> bytes:
    """The digest of a run of nodes: their hexadecimal texts, concatenated."""
    return hashlib.sha256(b"".join(run).hex().encode()).digest()


def levels(n: int) -> int:
    """How often a row of ``n`` nodes is joined until one is left."""
    height, width = 0, 1
    while width < n:
        height, width = height + 1, width * ARITY
    return height


def walk(digests: list[bytes], height: int) -> tuple[bytes, list[bytes]]:
    """The root of a block and, for each of its nodes, the siblings from below up."""
    paths: list[list[bytes]] = [[] for _ in digests]

    def down(low: int, high: int, height: int) -> bytes:
        if height == 0:
            return digests[low]
        step = ARITY ** (height - 1)
        starts = range(low, high, step)
        roots = [down(at, min(at + step, high), height - 1) for at in starts]
        for i, at in enumerate(starts):
            if others := b"".join(roots[:i] + roots[i + 1 :]):
                for j in range(at, min(at + step, high)):
                    paths[j].append(others)
        return joined(roots)

    root = down(0, len(digests), height)
    return root, [b"".join(p) for p in paths]


def _walked(nodes: DataFrame, key: str, height: int) -> DataFrame:
    """Add ``siblings`` within the block and, on its first node, ``block_root``."""
    width = ARITY**height
    block = F.floor(F.col("pos") / F.lit(width)).cast("long")
    dealt = nodes.withColumn("__block", block).repartition(key, "__block").sortWithinPartitions(key, "__block", "pos").drop("__block")
    schema = StructType([*dealt.schema.fields, StructField("siblings", BinaryType()), StructField("block_root", BinaryType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(rows).combine_chunks()
            root, paths = walk(table.column("digest").to_pylist(), min(height, levels(table.column("n")[0].as_py())))
            more = [pa.array(paths, pa.binary()), pa.array([root, *[None] * (len(paths) - 1)], pa.binary())]
            return pa.RecordBatch.from_arrays([*(c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in table.columns), *more], [*table.column_names, "siblings", "block_root"])

        for batch in batches:
            begin = 0
            for at, pos in enumerate(batch.column("pos").to_pylist()):
                if pos % width == 0 and (held or at > begin):  # a block begins
                    if at > begin:
                        held.append(batch.slice(begin, at - begin))
                    yield done(held)
                    held, begin = [], at
            if begin < batch.num_rows:
                held.append(batch.slice(begin))
        if held:
            yield done(held)

    return dealt.mapInArrow(store.worker_task("merkle")(task), schema)


def _risen(nodes: DataFrame, key: str, height: int) -> tuple[DataFrame, DataFrame]:
    """The walked nodes, and (key, block, siblings above, top) of each of their blocks."""
    width = ARITY**height
    below = store.written(_walked(nodes, key, height), "merkle-walked")
    blocks = below.where("block_root is not null").select(key, F.floor(F.col("pos") / F.lit(width)).cast("long").alias("pos"), F.ceil(F.col("n") / F.lit(width)).cast("long").alias("n"), F.col("block_root").alias("digest"))
    if (blocks.agg(F.max("n")).first()[0] or 1) == 1:
        return below, blocks.select(key, F.col("pos").alias("block"), F.lit(b"").alias("above"), F.col("digest").alias("top"))
    return below, _met(*_risen(blocks, key, height), key, height).select(key, F.col("pos").alias("block"), F.concat("siblings", "above").alias("above"), "top")


def _met(below: DataFrame, above: DataFrame, key: str, height: int) -> DataFrame:
    """Nodes with what stands above their blocks; no block has more than its nodes."""
    right = above.withColumnRenamed(key, "__key")
    block = F.floor(F.col("pos") / F.lit(ARITY**height)).cast("long")
    return below.join(right, below[key].eqNullSafe(right["__key"]) & (block == right["block"])).drop("__key", "block")


def fold(digest: bytes, pos: int, n: int, siblings: bytes, at: int = 0) -> tuple[bytes, int]:
    """The root that follows from a node, its place and its siblings; and where these end."""
    while n > 1:
        i = pos % ARITY
        more = min(ARITY, n - pos + i) - 1
        others = siblings[at : at + 32 * more]
        digest = joined([others[: 32 * i], digest, others[32 * i :]])
        pos, n, at = pos // ARITY, -(-n // ARITY), at + 32 * more
    return digest, at


_RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns of the result, from nodes with all that stands above them."""
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    for batch in batches:
        rows = [batch.column(c).to_pylist() for c in ("digest", "tampered", "pos", "n", "siblings", "above", "top", "source_pos", "source_n", "root")]
        out: list[tuple] = []
        for digest, tampered, pos, n, siblings, above, top, source_pos, source_n, root in zip(*rows, strict=True):
            path = siblings + above
            folded, at = fold(tampered or digest, pos, n, path)
            folded, _ = fold(folded, source_pos, source_n, path, at)
            out.append((digest.hex(), top.hex(), root.hex(), hashlib.sha256(path.hex().encode()).hexdigest(), folded.hex(), folded == root))
        columns = [pa.array(c) for c in zip(*out, strict=True)] if out else [*[pa.array([], pa.string())] * 5, pa.array([], pa.bool_())]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)


def manifest(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    Each source is a tree of its own over its rows by ``doc_id``; the subroots,
    by source, are the leaves of the root. A null source is a source like any
    other and comes first; a null id comes first in its source. Rows that share
    an id are ordered by their digests; equal rows are leaves each, in any
    order. Null columns have a text of their own (``-``), which no value has.
    Without rows there is no row. Other columns are not looked at, whatever
    their names.
    """
    found = placed(leaves(docs.select(*COLUMNS)), "source", ["doc_id", "digest"], "merkle-leaves")
    below, above = _risen(found, "source", height)
    above = store.written(above, "merkle-above")  # a row for each block, read twice
    tops = above.where("block = 0").select(F.lit(0).alias("all"), "source", F.col("top").alias("digest"))
    sources = _met(*_risen(placed(tops, "all", ["source"], "merkle-sources"), "all", height), "all", height)
    right = sources.select(F.col("source").alias("__source"), F.col("pos").alias("source_pos"), F.col("n").alias("source_n"), F.concat("siblings", "above").alias("__more"), F.col("top").alias("root"))
    above = above.join(right, above["source"].eqNullSafe(right["__source"])).withColumn("above", F.concat("above", "__more")).drop("__source", "__more")
    return _met(below, above, "source", height).select("doc_id", "digest", "tampered", "pos", "n", "siblings", "above", "top", "source_pos", "source_n", "root").mapInArrow(store.worker_task("merkle")(_folded), _RESULT)


def verified(leaf_hex: str, pos: int, n: int, source_pos: int, source_n: int, siblings: list[str], root: str) -> bool:
    """Whether a leaf with its siblings, from below up, leads to the root: what a reader of the manifest does."""
    path = bytes.fromhex("".join(siblings))
    digest, at = fold(bytes.fromhex(leaf_hex), pos, n, path)
    digest, at = fold(digest, source_pos, source_n, path, at)
    return digest.hex() == root and at == len(path)

