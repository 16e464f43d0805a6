"""Exact Jaccard join over sets of word shingles, with set-relation skipping.

Texts with equal sets are one class. What follows only serves to find all links
between classes without ever comparing all pairs of a group:

1. A sieve, before the join. A set that links with another shares 75% of its
   shingles with it, so of any choice of its shingles all but a quarter of the
   set occur in some other set. Shingles in a fixed part of the hash space are
   dealt by hash, in packed arrays that each task has sorted and reduced to one
   entry a shingle; sets with too many shingles of their own link with nothing.
   What passes is asked again, later, for shingles in sets of another component.
   The sieve answers nothing else; all links come from 2 and 3.
2. Highly similar sets. Sets are grouped by their least shingle under some
   permutations, and each is compared with the leader of its group. Large
   groups are split and their leaders meet in a next level. A set that links
   takes over the leader's component; one that shares ``close`` percent follows
   the leader, and is not indexed: its answers are derived.
3. The index. The rarest shingles of each set that follows none (prefix filter,
   longer by what followers can add) have lists, whose entries of equal size and
   position are blocks; blocks that cannot hold an answer are skipped whole
   (:mod:`pagemill.llm.relations`). Long lists are split, and their parts meet in
   tasks of their own. The sets of a pair that remains are compared exactly, and
   the answers of their followers derived from theirs by the difference of the
   sets. Before that, for some rounds, a few pairs of each two components that
   meet in a list are compared; where one links, the others are answered.

Shingles are 64-bit hashes and classes 128 bits; two different ones are taken
for one with a chance of about 2**-64 a pair, and no regular text brings that
about (see :mod:`pagemill.llm.grams`).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import graph, grams, relations, store
from .store import worker_task


_ENTRY = ["id", "component", "n", "lo", "hi", "slack"]


@dataclass(frozen=True)
class Join:
    """Links need ``100 * intersection >= percent * union``.

    ``region`` is the part of the hash space that the first sieve looks at,
    ``permutations`` the number of groupings by least shingle, ``group`` the
    sets that are compared with one leader before a group is split, ``rounds``
    and ``tries`` the rounds and pairs for which two components are tried first,
    ``cell_tokens`` the shingles that a sieve's task sorts at once. A set that
    shares ``close`` percent with its leader follows it. ``list_part`` is the
    number of entries of a list that two tasks' parts are made of. Where an
    entry meets ``dense`` others of its list or fewer on average, nothing is
    tried first: the lists themselves are no dearer, and the links are the same.
    """

    k: int = 5
    percent: int = 75
    region: float = 0.4
    permutations: int = 4
    group: int = 200
    rounds: int = 1
    tries: int = 32
    cell_tokens: int = 1_000_000
    close: int = 95
    list_part: int = 8192
    dense: int = 64


def least_shared(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a set of ``n`` shares with any set that it links with."""
    return -(-n * percent // 100)


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays[0])], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def _unpack(content: bytes, *kinds: type) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(content)
    n, at, out = int(np.frombuffer(raw[:8], np.int64)[0]), 8, []
    for kind in kinds:
        size = n * np.dtype(kind).itemsize
        out.append(np.frombuffer(raw[at : at + size], kind))
        at += size
    return out


def text_sets(texts: grams.Texts, k: int) -> list[np.ndarray]:
    """The set of every text of a slice, as sorted hashes."""
    doc, h = grams.shingles(texts, k)
    order = np.argsort(doc, kind="stable")
    cut = np.searchsorted(doc[order], np.arange(texts.n + 1))
    h = h[order]
    return [np.unique(h[i:j]) for i, j in zip(cut, cut[1:], strict=False)]


def _signature(s: np.ndarray) -> tuple[int, int]:
    a = grams.mix(s).sum(dtype=np.uint64)
    b = grams.mix(s + np.uint64(0xABCDEF12345)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _cells(tokens: list[np.ndarray], owner: list[int], region: float, n_cells: int) -> Iterator[tuple[int, bytes]]:
    """The shingles of a chunk of sets by cell, one or two entries a shingle.

    An entry has the shingle, 32 bits of its owner under a hash that differs
    from shingle to shingle, and the first set in the chunk that has it, or -1
    where sets of several owners do; then a second entry tells another owner.
    """
    if not tokens:
        return
    t = np.concatenate(tokens)
    index = np.repeat(np.arange(len(tokens), dtype=np.int32), [len(x) for x in tokens])
    if region < 1:
        held = t < np.uint64(int(region * 2**64))
        t, index = t[held], index[held]
    if not len(t):
        return
    own = np.array(owner, np.int64).astype(np.uint64)[index]
    own = (grams.mix(own ^ t) >> np.uint64(32)).astype(np.uint32)
    order = np.argsort(t, kind="stable")
    t, index, own = t[order], index[order], own[order]
    first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    low, high = np.minimum.reduceat(own, first), np.maximum.reduceat(own, first)
    index = np.where(low == high, index[first], np.int32(-1))
    t = t[first]
    two = np.flatnonzero(low != high)
    t = np.concatenate([t, t[two]])
    index = np.concatenate([index, index[two]])
    own = np.concatenate([low, high[two]])
    cell = np.minimum((t.astype(np.float64) * (n_cells / (region * 2.0**64))).astype(np.int64), n_cells - 1)
    order = np.lexsort((t, cell))
    cell, t, index, own = cell[order], t[order], index[order], own[order]
    cut = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
    for i, j in zip(cut, cut[1:], strict=False):
        gap = np.diff(t[i:j], prepend=np.uint64(0))
        yield int(cell[i]), _pack(gap, own[i:j], index[i:j])


def _alone(rows: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """Of one cell: for each chunk how many shingles its sets have for themselves."""
    parts = [_unpack(p, np.uint64, np.uint32, np.int32) for _, p in rows]
    t = np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in parts])
    own = np.concatenate([p[1] for p in parts])
    order = np.argsort(t, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], t[order][1:] != t[order][:-1]]))
    single = np.minimum.reduceat(own[order], first) == np.maximum.reduceat(own[order], first)
    alone = np.empty(len(t), bool)
    alone[order] = np.repeat(single, np.diff(np.append(first, len(t))))
    at = 0
    for (chunk, _), p in zip(rows, parts, strict=True):
        index = p[2][alone[at : at + len(p[2])]]
        at += len(p[2])
        index, n = np.unique(index[index >= 0], return_counts=True)
        if len(index):
            yield chunk, _pack(index.astype(np.int32), n.astype(np.int32))


_ROW = "chunk long, cell int, payload binary"


def _row(chunk: list[int], cell: list[int], payload: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), pa.array(cell, pa.int32()), pa.array(payload, pa.binary())], names=["chunk", "cell", "payload"])


def _grouped(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[tuple[int, list[tuple]]]:
    """Runs of rows with an equal value in column ``key``."""
    at, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and row[key] != at:
                yield at, rows
                rows = []
            at = row[key]
            rows.append(row)
    if rows:
        yield at, rows


#: Tasks of a shuffle, at most; a task then has several cells, one after another.
MOST_TASKS = 20_000
#: Bytes of rows that are broadcast, at most.
MOST_BROADCAST = 64 << 20
#: Tasks that the rows of a hot key are dealt over where broadcast is out.
SALTS = 64


def sieve(chunks: DataFrame, n_cells: int) -> DataFrame:
    """(id, n, s1, s2, m, alone) of every set in rows made by :func:`_chunked`.

    ``m`` counts a set's shingles in the region, ``alone`` those that no set of
    another owner has. Of sets in one chunk with equal owner and shingles only
    the first is counted; the others have 0.
    """

    @worker_task("sets")
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell, rows in _grouped(batches, 1):
            if cell < 0:
                yield _row([r[0] for r in rows], [-1] * len(rows), [r[2] for r in rows])
            else:
                for chunk, payload in _alone([(r[0], r[2]) for r in rows]):
                    yield _row([chunk], [0], [payload])

    @worker_task("sets")
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _grouped(batches, 0):
            head = [r for r in rows if r[1] < 0][0]
            id_, known, n, s1, s2, m = _unpack(head[2], np.int64, np.uint8, np.int64, np.int64, np.int64, np.int64)
            alone = np.zeros(len(n), np.int64)
            for _, cell, payload in rows:
                if cell >= 0:
                    index, count = _unpack(payload, np.int32, np.int32)
                    alone[index] += count
            yield pa.RecordBatch.from_arrays([pa.array(id_, mask=known == 0), *map(pa.array, (n, s1, s2, m, alone))], names=["id", "n", "s1", "s2", "m", "alone"])

    n_parts = min(n_cells, MOST_TASKS)
    # a chunk's own row has a negative cell, dealt by its chunk
    dealt = F.when(F.col("cell") < 0, -1 - F.pmod("chunk", F.lit(n_parts))).otherwise(F.col("cell"))
    cells = chunks.repartition(n_parts, dealt).sortWithinPartitions("cell", "chunk").mapInArrow(reduce, _ROW)
    return cells.repartition(n_parts, "chunk").sortWithinPartitions("chunk", "cell").mapInArrow(gather, "id long, n long, s1 long, s2 long, m long, alone long")


def _chunked(sets: Iterator[tuple[int | None, int, np.ndarray]], region: float, n_cells: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows of a partition's sets (id, owner or None for the set's own signature, shingles)."""
    from pyspark import TaskContext

    base, number = TaskContext.get().partitionId() << 24, 0
    ids, owner, held, size = [], [], [], 0
    limit = np.uint64(min(int(region * 2**64), 2**64 - 1))

    def closed() -> Iterator[pa.RecordBatch]:
        signed = [_signature(s) for s in held]
        n = np.array([len(s) for s in held], np.int64)
        m = np.array([np.searchsorted(s, limit) if region < 1 else len(s) for s in held], np.int64)
        head = _pack(np.array([x or 0 for x in ids], np.int64), np.array([x is not None for x in ids], np.uint8), n, np.array([s[0] for s in signed], np.int64), np.array([s[1] for s in signed], np.int64), m)
        yield _row([base + number], [-1], [head])
        for cell, payload in _cells(held, [s[0] if o is None else o for o, s in zip(owner, signed, strict=True)], region, n_cells):
            yield _row([base + number], [cell], [payload])

    for id_, o, s in sets:
        ids.append(id_)
        owner.append(o)
        held.append(s)
        size += len(s)
        if size >= most:
            yield from closed()
            number += 1
            ids, owner, held, size = [], [], [], 0
    if ids:
        yield from closed()


def marked(documents: DataFrame, p: Join) -> DataFrame:
    """(id, n, s1, s2, maybe) of every document, by the first sieve, written.

    ``s1, s2`` are 128 bits that stand for the set. ``maybe`` is false only for
    sets that link with no other.
    """
    chars = documents.agg(F.sum(F.length("text"))).first()[0] or 0
    n_cells = int(chars / 6 * p.region) // p.cell_tokens + 1

    @worker_task("sets")
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sets() -> Iterator[tuple[int | None, None, np.ndarray]]:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                for i, j, texts in grams.slices(batch.column(1)):
                    for id_, s in zip(ids[i:j], text_sets(texts, p.k), strict=True):
                        yield id_, None, s

        yield from _chunked(sets(), p.region, n_cells, p.cell_tokens)

    chunks = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(task, _ROW)
    own = F.col("n") - F.ceil(F.col("n") * p.percent / 100)  # shingles that may be a set's own
    found = sieve(chunks, n_cells).withColumn("maybe", (F.col("n") > 0) & (F.col("alone") <= own))
    return store.written(found.select("id", "n", "s1", "s2", "maybe"), "marks")


def sets_of(documents: DataFrame, wanted: DataFrame, p: Join) -> DataFrame:
    """(id, n, shingles) of the documents in ``wanted`` (id, s1), written."""

    @worker_task("sets")
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, signs = batch.column(0), batch.column(2).to_numpy()
            for i, j, texts in grams.slices(batch.column(1)):
                found = text_sets(texts, p.k)
                same = [k for k, s in enumerate(found) if _signature(s)[0] == signs[i + k]]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([i + k for k in same], pa.int64())), pa.array([len(found[k]) for k in same], pa.int64()), pa.array([found[k].tobytes() for k in same], pa.binary())], names=["id", "n", "shingles"])

    own = documents.select(F.col("doc_id").cast("long").alias("id"), "text").join(wanted.select("id", "s1"), "id")
    return store.written(own.select("id", "text", "s1").mapInArrow(task, "id long, n long, shingles binary"), "sets", "lz4")


def _met(left: DataFrame, right: DataFrame, key: str, how: str = "inner", sizes: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right``, in which ``key`` is unique.

    Rows of hot keys stay where they are and get the rows of ``right`` that they
    need by broadcast, if these have less than ``MOST_BROADCAST`` bytes; else
    they are dealt by key and salt, and the rows of ``right`` go to every salt.
    All others are dealt by key. A key is hot that more than a thousandth of the
    rows have, so there are less than a thousand of them.
    ``sizes`` has (key, __n), where that is known. What is given is read more
    than once and should be a table.
    """
    n = left.groupBy(key).agg(F.count(F.lit(1)).alias("__n")) if sizes is None else sizes
    total, most = n.where(F.col(key).isNotNull()).agg(F.sum("__n"), F.max("__n")).first()
    limit = max((total or 0) / 1000, 1000)
    if (most or 0) <= limit:
        return left.join(right, key, how)
    hot = [r[0] for r in n.where(F.col(key).isNotNull() & (F.col("__n") > limit)).select(key).collect()]
    many, few = left.where(F.col(key).isin(hot)), right.where(F.col(key).isin(hot))
    wide = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in right.dtypes if kind in ("binary", "string")]
    size = few.agg(F.sum(sum(wide, F.lit(8 * len(right.columns)).cast("long")))).first()[0] or 0
    if size <= MOST_BROADCAST:
        warm = many.join(F.broadcast(few), key, how)
    else:
        salted = many.withColumn("__salt", F.pmod(F.xxhash64(*many.columns), F.lit(SALTS)))
        spread = few.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
        warm = salted.join(spread, [key, "__salt"], how).drop("__salt")
    cold = left.where(~F.coalesce(F.col(key).isin(hot), F.lit(False))).join(right, key, how)
    return cold.unionByName(warm)


_LED = "key long, a long, b long, linked boolean, close boolean, extra int"


def led(sets: DataFrame, p: Join) -> DataFrame:
    """Sets b and the leaders a of their groups, whether they link, whether they
    are close, and how many shingles b has that a has not; written.

    Groups have an equal least shingle under a permutation. A group of more
    than ``group`` sets is split by hash, and the leaders of its parts form a
    group of the next level.
    """

    @worker_task("sets")
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = grams.constants(77, p.permutations)
        for batch in batches:
            ids = batch.column(0)
            least = np.empty((batch.num_rows, p.permutations), np.uint64)
            for k, content in enumerate(batch.column(1)):
                s = np.frombuffer(content.as_buffer(), np.uint64)
                for r in range(p.permutations):
                    least[k, r] = grams.mix(s * salt[r]).min() ^ salt[r]
            for r in range(p.permutations):
                yield pa.RecordBatch.from_arrays([ids, pa.array(least[:, r].astype(np.int64))], names=["id", "key"])

    @worker_task("sets")
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leader, first = None, 0, np.empty(0, np.uint64)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32())
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for key, part, id_, content in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), strict=True):
                s = np.frombuffer(content.as_buffer(), np.uint64)
                if (key, part) != at:
                    at, leader, first = (key, part), id_, s.copy()
                n, m = len(first), len(s)
                both = relations.common(first, s) if id_ != leader and 100 * min(n, m) >= p.percent * max(n, m) else 0
                row = (key, leader, id_, relations.linked(both, n, m, p.percent), relations.linked(both, n, m, max(p.close, p.percent)), m - both)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=["key", "a", "b", "linked", "close", "extra"])

    level = store.written(sets.select("id", "shingles").mapInArrow(keys, "id long, key long").distinct(), "keys")
    found = None
    while True:
        sizes = level.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        sizes = store.written(sizes, "sizes")
        rows = _met(level, sizes, "key", sizes=sizes.select("key", F.col("size").alias("__n")))
        rows = rows.withColumn("part", F.pmod(F.xxhash64("id", F.lit(5)), F.ceil(F.col("size") / p.group)).cast("int"))
        rows = rows.join(sets.select("id", "shingles"), "id").select("key", "part", "id", "shingles")
        done = rows.repartition("key", "part").sortWithinPartitions("key", "part", "id").mapInArrow(compare, _LED)
        done = store.written(done, "led")
        links = done.where("linked").select("a", "b", "close", "extra")
        found = links if found is None else found.union(links)
        leaders = done.where("a = b").select(F.col("a").alias("id"), "key")
        again = store.written(leaders.groupBy("key").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1"), "again")
        if again.isEmpty():
            return found
        level = store.written(_met(leaders, again.select("key"), "key", sizes=again).select("id", "key"), "keys")


def grouped(left: DataFrame, near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hosts (id, component, n, lo, hi, slack, shingles), and (host, members).

    ``left`` has the sets (id, component, n, shingles), ``near`` close pairs
    (a, b, extra). A set that has a close leader follows the smallest one that
    itself follows none; all others are hosts. A host leads ``group`` sets for
    each permutation and level at most, so its members fit one row.
    """
    ids = left.select("id", "n")
    near = near.join(ids.select(F.col("id").alias("a")), "a", "left_semi").join(ids.select(F.col("id").alias("b")), "b", "left_semi")
    near = store.written(near, "near")
    follow = near.join(near.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
    follow = follow.groupBy(F.col("b").alias("id")).agg(F.min(F.struct("a", "extra")).alias("f"))
    follow = store.written(follow.select("id", F.col("f.a").alias("host"), F.col("f.extra").alias("extra")), "follow")

    @worker_task("sets")
    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            minus, plus = [], []
            for own, host in zip(batch.column(1), batch.column(2), strict=True):
                y, x = np.frombuffer(own.as_buffer(), np.uint64), np.frombuffer(host.as_buffer(), np.uint64)
                minus.append(np.setdiff1d(x, y, True).tobytes())
                plus.append(np.setdiff1d(y, x, True).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(minus, pa.binary()), pa.array(plus, pa.binary())], names=["host", "minus", "plus"])

    both = follow.join(left.select("id", F.col("shingles").alias("own")), "id")
    both = both.join(left.select(F.col("id").alias("host"), "shingles"), "host").select("host", "own", "shingles")
    members = both.mapInArrow(differ, "host long, minus binary, plus binary")
    members = store.written(members.groupBy("host").agg(F.collect_list(F.struct("minus", "plus")).alias("members")), "members")
    span = follow.join(ids, "id").groupBy("host").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("extra").alias("most"))
    hosts = left.join(follow.select("id"), "id", "left_anti").join(span.withColumnRenamed("host", "id"), "id", "left")
    hosts = hosts.select("id", "component", "n", F.least("n", "low").alias("lo"), F.greatest("n", "high").alias("hi"), F.coalesce("most", F.lit(0)).cast("long").alias("slack"), "shingles")
    return store.written(hosts, "hosts", "lz4"), members


def listed(entries: DataFrame, p: Join) -> DataFrame:
    """Pairs (a, ca, b, cb) of entries (token, id, component, lo, hi, slack, left, parts)
    that meet in a list and can belong to linked sets.

    A list of several parts has a task for each two of them.
    """
    names = ["token", "i", "j", "side", "id", "component", "lo", "hi", "slack", "left"]

    @worker_task("sets")
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def pairs(columns: tuple, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
            a, ca, b, cb = columns[4][x], columns[5][x], columns[4][y], columns[5][y]
            swap = ca > cb
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            ca, cb = np.where(swap, cb, ca), np.where(swap, ca, cb)
            rows = np.unique(np.stack([a, ca, b, cb], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(4)], names=["a", "ca", "b", "cb"])

        def met(rows: tuple) -> Iterator[pa.RecordBatch]:
            token, i, j, side, _, component, lo, hi, slack, left = rows
            first = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
            length = np.diff(np.append(first, len(token)))
            brief = (length <= relations.SHORT) & (i[first] == j[first])
            x, y = relations.short_pairs(first[brief], length[brief], lo, hi, slack, left, component, p.percent)
            if len(x):
                yield pairs(rows, x, y)
            for at in np.flatnonzero(~brief & (length > 1)):
                s = slice(first[at], first[at] + length[at])
                part = tuple(c[s] for c in rows)
                sides = None if i[first[at]] == j[first[at]] else side[s]
                for x, y in relations.block_pairs(lo[s], hi[s], slack[s], left[s], component[s], p.percent, sides):
                    yield pairs(part, x, y)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = tuple(batch.column(k).to_numpy() for k in range(len(names)))
            if held:
                rows = tuple(np.concatenate([h[k] for h in held] + [rows[k]]) for k in range(len(names)))
            # the last list may go on in the next batch
            changes = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]) | (rows[2][1:] != rows[2][:-1]))
            cut = int(changes[-1]) + 1 if len(changes) else 0
            if cut:
                yield from met(tuple(r[:cut] for r in rows))
            held = [tuple(r[cut:] for r in rows)]
        if held:
            yield from met(held[0])

    own = F.pmod(F.xxhash64("id", F.lit(9)), F.col("parts")).cast("int")
    dealt = entries.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("token", F.least("own", "other").cast("int").alias("i"), F.greatest("own", "other").cast("int").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), *names[4:])
    return dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j").mapInArrow(meet, "a long, ca long, b long, cb long").distinct()


def crossed(sets: DataFrame, near: DataFrame, p: Join) -> DataFrame:
    """Links (a, b) that join sets of different components.

    ``sets`` has (id, component, n, shingles), ``near`` close pairs. First the
    second sieve, then the index over the hosts of what it leaves. A link of
    followers is told by their hosts, which are in the same components.
    """
    total = sets.agg(F.sum("n")).first()[0] or 0
    n_cells = total // p.cell_tokens + 1

    @worker_task("sets")
    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int, np.ndarray]]:
            for batch in batches:
                for id_, component, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                    yield id_, component, np.frombuffer(content.as_py(), np.uint64)

        yield from _chunked(rows(), 1.0, n_cells, p.cell_tokens)

    @worker_task("sets")
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                t = np.frombuffer(batch.column(6)[i].as_buffer(), np.int64)
                own = [pa.array(np.full(len(t), batch.column(k)[i].as_py(), np.int64)) for k in range(6)]
                yield pa.RecordBatch.from_arrays([pa.array(t), *own], names=["token", *_ENTRY])

    spare = F.col("n") - F.ceil(F.col("n") * p.percent / 100)
    packed = sets.select("id", "component", "shingles").mapInArrow(chunk, _ROW)
    open_ = sieve(packed, n_cells).where(F.col("alone") <= spare).select("id")
    left = store.written(sets.join(open_.distinct(), "id"), "open", "lz4")
    hosts, members = grouped(left, near)
    tokens = hosts.select(*_ENTRY, "shingles").mapInArrow(spread, "token long, id long, component long, n long, lo long, hi long, slack long")
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.min("component").alias("c1"), F.max("component").alias("c2"))
    shared = store.written(shared.where("c1 < c2").select("token", "df"), "tokens")
    inside = W.partitionBy("id", "n")
    entries = _met(tokens, shared, "token", sizes=shared.select("token", F.col("df").alias("__n")))
    entries = entries.withColumn("place", F.row_number().over(inside.orderBy("df", "token")) - 1)
    # a set's own shingles come first in the order, and count in its prefix
    entries = entries.withColumn("left", F.count(F.lit(1)).over(inside) - F.col("place"))
    # the least that hosts share whose groups link: a partner has from percent to
    # 100 / percent of the size, and its followers add at most `rate` of theirs
    rate = (100 - max(p.close, p.percent)) / max(p.close, p.percent)
    factor = min(p.percent / 100 * (1 - rate), 1 - rate * 100 / p.percent)
    least = F.ceil(F.col("lo") * F.lit(max(0.0, factor)) - 1e-9) - F.col("slack")
    entries = entries.where(F.col("left") >= F.greatest(least, F.lit(1)))
    entries = entries.withColumn("parts", F.ceil(F.col("df") / p.list_part))
    entries = store.written(entries.select("token", *_ENTRY, "left", "parts"), "index")
    own = hosts.select("id", "shingles").join(members.withColumnRenamed("host", "id"), "id", "left")
    own = store.written(own, "own", "lz4")
    found = []
    meets = shared.agg(F.sum(F.col("df").cast("double") * F.col("df")) / F.sum("df")).first()[0] or 0
    for r in range(p.rounds if meets > p.dense else 0):
        # of each list one set a component, to compare with that of the largest one
        one = entries.groupBy("token", "component").agg(F.count(F.lit(1)).alias("m"), F.min_by("id", F.xxhash64("id", "token", F.lit(r))).alias("id"))
        one = store.written(one, "ones")
        hub = store.written(one.groupBy("token").agg(F.max(F.struct("m", "component", "id")).alias("hub"), F.count(F.lit(1)).alias("__n")).where("__n > 1"), "hubs")
        meet = _met(one, hub.drop("__n"), "token", sizes=hub.select("token", "__n")).where("component <> hub.component")
        meet = meet.select(F.col("hub.id").alias("a"), F.col("hub.component").alias("ca"), F.col("id").alias("b"), F.col("component").alias("cb"))
        # and of each two components a few such pairs
        h = F.xxhash64("a", "b", F.lit(r))
        few = meet.groupBy("ca", "cb", F.pmod(h, F.lit(p.tries)).alias("try")).agg(F.min(F.struct(h.alias("h"), "a", "b")).alias("p"))
        links = _compared(store.written(few.select("p.a", "ca", "p.b", "cb").distinct(), "few"), own, p)
        found.append(links)
        entries = store.written(_relabelled(entries, links, "component"), "index")
    pairs = store.written(listed(entries, p), "pairs")
    found.append(_compared(pairs, own, p))
    return functools.reduce(DataFrame.union, found).select("a", "b")


def _relabelled(df: DataFrame, links: DataFrame, column: str) -> DataFrame:
    """``df`` with the components in ``column`` joined as ``links`` (ca, cb) tells."""
    if links.isEmpty():
        return df
    known = graph.components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    known = known.where("node <> component").select(F.col("node").alias("__from"), F.col("component").alias("__to"))
    known = store.written(known.withColumnRenamed("__from", column), "merged")
    out = _met(df, known, column, "left")
    return out.select(*(F.coalesce("__to", c).alias(c) if c == column else F.col(c) for c in df.columns))


def _compared(pairs: DataFrame, sets: DataFrame, p: Join) -> DataFrame:
    """Those of the pairs of hosts (a, ca, b, cb) whose groups link, written.

    ``pairs`` is a table, ``sets`` one of (id, shingles, members).
    """

    def group(shingles: pa.Scalar, members: pa.Scalar) -> relations.Group:
        differ = [tuple(np.frombuffer(m[k], np.uint64) for k in ("minus", "plus")) for m in members.as_py() or []]
        return relations.Group(np.frombuffer(shingles.as_buffer(), np.uint64), differ)

    @worker_task("sets")
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = [relations.groups_link(group(sa, ma), group(sb, mb), p.percent) for sa, ma, sb, mb in zip(*(batch.column(k) for k in range(4, 8)), strict=True)]
            kept = pa.array(hit, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(kept) for k in range(4)], names=["a", "ca", "b", "cb"])

    both = _met(pairs, sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"), F.col("members").alias("ma")), "a")
    both = _met(both, sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"), F.col("members").alias("mb")), "b", sizes=pairs.groupBy("b").agg(F.count(F.lit(1)).alias("__n")))
    return store.written(both.select("a", "ca", "b", "cb", "sa", "ma", "sb", "mb").mapInArrow(compare, "a long, ca long, b long, cb long"), "links")


def components(documents: DataFrame, p: Join = Join()) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document.

    Null and empty texts and texts without words have no shingles and link with
    nothing. Rows with a null id belong to the class of their text, and to no
    component (null) where no row with an id has it. Rows that repeat an id are
    placed each by its own text. A pair whose similarity is the limit links. A
    very long text is one slice of its own and one set, whose shingles a task
    holds at once. Other columns are ignored, whatever their names. An empty
    table gives an empty result.
    """
    with store.scope() as held:
        marks = held.keep(marked(documents.select("doc_id", "text"), p))
        classes = marks.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("id").alias("rep"), F.min("maybe").alias("maybe"))
        wanted = classes.where("maybe and rep is not null").select(F.col("rep").alias("id"), "s1")
        sets = sets_of(documents, wanted, p)
        links = led(sets, p)
        first = links.select("a", "b")
        known = graph.components(first)
        placed = sets.join(known.select(F.col("node").alias("id"), "component"), "id", "left")
        placed = placed.withColumn("component", F.coalesce("component", "id"))
        more = crossed(placed.select("id", "component", "n", "shingles"), links.where("close").select("a", "b", "extra"), p)
        # what is joined so far is a star for each component, and the new links come to it
        stars = known.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
        found = known if more.isEmpty() else graph.components(stars.union(more))
        classes = classes.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
        classes = classes.select(F.concat_ws(" ", "n", "s1", "s2").alias("set"), F.coalesce("component", "rep").alias("component"))
        classes = held.keep(store.written(classes, "classes"))
    some = marks.where("n > 0").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.concat_ws(" ", "n", "s1", "s2").alias("set"))
    copies = some.groupBy("set").agg(F.count(F.lit(1)).alias("__n"))
    # null where only rows with a null id have the set
    out = _met(some, classes, "set", sizes=copies).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    return out.union(marks.where("n = 0").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("id").alias("component_id")))


def keep_first(documents: DataFrame, p: Join = Join()) -> DataFrame:
    """One document of each component, the one with the smallest id.

    Documents without shingles and those with a null id all stay, and so do
    rows that repeat a kept id.
    """
    kept = components(documents.select("doc_id", "text"), p).where("doc_id = component_id").select("doc_id").distinct()
    named = documents.join(kept, "doc_id", "left_semi")
    return named.unionByName(documents.where("doc_id is null")).select(*(F.col(f"`{c}`") for c in documents.columns))
