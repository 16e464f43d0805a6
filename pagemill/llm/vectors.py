"""Exact metric range join over vectors by cosine similarity.

Pivots partition the vectors: each belongs to the cell of its nearest pivot.
By the triangle inequality, in angles, a vector also visits those cells that
may hold one within the threshold of it, and of two cells only the one of lower
number is visited, so that every pair meets once. Cells are joined apart, in
blocks of bounded size; a block sends out counts and a spanning forest of its
links, never the pairs themselves.

Pairs are screened by a matrix product of unit vectors. Its rounding error is
below ``slack``; pairs that are nearer to the threshold than that are decided
by :func:`cosine`, from the vectors as they are: the correctly rounded sums of
a*b, a*a and b*b, and the double dot / sqrt(aa * bb). A pair whose cosine is the
threshold links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph, store
from .store import worker_task


@dataclass(frozen=True)
class Range:
    """Links have cosine >= ``threshold``, which is above 0.

    ``block_bytes`` bounds the vectors of a cell, in double precision, that one
    task holds; a pivot stands for as many. Vectors that a cell's bounds don't
    keep out visit each of its blocks, so larger blocks move fewer rows. There
    are ``least_pivots`` at least, for parallel work, where each has
    ``least_cell`` vectors. ``most_pivots`` bounds what is broadcast. A length
    that at most ``alone`` vectors have is joined by one task.
    """

    threshold: float = 0.9
    block_bytes: int = 16 << 20
    least_pivots: int = 8
    least_cell: int = 512
    most_pivots: int = 1024
    alone: int = 4096

    def block(self, dim: int) -> int:
        """Vectors of length ``dim`` in a block."""
        return max(2, self.block_bytes // (8 * dim))

    def n_pivots(self, total: int, dim: int) -> int:
        wanted = max(total // self.block(dim), min(self.least_pivots, total // self.least_cell))
        return int(max(1, min(self.most_pivots, wanted)))


def usable(v: str = "embedding") -> Column:
    """Vectors with finite components of which some are not 0."""
    each = F.col(v)
    finite = F.forall(each, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(each.isNotNull() & finite & F.exists(each, lambda x: x != 0), F.lit(False))


def unit(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column in double precision, at length 1.

    Scaling by the largest component first keeps tiny and huge vectors exact.
    """
    flat = raw(column, dim)
    flat = flat / np.abs(flat).max(1, keepdims=True)
    return flat / np.sqrt((flat * flat).sum(1, keepdims=True))


def raw(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def slack(dim: int) -> float:
    """More than the error of a product of unit vectors in double precision."""
    return 1e-12 + 4 * dim * np.finfo(np.float64).eps


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """dot / sqrt(aa * bb) of two vectors, from correctly rounded sums.

    Powers of two are taken out first, which changes no digit, so that nothing
    overflows.
    """
    a, b = (np.ldexp(x, -int(np.frexp(np.abs(x).max())[1])) for x in (a, b))
    dot, aa, bb = (math.fsum((x * y).tolist()) for x, y in ((a, b), (a, a), (b, b)))
    return dot / math.sqrt(aa * bb)


def choose_pivots(sample: np.ndarray, most: int, threshold: float) -> np.ndarray:
    """Sampled vectors, without those that link with an earlier one.

    A dense cluster so gets one pivot or a few, and its vectors don't visit
    many cells that all lie within it.
    """
    out: list[np.ndarray] = []
    for x in sample:
        if len(out) >= most:
            break
        if not out or (np.array(out) @ x).max() < threshold:
            out.append(x)
    return np.array(out)


def visits(x: np.ndarray, pivots: np.ndarray, reach: np.ndarray, least: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each vector, and which cells of lower number it visits.

    Let y be in cell j and link with x of cell i. Then y is not nearer to pivot
    i than to pivot j, so x is at most the threshold's angle away from the half
    space of j, and its angle to pivot j is within that angle of the angles
    that cell j has. The bounds have a margin for rounding: an angle near 0, got
    from a cosine, is off by the square root of the cosine's error.
    """
    dots = x @ pivots.T
    home = dots.argmax(1)
    angle = np.arccos(np.clip(dots, -1, 1))
    theta = math.acos(threshold)
    apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 1e-300))
    margin = 4 * math.sqrt(slack(x.shape[1]))
    near = (dots[np.arange(len(x)), home][:, None] - dots) <= apart[home] * math.sin(theta) + margin
    near &= angle <= reach[None, :] + theta + margin
    near &= angle >= least[None, :] - theta - margin
    near &= np.arange(len(pivots))[None, :] < home[:, None]
    return home, near


class Forest:
    """Components of the vectors that a task holds and meets.

    ``label`` of the held ones is kept as an array, so that a batch of links is
    brought down to the few pairs of different labels at once.
    """

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        self.label = ids.copy()

    def join(self, rows: np.ndarray, others: np.ndarray, both_held: bool) -> tuple[np.ndarray, np.ndarray]:
        """Take in links of held rows with ids; return the edges that join components."""
        up: dict[int, int] = {}

        def find(x: int) -> int:
            root = x
            while (y := up.get(root, root)) != root:
                root = y
            while x != root:
                up[x], x = root, up.get(x, x)
            return root

        left = self.label[rows]
        right = self.label[others] if both_held else others
        # an id that is not held gets the label of the first held row it links with
        pair = np.unique(np.stack([left, right], 1), axis=0)
        a, b = [], []
        for x, y in pair[pair[:, 0] != pair[:, 1]].tolist():
            p, q = find(x), find(y)
            if p != q:
                up[max(p, q)] = min(p, q)
                a.append(x)
                b.append(y)
        if up:
            old, where = np.unique(self.label, return_inverse=True)
            self.label = np.array([find(int(x)) for x in old], np.int64)[where]
        return np.array(a, np.int64), np.array(b, np.int64)


_OUT = "id long, other long, n long"


def _hits(x: np.ndarray, y: np.ndarray, raw_x: np.ndarray, raw_y: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs have a cosine of ``threshold`` at least."""
    dots = x @ y.T
    near = slack(x.shape[1])
    hit = dots >= threshold + near
    for a, b in zip(*np.nonzero((dots >= threshold - near) & ~hit), strict=True):
        hit[a, b] = cosine(raw_x[a], raw_y[b]) >= threshold
    return hit


def _joined(held: tuple, more: tuple | None, threshold: float, forest: Forest) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Links of a block with itself, or with other rows, as (id, other, n).

    Blocks are (ids, unit vectors, weights, vectors as they are). Rows with
    ``other`` null (-1 here) carry the links of a vector, weighted by the copies
    at the other end; the others are edges of the forest.
    """
    ids, x, w, raw_x = held
    ids2, y, w2, raw_y = held if more is None else more
    gain = np.zeros(len(ids), np.int64)
    for k in range(0, len(y), 1024):
        for i in range(0, len(x), 8192):
            hit = _hits(x[i : i + 8192], y[k : k + 1024], raw_x[i : i + 8192], raw_y[k : k + 1024], threshold)
            if more is None:  # the diagonal is no link
                here = np.arange(max(i, k), min(i + len(hit), k + hit.shape[1]))
                hit[here - i, here - k] = False
            rows = np.flatnonzero(hit.any(0))
            if not len(rows):
                continue
            hit = hit[:, rows]
            gain[i : i + len(hit)] += hit @ w2[k + rows]
            if more is not None:
                yield ids2[k + rows], np.full(len(rows), -1), w[i : i + len(hit)] @ hit
            at, c = np.nonzero(hit)
            a, b = forest.join(i + at, k + rows[c] if more is None else ids2[k + rows[c]], more is None)
            if len(a):
                yield a, b, np.zeros(len(a), np.int64)
    some = np.flatnonzero(gain)
    if len(some):
        yield ids[some], np.full(len(some), -1), gain[some]


def _rows(found: Iterator) -> Iterator[pa.RecordBatch]:
    for a, b, n in found:
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64(), mask=b < 0), pa.array(n, pa.int64())], names=["id", "other", "n"])


def _part(batch: pa.RecordBatch, i: int, j: int, dim: int) -> tuple:
    """A block of the rows [i, j) of (id, w, embedding)."""
    vectors = batch.column(2)[i:j]
    return batch.column(0)[i:j].to_numpy(), unit(vectors, dim), batch.column(1)[i:j].to_numpy(), raw(vectors, dim)


def _block(parts: list[tuple]) -> tuple:
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(4))


def small(reps: DataFrame, p: Range) -> DataFrame:
    """(id, other, n) of distinct vectors (id, embedding, w, dim), a block a length."""

    @worker_task("vectors")
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def shut() -> Iterator[pa.RecordBatch]:
            if held:
                block = _block(held)
                yield from _rows(_joined(block, None, p.threshold, Forest(block[0])))

        for batch in batches:
            dim = batch.column(3).to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], dim[1:] != dim[:-1], [True]])) if len(dim) else []
            for i, j in zip(edge, edge[1:], strict=False):
                if dim[i] != at:
                    yield from shut()
                    at, held = dim[i], []
                held.append(_part(batch, i, j, int(dim[i])))
        yield from shut()

    n = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return reps.select("id", "w", "embedding", "dim").repartition(n, "dim").sortWithinPartitions("dim").mapInArrow(join, _OUT)


def links(reps: DataFrame, dim: int, p: Range) -> DataFrame:
    """(id, other, n) of distinct vectors (id, embedding, w) of one length."""
    spark = reps.sparkSession
    total, size = reps.count(), p.block(dim)
    most = p.n_pivots(total, dim)
    sample = reps.orderBy(F.xxhash64("id", F.lit(3)), "id").limit(4 * most).select("embedding").toArrow()
    pivots = choose_pivots(unit(sample.column(0).combine_chunks(), dim), most, p.threshold)
    shared = spark.sparkContext.broadcast(pivots)

    @worker_task("vectors")
    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                dots = unit(batch.column(0), dim) @ shared.value.T
                home = dots.argmax(1)
                angle = np.arccos(np.clip(dots[np.arange(len(home)), home], -1, 1))
                yield pa.RecordBatch.from_arrays([pa.array(home, pa.int32()), pa.array(angle)], names=["home", "angle"])

    cells = reps.select("embedding").mapInArrow(homes, "home int, angle double").groupBy("home")
    cells = cells.agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("far"), F.min("angle").alias("near")).collect()
    reach, least, n_blocks = np.full(len(pivots), -10.0), np.full(len(pivots), 10.0), np.zeros(len(pivots), np.int64)
    for c in cells:
        reach[c.home], least[c.home], n_blocks[c.home] = c.far, c.near, -(-c.n // size)
    first = np.concatenate([[0], np.cumsum(n_blocks * (n_blocks + 1) // 2)])  # tasks of the cells before
    table = spark.sparkContext.broadcast((reach, least, n_blocks, first))

    @worker_task("vectors")
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (task, role): the block that a task holds has role 0."""
        reach, least, n_blocks, first = table.value

        def task_of(cell: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
            # block pairs a <= b of a cell, row by row
            n = n_blocks[cell]
            return first[cell] + a * n - a * (a - 1) // 2 + b - a

        def rows(batch: pa.RecordBatch, at: np.ndarray, task: np.ndarray, role: int) -> pa.RecordBatch:
            take = batch.take(pa.array(at))
            return pa.RecordBatch.from_arrays([pa.array(task, pa.int64()), pa.array(np.full(len(at), role, np.int8)), *take.columns], names=["task", "role", "id", "w", "embedding"])

        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                home, near = visits(unit(batch.column(2), dim), shared.value, reach, least, p.threshold)
                mixed = np.array(batch.column(0).to_numpy()).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                block = (mixed % n_blocks[home].astype(np.uint64)).astype(np.int64)
                for b in range(int(n_blocks[home].max())):
                    low = np.flatnonzero((b >= block) & (b < n_blocks[home]))
                    yield rows(batch, low, task_of(home[low], block[low], np.full(len(low), b)), 0)
                    high = np.flatnonzero(b < block)
                    yield rows(batch, high, task_of(home[high], np.full(len(high), b), block[high]), 1)
                at, cell = np.nonzero(near & (n_blocks > 0)[None, :])
                for b in range(int(n_blocks[cell].max()) if len(cell) else 0):
                    here = np.flatnonzero(b < n_blocks[cell])
                    yield rows(batch, at[here], task_of(cell[here], np.full(len(here), b), np.full(len(here), b)), 1)

    diagonal = np.concatenate([first[c] + np.cumsum([0, *range(n, 1, -1)]) for c, n in enumerate(n_blocks) if n] or [np.empty(0, np.int64)])
    own = spark.sparkContext.broadcast(frozenset(int(x) for x in diagonal))

    @worker_task("vectors")
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at, block, forest = None, None, None

        def shut() -> Iterator[pa.RecordBatch]:
            if held and block is None and at in own.value:
                whole = _block(held)
                yield from _rows(_joined(whole, None, p.threshold, Forest(whole[0])))

        for batch in batches:
            task, role = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            batch = batch.select([2, 3, 4])
            edge = np.flatnonzero(np.concatenate([[True], (task[1:] != task[:-1]) | (role[1:] != role[:-1]), [True]])) if len(task) else []
            for i, j in zip(edge, edge[1:], strict=False):
                part = _part(batch, i, j, dim)
                if task[i] != at:
                    yield from shut()
                    held, at, block = [], task[i], None
                if role[i] == 0:
                    held.append(part)
                    continue
                if block is None and held:
                    block = _block(held)
                    forest = Forest(block[0])
                    if at in own.value:
                        yield from _rows(_joined(block, None, p.threshold, forest))
                if block is not None:
                    yield from _rows(_joined(block, part, p.threshold, forest))
        yield from shut()

    kind = reps.schema["embedding"].dataType.simpleString()
    dealt = reps.select("id", "w", "embedding").mapInArrow(deal, f"task long, role tinyint, id long, w long, embedding {kind}")
    n = max(int(first[-1]), int(spark.conf.get("spark.sql.shuffle.partitions")))
    return dealt.repartition(min(n, 20_000), "task").sortWithinPartitions("task", "role").mapInArrow(join, _OUT)


def near_copies(embeddings: DataFrame, p: Range = Range()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, and neither do rows with a null id, whose component is
    null. Vectors of different lengths never link; lengths that fill a block
    are joined apart, all others in one go. Equal vectors are joined once and
    count as often as they occur; they link with one another. A pair whose
    cosine is the threshold links (see the module on rounding). Rows that
    repeat an id each have a row. An empty table gives an empty result, and
    other columns are ignored, whatever their names.
    """
    emb = F.transform("embedding", lambda x: x + F.lit(0).cast("float"))  # -0.0 becomes 0.0
    rows = embeddings.select("vec_id", emb.alias("embedding"))
    ok = usable() & F.col("vec_id").isNotNull()
    good = rows.where(ok).select("vec_id", "embedding", F.xxhash64(F.lit(1), "embedding").alias("h1"), F.xxhash64(F.lit(2), "embedding").alias("h2"))
    alone = rows.where(~ok).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    with store.scope() as held:
        classes = good.groupBy("h1", "h2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("w"), F.first("embedding").alias("embedding"))
        classes = store.written(classes.withColumn("dim", F.size("embedding")), "classes")
        # a length with more vectors than a block; of these there are few
        sizes = classes.groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
        large = [r.dim for r in sizes.where((F.col("n") > p.alone) | (F.col("n") > F.lit(p.block_bytes) / 8 / F.col("dim"))).orderBy("dim").collect()]
        found = store.written(small(classes.where(~F.col("dim").isin(large)) if large else classes, p), "range")
        for dim in large:
            found = found.union(store.written(links(classes.where(F.col("dim") == dim), dim, p), "range"))
        edges = found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b"))
        summed = found.where("other is null").groupBy("id").agg(F.sum("n").alias("n"))
        placed = graph.components(edges)
        side = classes.select("h1", "h2", "id", "w").join(summed, "id", "left").join(placed.withColumnRenamed("node", "id"), "id", "left")
        side = side.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
        side = held.keep(store.written(side, "placed"))
    out = good.select("vec_id", "h1", "h2").join(side, ["h1", "h2"])
    return out.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept")).union(alone)
