"""Mixing sources to target weights by subset-sum budget fitting.

Every document is taken a whole number of times, 0 to ``most_copies``. A source
that has to give T of its S words takes each document floor(T / S) times; which
documents it takes once more is fitted to the remaining budget: documents are
counted by exact length, most of the budget is dealt over the lengths in
proportion, and a bounded-knapsack dynamic programme fills the rest. Of each
length the documents with the smallest seeded hashes are taken.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import store


@dataclass(frozen=True)
class Mix:
    """``weights`` repeat over the sources by code point, null last.

    ``share`` is the part of all words that the mix holds. ``knapsack_words``
    is the budget that the dynamic programme fills after most was dealt, or four
    times the longest document; ``knapsack_bits`` bounds what it keeps where it
    searches all sums of a source.
    ``buckets`` cuts the documents of one source and length, which may be many,
    into parts that are ranked apart.
    """

    weights: tuple[float, ...] = (5, 2, 1)
    share: float = 1.0
    most_copies: int = 3
    seed: int = 42
    knapsack_words: int = 1 << 15
    knapsack_bits: int = 1 << 31
    buckets: int = 64


def n_words(text: str = "text") -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null."""
    blank = F.translate(F.col(text), "\t\n\x0b\x0c\r", "     ")
    return F.coalesce(F.size(F.array_remove(F.split(blank, " "), F.lit(""))), F.lit(0)).cast("long")


def targets(sizes: Sequence[tuple[str | None, int]], mix: Mix = Mix()) -> dict[str | None, float]:
    """Words that each source has to give.

    By weight, but never above ``most_copies`` times a source's size; what that
    leaves over goes to the other sources by weight until none is above.
    """
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: mix.weights[i % len(mix.weights)] for i, (s, _) in enumerate(order)}
    cap = {s: mix.most_copies * n for s, n in order}
    left = mix.share * sum(n for _, n in order)
    found: dict[str | None, float] = {}
    open_ = [s for s, _ in order]
    while open_:
        total = sum(weight[s] for s in open_)
        part = {s: left * weight[s] / total for s in open_}
        full = [s for s in open_ if part[s] > cap[s]]
        if not full:
            return found | part
        for s in full:
            found[s] = float(cap[s])
            left -= cap[s]
        open_ = [s for s in open_ if s not in found]
    return found


def _reached(lengths: np.ndarray, free: np.ndarray, upto: int, wanted: int) -> tuple[int, list[tuple[int, int, int]]]:
    """The sums up to ``upto``, as the bits of an integer, and the steps to them.

    Each length enters in parts of 1, 2, 4, ... copies; a step is (length's
    place, copies, sums before it). No more steps are made once ``wanted`` is reached.
    """
    mask, reach = (1 << (upto + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for i in np.flatnonzero((lengths > 0) & (lengths <= upto) & (free > 0)):
        most, part = min(int(free[i]), upto // int(lengths[i])), 1
        while most:
            c = min(part, most)
            steps.append((int(i), c, reach))
            reach |= (reach << (c * int(lengths[i]))) & mask
            most, part = most - c, part * 2
        if reach >> wanted & 1:
            break
    return reach, steps


def _back(lengths: np.ndarray, steps: list[tuple[int, int, int]], at: int) -> np.ndarray:
    """How many of each length make the sum ``at``."""
    taken = np.zeros(len(lengths), np.int64)
    for i, c, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += c
            at -= c * int(lengths[i])
    return taken


def fill(lengths: np.ndarray, free: np.ndarray, budget: int) -> tuple[np.ndarray, int]:
    """How many of ``free`` documents of each length add up to ``budget`` best, from below.

    A bounded knapsack whose value is its weight. Returns the numbers and their
    sum, the largest that is not above the budget.
    """
    reach, steps = _reached(lengths, free, budget, budget)
    best = reach.bit_length() - 1
    return _back(lengths, steps, best), best


def nearest(lengths: np.ndarray, free: np.ndarray, budget: int) -> tuple[np.ndarray, int]:
    """As :func:`fill`, but the nearest sum, from below or above; of two the lower one."""
    some = lengths[(lengths > 0) & (free > 0)]
    if budget <= 0 or not len(some):
        return np.zeros(len(lengths), np.int64), 0
    step = int(np.gcd.reduce(some))  # sums are its multiples
    small, wanted = lengths // step, round(budget / step)
    reach, steps = _reached(small, free, -(-budget // step) + int(some.max()) // step, wanted)
    middle = budget // step
    low, rest = (reach & ((1 << (middle + 1)) - 1)).bit_length() - 1, reach >> (middle + 1)
    high = middle + (rest & -rest).bit_length() if rest else None
    best = low if high is None or budget - low * step <= high * step - budget else high
    return _back(small, steps, best), best * step


def _dealt(lengths: np.ndarray, n: np.ndarray, rest: int, reserve: int) -> tuple[np.ndarray, int]:
    """Take of all lengths in proportion until about ``reserve`` is left of ``rest``."""
    share = n * (max(0, rest - reserve) / max(1, int((lengths * n).sum())))
    extra = np.minimum(np.floor(share).astype(np.int64), n)
    rest -= int((extra * lengths).sum())
    for i in np.argsort(extra - share, kind="stable"):  # largest fraction first
        if rest - lengths[i] >= reserve and extra[i] < n[i]:
            extra[i] += 1
            rest -= int(lengths[i])
    for i in np.argsort(-lengths, kind="stable"):
        if rest <= 2 * reserve:
            break
        more = min(int(n[i] - extra[i]), int((rest - reserve) // max(1, int(lengths[i]))))
        extra[i] += more
        rest -= more * int(lengths[i])
    return extra, rest


def plan_source(lengths: np.ndarray, n: np.ndarray, target: float, mix: Mix) -> tuple[int, np.ndarray]:
    """Copies of every document, and how many more of each length.

    First each document is taken at most once more, with most of the rest dealt
    in proportion. Where that misses the target by a word or more, any number
    of copies up to ``most_copies`` is open and nothing is dealt before, which
    finds the nearest sum that there is; the sums of a source whose knapsack
    would hold more than ``knapsack_bits`` bits are not searched like that.
    Such a source has many documents, and the first way meets its target unless
    its lengths have a common step, which both ways allow for.
    """
    total = int((lengths * n).sum())
    if not total:
        return 0, np.zeros(len(lengths), np.int64)
    base, want = min(int(target // total), mix.most_copies), round(target)
    rest = want - base * total
    if base == mix.most_copies or rest <= 0:
        return base, np.zeros(len(lengths), np.int64)
    best, miss = np.zeros(len(lengths), np.int64), rest
    longest, half = int(lengths[n > 0].max()), mix.knapsack_words // 2
    for reserve in dict.fromkeys([half, max(half, 2 * longest)]):
        extra, left = _dealt(lengths, n, rest, reserve)
        more, got = nearest(lengths, n - extra, left)
        if abs(left - got) < miss:
            best, miss = extra + more, abs(left - got)
        if not miss:
            return base, best
    free = n * mix.most_copies
    steps = int(np.ceil(np.log2(free[free > 0] + 1)).sum())
    if steps * (want + longest) // int(np.gcd.reduce(lengths[(lengths > 0) & (n > 0)])) <= mix.knapsack_bits:
        any_, got = nearest(lengths, free, want)
        if abs(want - got) < miss:
            return 0, any_
    return base, best


def _keys(df: DataFrame, mix: Mix, size: Column) -> DataFrame:
    """Columns to join and rank on; a null source has a key of its own."""
    h = F.xxhash64(F.lit(mix.seed), F.col("doc_id"))
    return df.withColumns({
        "__key": F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source"))),
        "__size": size,
        "__hash": h,
        "__bucket": F.pmod(h, F.lit(mix.buckets)).cast("int"),
    })


def mixed(documents: DataFrame, mix: Mix = Mix(), columns: Sequence[str] = ("doc_id", "source")) -> DataFrame:
    """``columns`` of all documents with size, source_size, target, copies, taken.

    Needs doc_id, text and source. Documents without words are taken once and
    count nothing. The words that a source gives are the nearest to its target
    that any choice of copies allows (:func:`plan_source`). Rows that repeat an id are ranked side by side; between rows
    that are equal in id, source and length either may be taken. An empty table
    gives an empty result. The list of sources is collected to the driver: it
    is the mix's configuration, one row for each source. The lengths of a
    source go to one task; there are at most sqrt(2 x words) different ones.
    """
    spark = documents.sparkSession
    narrow = _keys(documents.select("doc_id", "source", "text"), mix, n_words())
    narrow = store.written(narrow.drop("text"), "sizes")
    hist = narrow.groupBy("__key", "__size", "__bucket").agg(F.count(F.lit(1)).alias("__n"))
    totals = narrow.groupBy("__key").agg(F.sum("__size").alias("n")).collect()
    sizes = [(None if r["__key"] == "n" else r["__key"][1:], r["n"]) for r in totals]
    wanted = targets(sizes, mix)
    rows = [("n" if s is None else "s" + s, n, float(wanted[s])) for s, n in sizes]
    by_source = spark.createDataFrame(rows, "__key string, source_size long, target double")

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__size")
        base, extra = plan_source(pdf["__size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64), float(pdf["target"].iloc[0]), mix)
        return pd.DataFrame({"__key": pdf["__key"], "__size": pdf["__size"], "source_size": pdf["source_size"], "target": pdf["target"], "__base": base, "__extra": extra, "__docs": pdf["n"]})

    lengths = hist.groupBy("__key", "__size").agg(F.sum("__n").alias("n")).join(by_source, "__key")
    plans = lengths.groupBy("__key").applyInPandas(plan, "__key string, __size long, source_size long, target double, __base long, __extra long, __docs long")
    before = F.sum("__n").over(W.partitionBy("__key", "__size").orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1))
    parts = hist.withColumn("__before", F.coalesce(before, F.lit(0))).join(plans, ["__key", "__size"])
    whole, more = F.floor(F.col("__extra") / F.col("__docs")), F.col("__extra") % F.col("__docs")
    parts = parts.select("__key", "__size", "__bucket", "source_size", "target", (F.col("__base") + whole).alias("__base"), (more - F.col("__before")).alias("__need"))
    own = list(columns)
    if set(own) <= {"doc_id", "source"}:
        rows_ = narrow
    else:
        rows_ = _keys(documents, mix, n_words())
    keys = ["__key", "__size", "__bucket"]
    rows_ = rows_.select(*(F.col(f"`{c}`").alias(f"__own{i}") for i, c in enumerate(own)), *keys, "__hash", F.col("doc_id").alias("__id"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("__hash", "__id"))
    out = rows_.join(parts, keys).withColumn("__rank", rank)
    copies = F.when(F.col("__size") == 0, F.lit(1)).otherwise(F.col("__base") + (F.col("__rank") <= F.col("__need")).cast("long"))
    added = {"size": F.col("__size"), "source_size": F.col("source_size"), "target": F.col("target"), "copies": copies.cast("int"), "taken": F.col("__size") * copies}
    return out.select(*(F.col(f"__own{i}").alias(c) for i, c in enumerate(own) if c not in added), *(v.alias(k) for k, v in added.items()))


def apply(documents: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The documents of the mix: a row for each time that one is taken."""
    own = documents.columns
    keep = documents.withColumn("__row", F.struct(*(F.col(f"`{c}`") for c in own)))
    out = mixed(keep.select("doc_id", "source", "text", "__row"), mix, ["__row"])
    out = out.where("copies > 0").withColumn("__again", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return out.select("__row.*")
