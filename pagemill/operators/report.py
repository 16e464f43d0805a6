"""Word-frequency reports by page, file and corpus; limits and orders."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..plans.tables import ensure_checkpoint_dir, ranked

#: Keys of a report's scope.
SCOPES = {"page": ["file_path", "page_no"], "file": ["file_path"], "corpus": []}


def page_counts(pages: DataFrame, limit: str = "") -> DataFrame:
    """(file_path, page_no, word, freq, first_no) of every page.

    A page is a row and is counted where it is, so that no row of a token and no
    page's counts are shuffled; everything else is aggregated from this table.
    ``first_no`` is the place in the page where the word first occurs.
    ``page_no_overall`` is kept if there is one. With a limit, as
    :func:`limited` has them, each page keeps only the words within it.
    """
    keys = [c for c in ("file_path", "page_no", "page_no_overall", "file_ord") if c in pages.columns]
    counted = text.word_counts(F.col("text"), _picked(limit))
    return pages.select(*keys, F.explode(counted).alias("__w")).select(*keys, "__w.*")


#: Different words that a task holds before it sends them on.
_HELD = 300_000


def corpus_counts(rows: DataFrame, column: str = "text") -> DataFrame:
    """(word, freq) of all texts, for reports that need no place: each task adds up its own first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for value in batch.column(0):
                held.update(value.as_py().split(" "))
                if len(held) > _HELD:
                    yield from batches_of(held)
        yield from batches_of(held)

    def batches_of(held: Counter[str]) -> Iterator[pa.RecordBatch]:
        held.pop("", None)
        words, freqs = list(held), list(held.values())
        for k in range(0, len(words), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[k : k + 50_000], pa.string()), pa.array(freqs[k : k + 50_000], pa.int64())], names=["word", "freq"])
        held.clear()

    joined = rows.select(F.coalesce(text.counted_text(F.col(column)), F.lit("")).alias("words"))
    return joined.mapInArrow(count, "word string, freq long").groupBy("word").agg(F.sum("freq").alias("freq"))


def _picked(limit: str):
    """What a limit leaves of a page's (word, freq) in the order of first occurrence."""
    kind, n = parse_limit(limit)
    if (kind, n) == ("percent", 100):
        return None

    def pick(counts: list[tuple[str, int]]) -> list[tuple[str, int]]:
        if kind == "least":
            return [c for c in counts if c[1] >= n]
        falling = sorted(counts, key=lambda c: -c[1])  # stable: ties stay in order
        if kind == "top":
            return falling[:n]
        bound, before = math.ceil(n / 100 * sum(f for _, f in counts)), 0
        for i, (_, freq) in enumerate(falling):
            if before >= bound:
                return falling[:i]
            before += freq
        return falling

    return pick


def _place(page: str) -> Column:
    """A page's number and the place in it as one long that sorts as both do: a text has less than 2 ** 30 words."""
    return F.shiftleft(F.col(page).cast("long"), 30).bitwiseOR(F.col("first_no").cast("long"))


def frequency(counts: DataFrame, scope: str = "corpus", first: bool = False) -> DataFrame:
    """(scope's keys, word, freq): counts of pages added up.

    With ``first``, also ``first_seen``, a number that sorts as the page and the
    place in it where the word first occurs within the scope.
    """
    keys = SCOPES[scope]
    if scope == "page":  # is added up already
        return counts.select(*keys, "word", "freq", *([_place("page_no").alias("first_seen")] if first else []))
    more = [F.min(_place("page_no")).alias("first_seen")] if first else []
    return counts.groupBy(*keys, "word").agg(F.sum("freq").alias("freq"), *more)


def last_wins(counts: DataFrame, scope: str = "corpus") -> DataFrame:
    """The count of the last page that has the word, instead of a sum."""
    keys = SCOPES[scope]
    return counts.groupBy(*keys, "word").agg(F.max_by("freq", "page_no_overall").alias("freq"))


def first_seen(counts: DataFrame) -> DataFrame:
    """(word, freq, first_seen): a number that sorts as the places where words occur first.

    Needs ``page_no_overall``, the place of the page in the natural order of files.
    """
    return counts.groupBy("word").agg(F.sum("freq").alias("freq"), F.min(_place("page_no_overall")).alias("first_seen"))


CHRONOLOGICAL = ["first_seen"]


def ordered(report: DataFrame, by: str = "alpha") -> DataFrame:
    """The report with ``rank``: by word, by frequency, or by first occurrence."""
    order = {"alpha": ["word"], "freq": [F.desc("freq"), *CHRONOLOGICAL], "chron": CHRONOLOGICAL}[by]
    return ranked(report, order).select("rank", "word", "freq")


def only(report: DataFrame, words: Sequence[str]) -> DataFrame:
    """Words of the list, in any case. The list is written by hand and small."""
    return report.where(F.col("word").isin(sorted({w.lower() for w in words})))


def ignored(report: DataFrame, words: Sequence[str]) -> DataFrame:
    return report.where(~F.col("word").isin(sorted({w.lower() for w in words}))) if words else report


def parse_limit(limit: str) -> tuple[str, int]:
    """``N%``, ``N+`` or ``N`` as (percent | least | top, N); else all of it."""
    kept = re.sub(r"[^0-9%+]", "", limit or "")
    if m := re.fullmatch(r"(\d+)%", kept):
        return "percent", min(100, int(m[1]))
    if m := re.fullmatch(r"(\d+)\+", kept):
        return "least", int(m[1])
    if m := re.fullmatch(r"(\d+)", kept):
        return "top", int(m[1])
    return "percent", 100


def least_frequency(report: DataFrame, n: int) -> DataFrame:
    return report.where(F.col("freq") >= n)


def top(report: DataFrame, n: int) -> DataFrame:
    """The ``n`` most frequent words; ties go by first occurrence."""
    return report.orderBy(F.desc("freq"), *CHRONOLOGICAL).limit(n)


def percentile(report: DataFrame, percent: int) -> DataFrame:
    """Words by falling frequency while the total before is under the percentage.

    The bound is ceil(percent / 100 * total) in double arithmetic. Words of
    equal frequency form one row of a small table on which the running total is
    taken; only the words of the frequency at which it ends are ordered.
    """
    ensure_checkpoint_dir(report.sparkSession)
    report = report.checkpoint()  # a row for each word; it is read four times
    total = report.agg(F.sum("freq")).first()[0] or 0
    bound = math.ceil(percent / 100 * total)
    groups = report.groupBy("freq").agg(F.sum("freq").alias("sum"))
    before = F.coalesce(F.sum("sum").over(W.orderBy(F.desc("freq")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    edge = groups.withColumn("before", before).where(F.col("before") < bound).orderBy("freq").first()
    if edge is None:
        return report.limit(0)
    need = -(-(bound - edge["before"]) // edge["freq"])
    last = report.where(F.col("freq") == edge["freq"]).orderBy(*CHRONOLOGICAL).limit(need)
    return report.where(F.col("freq") > edge["freq"]).unionByName(last)


def _edges(report: DataFrame, keys: Sequence[str], kind: str, n: int) -> DataFrame:
    """(keys, __edge, __need): of each scope the frequency at which it is cut, and how many words of it stay.

    Running sums go over a histogram, a row for each frequency of a scope, of
    which a scope of m words has at most sqrt(2 m).
    """
    by = W.partitionBy(*keys)
    down = by.orderBy(F.desc("freq")).rowsBetween(W.unboundedPreceding, -1)
    groups = report.groupBy(*keys, "freq").agg(F.count(F.lit(1)).alias("__words"), F.sum("freq").alias("__sum"))
    if kind == "top":
        size, bound = F.col("__words"), F.lit(n)
    else:  # the bound is ceil(percent / 100 * total) in double arithmetic
        size, bound = F.col("__sum"), F.ceil(F.lit(n / 100) * F.sum("__sum").over(by).cast("double"))
    groups = groups.withColumn("__before", F.coalesce(F.sum(size).over(down), F.lit(0))).withColumn("__bound", bound)
    last = groups.where("__before < __bound").groupBy(*keys).agg(F.min_by(F.struct("freq", "__before", "__bound"), "freq").alias("e"))
    left = F.col("e.__bound") - F.col("e.__before")
    need = left if kind == "top" else F.ceil(left / F.col("e.freq"))
    return last.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("e.freq").alias("__edge"), need.alias("__need"))


def limited_within(report: DataFrame, keys: Sequence[str], limit: str, ties: Sequence[str] = ("first_seen",)) -> DataFrame:
    """Each scope's report limited on its own: ``N%``, ``N+`` or ``N`` as :func:`limited` has them.

    Words above a scope's edge frequency stay, those below go, and of the words
    at it the first in the order of ``ties`` stay; they alone are ranked, so no
    window holds all words of a file. The report is read twice and should be cut
    from its lineage by the caller if it is dear. Keys may be null.
    """
    kind, n = parse_limit(limit)
    if kind == "least":
        return least_frequency(report, n)
    if (kind, n) == ("percent", 100):
        return report
    edges = _edges(report, keys, kind, n)
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    met = report.join(edges, same).drop(*(f"__{k}" for k in keys))
    at_edge = met.where("freq = __edge").withColumn("__rank", F.row_number().over(W.partitionBy(*keys).orderBy(*ties)))
    kept = [met.where("freq > __edge").drop("__edge", "__need"), at_edge.where("__rank <= __need").drop("__edge", "__need", "__rank")]
    return kept[0].unionByName(kept[1])


def limited(report: DataFrame, limit: str) -> DataFrame:
    kind, n = parse_limit(limit)
    return {"percent": percentile, "least": least_frequency, "top": top}[kind](report, n)
