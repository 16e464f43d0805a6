"""Sentence boundaries learned from the corpus itself, without labels.

After Kiss and Strunk (2006): a type of token that nearly always has a period
behind it, and is short, is an abbreviation; a number or single letter with a
period that keeps company with the next word more often than chance has it is
no end of a sentence, either. Both are log-likelihood ratios over counts, made
by aggregation. Where a text ends its sentences is then a join of the tokens
that have a period with the small tables learned.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..plans.tables import ensure_checkpoint_dir

#: Thresholds that were published with the method.
ABBREVIATION, COLLOCATION = 0.3, 7.88
#: A token that may end a sentence.
END = r"[.!?]+[\"')]*$"


_INITIAL = re.compile("[^A-Za-z0-9]*([A-Za-z]|[0-9]+)[.]")
_PAIRED = re.compile("[a-z]|[0-9]+")
_STOP = re.compile(END)


def type_of(t: str) -> str:
    """A token in lower case, without signs before it and the period behind it."""
    return re.sub("^[^a-z0-9]+", "", t.lower()).removesuffix(".")


#: (type, ends with a period, is a number or single letter with a period, ends with a stop) of a token, once for each.
_KINDS = text.Cut(lambda t: (type_of(t), t.endswith("."), bool(_INITIAL.fullmatch(t)), bool(_STOP.search(t))))
_COUNTS = pa.struct([("type", pa.string()), ("following", pa.string()), ("n_period", pa.int64()), ("n_bare", pa.int64()), ("n_initial", pa.int64()), ("n", pa.int64())])


def tokens(value: str | None) -> list[str]:
    """What stands between the spaces of a cleaned text."""
    return [t for t in (value or "").split(" ") if t]


#: Different tokens and pairs that a task holds before it sends them on.
_HELD = 300_000


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's texts; a token is looked at once until the counts are sent on."""
    counts, pairs = Counter(), Counter()

    def rows() -> Iterator[pa.RecordBatch]:
        found = []
        for t, n in counts.items():
            kind, dot, initial = type_of(t), t.endswith("."), bool(_INITIAL.fullmatch(t))
            found.append((kind, None, n * dot, n * (not dot), n * initial, 0))
        found += [(type_of(a), type_of(b), 0, 0, 0, n) for (a, b), n in pairs.items()]
        for k in range(0, len(found), 50_000):
            columns = zip(*found[k : k + 50_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _COUNTS, strict=True)], names=[f.name for f in _COUNTS])
        counts.clear()
        pairs.clear()

    for batch in batches:
        for value in batch.column(0):
            each = tokens(value.as_py())
            counts.update(each)
            pairs.update((a, b) for a, b in pairwise(each) if a[-1] == "." and _INITIAL.fullmatch(a))
            if len(counts) + len(pairs) > _HELD:
                yield from rows()
    yield from rows()


def counts_of(rows: DataFrame, column: str = "text") -> DataFrame:
    """What both tests of the method need, counted in one pass, and cut from its lineage.

    A row without ``following`` has the counts of a type with and without a
    period, and as a number or single letter with one; a row with it counts a
    pair of such a one and the type behind. Each task adds up its own first.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    schema = ", ".join(f"{f.name} {'string' if pa.types.is_string(f.type) else 'long'}" for f in _COUNTS)
    each = rows.select(F.col(column)).mapInArrow(_counted, schema)
    return each.groupBy("type", "following").agg(*(F.sum(c).alias(c) for c in ("n_period", "n_bare", "n_initial", "n"))).checkpoint()


def _log(k: Column, n: Column, p: Column) -> Column:
    """Logarithm of the likelihood of k in n at probability p; 0 ln 0 is 0."""
    term = lambda a, x: F.when(a == 0, F.lit(0.0)).otherwise(a * F.ln(x))
    return term(k, p) + term(n - k, 1 - p)


def statistics(rows: DataFrame, column: str = "text") -> DataFrame:
    """(type, n_period, n_bare, score, abbreviation) of types seen with a period.

    The score is the ratio of the likelihood that a period follows with 0.99 to
    that it follows as it does anywhere, times e to the minus length, the number
    of inner periods and one, and the length to the minus times without period.
    A corpus without tokens gives no row.
    """
    return _statistics(counts_of(rows, column))


def _statistics(counts: DataFrame) -> DataFrame:
    counts = counts.where("following is null")
    total = counts.agg(F.sum("n_period").alias("dots"), F.sum(F.col("n_period") + F.col("n_bare")).alias("all")).first()
    if not total["all"]:
        return counts.select("type", "n_period", "n_bare", F.lit(0.0).alias("score"), F.lit(False).alias("abbreviation"))
    p = F.lit(min(max(total["dots"] / total["all"], 1e-9), 1 - 1e-9))
    k, n = F.col("n_period").cast("double"), (F.col("n_period") + F.col("n_bare")).cast("double")
    ratio = 2 * (_log(k, n, F.lit(0.99)) - _log(k, n, p))
    letters = F.length(F.replace(F.col("type"), F.lit("."), F.lit("")))
    score = ratio * F.exp(-letters.cast("double")) * (F.length("type") - letters + 1) * F.pow(letters.cast("double"), -F.col("n_bare").cast("double"))
    found = counts.where("n_period > 0").select("type", "n_period", "n_bare", F.when(letters == 0, F.lit(0.0)).otherwise(score).alias("score"))
    return found.withColumn("abbreviation", (F.col("score") >= ABBREVIATION) & F.col("type").rlike("[a-z]"))


def collocations(rows: DataFrame, column: str = "text") -> DataFrame:
    """(type, following, n, score) of numbers and single letters with a period and the word behind.

    Only pairs whose log-likelihood ratio reaches the threshold and that are
    more frequent than chance has it. Counts of the first and of the second
    member come from all tokens.
    """
    return _collocations(counts_of(rows, column))


def _collocations(found: DataFrame) -> DataFrame:
    pairs = found.where("following is not null").select("type", "following", "n")
    counts = found.where("following is null").select("type", (F.col("n_period") + F.col("n_bare")).alias("c"), F.col("n_initial").alias("c_dot"))
    total = float(counts.agg(F.sum("c")).first()[0] or 1)
    met = pairs.join(counts.select("type", F.col("c_dot").cast("double").alias("a")), "type").join(counts.select(F.col("type").alias("following"), F.col("c").cast("double").alias("b")), "following")
    k, a, b, rest = F.col("n").cast("double"), F.col("a"), F.col("b"), F.lit(total) - F.col("a")
    p = b / total
    p2 = (b - k) / F.greatest(rest, F.lit(1.0))
    score = -2 * (_log(k, a, p) + _log(b - k, rest, p) - _log(k, a, k / a) - _log(b - k, rest, p2))
    return met.select("type", "following", "n", score.alias("score"), (k / a > p).alias("__more")).where(F.col("__more") & (F.col("score") >= COLLOCATION)).drop("__more")


def _stops(values: pa.Array) -> pa.Array:
    out = []
    for value in values.to_pylist():
        kinds = list(map(_KINDS.__getitem__, tokens(value)))
        found = {k[0] for k in kinds if k[1]}
        found |= {f"{a[0]} {b[0]}" for a, b in pairwise(kinds) if a[1] and _PAIRED.fullmatch(a[0])}
        out.append(list(found))
    return pa.array(out, pa.list_(pa.string()))


def _cut(values: pa.Array, lines: pa.Array) -> pa.Array:
    out = []
    for value, known in zip(values.to_pylist(), lines.to_pylist(), strict=True):
        kept, sentences, held, each = set((known or "").split("\n")), [], [], tokens(value)
        kinds = list(map(_KINDS.__getitem__, each))
        for i, (t, (kind, dot, _, ends)) in enumerate(zip(each, kinds, strict=True)):
            held.append(t)
            if ends and not (dot and (kind and kind in kept or i + 1 < len(each) and f"{kind} {kinds[i + 1][0]}" in kept)):
                sentences.append(" ".join(held))
                held = []
        out.append([*sentences, " ".join(held)] if held else sentences)
    return pa.array(out, pa.list_(pa.string()))


def sentence_rows(rows: DataFrame, key: str, column: str = "text") -> DataFrame:
    """(key, sentence_no, sentence): texts cut by what the corpus teaches.

    A token that ends with a stop ends a sentence, unless it is an abbreviation
    or the first of a collocation. Of each text the different tokens with a
    period meet the tables, once; those that are known come back to it as one
    list. Texts without tokens have no sentence; rows that share a key must be
    one text. Texts are cut from their lineage, as they are read three times.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    texts = rows.select(key, F.col(column).alias("__text")).checkpoint()
    counts = counts_of(texts, "__text")
    short = _statistics(counts).where("abbreviation").select(F.col("type").alias("__stop"))
    paired = _collocations(counts).select(F.concat("type", F.lit(" "), "following").alias("__stop"))
    stops = texts.select(key, F.explode(F.arrow_udf(_stops, "array<string>")("__text")).alias("__stop"))
    kept = stops.join(short.unionByName(paired), "__stop", "left_semi").groupBy(key).agg(F.array_join(F.collect_set("__stop"), "\n").alias("__kept"))
    cut = F.arrow_udf(_cut, "array<string>")("__text", "__kept")
    out = texts.join(kept, key, "left").select(key, F.posexplode(cut).alias("__i", "sentence"))
    return out.select(key, (F.col("__i") + 1).alias("sentence_no"), "sentence")
