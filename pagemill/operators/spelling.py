"""Spelling correction against a frequency dictionary.

Only distinct unknown words are looked up. Words within one edit (deletion,
transposition, replacement, insertion) or two meet by symmetric deletion: both
sides drop one or two letters. The unknown words of a length are dealt in blocks,
and all dictionary words that are up to two letters shorter or longer go past
each block: what moves are words, not their keys, which only live in a task, as
hashes. The keys of a word grow with the square of its length, so very long
words meet by their parts: an edit changes two parts of a word at most, so of
five parts of a dictionary word one stands unchanged in every word within two
edits, at most two places away. Whatever meets is checked exactly at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import process
from ..plans.tables import ensure_checkpoint_dir
from . import positions

#: Words of more letters meet by their parts.
LONG = 32
#: Keys of unknown words that a task holds at once.
KEYS_AT_ONCE = 2_000_000
#: Dictionary words that go past a block at once, pairs that meet at once, and those that are checked at once.
_WORDS_AT_ONCE, _PAIRS_AT_ONCE, _CHECKED_AT_ONCE = 2_000, 500_000, 20_000

_PAIR = "word string, cand string, freq long, edits int"
_BASE = 0x9E3779B97F4A7C15
_FAR = 9


def _letters(words: Sequence[str], size: int) -> np.ndarray:
    """Words of a length as rows of code points."""
    return np.array(words, f"U{max(size, 1)}").view(np.uint32).reshape(len(words), -1)[:, :size]


def _keys(letters: np.ndarray, edits: int) -> np.ndarray:
    """Hashes of words and of what is left when they drop up to two letters: a row for each way to drop."""
    n, size = letters.shape
    back = pow(_BASE, -1, 1 << 64)
    power = [np.uint64(pow(_BASE, k, 1 << 64)) for k in range(size)]
    one, two = np.uint64(back), np.uint64(back * back % (1 << 64))
    upto = np.zeros((size + 1, n), np.uint64)  # hashes of the first letters; what stands behind a dropped letter moves down by a power
    for k in range(size):
        upto[k + 1] = upto[k] + letters[:, k].astype(np.uint64) * power[k]
    rows = [upto[size]]
    for i in range(size if edits > 0 else 0):
        rows.append(upto[i] + one * (upto[size] - upto[i + 1]))
        for j in range(i + 1, size if edits > 1 else 0):
            rows.append(upto[i] + one * (upto[j] - upto[i + 1]) + two * (upto[size] - upto[j + 1]))
    return np.stack(rows)


def _n_keys(size: int) -> int:
    return 1 + size + size * (size - 1) // 2


def _distance(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Edits between words of one length and words of another, row by row; more than ``most``, which is two at most, are any number above.

    A transposition may stand around one letter that is put in or left out:
    ab and bxa are two edits apart.
    """
    n, size, other = len(a), a.shape[1], b.shape[1]
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    far = np.full(n, _FAR, np.uint8)
    rows: list[dict[int, np.ndarray]] = []
    for i in range(size + 1):
        row: dict[int, np.ndarray] = {}
        for j in range(max(0, i - most), min(other, i + most) + 1):
            if not i or not j:
                row[j] = np.full(n, i + j, np.uint8)
                continue
            d = rows[i - 1][j - 1] + (a[i - 1] != b[j - 1])
            np.minimum(d, np.minimum(rows[i - 1].get(j, far), row.get(j - 1, far)) + np.uint8(1), out=d)
            for k, l in ((2, 2), (2, 3), (3, 2)):
                if k <= i and l <= j and j - l in rows[i - k] and k + l - 3 <= most:
                    swapped = (a[i - 1] == b[j - l]) & (a[i - k] == b[j - 1])
                    np.minimum(d, np.where(swapped, rows[i - k][j - l] + np.uint8(k + l - 3), far), out=d)
            row[j] = d
        rows.append(row)
        if i > 2:
            rows[i - 3] = {}
    return rows[size].get(other, far)


class _Block:
    """Unknown words of one length, found by their keys."""

    #: Bits of a key that tell quickly that nobody has it.
    QUICK = 24

    def __init__(self, words: list[str], edits: int):
        self.words, self.size, self.edits = words, len(words[0]), edits
        self.letters = _letters(words, self.size)
        keys = _keys(self.letters, edits).ravel()
        order = np.argsort(keys)
        self.keys, self.rows = keys[order], (order % len(words)).astype(np.int32)
        self.some = np.zeros(1 << self.QUICK, bool)
        self.some[self._quick(keys)] = True

    def _quick(self, keys: np.ndarray) -> np.ndarray:
        return keys >> np.uint64(64 - self.QUICK)

    def near(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of the block, rows of dictionary words of one length, and the edits between them."""
        letters = _letters(words, len(words[0]))
        keys = _keys(letters, self.edits).ravel()
        at = np.flatnonzero(self.some[self._quick(keys)])
        keys, of = keys[at], at % len(words)
        low, high = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, "right")
        n = high - low
        low, of, n = low[n > 0], of[n > 0], n[n > 0]
        # all that a dictionary word meets is taken at once, so that no pair comes twice
        group = (np.cumsum(np.bincount(of, n, len(words))) // _PAIRS_AT_ONCE)[of]
        for g in np.unique(group):
            part = np.flatnonzero(group == g)
            m = n[part]
            met = np.repeat(low[part] - np.cumsum(m) + m, m) + np.arange(m.sum())
            pairs = np.unique(np.repeat(of[part], m) * len(self.words) + self.rows[met])
            for k in range(0, len(pairs), _CHECKED_AT_ONCE):
                cand, word = np.divmod(pairs[k : k + _CHECKED_AT_ONCE], len(self.words))
                edits = _distance(self.letters[word], letters[cand], self.edits)
                ok = edits <= self.edits
                yield word[ok], cand[ok], edits[ok]


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[int, bool, int], list[str], list[int]]]:
    """((task, known, length), words, frequencies) of neighbours that share these, a few at a time."""
    for batch in batches:
        for k in range(0, batch.num_rows, _WORDS_AT_ONCE):
            task, known, word, freq = (c.to_pylist() for c in batch.slice(k, _WORDS_AT_ONCE).columns)
            kinds = list(zip(task, known, map(len, word), strict=True))
            starts = [i for i, x in enumerate(kinds) if not i or x != kinds[i - 1]]
            for i, j in zip(starts, [*starts[1:], len(kinds)], strict=True):
                yield kinds[i], word[i:j], freq[i:j]


def _met(edits: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: (task, known, word, freq) in this order, by length too, as pairs; of a task unknown words come first."""

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, unknown, block = None, [], None
        for (here, known, _), words, freqs in _runs(batches):
            if here != task:
                task, unknown, block = here, [], None
            if not known:
                unknown += words
                continue
            if not unknown:
                continue
            block = block or _Block(unknown, edits)
            names, cands, counts = pa.array(unknown, pa.string()), pa.array(words, pa.string()), pa.array(freqs, pa.int64())
            for word, cand, found in block.near(words):
                at, of = pa.array(word), pa.array(cand)
                yield pa.RecordBatch.from_arrays([names.take(at), cands.take(of), counts.take(of), pa.array(found.astype(np.int32))], names=["word", "cand", "freq", "edits"])

    return meet


def _dealt(unknown: DataFrame, dictionary: DataFrame, edits: int) -> DataFrame:
    """(task, known, word, freq): short unknown words in the task of their block, and dictionary words in all tasks that they may have a pair in."""
    spark = unknown.sparkSession
    unknown = unknown.where(F.length("word") <= LONG).withColumn("size", F.length("word"))
    blocks, sees, n = [], [], 0
    for size, words in unknown.groupBy("size").count().collect():  # a row for each length
        mine = -(-words * _n_keys(size) // KEYS_AT_ONCE)
        blocks.append((size, n, mine))
        sees += [(size + more, n + i) for i in range(mine) for more in range(-edits, edits + 1)]
        n += mine
    blocks = F.broadcast(spark.createDataFrame(blocks, "size int, first int, blocks int"))
    sees = F.broadcast(spark.createDataFrame(sees, "size int, task int"))
    task = F.col("first") + F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    left = unknown.join(blocks, "size").select(task.alias("task"), F.lit(False).alias("known"), "word", F.lit(0).cast("long").alias("freq"))
    right = dictionary.withColumn("size", F.length("word")).join(sees, "size").select("task", F.lit(True).alias("known"), "word", F.col("freq").cast("long").alias("freq"))
    return left.unionByName(right).repartitionById(max(1, min(n, 20_000)), F.col("task"))


def _by_keys(unknown: DataFrame, dictionary: DataFrame, edits: int) -> DataFrame:
    """(word, cand, freq, edits): pairs of short words, a task for each block of unknown words."""
    return _dealt(unknown, dictionary, edits).sortWithinPartitions("task", "known", F.length("word")).mapInArrow(_met(edits), _PAIR)


def _parts(words: DataFrame, edits: int) -> DataFrame:
    """(cand, key): the parts of dictionary words, by length and place."""
    n = 2 * edits + 1
    size = F.length("cand")
    start = lambda k: F.floor(F.lit(k) * size / n).cast("int")
    keys = [F.concat_ws(":", size, F.lit(k), F.col("cand").substr(start(k) + 1, start(k + 1) - start(k))) for k in range(n)]
    return words.select("cand", F.explode(F.array(*keys)).alias("key"))


def _probes(words: DataFrame, edits: int) -> DataFrame:
    """(word, key): what stands in a word where a part of a dictionary word may be."""
    n = 2 * edits + 1
    keys = []
    for more in range(-edits, edits + 1):
        size = F.length("word") + more
        for k in range(n):
            start, end = F.floor(F.lit(k) * size / n).cast("int"), F.floor(F.lit(k + 1) * size / n).cast("int")
            for shift in range(-edits, edits + 1):
                fits = (start + shift >= 0) & (end + shift <= F.length("word"))
                keys.append(F.when(fits, F.concat_ws(":", size, F.lit(k), F.col("word").substr(start + (shift + 1), end - start))))
    return words.select("word", F.explode(F.array_distinct(F.array_compact(F.array(*keys)))).alias("key"))


def _distances(edits: int) -> Callable[[pa.Array, pa.Array], pa.Array]:
    def change(words: pa.Array, cands: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(words.to_pylist(), cands.to_pylist(), strict=True):
            out.append(int(_distance(_letters([a], len(a)), _letters([b], len(b)), edits)[0]))
        return pa.array(out, pa.int32())

    return change


def _by_parts(unknown: DataFrame, dictionary: DataFrame, edits: int) -> DataFrame:
    """(word, cand, freq, edits): pairs of long words. An edit changes a distance without transpositions by two at most."""
    right = dictionary.where(F.length("word") > LONG - edits).select(F.col("word").alias("cand")).distinct()
    met = _probes(unknown.where(F.length("word") > LONG), edits).join(_parts(right, edits), "key").where(F.levenshtein("word", "cand", 2 * edits) >= 0)
    pairs = met.select("word", "cand", F.arrow_udf(_distances(edits), "int")("word", "cand").alias("edits")).where(F.col("edits") <= edits).distinct()
    return pairs.join(dictionary.select(F.col("word").alias("cand"), "freq"), "cand").select("word", "cand", "freq", "edits")


def _near(unknown: DataFrame, dictionary: DataFrame, edits: int) -> DataFrame:
    """(word, cand, freq, edits): dictionary words within the edits, two at most, of each word."""
    edits, dictionary = min(edits, 2), dictionary.select("word", "freq")
    return _by_keys(unknown, dictionary, edits).unionByName(_by_parts(unknown, dictionary, edits))


def _candidates(unknown: DataFrame, dictionary: DataFrame, edits: int) -> DataFrame:
    """(word, cand, lev): the pairs with their distance without transpositions."""
    return _near(unknown, dictionary, edits).select("word", "cand", F.levenshtein("word", "cand").alias("lev"))


def _known(dictionary: DataFrame) -> DataFrame:
    return dictionary.select("word", F.lit(True).alias("known")).distinct()


def _best(unknown: DataFrame, dictionary: DataFrame, edits: int) -> DataFrame:
    """(word, cand, share): the best dictionary word of each unknown one that has any; reads both tables several times."""
    # structs compare by their first field first: the fewest edits win
    best = _near(unknown, dictionary, edits).groupBy("word", "edits").agg(F.sum("freq").alias("total"), F.max(F.struct("freq", "cand")).alias("top"))
    best = best.groupBy("word").agg(F.min(F.struct("edits", "total", "top")).alias("b"))
    return best.select("word", F.col("b.top.cand").alias("cand"), (F.col("b.top.freq") / F.col("b.total")).alias("share"))


def _confidence() -> Column:
    return F.when((F.length("word") == 1) | F.col("known"), 1.0).otherwise(F.coalesce("share", F.lit(0.0)))


def suggestions(words: DataFrame, dictionary: DataFrame, edits: int = 2) -> DataFrame:
    """(word, correction, confidence) of distinct lower-case words.

    One letter: itself, 1.0. Known: itself, 1.0. Else the words at one edit,
    else those at two; the confidence is the share in the candidates'
    frequencies and the largest (confidence, word) wins. Else (word, 0.0).
    """
    ensure_checkpoint_dir(words.sparkSession)
    dictionary = dictionary.select("word", "freq").checkpoint()
    distinct = words.select("word").distinct().join(_known(dictionary), "word", "left").checkpoint()
    best = _best(distinct.where("known is null and length(word) > 1"), dictionary, edits)
    return distinct.join(best, "word", "left").select("word", F.coalesce("cand", "word").alias("correction"), _confidence().alias("confidence"))


def _tokens(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(token, n, kind, word, known) of the tokens of texts that were cut; ``word`` is in lower case.

    Kinds: punctuation (no letter or digit), other (not all letters), word.
    """
    kind = F.when(~F.col("token").rlike("[A-Za-z0-9]"), "punctuation").when(~F.col("token").rlike("^[A-Za-z]+$"), "other").otherwise("word")
    tokens = positions.counted(texts).withColumn("word", F.lower("token")).join(_known(dictionary), "word", "left")
    known = (F.col("kind") == "word") & F.coalesce("known", F.lit(False))
    return tokens.withColumn("kind", kind).select("token", "n", "kind", "word", known.alias("known")).checkpoint()  # a row for each token of the corpus; it is read several times


def corrected(tokens: DataFrame, dictionary: DataFrame, edits: int = 2) -> DataFrame:
    """(token, kind, known, correction, confidence) of tokens with their words.

    Numbers and signs pass by. Case is restored.
    """
    unknown = tokens.where("kind = 'word' and not known and length(word) > 1").select("word").distinct().checkpoint()
    words = tokens.where("kind = 'word'").join(_best(unknown, dictionary, edits), "word", "left")
    words = words.select("token", "kind", "known", process.like_case(F.coalesce("cand", "word"), F.col("token")).alias("correction"), _confidence().alias("confidence"))
    marks = tokens.where("kind <> 'word'").select("token", "kind", "known", F.col("token").alias("correction"), F.when(F.col("kind") == "punctuation", -1.0).otherwise(-2.0).alias("confidence"))
    return words.unionByName(marks)


def autocorrected(rows: DataFrame, key: str, dictionary: DataFrame, remove: bool = False, column: str = "text", edits: int = 2) -> DataFrame:
    """(key, text) with words corrected; ``remove`` drops what stays unknown.

    Punctuation stays either way, glued to the token before it.
    """
    texts = positions.cut(rows, key, column)
    dictionary = dictionary.select("word", "freq").checkpoint()
    tokens = _tokens(texts, dictionary)
    value, stays = F.col("correction"), F.col("kind") != "word"
    if remove:
        value = F.when((F.col("confidence") > 0) | (F.col("kind") == "punctuation"), value).otherwise("")
        stays = F.col("kind") == "punctuation"
    changes = corrected(tokens, dictionary, edits).select("token", value.alias("value")).where("value <> token")
    same = positions.frequent(tokens).where(stays | (F.col("known") & (process.like_case(F.col("word"), F.col("token")) == F.col("token"))))
    return positions.replaced(texts, key, changes, same)


def known_only(rows: DataFrame, key: str, dictionary: DataFrame, column: str = "text") -> DataFrame:
    """(key, text) of the words that the dictionary knows, and punctuation."""
    texts = positions.cut(rows, key, column)
    tokens = positions.distinct(texts).where(F.col("token").rlike("[A-Za-z0-9]")).withColumn("word", F.lower("token"))
    unknown = tokens.join(dictionary.select("word"), "word", "left_anti")
    return positions.replaced(texts, key, unknown.select("token", F.lit("").alias("value")))


def correction_log(rows: DataFrame, key: str, dictionary: DataFrame, column: str = "text", edits: int = 2) -> DataFrame:
    """(key, pos, word, attempted, correction, confidence) of unknown words."""
    texts = positions.cut(rows, key, column)
    dictionary = dictionary.select("word", "freq").checkpoint()
    tokens = _tokens(texts, dictionary)
    unknown = corrected(tokens, dictionary, edits).where("kind = 'word' and not known")
    same = positions.frequent(tokens).where("kind <> 'word' or known")
    done = F.col("confidence") > 0
    each = positions.places(texts, key, same).join(unknown, "token").withColumnRenamed("token", "word")
    return each.select(key, "pos", "word", done.alias("attempted"), F.when(done, F.col("correction")).alias("correction"), F.when(done, F.col("confidence")).alias("confidence"))
