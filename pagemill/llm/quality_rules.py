"""Quality rules: base rules and a calibrated n-gram logistic regression.

The model is a logistic regression over hashed word and character n-grams. It
is fitted by AdaGrad on a bounded sample of the labelled rows, calibrated by
Platt scaling on a part of that sample which the fit doesn't see, and applied
in Arrow batches to whole texts against a fixed threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import grams, labelled
from .store import quoted, worker_task


@dataclass(frozen=True)
class Rules:
    """Limits of the base rules, and parameters of the model.

    ``sample_rows`` bounds the labelled rows that the model is fitted on.
    ``threshold`` is the least calibrated probability that is kept.
    """

    least_words: int = 20
    repeat_percent: int = 30
    window: int = 8
    threshold: float = 0.5
    sample_rows: int = 4000
    bits: int = 17
    epochs: int = 8
    chars: tuple[int, ...] = (2, 4)


def sparse(texts: grams.Texts, bits: int, chars: tuple[int, ...]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct features and their shares, by family in turn.

    Family f has the features from ``f << bits`` on; the shares of a family add
    up to 1 in each text that has it.
    """
    rows: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(texts.n)]
    for f, (doc, bucket) in enumerate(grams.features(texts, bits, chars)):
        key, n = np.unique(doc.astype(np.int64) << bits | bucket, return_counts=True)
        cut = np.searchsorted(key >> bits, np.arange(texts.n + 1))
        for d in range(texts.n):
            i, j = cut[d], cut[d + 1]
            at = ((key[i:j] & ((1 << bits) - 1)) + (f << bits)).astype(np.int32)
            rows[d].append((at, (n[i:j] / max(1, n[i:j].sum())).astype(np.float32)))
    return [(np.concatenate([x[0] for x in r]), np.concatenate([x[1] for x in r])) for r in rows]


def sigmoid(x: np.ndarray | float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def platt(z: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset that turn scores into probabilities (Newton's method).

    The targets are smoothed as Platt proposed, so a perfect separation gives
    finite values.
    """
    up, down = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * z + b)
        g = np.array([((p - target) * z).sum() + 1e-3 * (a - 1), (p - target).sum()])
        w = p * (1 - p) + 1e-9
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        size = np.abs(step).max()
        step *= min(1, 2 / max(size, 1e-12))
        a, b = a - step[0], b - step[1]
        if size < 1e-8:
            break
    return max(float(a), 1e-3), float(b)


def fit_logistic(table: pa.Table, bits: int, chars: tuple[int, ...], epochs: int) -> bytes:
    """Fit, calibrate, and return the weights with offset, slope and shift.

    One row in five is kept for the calibration. With one class only, the
    weights stay near 0 and the offset alone carries the share of the class.
    """
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for _, _, texts in grams.slices(table.column("text")):
        rows += sparse(texts, bits, chars)
    y = (table.column("label").to_numpy() > 0).astype(float)
    n, size = len(rows), (1 + len(chars)) << bits
    held = grams.constants(11, n) % np.uint64(5) == 0
    train = np.flatnonzero(~held) if 0 < held.sum() < n else np.arange(n)
    check = np.flatnonzero(held) if 0 < held.sum() < n else np.arange(n)
    weights, squares = np.zeros(size), np.full(size, 1e-8)
    bias, bias_square = 0.0, 1e-8
    rng = np.random.default_rng(17)
    for _ in range(epochs):
        for d in rng.permutation(train):
            at, share = rows[d]
            g = float(sigmoid(weights[at] @ share + bias)) - y[d]
            step = g * share + 1e-6 * weights[at]
            squares[at] += step * step
            weights[at] -= 0.5 * step / np.sqrt(squares[at])
            bias_square += g * g
            bias -= 0.5 * g / np.sqrt(bias_square)
    z = np.array([weights[rows[d][0]] @ rows[d][1] + bias for d in check])
    slope, shift = platt(z, y[check])
    return np.concatenate([weights, [bias, slope, shift]]).astype(np.float32).tobytes()


def linear_scores(texts: grams.Texts, weights: np.ndarray, bits: int, chars: tuple[int, ...]) -> np.ndarray:
    """For each text the sum over families of the mean weight of its n-grams."""
    z = np.zeros(texts.n)
    for f, (doc, bucket) in enumerate(grams.features(texts, bits, chars)):
        table = weights[f << bits : (f + 1) << bits]
        n = np.bincount(doc, minlength=texts.n)
        z += np.bincount(doc, table[bucket], minlength=texts.n) / np.maximum(n, 1)
    return z


def base_features(texts: grams.Texts, window: int = 8) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    n, data, at = texts.n, texts.data, texts.at
    w = grams.words(texts)
    ink = ~grams.white(data)
    symbol = np.zeros(256, bool)
    symbol[list(b"#*$%&|<>")] = True
    out = {
        "n_words": grams.counts(w.doc, n),
        "word_chars": grams.within(ink & ((data & 0xC0) != 0x80), at),
        "n_symbols": grams.within(symbol[data], at),
    }
    # a line begins with its text or after a line feed
    feeds = np.flatnonzero(data == 10)
    start = np.union1d(at[:-1], feeds + 1)
    start = start[start < len(data)]
    stop = np.minimum(np.append(start[1:], len(data)), len(data))
    end = np.where(data[stop - 1] == 10, stop - 1, stop) if len(start) else stop
    sums = np.concatenate([[0], np.cumsum(ink)])
    full = sums[end] > sums[start]
    start, end = start[full], end[full]
    doc = np.searchsorted(at, start, "right") - 1
    first = _earliest(grams.salted(grams.run_hashes(data, start, end), doc))
    dup = first != np.arange(len(first))
    if not grams.same_runs(data, start[dup], end[dup], start[first[dup]], end[first[dup]]).all():
        dup = _dup_exact([(int(d), data[i:j].tobytes()) for d, i, j in zip(doc, start, end, strict=True)])
    out["n_dup_lines"] = grams.counts(doc[dup], n)
    place, h = grams.windows(w, window)
    first = _earliest(grams.salted(h, w.doc[place]))
    dup = first != np.arange(len(first))
    a, b = place[dup], place[first[dup]]
    if not all(grams.same_runs(data, w.start[a + k], w.end[a + k], w.start[b + k], w.end[b + k]).all() for k in range(window)):
        held = [data[i:j].tobytes() for i, j in zip(w.start, w.end, strict=True)]
        keys = [(int(w.doc[p]), *held[p : p + window]) for p in place]
        dup = _dup_exact(keys)
        seen = {keys[k] for k in np.flatnonzero(dup)}
        again = place[np.array([x in seen for x in keys])]
    else:
        again = place[np.union1d(np.flatnonzero(dup), first[dup])]
    cover = np.zeros(len(w.doc) + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + window, -1)
    out["n_repeat_words"] = np.bincount(w.doc[np.cumsum(cover[:-1]) > 0], minlength=n).astype(np.int64)
    return out


def _earliest(keys: np.ndarray) -> np.ndarray:
    """For each key the place of the first that equals it."""
    _, first, which = np.unique(keys, return_index=True, return_inverse=True)
    return first[which]


def _dup_exact(keys: list[tuple]) -> np.ndarray:
    """Which keys equal an earlier one; where two different runs have one hash."""
    seen: set[tuple] = set()
    out = np.zeros(len(keys), bool)
    for i, k in enumerate(keys):
        out[i] = k in seen
        seen.add(k)
    return out


def score(documents: DataFrame, labels: DataFrame, rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """Add the base features, ``base_failed``, ``quality`` and ``kept``.

    ``quality`` is the calibrated probability of a good text. Null and empty
    texts have no words and fail. Without any labelled row there is no model:
    ``quality`` is null and the base rules alone decide. Columns of the input
    that have the name of an added one are replaced; other columns stay,
    whatever their names. Rows that repeat an id are scored each. A quality that
    equals the threshold is kept. Texts are scored whole, however long.
    """
    spark = documents.sparkSession
    rows = labelled.sample(documents.select("doc_id", F.col(f"`{text}`").alias("text")), labels, "quality", rules.sample_rows)
    model = labelled.fitted(rows, lambda t: fit_logistic(t, rules.bits, rules.chars, rules.epochs))
    held = spark.sparkContext.broadcast(model)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "quality", "kept"]
    own = {f"__own{i}": c for i, c in enumerate(documents.columns) if c not in names}  # safe names for tasks
    kinds = dict(zip(names, ["long"] * 5 + ["boolean", "double", "boolean"], strict=True))

    @worker_task("quality")
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = np.frombuffer(held.value, np.float32) if held.value else None
        for batch in batches:
            if not batch.num_rows:
                continue
            found: list[dict[str, np.ndarray]] = []
            for _, _, texts in grams.slices(batch.column("__text")):
                x = base_features(texts, rules.window)
                x["base_failed"] = (x["n_words"] < rules.least_words) | (100 * x["n_repeat_words"] > rules.repeat_percent * x["n_words"])
                if values is None:
                    x["quality"] = np.full(texts.n, np.nan)
                    x["kept"] = ~x["base_failed"]
                else:
                    z = linear_scores(texts, values[:-3], rules.bits, rules.chars) + values[-3]
                    x["quality"] = sigmoid(float(values[-2]) * z + float(values[-1]))
                    x["kept"] = ~x["base_failed"] & (x["quality"] >= rules.threshold)
                found.append(x)
            new = [pa.array(np.concatenate([x[k] for x in found]), from_pandas=k == "quality") for k in names]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *new], names=[*own, *names])

    schema = ", ".join([*(f"{k} {documents.schema[c].dataType.simpleString()}" for k, c in own.items()), *(f"{k} {v}" for k, v in kinds.items())])
    given = documents.select(*(F.col(quoted(c)).alias(k) for k, c in own.items()), F.col(f"`{text}`").alias("__text"))
    return given.mapInArrow(apply, schema).select(*(F.col(k).alias(c) for k, c in own.items()), *names)


def keep(documents: DataFrame, labels: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    own = documents.columns
    renamed = documents.select(*(F.col(quoted(c)).alias(f"__own{i}") for i, c in enumerate(own)))
    ids = {"doc_id": F.col(f"__own{own.index('doc_id')}")}
    marked = score(renamed.withColumns(ids), labels, rules, f"__own{own.index('text')}")
    return marked.where("kept").select(*(F.col(f"__own{i}").alias(c) for i, c in enumerate(own)))
