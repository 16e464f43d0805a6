"""Quality classifier: supervised subword embeddings.

A document is the mean of the vectors of its hashed word and character
n-grams; a softmax over a linear layer gives the classes. Vectors and layer are
learned together by stochastic gradient descent in numpy, with a step for each
row of the vectors that shrinks with the gradients it has had.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import grams, labelled
from .quality_rules import linear_scores, sigmoid, sparse
from .store import worker_task


@dataclass(frozen=True)
class Embedding:
    """Parameters. ``sample_rows`` bounds the labelled rows of the fit."""

    dim: int = 8
    bits: int = 16
    chars: tuple[int, ...] = (2, 4)
    epochs: int = 6
    rate: float = 0.3
    sample_rows: int = 4000
    threshold: float = 0.7


def fit(table: pa.Table, p: Embedding) -> bytes:
    """Train vectors and layer; return each n-gram's share of the class score.

    The layer is linear, so the score of a document, the difference between the
    two classes, is the mean over its n-grams of (vector x layer). These
    products and the offset are all that scoring needs.
    """
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for _, _, texts in grams.slices(table.column("text")):
        rows += sparse(texts, p.bits, p.chars)
    y = (table.column("label").to_numpy() > 0).astype(int)
    families = 1 + len(p.chars)
    rng = np.random.default_rng(29)
    vectors = rng.uniform(-1 / p.dim, 1 / p.dim, (families << p.bits, p.dim))
    layer, bias = rng.uniform(-0.5, 0.5, (p.dim, 2)), np.zeros(2)
    seen, layer_seen, bias_seen = np.full(families << p.bits, 1e-8), 1e-8, 1e-8
    for _ in range(p.epochs):
        for d in rng.permutation(len(rows)):
            at, share = rows[d]
            own = vectors[at]
            hidden = share @ own
            z = hidden @ layer + bias
            e = np.exp(z - z.max())
            g = e / e.sum()
            g[y[d]] -= 1
            back = layer @ g
            seen[at] += share * share * (back @ back)
            vectors[at] = own - (p.rate * share / np.sqrt(seen[at]))[:, None] * back
            slope = np.outer(hidden, g)
            layer_seen += (slope * slope).sum()
            layer -= p.rate * slope / np.sqrt(layer_seen)
            bias_seen += g @ g
            bias -= p.rate * g / np.sqrt(bias_seen)
    product = vectors @ (layer[:, 1] - layer[:, 0])
    return np.append(product, bias[1] - bias[0]).astype(np.float32).tobytes()


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 4; null ids have fold null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def score(documents: DataFrame, labels: DataFrame, p: Embedding = Embedding()) -> DataFrame:
    """doc_id, held_out, score and predicted for every document.

    Labels of fold 2 are never read. The text is the only input of a score; an
    empty or null text gets the score of the offset alone. Without labelled
    rows every score is 0.5. Rows with null ids are scored and not held out.
    """
    rows = labelled.sample(documents, labels, "quality", p.sample_rows, fold() != 2)
    model = labelled.fitted(rows, lambda t: fit(t, p))
    held = documents.sparkSession.sparkContext.broadcast(model)

    @worker_task("quality")
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = np.frombuffer(held.value, np.float32) if held.value else np.zeros(((1 + len(p.chars)) << p.bits) + 1, np.float32)
        for batch in batches:
            if not batch.num_rows:
                continue
            z = np.concatenate([linear_scores(t, values[:-1], p.bits, p.chars) for _, _, t in grams.slices(batch.column("text"))]) + values[-1]
            s = sigmoid(z)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= p.threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    inputs = documents.select("doc_id", F.coalesce(fold() == 2, F.lit(False)).alias("held_out"), "text")
    return inputs.mapInArrow(apply, f"doc_id {kind}, held_out boolean, score double, predicted int")
