"""Bounded samples of labelled documents, and the task that fits a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import worker_task


def sample(documents: DataFrame, labels: DataFrame, label: str, most: int, where=None) -> DataFrame:
    """At most ``most`` labelled documents as (doc_id, text, label), the same each time.

    Of the labelled ids that ``documents`` has, those with the least hashes are
    picked before any text is read: the fit gets min(most, labelled documents)
    rows, however many labels belong to absent ones. Null ids and labels are
    left out. An id counts once: with its largest label, and with the largest
    of its texts where documents repeat it. The picked ids, of which there are
    ``most`` at most, are broadcast.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if where is not None:
        ids = ids.where(where)
    ids = ids.groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.col(label).cast("int")).alias("__label"))
    present = documents.select(F.col("doc_id").alias("__doc"))
    ids = ids.join(present, F.col("__id") == F.col("__doc"), "left_semi")
    ids = ids.orderBy(F.xxhash64("__id"), "__id").limit(most)
    texts = documents.select(F.col("doc_id").alias("__doc"), F.coalesce("text", F.lit("")).alias("__text"))
    found = texts.join(F.broadcast(ids), F.col("__doc") == F.col("__id"))
    once = found.groupBy(F.col("__doc").alias("doc_id")).agg(F.max("__text").alias("text"), F.max("__label").alias("label"))
    return once


def fitted(rows: DataFrame, fit: Callable[[pa.Table], bytes]) -> bytes | None:
    """Run ``fit`` on a bounded sample in one executor task.

    ``rows`` comes from :func:`sample`. They are put in an order of their own,
    so that the model doesn't depend on how the input is divided. None without
    rows.
    """

    @worker_task("labels")
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if rows:
            table = pa.Table.from_batches(rows)
            model = fit(table.sort_by([("doc_id", "ascending"), ("text", "ascending")]))
            yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    rows = rows.select(F.col("doc_id").cast("long"), "text", F.col("label").cast("int")).repartition(1)
    out = rows.mapInArrow(task, "model binary").collect()
    return bytes(out[0].model) if out else None
