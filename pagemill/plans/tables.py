"""Cutting lineage, and numbering rows without gathering them in one task."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use ``spark.checkpoint.dir``; only a local master, as in tests, gets a folder where it is unset."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(path or "file://" + tempfile.mkdtemp(prefix="pagemill-"))


#: Rows of counts, one for each key and part, that are broadcast at most.
FEW_COUNTS = 100_000


def numbered(df: DataFrame, key: str, order: str, name: str, rows_per_group: int = 50_000) -> DataFrame:
    """Add the row number within ``key`` by the integer column ``order``.

    The range of ``order`` is cut into as many equal parts as bring about
    ``rows_per_group`` rows to each on average. Rows are ranked within (key,
    part), and the rows of a key's earlier parts are added, so that one task
    never sorts a whole key. Where there are few keys and parts, their counts come
    by broadcast, and rows move once.
    """
    span = df.agg(F.min(order).alias("low"), F.max(order).alias("high"), F.count(F.lit(1)).alias("n"), F.approx_count_distinct(key).alias("keys")).first()
    parts = max(1, -(-span.n // rows_per_group))
    if parts == 1 or span.low is None:
        return df.withColumn(name, F.row_number().over(W.partitionBy(key).orderBy(order)))
    width = max(1, -(-(span.high - span.low + 1) // parts))
    df = df.withColumn("__part", F.floor((F.col(order) - span.low) / width))
    before = F.sum("__n").over(W.partitionBy(key).orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    sizes = df.groupBy(key, "__part").agg(F.count(F.lit(1)).alias("__n"))
    sizes = sizes.select(F.col(key).alias("__key"), F.col("__part").alias("__p"), F.coalesce(before, F.lit(0)).alias("__before"))
    sizes = F.broadcast(sizes) if (span.keys + 1) * parts <= FEW_COUNTS else sizes
    out = df.join(sizes, F.col(key).eqNullSafe(F.col("__key")) & F.col("__part").eqNullSafe(F.col("__p")))
    rank = F.row_number().over(W.partitionBy("__key", "__p").orderBy(order))
    return out.withColumn(name, (rank + F.col("__before")).cast("int")).drop("__part", "__key", "__p", "__before")


def ranked(df: DataFrame, order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """Add the row number over the whole table, from 1, in some total order.

    The table is range-sorted and cut from its lineage once; each row then has
    its place within its partition, and partitions, of which there are few, are
    counted. No task sees more than its own range.
    """
    ensure_checkpoint_dir(df.sparkSession)
    mask = (1 << 33) - 1
    held = df.orderBy(*order).withColumn("__id", F.monotonically_increasing_id())
    held = held.withColumn("__p", F.shiftright("__id", 33)).checkpoint()
    sizes = sorted((r["__p"], r["n"]) for r in held.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).collect())
    rows, total = [], 0
    for p, n in sizes:
        rows.append((p, total))
        total += n
    if not rows:
        return held.drop("__id", "__p").withColumn(name, F.lit(None).cast("long"))
    offsets = held.sparkSession.createDataFrame(rows, "__q long, __offset long")
    out = held.join(F.broadcast(offsets), F.col("__p") == F.col("__q"))  # a row for each partition
    return out.withColumn(name, F.col("__id").bitwiseAND(F.lit(mask)) + F.col("__offset") + 1).drop("__id", "__p", "__q", "__offset")
