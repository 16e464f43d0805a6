"""Connected components of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


#: Edges of a graph whose least neighbours are broadcast, at most; these have 16 bytes each.
FEW_EDGES = 100_000


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of (a, b): the smallest node reachable.

    Alternates large-star and small-star steps, which need a logarithmic number
    of rounds. Every round is aggregations and joins, no node's neighbours are
    ever gathered, and each result is written so that lineage stays short. Of a
    small graph the edges stay where they are and least neighbours come to them. Rows
    with a null end and loops are left out.
    """
    e = edges.where("a is not null and b is not null and a <> b")
    e = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before = store.written(e, "edges"), None
    for _ in range(most_rounds):
        seen = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen == before or not seen.n:
            break
        before = seen
        near = F.broadcast if seen.n <= FEW_EDGES else lambda df: df
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: neighbours above a node go to the least of its neighbourhood
        large = both.where("v > u").join(near(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node and its lower neighbours go to the least of these
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near(low), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, store.written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        store.forget(last)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
