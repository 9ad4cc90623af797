"""Connected components and label numbering."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hitweave.session import removed, written


def _with_least(edges: DataFrame, least: DataFrame, hub: int = 1000) -> DataFrame:
    """Rows of edges(u, v) with the `m` of their u. Nodes with more than `hub` edges, of which there are at most two edges a
    thousandth, are broadcast, so that no task gets a whole hub."""
    hubs = least.where(F.col("n") > hub).select("u", F.col("m").alias("_hub"))
    marked = edges.join(F.broadcast(hubs), "u", "left")
    rest = marked.where("_hub is null").select("u", "v").join(least.select("u", "m"), "u")
    return rest.unionByName(marked.where("_hub is not null").select("u", "v", F.col("_hub").alias("m")))


def components(spark: SparkSession, edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of the undirected graph `edges(a, b)`; a component is named by its least node.

    Alternating large-star and small-star contractions: only aggregations and equi-joins, a table a round, no collected data. The
    table of a round is removed once the next one is written.
    """
    now = written(spark, edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    state = _state(now)
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"), F.count("*").alias("n"))
        large = _with_least(both.where("v > u"), least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lesser = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = _with_least(large, lesser).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lesser.select("u", F.col("m").alias("v")))
        last, now = now, written(spark, small.distinct(), "edges")
        removed(last)
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.expr("bit_xor(hash(v, u))")).first())


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least position that each of n positions hangs together with, by min-label rounds with pointer jumping."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        nxt = label.copy()
        np.minimum.at(nxt, label[a], low)
        np.minimum.at(nxt, label[b], low)
        while True:
            jumped = nxt[nxt]
            if (jumped == nxt).all():
                break
            nxt = jumped
        label = nxt[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def dense_labels(labels: DataFrame, by: list[str], order: str, label: str = "label", sort_by_label: bool = False) -> DataFrame:
    """Labels numbered 0.. within `by`, by first appearance along `order` (or by old label); -1 stays.

    The numbers are ranks over one row a label, not over hits.
    """
    firsts = labels.where(F.col(label) >= 0).groupBy(*by, label).agg(F.min(order).alias("_first"))
    rank = firsts.withColumn("_dense", F.row_number().over(Window.partitionBy(*by).orderBy(label if sort_by_label else "_first")) - 1).drop("_first")
    return labels.join(rank, [*by, label], "left").withColumn(label, F.coalesce(F.col("_dense").cast("long"), F.lit(-1).cast("long"))).drop("_dense")
