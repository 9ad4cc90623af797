"""Window operators over time-ordered hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitweave.operators.order import block_window, in_blocks, ranked


def neighbour_gaps(hits: DataFrame, time_scale: float = 0.625, most: float = 10.0) -> DataFrame:
    """dt_prev and dt_next in ticks over max(time_scale, 1), clipped to [0, most]; 0 at the ends of a source."""
    scale = max(time_scale, 1.0) * 16.0
    clip = lambda c: F.round(F.least(F.greatest(F.coalesce(c / scale, F.lit(0.0)), F.lit(0.0)), F.lit(most)), 6)
    w = block_window()
    both = in_blocks(ranked(hits.select("source", "hit_id", "fine")), 1)
    return both.select("source", "hit_id", "_own", clip(F.col("fine") - F.lag("fine").over(w)).alias("dt_prev"), clip(F.lead("fine").over(w) - F.col("fine")).alias("dt_next")).where("_own").drop("_own")


def time_rank(hits: DataFrame, by: str = "label") -> DataFrame:
    """Rank in [0, 1] by stable time order within `by`; 0 for a single hit."""
    placed = ranked(hits.select(by, "hit_id", "fine"), by)
    return placed.select(by, "hit_id", F.round(F.when(F.col("n") > 1, F.col("pos") / (F.col("n") - 1)).otherwise(0.0), 6).alias("rank"))


def overlapping_windows(hits: DataFrame, size: int = 2048, overlap: int = 512, least: int = 2) -> DataFrame:
    """Count windows of `size` hits that step by size - overlap; the first that reaches the end is the last."""
    step = size - overlap
    placed = ranked(hits.select("source", "hit_id", "fine"))
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - size) / step))
    first = F.greatest(F.lit(0), F.floor((F.col("pos") - size) / step) + 1)
    dealt = placed.withColumn("w", F.explode(F.sequence(first, F.least(last, F.floor(F.col("pos") / step)))))
    return dealt.groupBy("source", F.col("w").cast("long").alias("window")).agg(F.count("*").alias("n_hits"), F.min("fine").alias("first_fine"), F.max("fine").alias("last_fine")).where(F.col("n_hits") >= least)


def tumbling(hits: DataFrame, width: int) -> DataFrame:
    """Buckets of `width` sixteenths: hits, distinct particles, share of noise."""
    return hits.groupBy("source", F.floor(F.col("fine") / width).alias("bucket")).agg(
        F.count("*").alias("n_hits"), F.count_distinct(F.when(F.col("label") >= 0, F.col("label"))).alias("n_particles"), F.round(F.avg(F.when(F.col("label") < 0, 1.0).otherwise(0.0)), 6).alias("noise_fraction")
    )


def largest_gap(hits: DataFrame) -> DataFrame:
    """Per label of at least two hits: the largest time gap, the median gap, and the hit before the first largest gap."""
    w = Window.partitionBy("label").orderBy("fine", "hit_id")
    gaps = hits.where("label >= 0").select("label", "hit_id", "fine", (F.lead("fine").over(w) - F.col("fine")).alias("gap")).where("gap is not null")
    return gaps.groupBy("label").agg(F.max("gap").alias("max_gap"), F.round(F.percentile("gap", F.lit(0.5)), 6).alias("median_gap"), F.min_by("hit_id", F.struct(-F.col("gap"), "fine", "hit_id")).alias("before"))


def monotonicity(hits: DataFrame, along: str = "x") -> DataFrame:
    """|mean of the sign of the steps along an axis in time order| for labels of more than two hits."""
    w = Window.partitionBy("label").orderBy("fine", "hit_id")
    steps = hits.where("label >= 0").select("label", F.signum((F.lead(along).over(w) - F.col(along)).cast("double")).alias("s")).where("s is not null")
    return steps.groupBy("label").agg(F.count("*").alias("steps"), F.round(F.abs(F.avg("s")), 6).alias("monotonicity")).where("steps > 1")


def evenly(rows: DataFrame, by: str, order: str, quota: int, slab: Column | None = None) -> DataFrame:
    """`quota` rows of each group, spread evenly over its order; `slab` ascends with the order (by default each 2^34 of a number)."""
    placed = ranked(rows, by, (order,), F.shiftright(order, 34) if slab is None else slab)
    i, n = F.col("pos"), F.col("n")
    q = F.least(F.lit(quota), n)
    return placed.where(F.floor((i + 1) * q / n) > F.floor(i * q / n)).select(*rows.columns)
