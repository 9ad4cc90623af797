"""Places and neighbours in the order of a group, without a task that holds a whole group.

Rows are ranked within slabs, coarse values that ascend with the order; the rows before a slab come from the counts of slabs, a
table far smaller than the rows. Blocks of consecutive places then serve windows that look a few rows back or ahead: each block also
gets the rows next to its bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 16_384


def time_slab(ticks: int = 4096) -> Column:
    return F.floor(F.col("fine") / (16 * ticks))


def before_slabs(rows: DataFrame, by: list[str], slab: str, value: Column, name: str, whole: str | None = None) -> DataFrame:
    """(by, slab, name): the sum of `value` over the slabs before; `whole` is the sum over the group."""
    sums = rows.groupBy(*by, slab).agg(value.alias("_sum"))
    w = Window.partitionBy(*by)
    extra = [F.sum("_sum").over(w).alias(whole)] if whole else []
    return sums.select(*by, slab, F.coalesce(F.sum("_sum").over(w.orderBy(slab).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(name), *extra)


def ranked(rows: DataFrame, by: str | list[str] = "source", order: tuple[str, ...] = ("fine", "hit_id"), slab: Column | None = None) -> DataFrame:
    """rows with `pos` (from 0) in their group, and `n`, the rows of the group. `slab` must ascend with the order."""
    by = [by] if isinstance(by, str) else by
    slabbed = rows.withColumn("_slab", time_slab() if slab is None else slab)
    starts = before_slabs(slabbed, by, "_slab", F.count("*"), "_before", "n")
    inner = F.row_number().over(Window.partitionBy(*by, "_slab").orderBy(*order))
    return slabbed.withColumn("_i", inner).join(starts, [*by, "_slab"]).withColumn("pos", F.col("_before") + F.col("_i") - 1).drop("_slab", "_i", "_before")


def in_blocks(placed: DataFrame, reach: int, block: int = BLOCK) -> DataFrame:
    """Ranked rows dealt to blocks of places, with the `reach` rows on either side of a block; `_own` marks its own rows."""
    home, at = F.floor(F.col("pos") / block), F.pmod("pos", F.lit(block))
    places = F.filter(F.array(F.when(at < reach, home - 1), home, F.when(at >= block - reach, home + 1)), lambda b: b.isNotNull())
    return placed.withColumn("_block", F.explode(places)).withColumn("_own", F.col("_block") == home)


def block_window(by: str = "source") -> Window:
    return Window.partitionBy(by, "_block").orderBy("pos")


def group_minimum(rows: DataFrame, by: str, column: str, name: str) -> DataFrame:
    """rows with the least `column` of their group, by an aggregation and a join rather than a window over the group."""
    return rows.join(rows.groupBy(by).agg(F.min(column).alias(name)), by)
