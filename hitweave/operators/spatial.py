"""Joins by nearness in pixels and time: radius pairs, nearest neighbours, time neighbours, same pixel, adjacent voxels.

Hits are rows (source, hit_id, x, y, fine, ...); fine counts sixteenths of a tick. Radius pairs come from sweeps over slabs of time; every
join is an equi-join on the source and a bucket, with the neighbouring buckets of one side exploded, never a range or cross join.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitweave.operators.order import block_window, in_blocks, ranked


def sweep_pairs(x: np.ndarray, y: np.ndarray, fine: np.ndarray, eps: float, unit: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs within eps among hits sorted by time: each step compares every hit with the one `step` places later."""
    reach, limit = eps * unit + 1e-9, eps * eps + 1e-12
    at, found_a, found_b = np.arange(len(fine)), [], []
    step = 1
    while True:
        at = at[at + step < len(fine)]
        if not len(at):
            break
        gap = fine[at + step] - fine[at]
        near = gap <= reach
        at, gap = at[near], gap[near]
        if not len(at):
            break
        dx, dy, dt = x[at + step] - x[at], y[at + step] - y[at], gap / unit
        hit = dx * dx + dy * dy + dt * dt <= limit
        found_a.append(at[hit])
        found_b.append(at[hit] + step)
        step += 1
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (none, none)


def radius_pairs(hits: DataFrame, eps: float = 5.0, time_scale: float = 0.625, directed: bool = True, keep: tuple[str, ...] = (), slab_ticks: int = 4096) -> DataFrame:
    """Pairs (source, a, b, dx, dy, df, dist) of different hits of a source within `eps`, ends included.

    Distance is over (x, y, fine / (16 * time_scale)). A source is cut into slabs of time; each slab also gets the hits that follow it
    within reach, and gives the pairs whose earlier hit is its own, so every pair is found once, by a vectorised sweep in time.
    Undirected pairs have the lesser id first. Columns of `keep` come along as a_ and b_.
    """
    unit = 16.0 * time_scale
    reach = math.ceil(eps * unit)
    width = max(16 * slab_ticks, reach + 1)
    slab = F.floor(F.col("fine") / width)
    places = F.filter(F.array(slab, F.when(F.pmod("fine", F.lit(width)) <= reach, slab - 1)), lambda k: k.isNotNull())
    dealt = hits.select("source", "hit_id", "x", "y", "fine", *keep, slab.alias("home"), F.explode(places).alias("slab")).withColumn("own", F.col("home") == F.col("slab"))
    kept = ", ".join(f"{s}_{c} {hits.schema[c].dataType.simpleString()}" for c in keep for s in "ab")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["fine", "hit_id"], kind="stable", ignore_index=True)
        x, y, fine, ids = (pdf[c].to_numpy(np.int64) for c in ("x", "y", "fine", "hit_id"))
        a, b = sweep_pairs(x, y, fine, eps, unit)
        mine = pdf["own"].to_numpy(bool)[a] & (ids[a] != ids[b])
        a, b = a[mine], b[mine]
        if directed:
            a, b = np.concatenate([a, b]), np.concatenate([b, a])
        else:
            a, b = np.where(ids[a] < ids[b], a, b), np.where(ids[a] < ids[b], b, a)
        dx, dy, df = x[b] - x[a], y[b] - y[a], fine[b] - fine[a]
        out = {"source": pdf["source"].iloc[0], "a": ids[a], "b": ids[b], "dx": dx, "dy": dy, "df": df, "dist": np.sqrt((dx * dx + dy * dy) + (df / unit) * (df / unit))}
        return pd.DataFrame(out | {f"{s}_{c}": pdf[c].to_numpy()[k] for c in keep for s, k in (("a", a), ("b", b))})

    return dealt.groupBy("source", "slab").applyInPandas(run, f"source {hits.schema['source'].dataType.simpleString()}, a long, b long, dx long, dy long, df long, dist double" + (f", {kept}" if kept else ""))


def knn_edges(hits: DataFrame, k: int, radius: float, time_scale: float = 0.625) -> DataFrame:
    """Directed edges (source, src, dst, dist) to at most k nearest others within `radius`; ties by hit_id."""
    near = radius_pairs(hits, radius, time_scale)
    rank = F.row_number().over(Window.partitionBy("source", "a").orderBy("dist", "b"))
    return near.withColumn("_rank", rank).where(F.col("_rank") <= k).select("source", F.col("a").alias("src"), F.col("b").alias("dst"), "dist")


def time_edges(hits: DataFrame, reach: int = 4) -> DataFrame:
    """Directed edges (source, src, dst) to the `reach` hits before and after in time order."""
    w = block_window()
    steps = [s for s in range(-reach, reach + 1) if s]
    near = in_blocks(ranked(hits.select("source", "hit_id", "fine")), reach).select("source", "_own", F.col("hit_id").alias("src"), F.array(*(F.lead("hit_id", s).over(w) if s > 0 else F.lag("hit_id", -s).over(w) for s in steps)).alias("near"))
    return near.where("_own").select("source", "src", F.explode("near").alias("dst")).where("dst is not null")


def same_pixel_edges(hits: DataFrame, reach_ticks: float = 8.0) -> DataFrame:
    """Directed edges (source, src, dst) between hits of one pixel at most `reach_ticks` apart."""
    wide = max(1, math.ceil(16 * reach_ticks))
    base = hits.select("source", "hit_id", "x", "y", "fine", F.floor(F.col("fine") / wide).alias("tb"))
    other = base.withColumn("tb", F.explode(F.array(F.col("tb") - 1, F.col("tb"), F.col("tb") + 1))).withColumnsRenamed({"hit_id": "dst", "fine": "fine_b"})
    return base.join(other, ["source", "x", "y", "tb"]).where((F.col("hit_id") != F.col("dst")) & (F.abs(F.col("fine_b") - F.col("fine")) <= 16 * reach_ticks)).select("source", F.col("hit_id").alias("src"), "dst")


def offsets(connectivity: str) -> list[tuple[int, int, int]]:
    """Neighbour offsets of a voxel: face (6), edge (18) or corner (26)."""
    most = {"face": 1, "edge": 2, "corner": 3}[connectivity]
    return [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if 1 <= abs(i) + abs(j) + abs(k) <= most]


def voxels(hits: DataFrame, time_bin: float, extra: tuple[str, ...] = ()) -> DataFrame:
    """hits with `vt`, the voxel time: floor(fine / (16 * time_bin) + 1e-9)."""
    return hits.withColumn("vt", F.floor(F.col("fine") / (16.0 * time_bin) + 1e-9).cast("long"))


def adjacent_voxels(cells: DataFrame, connectivity: str, by: tuple[str, ...] = ("source",), keep: tuple[str, ...] = ()) -> DataFrame:
    """Ordered pairs of occupied cells (x, y, vt) that touch: columns of `by`, and a_/b_ columns of the cells."""
    steps = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i, j, k in offsets(connectivity))))
    left = cells.select(*by, F.col("x").alias("a_x"), F.col("y").alias("a_y"), F.col("vt").alias("a_vt"), *(F.col(c).alias(f"a_{c}") for c in keep), steps.alias("s"))
    left = left.select("*", (F.col("a_x") + F.col("s.i")).alias("b_x"), (F.col("a_y") + F.col("s.j")).alias("b_y"), (F.col("a_vt") + F.col("s.k")).alias("b_vt")).drop("s")
    right = cells.select(*by, F.col("x").alias("b_x"), F.col("y").alias("b_y"), F.col("vt").alias("b_vt"), *(F.col(c).alias(f"b_{c}") for c in keep))
    return left.join(right, [*by, "b_x", "b_y", "b_vt"])
