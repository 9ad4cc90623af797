"""Voxel tensors: cropped energy grids, down-binning, window voxels, adjacency audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hitweave.operators.cluster import voxel_components
from hitweave.operators.particles import log_energy
from hitweave.operators.spatial import adjacent_voxels, voxels


def energy_grid(hits: DataFrame, bins: tuple[int, int, int] = (32, 64, 64), time_bin: float = 0.625) -> DataFrame:
    """(label, voxel, value): energy over log(1024) summed in a grid (time, y, x) centred on the middle of each label's box;
    hits outside the grid are cropped. voxel is the flat index, x fastest."""
    nt, ny, nx = bins
    box = hits.where("label >= 0").groupBy("label").agg(*(F.min(c).alias(f"{c}_lo") for c in ("x", "y", "fine")), *(F.max(c).alias(f"{c}_hi") for c in ("x", "y", "fine")))
    at = lambda c, unit, n: F.floor((F.col(c) - (F.col(f"{c}_lo") + F.col(f"{c}_hi")) / 2) / unit + n / 2).cast("int")
    g = hits.join(box, "label").select("label", at("fine", 16.0 * time_bin, nt).alias("t"), at("y", 1.0, ny).alias("v"), at("x", 1.0, nx).alias("u"), (log_energy(F.col("tot")) / F.lit(6.931471805599453)).alias("e"))
    inside = g.where(f"t >= 0 and t < {nt} and v >= 0 and v < {ny} and u >= 0 and u < {nx}")
    return inside.groupBy("label", ((F.col("t") * ny + F.col("v")) * nx + F.col("u")).alias("voxel")).agg(F.round(F.sum("e"), 6).alias("value"))


def grid_coverage(hits: DataFrame, grid: DataFrame, bins: tuple[int, int, int] = (32, 64, 64)) -> DataFrame:
    """Per label: energy of all hits, energy in the grid, and the share that the crop keeps."""
    total = hits.where("label >= 0").groupBy("label").agg(F.sum(log_energy(F.col("tot")) / F.lit(6.931471805599453)).alias("total"))
    kept = grid.groupBy("label").agg(F.sum("value").alias("kept"), F.count("*").alias("n_voxels"))
    return total.join(kept, "label", "left").select("label", F.coalesce("n_voxels", F.lit(0)).alias("n_voxels"), F.round(F.when(F.col("total") > 0, F.coalesce("kept", F.lit(0.0)) / F.col("total")).otherwise(1.0), 4).alias("kept_fraction"))


def coverage_of_grids(hits: DataFrame, grids: list[tuple[int, int, int]], time_bin: float = 0.625) -> DataFrame:
    """Per grid (time, y, x bins): the share of particles kept whole, of hits and of energy, in one pass over the hits."""
    box = hits.where("label >= 0").groupBy("label").agg(*(F.min(c).alias(f"{c}_lo") for c in ("x", "y", "fine")), *(F.max(c).alias(f"{c}_hi") for c in ("x", "y", "fine")))
    off = lambda c, unit: (F.col(c) - (F.col(f"{c}_lo") + F.col(f"{c}_hi")) / 2) / unit
    spot = hits.join(box, "label").select("label", off("fine", 16.0 * time_bin).alias("t"), off("y", 1.0).alias("v"), off("x", 1.0).alias("u"), log_energy(F.col("tot")).alias("e"))
    inside = lambda g: F.lit(True) if not g else F.floor(F.col("t") + g[0] / 2).between(0, g[0] - 1) & F.floor(F.col("v") + g[1] / 2).between(0, g[1] - 1) & F.floor(F.col("u") + g[2] / 2).between(0, g[2] - 1)
    each = spot.groupBy("label").agg(F.count("*").alias("n"), F.sum("e").alias("e"), *(f.alias(f"{k}{i}") for i, g in enumerate(grids) for k, f in (("n", F.count_if(inside(g))), ("e", F.sum(F.when(inside(g), F.col("e")).otherwise(0.0))))))
    rows = each.select("n", "e", F.explode(F.array(*(F.struct(F.lit(g[0]).alias("bins"), F.col(f"n{i}").alias("kept"), F.col(f"e{i}").alias("energy")) for i, g in enumerate(grids)))).alias("g"))
    return rows.groupBy("g.bins").agg(F.round(F.avg((F.col("g.kept") == F.col("n")).cast("int")), 6).alias("particles"), F.round(F.sum("g.kept") / F.sum("n"), 6).alias("hits"), F.round(F.sum("g.energy") / F.sum("e"), 6).alias("energy"))


def down_bin(grid: DataFrame, bins: tuple[int, int, int] = (32, 64, 64), factors: tuple[int, int, int] = (4, 2, 2), mirror_x: bool = False) -> DataFrame:
    """grid summed into coarser cells; mirror_x flips the x axis first."""
    nt, ny, nx = bins
    ft, fy, fx = factors
    u, v, t = F.col("voxel") % nx, F.floor(F.col("voxel") / nx) % ny, F.floor(F.col("voxel") / (nx * ny))
    u = (nx - 1 - u) if mirror_x else u
    flat = (F.floor(t / ft) * (ny // fy) + F.floor(v / fy)) * (nx // fx) + F.floor(u / fx)
    return grid.groupBy("label", flat.cast("int").alias("voxel")).agg(F.round(F.sum("value"), 6).alias("value"))


def window_voxels(hits: DataFrame, factor: int = 2, time_factor: int = 16) -> DataFrame:
    """Cells of a source: hits, sum and mean of ToT, and the commonest label that isn't noise (ties: the least; -1 where all are)."""
    cell = ["source", F.floor(F.col("x") / factor).alias("cx"), F.floor(F.col("y") / factor).alias("cy"), F.floor(F.col("fine") / time_factor).alias("ct")]
    keyed = hits.select(*cell, "tot", "label")
    votes = keyed.where("label >= 0").groupBy("source", "cx", "cy", "ct", "label").count()
    major = votes.groupBy("source", "cx", "cy", "ct").agg(F.min_by("label", F.struct(-F.col("count"), "label")).alias("label"))
    sums = keyed.groupBy("source", "cx", "cy", "ct").agg(F.count("*").alias("n_hits"), F.sum("tot").alias("tot_sum"), F.round(F.avg("tot"), 6).alias("tot_mean"))
    return sums.join(major, ["source", "cx", "cy", "ct"], "left").withColumn("label", F.coalesce("label", F.lit(-1).cast("long")))


def components_by_particle(spark: SparkSession, hits: DataFrame, time_bin: float = 1.0, connectivity: str = "corner") -> DataFrame:
    """Per label: occupied voxels and the number of pieces that they fall into."""
    own = hits.where("label >= 0").withColumnRenamed("label", "particle")
    pieces = voxel_components(spark, own, time_bin, connectivity, 1, ("particle",))
    cells = voxels(own, time_bin).groupBy("particle").agg(F.count_distinct("x", "y", "vt").alias("n_voxels"))
    return pieces.groupBy("particle").agg(F.count_distinct("label").alias("n_components")).join(cells, "particle").withColumnRenamed("particle", "label")


def touching_labels(hits: DataFrame, time_bin: float = 1.0, connectivity: str = "corner") -> DataFrame:
    """Pairs of different labels with adjacent voxels, and the number of adjacencies seen from both sides; a shared voxel isn't one."""
    cells = voxels(hits.where("label >= 0"), time_bin).select("source", "x", "y", "vt", "label").distinct()
    near = adjacent_voxels(cells, connectivity, ("source",), ("label",)).where("a_label <> b_label")
    return near.groupBy(F.least("a_label", "b_label").alias("a"), F.greatest("a_label", "b_label").alias("b")).agg(F.count("*").alias("contacts"))


def standardised(rows: DataFrame, columns: list[str], train: str | None = None) -> DataFrame:
    """z-scores by population moments of the training rows (all rows where there are none); a deviation under 1e-6 counts as 1."""
    flag = F.col(train) if train else F.lit(True)
    fit = rows.agg(*(f.alias(f"_{n}_{c}") for c in columns for n, f in (("m", F.coalesce(F.avg(F.when(flag, F.col(c))), F.avg(c))), ("s", F.coalesce(F.stddev_pop(F.when(flag, F.col(c))), F.stddev_pop(c))))))
    z = lambda c: F.round((F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") < 1e-6, 1.0).otherwise(F.col(f"_s_{c}")), 6).alias(f"z_{c}")
    return rows.join(F.broadcast(fit)).select(*rows.columns, *(z(c) for c in columns))


