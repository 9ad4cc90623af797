"""Shape of particles: moments by aggregation, their axes by a vectorised function, descriptors, views and normalisation.

Hits are summed once a particle, whatever its size; a vectorised function then takes the axes of all particles of a batch
from these sums, so no hit leaves the engine. What depends on an axis (canonical frames, profiles, order along it) joins it back.
Moments are taken about a particle's first pixel and tick, lest large coordinates lose digits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitweave.operators.order import ranked
from hitweave.operators.particles import log_energy
from hitweave.operators.sampling import group_split, stable_int

LOG_FULL = 6.931471805599453  # log of 1024: the largest ToT plus one
AXES = "e1 double, e2 double, e3 double, x3 double, y3 double, t3 double, f1 double, f2 double, x2 double, y2 double"


def axes(m: pd.DataFrame) -> pd.DataFrame:
    """Eigenvalues (falling) and first axis of the 3x3 matrix, and of its pixel part, from the six distinct entries."""
    c = m[["xx", "xy", "xt", "xy", "yy", "yt", "xt", "yt", "tt"]].to_numpy(float).reshape(-1, 3, 3)
    value, vector = np.linalg.eigh(c)
    flat, own = np.linalg.eigh(c[:, :2, :2])
    lead, low = vector[:, :, 2], own[:, :, 1]
    turn = lambda v: v * np.where((v[:, 0] < -1e-9) | ((np.abs(v[:, 0]) <= 1e-9) & (v[:, 1] < 0)), -1.0, 1.0)[:, None]
    lead, low = turn(lead), turn(low)
    value, flat = np.clip(value, 0, None), np.clip(flat, 0, None)
    return pd.DataFrame({"e1": value[:, 2], "e2": value[:, 1], "e3": value[:, 0], "x3": lead[:, 0], "y3": lead[:, 1], "t3": lead[:, 2], "f1": flat[:, 1], "f2": flat[:, 0], "x2": low[:, 0], "y2": low[:, 1]})


def moments(points: DataFrame, by: str, weight: Column, x: Column, y: Column, t: Column) -> DataFrame:
    """(by, n, w, cx, cy, ct, x0, y0, t0, axes...) of weighted points; a single point has no extent."""
    first = points.groupBy(by).agg(F.min(x).alias("x0"), F.min(y).alias("y0"), F.min(t).alias("t0"))
    p = points.join(first, by).select(by, weight.alias("_w"), (x - F.col("x0")).alias("_x"), (y - F.col("y0")).alias("_y"), (t - F.col("t0")).alias("_t"), "x0", "y0", "t0")
    s = lambda *c: F.sum(F.col("_w") * (F.col(c[0]) * F.col(c[1]) if len(c) > 1 else F.col(c[0])))
    g = p.groupBy(by).agg(F.count("*").alias("n"), F.sum("_w").alias("w"), *(F.first(c).alias(c) for c in ("x0", "y0", "t0")), *(s(f"_{k}").alias(f"s{k}") for k in "xyt"), *(s(f"_{k[0]}", f"_{k[1]}").alias(f"s{k}") for k in ("xx", "xy", "xt", "yy", "yt", "tt")))
    mean = {k: F.col(f"s{k}") / F.col("w") for k in "xyt"}
    cov = F.struct(*(F.when(F.col("n") > 1, F.col(f"s{k}") / F.col("w") - mean[k[0]] * mean[k[1]]).otherwise(0.0).alias(k) for k in ("xx", "xy", "xt", "yy", "yt", "tt")))
    return g.select(by, "n", "w", *((mean[k] + F.col(f"{k}0")).alias(f"c{k}") for k in "xyt"), "x0", "y0", "t0", F.pandas_udf(axes, AXES)(cov).alias("a")).select(by, "n", "w", "cx", "cy", "ct", "x0", "y0", "t0", "a.*")


def _xyt() -> tuple[Column, Column, Column]:
    return F.col("x").cast("double"), F.col("y").cast("double"), F.col("fine") / 16.0


def geometry(hits: DataFrame, time_scale: float = 1.0, eps: float = 1e-9) -> DataFrame:
    """Per label: weighted centroid, orientation, anisotropy, time pitch, eigenvalues, scales and energy figures.

    Energies are log ToT and weigh the hits; theta is of the major axis turned to x >= 0.
    """
    x, y, t = _xyt()
    own = hits.where("label >= 0").withColumn("_e", log_energy(F.col("tot")))
    m = moments(own, "label", F.col("_e") + eps, x, y, t * time_scale)
    energy = own.groupBy("label").agg(F.sum("_e").alias("total_energy"), F.max("_e").alias("max_energy"), F.avg("_e").alias("mean_energy"), F.stddev_pop("_e").alias("std_energy"))
    some = (F.col("f1") - F.col("f2")) > 1e-9
    return m.join(energy, "label").select(
        "label", "n", "cx", "cy", F.when(some, F.atan2("y2", "x2")).otherwise(0.0).alias("theta_xy"), ((F.col("f1") - F.col("f2")) / (F.col("f1") + F.col("f2") + eps)).alias("q_theta"),
        F.atan2("t3", F.sqrt(F.col("x3") * F.col("x3") + F.col("y3") * F.col("y3")) + eps).alias("phi_t"), "e1", "e2", "e3", "f1", "f2", "total_energy", "max_energy", "mean_energy", "std_energy",
    )


def canonical(hits: DataFrame, shapes: DataFrame) -> DataFrame:
    """Hits with (u, v): their pixels turned by -theta about the centroid."""
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    c, s = F.cos("theta_xy"), F.sin("theta_xy")
    return hits.join(shapes.select("label", "cx", "cy", "theta_xy"), "label").withColumn("u", c * dx + s * dy).withColumn("v", c * dy - s * dx).drop("cx", "cy", "theta_xy")


def profile(points: DataFrame, by: str, value: str, weight: str, bins: int, name: str, from_zero: bool = False) -> DataFrame:
    """(by, name): shares of the weight in equal bins between the least (or zero) and the greatest value; all in the first where these agree."""
    ends = points.groupBy(by).agg((F.lit(0.0) if from_zero else F.min(value)).alias("_lo"), F.max(value).alias("_hi"), F.sum(weight).alias("_total"))
    lo, hi = F.col("_lo"), F.col("_hi")
    flat = F.abs(hi - lo) <= 1e-8 + 1e-5 * F.abs(hi)
    cell = F.when(flat, 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(value) - lo) / F.when(flat, 1.0).otherwise(hi - lo) * bins)))
    sums = points.join(ends, by).groupBy(by, cell.cast("int").alias("_bin")).agg((F.sum(weight) / F.when(F.first("_total") > 0, F.first("_total")).otherwise(1.0)).alias("_share"))
    held = sums.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("_bin", "_share"))).alias("_m"))
    return held.select(by, F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.coalesce(F.element_at("_m", k), F.lit(0.0))).alias(name))


def profiles(hits: DataFrame, shapes: DataFrame, longitudinal: int = 16, radial: int = 8) -> DataFrame:
    """Per label: shares of energy along the major axis and away from it, in the canonical frame."""
    turned = canonical(hits.where("label >= 0"), shapes).select("label", F.round("u", 9).alias("u"), F.abs(F.round("v", 9)).alias("v"), log_energy(F.col("tot")).alias("e"))
    return profile(turned, "label", "u", "e", longitudinal, "longitudinal").join(profile(turned, "label", "v", "e", radial, "radial", True), "label")


def descriptors(hits: DataFrame, longitudinal: int = 16, radial: int = 8) -> DataFrame:
    """(label, descriptor): 14 figures of size, energy, ratios, scales and time pitch, then both profiles; orientation isn't among them."""
    g = geometry(hits)
    ratio = lambda a, b: F.when(F.col(b) > 1e-9, F.col(a) / F.greatest(F.col(b), F.lit(1e-12))).otherwise(0.0)
    base = [F.log1p("n"), F.log1p("total_energy"), F.log1p("max_energy"), F.log1p("mean_energy"), F.log1p("std_energy"), F.col("max_energy") / (F.col("total_energy") + 1e-9), ratio("f2", "f1"), ratio("e2", "e1"), ratio("e3", "e1"), *(F.log1p(F.sqrt(c)) for c in ("e1", "e2", "e3")), F.cos("phi_t"), F.sin("phi_t")]
    return g.join(profiles(hits, g, longitudinal, radial), "label").select("label", F.concat(F.array(*base), "longitudinal", "radial").alias("descriptor"))


def view_descriptors(hits: DataFrame, time_scale: float = 0.625) -> DataFrame:
    """Per label: span, box, density and shares of variance of pixels over 128 and time over max(time_scale, 1), axis angles, and how
    steadily its hits go along the first axis in time."""
    scale = max(time_scale, 1.0)
    own = hits.where("label >= 0").withColumn("_e", log_energy(F.col("tot")))
    x, y, t = F.col("x") / 128.0, F.col("y") / 128.0, F.col("fine") / (16.0 * scale)
    m = moments(own, "label", F.col("_e") + 1e-3, x, y, t)
    box = own.groupBy("label").agg(((F.max("fine") - F.min("fine")) / 16.0).alias("time_span"), (F.max("x") - F.min("x")).cast("double").alias("bbox_x"), (F.max("y") - F.min("y")).cast("double").alias("bbox_y"))
    along = own.join(m.select("label", "x3", "y3", "t3", "x0", "y0", "t0"), "label").withColumn("_p", F.round((x - F.col("x0")) * F.col("x3") + (y - F.col("y0")) * F.col("y3") + (t - F.col("t0")) * F.col("t3"), 9))
    steps = along.withColumn("_s", F.signum(F.lead("_p").over(Window.partitionBy("label").orderBy("fine", "hit_id")) - F.col("_p"))).groupBy("label").agg(F.abs(F.avg("_s")).alias("_mono"))
    all2, all3 = F.col("f1") + F.col("f2") + 1e-12, F.col("e1") + F.col("e2") + F.col("e3") + 1e-12
    area = F.greatest("bbox_x", F.lit(1.0)) * F.greatest("bbox_y", F.lit(1.0))
    duration = F.col("time_span") / scale
    return m.join(box, "label").join(steps, "label").select(
        "label", "n", "cx", "cy", "time_span", duration.alias("duration_scaled"), "bbox_x", "bbox_y", area.alias("bbox_area"), (F.col("n") / F.greatest(area * F.greatest(duration, F.lit(1e-3)), F.lit(1e-3))).alias("density_xy_time"),
        (F.col("f1") / all2).alias("pca_xy_linearity"), (F.col("f2") / all2).alias("pca_xy_minor"), (F.col("e1") / all3).alias("pca_xyt_linearity"), ((F.col("e1") + F.col("e2")) / all3).alias("pca_xyt_planarity"),
        F.when(F.col("n") > 1, F.abs(F.col("x2"))).otherwise(1.0).alias("q_theta"), F.when(F.col("n") > 1, F.atan2("t3", F.sqrt(F.col("x3") * F.col("x3") + F.col("y3") * F.col("y3")))).otherwise(0.0).alias("phi_t"),
        F.when(F.col("n") > 2, F.coalesce("_mono", F.lit(0.0))).otherwise(0.0).alias("time_monotonicity"),
    )


def views(hits: DataFrame, most: int = 512, large: int = 512, views_per_large: int = 4, least: int = 1, seed: int = 0) -> DataFrame:
    """Hits of every (label, view_id): one view a particle, several of those with more than `large` hits; a view has at most `most`
    hits, the one of least hash in each of `most` equal strata of time. Hits of small particles are all there."""
    sizes = hits.where("label >= 0").groupBy("label").agg(F.count("*").alias("n_hits")).where(F.col("n_hits") >= least)
    placed = ranked(hits.where("label >= 0").join(sizes, "label"), "label").drop("n")
    dealt = placed.withColumn("view_id", F.explode(F.sequence(F.lit(0), F.when(F.col("n_hits") > large, views_per_large - 1).otherwise(0))))
    stratum = F.floor(F.col("pos") * most / F.col("n_hits"))
    key = stable_int(F.concat_ws(":", F.lit(seed), F.col("source"), F.col("label"), F.col("view_id"), F.col("hit_id")), 15)
    w = Window.partitionBy("label", "view_id", "_stratum").orderBy("_h", "hit_id")
    sampled = dealt.where(F.col("n_hits") > most).withColumn("_stratum", stratum).withColumn("_h", key).withColumn("_first", F.row_number().over(w)).where("_first = 1").drop("_stratum", "_h", "_first")
    return dealt.where(F.col("n_hits") <= most).unionByName(sampled).drop("pos")


def view_points(sampled: DataFrame, shapes: DataFrame, time_scale: float = 0.625) -> DataFrame:
    """The ten figures of every hit of a view: centre and first tick are of the whole particle, the rank is within the view."""
    bounds = shapes.select("label", (F.col("cx") * 128.0).alias("_cx"), (F.col("cy") * 128.0).alias("_cy"), "time_span")
    first = sampled.groupBy("label").agg(F.min("fine").alias("_view_first"))
    placed = ranked(sampled, ["label", "view_id"]).withColumnRenamed("n", "_n").join(bounds, "label").join(first, "label")
    dx, dy = (F.col("x") - F.col("_cx")) / 128.0, (F.col("y") - F.col("_cy")) / 128.0
    since = (F.col("fine") - F.coalesce("first_fine", "_view_first")) / 16.0
    r = F.sqrt(dx * dx + dy * dy)
    return placed.select(
        "label", "view_id", "hit_id", dx.alias("x_centered"), dy.alias("y_centered"), (since / max(time_scale, 1.0)).alias("t_scaled"), (since / F.greatest("time_span", F.lit(1.0))).alias("t_norm"), (log_energy(F.col("tot")) / LOG_FULL).alias("log_tot"),
        F.least(F.greatest(F.col("ftoa") / 30.0, F.lit(0.0)), F.lit(4.0)).alias("ftoa_norm"), r.alias("r_norm"), F.when(r > 0, dx / r).otherwise(1.0).alias("cos_theta"), F.when(r > 0, dy / r).otherwise(0.0).alias("sin_theta"),
        F.when(F.col("_n") > 1, F.col("pos") / (F.col("_n") - 1)).otherwise(0.0).alias("rank_time"),
    )


SUMMARY = "log_n_hits log_total_energy log_max_energy mean_energy std_energy duration_scaled log_duration bbox_x bbox_y bbox_area density_xy_time pca_xy_linearity pca_xy_minor pca_xyt_linearity pca_xyt_planarity q_theta cos_phi_t sin_phi_t sample_fraction view_log_n_hits large_flag time_monotonicity".split()


def view_summaries(hits: DataFrame, sampled: DataFrame, shapes: DataFrame, seed: int = 0) -> DataFrame:
    """One row a view: the 22 figures of SUMMARY (not finite: 0), size bucket, quality flags and split (by source alone)."""
    e = log_energy(F.col("tot"))
    energy = hits.where("label >= 0").groupBy("label").agg(F.first("source").alias("source"), F.sum(e).alias("_total"), F.max(e).alias("_max"), F.avg(e).alias("mean_energy"), F.stddev_pop(e).alias("std_energy"))
    counts = sampled.groupBy("label", "view_id").agg(F.count("*").alias("view_n_hits"))
    rows = counts.join(shapes, "label").join(energy, "label").withColumn("sample_fraction", F.col("view_n_hits") / F.col("n"))
    given = {
        "log_n_hits": F.log1p("n"), "log_total_energy": F.log1p("_total"), "log_max_energy": F.log1p("_max"), "log_duration": F.log1p("time_span"), "bbox_x": F.col("bbox_x") / 256.0, "bbox_y": F.col("bbox_y") / 256.0,
        "bbox_area": F.col("bbox_area") / 65536.0, "cos_phi_t": F.cos("phi_t"), "sin_phi_t": F.sin("phi_t"), "view_log_n_hits": F.log1p("view_n_hits"), "large_flag": (F.col("n") > F.col("view_n_hits")).cast("double"),
    }
    finite = lambda c: F.when(F.isnan(c) | (F.abs(c) == float("inf")) | c.isNull(), 0.0).otherwise(c)
    flags = F.concat_ws(";", F.when(F.col("sample_fraction") < 0.999, "sampled"), F.when(F.col("n") > 100_000, "file_scale_cluster"), F.when((F.col("pca_xyt_linearity") < 0.35) & (F.col("n") > 512), "diffuse_large"))
    bucket = F.when(F.col("n") <= 3, "1-3").when(F.col("n") <= 10, "4-10").when(F.col("n") <= 50, "11-50").when(F.col("n") <= 512, "51-512").otherwise(">512 sampled")
    return rows.select("source", "label", "view_id", F.col("n").alias("n_hits"), "view_n_hits", bucket.alias("size_bucket"), F.when(flags == "", "ok").otherwise(flags).alias("quality_flags"), group_split(F.col("source"), seed).alias("split"), *(F.round(finite(given.get(c, F.col(c).cast("double"))), 5).alias(c) for c in SUMMARY))


def view_dataset(hits: DataFrame, time_scale: float = 0.625, **kind: int) -> tuple[DataFrame, DataFrame]:
    """(points, summaries) of all views of all particles: the data set that embeddings are fitted on."""
    shapes = view_descriptors(hits, time_scale)
    firsts = hits.where("label >= 0").groupBy("label").agg(F.min("fine").alias("first_fine"))
    sampled = views(hits, **kind).join(firsts, "label")
    return view_points(sampled, shapes, time_scale), view_summaries(hits, sampled, shapes)


def candidate_features(hits: DataFrame) -> DataFrame:
    """Hits as (dx, dy over 255 from the weighted centroid, time from 0 to 1, log energy)."""
    own = hits.where("label >= 0").withColumn("_e", log_energy(F.col("tot")))
    w = F.col("_e") + 1e-9
    g = own.groupBy("label").agg((F.sum(w * F.col("x")) / F.sum(w)).alias("_cx"), (F.sum(w * F.col("y")) / F.sum(w)).alias("_cy"), F.min("fine").alias("_lo"), (F.max("fine") - F.min("fine")).alias("_span"))
    return own.join(g, "label").select("label", "hit_id", F.round((F.col("x") - F.col("_cx")) / 255.0, 6).alias("dx"), F.round((F.col("y") - F.col("_cy")) / 255.0, 6).alias("dy"), F.round(F.when(F.col("_span") > 0, (F.col("fine") - F.col("_lo")) / F.col("_span")).otherwise(0.0), 6).alias("t"), F.round(F.log1p("_e"), 6).alias("e"))


def grid_orientation(grid: DataFrame, bins: tuple[int, int, int] = (32, 64, 64), time_bin: float = 0.625, pixel_bin: float = 1.0) -> DataFrame:
    """Per label of a voxel grid: angle of the major axis modulo pi, tilt out of the pixel plane, linearity and aspect; fewer than two
    voxels give 0, 0, 0, 1."""
    _, ny, nx = bins
    x, y, t = F.col("voxel") % nx * pixel_bin, F.floor(F.col("voxel") / nx) % ny * pixel_bin, F.floor(F.col("voxel") / (nx * ny)) * time_bin
    m = moments(grid.where("value > 0"), "label", F.col("value"), x.cast("double"), y.cast("double"), t.cast("double"))
    some = F.col("n") > 1
    z = lambda c, other: F.when(some, c).otherwise(float(other))
    return m.select(
        "label", z(F.pmod(F.atan2("y2", "x2"), F.pi()), 0).alias("theta_xy"), z(F.atan2(F.abs("t3"), F.greatest(F.sqrt(F.col("x3") * F.col("x3") + F.col("y3") * F.col("y3")), F.lit(1e-12))), 0).alias("tilt"),
        z(1 - F.col("f2") / F.greatest("f1", F.lit(1e-12)), 0).alias("linearity_xy"), z(F.sqrt((F.col("f1") + 1e-12) / (F.col("f2") + 1e-12)), 1).alias("aspect_xy"),
    )


def grid_moments(grid: DataFrame, bins: tuple[int, int, int] = (32, 64, 64), most_shift: float = 0.5, most_tilt: float = 1.2, canonical_rms: float = 0.25, scales: tuple[float, float] = (0.25, 4.0)) -> DataFrame:
    """Per label of a voxel grid, in coordinates from -1 to 1: energy, centre, angle in [-pi/2, pi/2), tilt, scale and linearity, each
    within its bounds."""
    nt, ny, nx = bins
    unit = lambda k, n: F.lit(2.0) * k / (n - 1) - 1
    x, y, t = unit(F.col("voxel") % nx, nx), unit(F.floor(F.col("voxel") / nx) % ny, ny), unit(F.floor(F.col("voxel") / (nx * ny)), nt)
    p = grid.where("value > 0").select("label", "value", x.alias("gx"), y.alias("gy"), t.alias("gt"))
    m = moments(p, "label", F.col("value"), F.col("gx"), F.col("gy"), F.col("gt"))
    theta = F.pmod(F.atan2("y2", "x2") + F.pi() / 2, F.pi()) - F.pi() / 2
    side = p.join(m.select("label", "cx", "cy", "ct", theta.alias("_a")), "label").select("label", "value", ((F.col("gx") - F.col("cx")) * F.cos("_a") + (F.col("gy") - F.col("cy")) * F.sin("_a")).alias("u"), (F.col("gt") - F.col("ct")).alias("z"))
    tilt = side.groupBy("label").agg((F.sum(F.col("value") * F.col("u") * F.col("u")) / F.sum("value")).alias("uu"), (F.sum(F.col("value") * F.col("z") * F.col("z")) / F.sum("value")).alias("zz"), (F.sum(F.col("value") * F.col("u") * F.col("z")) / F.sum("value")).alias("uz"))
    clip = lambda c, lo, hi: F.least(F.greatest(c, F.lit(lo)), F.lit(hi))
    angle = F.atan2(2 * F.col("uz"), F.col("uu") - F.col("zz")) / 2  # of the major axis of the 2x2 part, with u >= 0
    return m.join(tilt, "label").select(
        "label", F.greatest("w", F.lit(1e-8)).alias("energy"), *(clip(F.col(c), -most_shift, most_shift).alias(c) for c in ("cx", "cy", "ct")), theta.alias("theta_xy"), clip(angle, -most_tilt, most_tilt).alias("theta_time"),
        clip(F.sqrt(F.greatest(F.col("e1") + F.col("e2") + F.col("e3"), F.lit(1e-8))) / canonical_rms, *scales).alias("scale"), (1 - F.col("f2") / F.greatest("f1", F.lit(1e-8))).alias("linearity_xy"),
    )


def normalised(rows: DataFrame, fit: DataFrame, columns: list[str], back: bool = False) -> DataFrame:
    """z-scores of `columns` by the one row `fit` (mean_c, std_c), or values again from z-scores; a deviation under 1e-6 counts as 1."""
    missing = [c for c in columns if f"mean_{c}" not in fit.columns]
    if missing:
        raise ValueError(f"no moments for {', '.join(missing)}")
    std = lambda c: F.when(F.col(f"std_{c}") < 1e-6, 1.0).otherwise(F.col(f"std_{c}"))
    one = rows.join(F.broadcast(fit.limit(1)))
    return one.select(*(((F.col(c) * std(c) + F.col(f"mean_{c}")) if back else (F.col(c) - F.col(f"mean_{c}")) / std(c)).alias(c) if c in columns else F.col(c) for c in rows.columns))


def fit_moments(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: mean_c and std_c (population) of each column."""
    return rows.agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))))
