"""Weighted moments, orientation, profiles, linearity, nearness of particles, and fixed-length paths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitweave.operators.particles import log_energy

EPS = 1e-9


def weighted_moments(hits: DataFrame) -> DataFrame:
    """Per label: weighted centroid and covariance of pixels, orientation of the major axis and its anisotropy q, in closed form."""
    w = log_energy(F.col("tot")) + EPS
    s = lambda c: F.sum(w * c)
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    g = hits.where("label >= 0").groupBy("label").agg(F.count("*").alias("n"), F.sum(w).alias("w"), s(x).alias("sx"), s(y).alias("sy"), s(x * x).alias("sxx"), s(y * y).alias("syy"), s(x * y).alias("sxy"))
    cx, cy = F.col("sx") / F.col("w"), F.col("sy") / F.col("w")
    some = F.col("n") > 1
    var = lambda c, a, b: F.when(some, F.col(c) / F.col("w") - a * b).otherwise(0.0)
    m = g.select("label", "n", cx.alias("cx"), cy.alias("cy"), F.greatest(var("sxx", cx, cx), F.lit(0.0)).alias("vxx"), F.greatest(var("syy", cy, cy), F.lit(0.0)).alias("vyy"), var("sxy", cx, cy).alias("vxy"))
    spread = F.sqrt((F.col("vxx") - F.col("vyy")) ** 2 + 4 * F.col("vxy") ** 2)
    r = lambda c: F.round(c, 5)
    angle = F.atan2(2 * F.col("vxy"), F.col("vxx") - F.col("vyy")) / 2
    theta = F.when(spread < 1e-6, 0.0).when(angle < -1.5707, angle + F.pi()).otherwise(angle)  # a vertical axis is +pi/2
    q = F.when(spread < 1e-6, 0.0).otherwise(spread / (F.col("vxx") + F.col("vyy") + EPS))
    return m.select("label", "n", r(F.col("cx")).alias("cx"), r(F.col("cy")).alias("cy"), r(F.col("vxx")).alias("vxx"), r(F.col("vyy")).alias("vyy"), r(F.col("vxy")).alias("vxy"), F.round(theta, 4).alias("theta"), F.round(q, 4).alias("q_theta"))


def angle_distance(a: Column, b: Column) -> Column:
    """Distance of two angles modulo pi."""
    return F.abs(F.atan2(F.sin(2 * (a - b)), F.cos(2 * (a - b)))) / 2


def longitudinal_profile(hits: DataFrame, bins: int = 16) -> DataFrame:
    """Share of a label's energy in each bin along x between its least and greatest x; all in bin 0 where these are equal."""
    e = log_energy(F.col("tot"))
    w = Window.partitionBy("label")
    lo, hi = F.min("x").over(w), F.max("x").over(w)
    binned = hits.where("label >= 0").select("label", e.alias("e"), F.when(hi == lo, 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col("x") - lo) * bins / F.when(hi == lo, 1).otherwise(hi - lo)))).cast("int").alias("bin"))
    g = binned.groupBy("label", "bin").agg(F.sum("e").alias("e"))
    total = F.sum("e").over(Window.partitionBy("label"))
    return g.select("label", "bin", F.round(F.when(total > 0, F.col("e") / total).otherwise(0.0), 6).alias("share"))


def principal_axes(hits: DataFrame, time_scale: float = 0.625) -> DataFrame:
    """Per label: linearity (s0 - s1) / (s0 + s1) of the singular values of its centred points, and the first axis.

    Nine sums are aggregated in the engine; a vectorised function takes the eigenvalues of all labels of a batch at once.
    """
    x, y, t = F.col("x").cast("double"), F.col("y").cast("double"), F.col("fine") / (16.0 * time_scale)
    # moments about the label's first point, lest large times lose digits
    first = hits.where("label >= 0").groupBy("label").agg(F.min("fine").alias("f0"))
    t = (F.col("fine") - F.col("f0")) / (16.0 * time_scale)
    g = hits.where("label >= 0").join(first, "label").groupBy("label").agg(F.count("*").alias("n"), *(F.sum(c).alias(k) for k, c in (("sx", x), ("sy", y), ("st", t), ("sxx", x * x), ("syy", y * y), ("stt", t * t), ("sxy", x * y), ("sxt", x * t), ("syt", y * t))))

    @F.pandas_udf("linearity double, vx double, vy double, vt double")
    def axes(m: pd.DataFrame) -> pd.DataFrame:
        n = m["n"].to_numpy(float)
        mean = m[["sx", "sy", "st"]].to_numpy() / n[:, None]
        raw = m[["sxx", "sxy", "sxt", "sxy", "syy", "syt", "sxt", "syt", "stt"]].to_numpy().reshape(-1, 3, 3)
        value, vector = np.linalg.eigh(raw - n[:, None, None] * mean[:, :, None] * mean[:, None, :])
        s = np.sqrt(np.clip(value, 0, None))
        lead = vector[:, :, 2]
        lead = lead * np.where(lead[np.arange(len(lead)), np.abs(lead).argmax(1)] < 0, -1, 1)[:, None]
        lin = np.clip((s[:, 2] - s[:, 1]) / (s[:, 2] + s[:, 1] + 1e-12), 0, 1)
        alone = n < 2
        lin, lead = np.where(alone, 0.0, lin), np.where(alone[:, None], [1.0, 0.0, 0.0], lead)
        return pd.DataFrame({"linearity": lin, "vx": lead[:, 0], "vy": lead[:, 1], "vt": lead[:, 2]})

    return g.select("label", "n", axes(F.struct(*(c for c in g.columns if c != "label"))).alias("a")).select("label", "n", "a.*")


def near_particles(parts: DataFrame, threshold: float, time_scale: float = 0.625) -> DataFrame:
    """Pairs of particles of one source whose boxes are within `threshold` in (x, y, scaled time); a < b.

    Boxes are dealt to all time buckets that they touch, widened by the threshold, so the join is by equality; a pair that meets in
    several buckets is kept in the first.
    """
    unit = 16.0 * time_scale
    wide = int(max(threshold * unit, 64))
    lo, hi = F.floor(F.col("first_fine") / wide), F.floor(F.col("last_fine") / wide)
    box = ("min_x", "max_x", "min_y", "max_y", "first_fine", "last_fine")
    left = parts.select("source", F.explode(F.sequence(lo, hi)).alias("bucket"), *(F.col(c).alias(f"a_{c}") for c in ("label", *box)), lo.alias("a_lo"))
    right = parts.select("source", F.explode(F.sequence(lo - 1, hi + 1)).alias("bucket"), *(F.col(c).alias(f"b_{c}") for c in ("label", *box)), (lo - 1).alias("b_lo"))
    gap = lambda a, b, c, d: F.greatest(F.col(c) - F.col(b), F.col(a) - F.col(d), F.lit(0))
    gx, gy = gap("a_min_x", "a_max_x", "b_min_x", "b_max_x"), gap("a_min_y", "a_max_y", "b_min_y", "b_max_y")
    gt = gap("a_first_fine", "a_last_fine", "b_first_fine", "b_last_fine") / unit
    near = gx * gx + gy * gy + gt * gt
    return (
        left.join(right, ["source", "bucket"]).where((F.col("a_label") < F.col("b_label")) & (F.col("bucket") == F.greatest("a_lo", "b_lo")) & (near <= threshold * threshold + 1e-12))
        .select("source", F.col("a_label").alias("a"), F.col("b_label").alias("b"), F.round(F.sqrt(near), 6).alias("box_distance"))
    )


def suspicious_splits(parts: DataFrame, axes: DataFrame, eps: float = 5.0, time_scale: float = 0.625) -> DataFrame:
    """Near pairs of linear particles (0.70 at least) whose axes agree (0.85 at least)."""
    side = lambda k: axes.select(F.col("label").alias(k), *(F.col(c).alias(f"{k}_{c}") for c in ("linearity", "vx", "vy", "vt")))
    p = near_particles(parts, 1.25 * eps, time_scale).join(side("a"), "a").join(side("b"), "b")
    agree = F.abs(F.col("a_vx") * F.col("b_vx") + F.col("a_vy") * F.col("b_vy") + F.col("a_vt") * F.col("b_vt"))
    return p.where((F.col("a_linearity") >= 0.7) & (F.col("b_linearity") >= 0.7) & (agree >= 0.85)).select("source", "a", "b", "box_distance")


def suspicious_merges(parts: DataFrame, axes: DataFrame, eps: float = 5.0, time_scale: float = 0.625, least: int = 100) -> DataFrame:
    """Particles that may be several: at least max(least, p99 of their source) hits, linearity under 0.35, wider than 4 eps in pixels and in
    scaled time."""
    p99 = parts.groupBy("source", "n_hits").count().groupBy("source").agg(F.percentile("n_hits", F.lit(0.99), F.col("count")).alias("p99"))
    wide = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")) > 4 * eps
    long = (F.col("last_fine") - F.col("first_fine")) / (16.0 * time_scale) > 4 * eps
    return parts.join(p99, "source").join(axes.select("label", "linearity"), "label").where((F.col("n_hits") >= F.greatest(F.lit(least), "p99")) & (F.col("linearity") < 0.35) & wide & long).select("source", "label", "n_hits")


def resampled_paths(hits: DataFrame, points: int = 128) -> DataFrame:
    """(label, step, x, y, t): each label's hits in time order, interpolated linearly at `points` even steps of their index, centred."""
    w = Window.partitionBy("label").orderBy("fine", "y", "x", "hit_id")
    whole = Window.partitionBy("label")
    at = hits.where("label >= 0").select("label", "x", "y", "fine", (F.row_number().over(w) - 1).alias("i"), F.count("*").over(whole).alias("n"), F.lead("x").over(w).alias("x1"), F.lead("y").over(w).alias("y1"), F.lead("fine").over(w).alias("f1"))
    # step k lies at index k * (n - 1) / (points - 1): each hit serves the steps up to the next hit
    scale = F.lit(points - 1)
    first = F.when(F.col("n") == 1, 0).otherwise(F.ceil(F.col("i") * scale / F.greatest(F.col("n") - 1, F.lit(1)) - 1e-9))
    last = F.when(F.col("n") == 1, points - 1).when(F.col("i") == F.col("n") - 1, points - 1).otherwise(F.ceil((F.col("i") + 1) * scale / F.greatest(F.col("n") - 1, F.lit(1)) - 1e-9) - 1)
    dealt = at.where(first <= last).select("*", F.explode(F.sequence(first, last)).alias("step"))
    part = F.when(F.col("n") == 1, 0.0).otherwise(F.col("step") * (F.col("n") - 1) / scale - F.col("i"))
    mix = lambda a, b: F.col(a) + F.when(F.col(b).isNull(), 0.0).otherwise((F.col(b) - F.col(a)) * part)
    p = dealt.select("label", F.col("step").cast("int").alias("step"), mix("x", "x1").alias("x"), mix("y", "y1").alias("y"), (mix("fine", "f1") / 16.0).alias("t"))
    return p.select("label", "step", *(F.round(F.col(c) - F.avg(c).over(whole) + 1e-7, 4).alias(c) for c in ("x", "y", "t")))
