"""Clusterings of vectors and how good they are: diagonal mixtures, a driver over several sizes, sweeps, and reconstruction.

Each fitting round is one pass that sums a fixed-size table in every task; nothing but parameters comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitweave.operators.embeddings import kmeans
from hitweave.operators.sampling import stable_int


def _stacked(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["embedding"].to_numpy()).astype(np.float64)


def _log_joint(x: np.ndarray, weight: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    quad = (x**2) @ (1 / var).T - 2 * x @ (mean / var).T + (mean**2 / var).sum(1)
    return np.log(weight) - 0.5 * (quad + np.log(2 * np.pi * var).sum(1))


def gaussian_mixture(vectors: DataFrame, k: int, seed: int = 1, rounds: int = 30, floor: float = 1e-6, tolerance: float = 1e-4) -> DataFrame:
    """(vec_id, cluster) by a mixture of k Gaussians with diagonal covariances: expectation-maximisation from the k-means split."""
    start = vectors.join(kmeans(vectors, k, seed), "vec_id").select("cluster", F.posexplode("embedding").alias("d", "v"))
    rows = start.groupBy("cluster", "d").agg(F.count("*").alias("n"), F.avg(F.col("v").cast("double")).alias("m"), F.var_pop(F.col("v").cast("double")).alias("s")).collect()
    dims = max(r["d"] for r in rows) + 1
    names = {c: i for i, c in enumerate(sorted({r["cluster"] for r in rows}))}
    weight, mean, var = np.zeros(len(names)), np.zeros((len(names), dims)), np.ones((len(names), dims))
    for r in rows:
        i = names[r["cluster"]]
        weight[i], mean[i, r["d"]], var[i, r["d"]] = r["n"], r["m"], max(r["s"], floor)
    weight /= weight.sum()
    last = -np.inf
    for _ in range(rounds):
        w, m, s = weight.copy(), mean.copy(), var.copy()

        def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total, first, second, fit = np.zeros(len(w)), np.zeros_like(m), np.zeros_like(m), 0.0
            for pdf in batches:
                if len(pdf):
                    x = _stacked(pdf)
                    joint = _log_joint(x, w, m, s)
                    top = joint.max(1, keepdims=True)
                    z = top[:, 0] + np.log(np.exp(joint - top).sum(1))
                    r = np.exp(joint - z[:, None])
                    total += r.sum(0)
                    first += r.T @ x
                    second += r.T @ (x**2)
                    fit += z.sum()
            yield pd.DataFrame({"part": [np.concatenate([[fit], total, first.ravel(), second.ravel()])]})

        parts = vectors.select("embedding").mapInPandas(sums, "part array<double>").select(F.posexplode("part").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
        flat = np.array([p["v"] for p in parts])
        k_, size = len(w), len(w) * dims
        fit, total = flat[0], np.maximum(flat[1 : 1 + k_], 1e-12)
        mean = flat[1 + k_ : 1 + k_ + size].reshape(k_, dims) / total[:, None]
        var = np.maximum(flat[1 + k_ + size :].reshape(k_, dims) / total[:, None] - mean**2, floor)
        weight = total / total.sum()
        if abs(fit - last) <= tolerance * abs(fit):
            break
        last = fit

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "cluster": _log_joint(_stacked(pdf), weight, mean, var).argmax(1)})

    return vectors.select("vec_id", "embedding").mapInPandas(assign, "vec_id long, cluster long")


def density_clusters(vectors: DataFrame, seed: int = 1) -> DataFrame:
    """Hierarchical density clustering isn't at hand; its stated stand-in is k-means with eight clusters."""
    return kmeans(vectors, min(8, vectors.limit(8).count()), seed)


def cluster_embeddings(vectors: DataFrame, sizes: tuple[int, ...] = (8, 12, 16, 24), seed: int = 1) -> dict[str, DataFrame]:
    """Clusterings by name: k-means and mixtures of each size that the vectors fill, and the stand-in for density clustering; under
    eight vectors (two at least) only k-means with one cluster a vector; none for fewer."""
    n = vectors.limit(max(sizes) + 1).count()
    if n < 2:
        return {}
    if n < 8:
        return {f"kmeans_{n}": kmeans(vectors, n, seed)}
    out = {}
    for k in sizes:
        if n >= k:
            out |= {f"kmeans_{k}": kmeans(vectors, k, seed), f"gmm_{k}": gaussian_mixture(vectors, k, seed)}
    return out | {"density_unavailable_kmeans_fallback": density_clusters(vectors, seed)}


def cluster_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("cluster").agg(F.count("*").alias("n"))


def _centres(vectors: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labelled vectors (noise left out), and the centre of each cluster."""
    own = vectors.join(labels.where("cluster >= 0"), "vec_id").select("vec_id", "cluster", "embedding")
    each = own.select("cluster", F.posexplode("embedding").alias("d", "v")).groupBy("cluster", "d").agg(F.avg(F.col("v").cast("double")).alias("m"), F.count("*").alias("n"))
    return own, each.groupBy("cluster").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("centre"), F.max("n").alias("n"))


def _gap(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, v: s + v)


def quality(vectors: DataFrame, labels: DataFrame, silhouette_rows: int = 1024, seed: int = 0) -> DataFrame:
    """One row: items, clusters, share of noise, silhouette, Davies-Bouldin and Calinski-Harabasz (0 where there are fewer than two
    clusters or no more items than clusters).

    The last two are of all vectors, from sums by cluster; centres are few, as many as clusters, and come to the driver. The
    silhouette is of the stated sample of rows (least hash), held against the same sample.
    """
    spark = vectors.sparkSession
    total = labels.agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("cluster") >= 0, F.col("cluster"))).alias("k"), F.count_if(F.col("cluster") >= 0).alias("valid")).first()
    n, k, valid = total["n"], total["k"], total["valid"]
    found = [0.0, 0.0, 0.0]
    if k >= 2 and valid > k:
        own, centres = _centres(vectors, labels)
        spread = own.join(centres, "cluster").select("cluster", _gap(F.col("embedding"), F.col("centre")).alias("g")).groupBy("cluster").agg(F.sum("g").alias("within"), F.avg(F.sqrt("g")).alias("radius"))
        rows = centres.join(spread, "cluster").orderBy("cluster").collect()
        c, sizes = np.array([r["centre"] for r in rows]), np.array([r["n"] for r in rows], float)
        within, radius = np.array([r["within"] for r in rows]), np.array([r["radius"] for r in rows])
        apart = np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(2), 0))
        np.fill_diagonal(apart, np.inf)
        ratio = np.where(apart > 0, (radius[:, None] + radius[None]) / np.where(apart > 0, apart, 1), 0)
        np.fill_diagonal(ratio, -np.inf)
        middle = (c * sizes[:, None]).sum(0) / sizes.sum()
        between = (sizes * ((c - middle) ** 2).sum(1)).sum()
        sample = own.withColumn("_h", stable_int(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 15)).orderBy("_h", "vec_id").limit(silhouette_rows).collect()
        found = [silhouette(np.array([r["embedding"] for r in sample], float), np.array([r["cluster"] for r in sample])), float(ratio.max(1).mean()), float(between * (valid - k) / max(within.sum() * (k - 1), 1e-300))]
    return spark.createDataFrame([(n, k, 1 - valid / n if n else 0.0, *(float(x) for x in found))], "n_items long, n_clusters long, noise_fraction double, silhouette double, davies_bouldin double, calinski_harabasz double")


def silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    """Mean of (b - a) / max(a, b) over the items of clusters with more than one."""
    names, at = np.unique(labels, return_inverse=True)
    if len(names) < 2:
        return 0.0
    d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T, 0))
    np.fill_diagonal(d, 0)
    member = np.eye(len(names))[at]
    sums, sizes = d @ member, member.sum(0)
    own = sizes[at]
    a = sums[np.arange(len(x)), at] / np.maximum(own - 1, 1)
    other = sums / sizes
    other[np.arange(len(x)), at] = np.inf
    b = other.min(1)
    s = (b - a) / np.maximum(np.maximum(a, b), 1e-12)
    return float(s[own > 1].mean()) if (own > 1).any() else 0.0


def size_sweep(vectors: DataFrame, sizes: tuple[int, ...] = (2, 4, 6, 8, 12), seed: int = 1) -> DataFrame:
    """(k, inertia, least, greatest): k-means of each size, its squared distance to the centres, and its smallest and largest cluster."""
    out = []
    for k in sizes:
        labels = kmeans(vectors, k, seed)
        own, centres = _centres(vectors, labels)
        inertia = own.join(centres, "cluster").agg(F.sum(_gap(F.col("embedding"), F.col("centre")))).first()[0]
        n = [r["n"] for r in cluster_counts(labels).collect()]
        out.append((k, float(inertia or 0.0), min(n, default=0), max(n, default=0)))
    return vectors.sparkSession.createDataFrame(out, "k int, inertia double, least long, greatest long")


def pca_model(vectors: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, the first k axes (rows, the greatest entry of each positive), and explained variances over n - 1; sums have a fixed size."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, first, second = 0, None, None
        for pdf in batches:
            if len(pdf):
                x = _stacked(pdf)
                n += len(x)
                first = x.sum(0) if first is None else first + x.sum(0)
                second = x.T @ x if second is None else second + x.T @ x
        if n:
            yield pd.DataFrame({"part": [np.concatenate([[n], first, second.ravel()])]})

    rows = vectors.select("embedding").mapInPandas(sums, "part array<double>").select(F.posexplode("part").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    flat = np.array([r["v"] for r in rows])
    d = int((np.sqrt(4 * len(flat) - 3) - 1) / 2)
    n, mean = flat[0], flat[1 : 1 + d] / flat[0]
    cov = (flat[1 + d :].reshape(d, d) - n * np.outer(mean, mean)) / max(n - 1, 1)
    value, vector = np.linalg.eigh(cov)
    axes = vector[:, ::-1][:, :k].T
    axes = axes * np.where(axes[np.arange(len(axes)), np.abs(axes).argmax(1)] < 0, -1, 1)[:, None]
    return mean, axes, np.maximum(value[::-1][:k], 0)


def pca_scores(vectors: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """(vec_id, scores, error): coordinates on the axes, and the relative L2 error of the vector rebuilt from them."""
    mean, axes, _ = model

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = _stacked(pdf)
                z = (x - mean) @ axes.T
                error = np.sqrt(((x - mean - z @ axes) ** 2).sum(1) / np.maximum((x**2).sum(1), 1e-12))
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "scores": list(z), "error": error})

    return vectors.select("vec_id", "embedding").mapInPandas(run, "vec_id long, scores array<double>, error double")


def exported(vectors: DataFrame, labels: DataFrame, most: int | None = None) -> DataFrame:
    """Vectors with their cluster, the first `most` by id if given (a top-k)."""
    rows = vectors.select("vec_id", "embedding").join(labels, "vec_id", "left")
    return rows if most is None else rows.orderBy("vec_id").limit(most)


def neighbour_pairs(vectors: DataFrame, k: int, source: str, sizes: str, query_every: int = 100, ratio: float = 4.0) -> DataFrame:
    """(a, b, distance) of near vectors of different sources whose sizes are within `ratio`, after z-scores of every component; each
    unordered pair once."""
    from hitweave.operators.embeddings import nearest

    parts = vectors.select("vec_id", F.posexplode("embedding").alias("d", "v"))
    fit = parts.groupBy("d").agg(F.avg(F.col("v").cast("double")).alias("m"), F.stddev_pop(F.col("v").cast("double")).alias("s")).agg(F.array_sort(F.collect_list(F.struct("d", "m", F.greatest("s", F.lit(1e-6)).alias("s")))).alias("fit"))
    scaled = vectors.join(F.broadcast(fit)).withColumn("embedding", F.zip_with("embedding", "fit", lambda v, f: (v.cast("double") - f["m"]) / f["s"])).drop("fit")
    near = nearest(scaled, k, query_every)
    side = lambda p: vectors.select(F.col("vec_id").alias(p), F.col(source).alias(f"{p}_source"), F.col(sizes).cast("double").alias(f"{p}_size"))
    j = near.join(side("a"), "a").join(side("b"), "b").where((F.col("a_source") != F.col("b_source")) & (F.greatest("a_size", "b_size") <= ratio * F.greatest(F.least("a_size", "b_size"), F.lit(1e-9))))
    return j.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance").distinct()


def balanced_batches(rows: DataFrame, bucket: str, key: str, batch: int, batches: int, seed: int = 0) -> DataFrame:
    """(batch, draw, key): equal draws from every bucket that isn't empty, with replacement; draw j of batch i takes the row at a hashed
    place of its bucket."""
    from hitweave.operators.order import ranked

    names = sorted(r[0] for r in rows.select(bucket).distinct().collect())
    placed = ranked(rows.select(bucket, key), bucket, (key,), F.shiftright(F.col(key).cast("long"), 34))
    sizes = placed.groupBy(bucket).agg(F.count("*").alias("_n"))
    draws = rows.sparkSession.range(batch * batches).select((F.col("id") / batch).cast("long").alias("batch"), (F.col("id") % batch).alias("draw"))
    draws = draws.withColumn(bucket, F.element_at(F.array(*(F.lit(b) for b in names)), (F.col("draw") % len(names) + 1).cast("int")) if names else F.lit(None))
    at = F.pmod(stable_int(F.concat_ws(":", F.lit(seed), "batch", "draw"), 15), F.col("_n"))
    return draws.join(sizes, bucket).withColumn("pos", at).join(placed.select(bucket, "pos", key), [bucket, "pos"]).select("batch", "draw", bucket, key)


