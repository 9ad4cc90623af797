"""Operators over vectors: neighbours, disjoint pairs, group moments, medoids, k-means, principal components, histograms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitweave.session import written


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def nearest(vectors: DataFrame, k: int, query_every: int = 100, block: int = 2048) -> DataFrame:
    """(a, b, rank, distance): the k nearest others, ties by id, of every vector whose id is a multiple of query_every, among all vectors.

    The queries are a stated set. They go out in blocks of `block`, which bounds what driver and tasks hold; each task keeps the k
    best of its own vectors for each query, and only these meet in the last ranking. A block's result is written before the next goes
    out, so the plan holds one block.
    """
    queries = vectors.where(F.col("vec_id") % query_every == 0).select("vec_id", "embedding")
    n_blocks = max(1, -(-queries.count() // block))
    out, last = None, None
    for b in range(n_blocks):
        if last is not None:
            done = written(vectors.sparkSession, last, "nearest")
            out = done if out is None else out.unionByName(done)
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b).orderBy("vec_id").collect()
        last = _nearest_block(vectors, np.array([r["vec_id"] for r in rows], np.int64), np.array([r["embedding"] for r in rows], np.float64), k)
    return last if out is None else out.unionByName(last)


def best_of(ids: np.ndarray, q: np.ndarray, own: np.ndarray, m: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, id, distance) of the k nearest rows of m to each query, ties by id.

    One matrix product gives distances up to rounding; rows within that of the k-th are measured exactly, so ties are kept whole.
    """
    rough = np.maximum((q**2).sum(1)[:, None] + (m**2).sum(1)[None, :] - 2 * (q @ m.T), 0)
    rough[ids[:, None] == own[None, :]] = np.inf
    kth = np.partition(rough, k - 1, axis=1)[:, k - 1] if m.shape[0] > k else np.full(len(q), np.inf)
    slack = 1e-9 * (1 + (q**2).sum(1) + (m**2).sum(1).max())
    i, j = np.nonzero((rough <= (kth + slack)[:, None]) & np.isfinite(rough))
    d = np.empty(len(i))
    for lo in range(0, len(i), 100_000):
        part = slice(lo, lo + 100_000)
        d[part] = np.sqrt(((m[j[part]] - q[i[part]]) ** 2).sum(1))
    order = np.lexsort((own[j], d, i))
    i, j, d = i[order], j[order], d[order]
    firsts = np.searchsorted(i, np.arange(len(q)))
    keep = np.arange(len(i)) - firsts[i] < k
    return i[keep], own[j[keep]], d[keep]


def _nearest_block(vectors: DataFrame, ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    from pyspark.sql import Window

    def best(batches):
        held = pd.DataFrame({"i": [], "b": [], "distance": []}).astype({"i": "int64", "b": "int64", "distance": "float64"})
        for pdf in batches:
            if len(pdf) and len(ids):
                m, own = np.stack(pdf["embedding"].to_numpy()).astype(np.float64), pdf["vec_id"].to_numpy()
                for lo in range(0, len(own), 2048):
                    i, b, d = best_of(ids, q, own[lo : lo + 2048], m[lo : lo + 2048], k)
                    held = pd.concat([held, pd.DataFrame({"i": i, "b": b, "distance": d})])
                held = held.sort_values(["i", "distance", "b"]).groupby("i").head(k)
        yield pd.DataFrame({"a": ids[held["i"].to_numpy()] if len(held) else held["i"], "b": held["b"], "distance": held["distance"]})

    found = vectors.select("vec_id", "embedding").mapInPandas(best, "a long, b long, distance double")
    w = Window.partitionBy("a").orderBy("distance", "b")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("distance", F.round("distance", 5))


def disjoint_pairs(pairs: DataFrame, n: int, block: int = 1000) -> list[tuple[int, int, float]]:
    """Greedy pairs in ascending distance, each id once, at most n: sequential, until n are found or no pair is left.

    Candidates come in blocks of the nearest pairs without the ids used so far (at most 2 n, a broadcast), so a block whose pairs all
    share an id costs one more round, not the pairs behind it. Each block gives at least one pair.
    """
    used, out, left = set(), [], pairs
    while len(out) < n:
        rows = left.orderBy("distance", "a", "b").limit(max(50 * n, block)).collect()
        for r in rows:
            if r["a"] not in used and r["b"] not in used:
                used |= {r["a"], r["b"]}
                out.append((r["a"], r["b"], r["distance"]))
                if len(out) == n:
                    break
        if not rows:
            break
        ids = pairs.sparkSession.createDataFrame([(i,) for i in sorted(used)], "id long")
        left = pairs.join(F.broadcast(ids.withColumnRenamed("id", "a")), "a", "left_anti").join(F.broadcast(ids.withColumnRenamed("id", "b")), "b", "left_anti")
    return out


def group_moments(vectors: DataFrame, by: str = "label") -> DataFrame:
    """Per group: vectors, norm of the centroid, and rms distance to it."""
    each = vectors.select(by, "vec_id", F.posexplode("embedding").alias("d", "v"))
    dims = each.groupBy(by, "d").agg(F.sum(F.col("v").cast("double")).alias("s"), F.sum(F.col("v").cast("double") * F.col("v").cast("double")).alias("ss"), F.count("*").alias("n"))
    return dims.groupBy(by).agg(F.max("n").alias("n"), F.sum((F.col("s") / F.col("n")) ** 2).alias("c2"), F.sum(F.col("ss") / F.col("n")).alias("e2")).select(by, "n", F.round(F.sqrt("c2"), 4).alias("centroid_norm"), F.round(F.sqrt(F.greatest(F.col("e2") - F.col("c2"), F.lit(0.0))), 4).alias("rms"))


def medoids(vectors: DataFrame, by: str = "label") -> DataFrame:
    """Per group: the vector nearest to the group's mean, ties by id."""
    mean = vectors.select(by, F.posexplode("embedding").alias("d", "v")).groupBy(by, "d").agg(F.avg(F.col("v").cast("double")).alias("m")).groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("mean"))
    d = squared_distance(F.col("embedding"), F.col("mean"))
    return vectors.join(mean, by).groupBy(by).agg(F.min_by("vec_id", F.struct(F.round(d, 9), F.col("vec_id"))).alias("vec_id"), F.round(F.sqrt(F.min(d)), 4).alias("distance"))


def correlations(vectors: DataFrame, dims: int) -> DataFrame:
    """(i, j, r) Pearson correlations of the first `dims` components; 0 where a deviation is under 1e-12."""
    cols = [F.get("embedding", F.lit(i)).cast("double").alias(f"c{i}") for i in range(dims)]
    wide = vectors.select(*cols)
    pairs = [(i, j) for i in range(dims) for j in range(i + 1, dims)]
    r = lambda i, j: F.when((F.stddev_pop(f"c{i}") < 1e-12) | (F.stddev_pop(f"c{j}") < 1e-12), 0.0).otherwise(F.corr(f"c{i}", f"c{j}"))
    one = wide.agg(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.round(r(i, j), 5).alias("r")) for i, j in pairs)).alias("all"))
    return one.select(F.explode("all").alias("p")).select("p.*")


def histogram_2d(points: DataFrame, x: str, y: str, bins: int, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Counts in bins x bins cells between the `low` and `high` quantiles with a margin of 3 %; equal bounds become mean -1 and +1."""
    at = lambda c, q: F.min(c) if q == 0 else F.max(c) if q == 1 else F.percentile(c, F.lit(q))
    bounds = points.agg(*(at(c, q).alias(f"{c}_{n}") for c in (x, y) for n, q in (("lo", low), ("hi", high))), F.avg(x).alias(f"{x}_m"), F.avg(y).alias(f"{y}_m"))
    margin = lambda c: 0.03 * (F.col(f"{c}_hi") - F.col(f"{c}_lo"))
    flat = lambda c: F.col(f"{c}_hi") <= F.col(f"{c}_lo")
    lo = lambda c: F.when(flat(c), F.col(f"{c}_m") - 1).otherwise(F.col(f"{c}_lo") - margin(c))
    hi = lambda c: F.when(flat(c), F.col(f"{c}_m") + 1).otherwise(F.col(f"{c}_hi") + margin(c))
    cell = lambda c: F.least(F.lit(bins - 1), F.floor((F.col(c) - lo(c)) / (hi(c) - lo(c)) * bins))
    inside = lambda c: (F.col(c) >= lo(c)) & (F.col(c) <= hi(c))
    return points.join(F.broadcast(bounds)).where(inside(x) & inside(y)).groupBy(cell(x).cast("int").alias("bx"), cell(y).cast("int").alias("by")).count().withColumnRenamed("count", "n")


def kmeans(vectors: DataFrame, k: int, seed: int = 1, iterations: int = 20) -> DataFrame:
    """(vec_id, cluster) by the engine's k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select("vec_id", array_to_vector(F.transform("embedding", lambda v: v.cast("double"))).alias("features"))
    model = KMeans(k=k, seed=seed, maxIter=iterations).fit(rows)
    return model.transform(rows).select("vec_id", F.col("prediction").cast("long").alias("cluster"))


def principal_components(vectors: DataFrame, k: int) -> DataFrame:
    """(component, explained, share) from the covariance over n - 1; the matrix of sums has a fixed size (dimensions squared)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    rows = vectors.select(array_to_vector(F.transform("embedding", lambda v: v.cast("double"))).alias("features"))
    model = PCA(k=k, inputCol="features", outputCol="p").fit(rows)
    spark = vectors.sparkSession
    return spark.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(model.explainedVariance.toArray())], "component int, share double")


def elbow(curve: DataFrame, x: str, y: str) -> DataFrame:
    """The x whose point is farthest from the chord between the curve's ends, both axes scaled to [0, 1]."""
    ends = curve.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.max_by(y, x).alias("y1"), F.min_by(y, x).alias("y0"))
    u = (F.col(x) - F.col("x0")) / F.greatest(F.col("x1") - F.col("x0"), F.lit(1e-12))
    v = (F.col("y0") - F.col(y)) / F.greatest(F.col("y0") - F.col("y1"), F.lit(1e-12))
    return curve.join(F.broadcast(ends)).agg(F.max_by(x, F.struct((v - u), -F.col(x))).alias(x))
