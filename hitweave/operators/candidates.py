"""Clustering of candidates: small sets of points (frames, bootstrap candidates, descriptors) by density over chosen features.

Candidates are grouped into tasks by hash, many to a task, and each is clustered by itself; a candidate is a frame or a chunk of a
stated size, never a whole source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitweave.operators.components import local_components

MODES = {"xy": ("x", "y"), "xyt": ("x", "y", "t"), "xyte": ("x", "y", "t", "energy")}


def density_labels(points: np.ndarray, eps: float, min_samples: int, block: int = 2048) -> np.ndarray:
    """Labels from 0 by first core, -1 for noise: cores have min_samples points within eps (themselves too), a border point joins the
    cluster of its first core. Distances are taken in blocks; points are swept along their first feature."""
    n = len(points)
    order = np.argsort(points[:, 0], kind="stable") if n else np.zeros(0, int)
    p = points[order]
    reach = np.searchsorted(p[:, 0], p[:, 0] + eps + 1e-9, "right") if n else order
    found_a, found_b = [], []
    for lo in range(0, n, block):
        hi = min(n, lo + block)
        end = int(reach[hi - 1])
        for start in range(lo, end, block):
            stop = min(end, start + block)
            near = ((p[lo:hi, None] - p[None, start:stop]) ** 2).sum(2) <= eps * eps + 1e-12
            i, j = np.nonzero(near)
            keep = i + lo < j + start
            found_a.append(order[i[keep] + lo])
            found_b.append(order[j[keep] + start])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_a, found_b))
    core = np.bincount(a, minlength=n) + np.bincount(b, minlength=n) + 1 >= min_samples
    both = core[a] & core[b]
    root = local_components(n, a[both], b[both])
    label = np.where(core, root, -1)
    s, c = np.concatenate([a, b]), np.concatenate([b, a])
    pick = ~core[s] & core[c]
    first = np.full(n, n)
    np.minimum.at(first, s[pick], c[pick])
    label[first < n] = root[first[first < n]]
    names, dense = np.unique(label[label >= 0], return_inverse=True)  # the least point of a component is its first core
    label[label >= 0] = dense
    return label


def candidate_labels(points: DataFrame, eps: float = 1.5, min_samples: int = 3, mode: str = "xy", tasks: int | None = None) -> DataFrame:
    """points(candidate, point, x, y, t, energy) with `label` within each candidate, over the features of `mode`."""
    if mode not in MODES:
        raise ValueError(f"unknown features {mode!r}; known: {', '.join(MODES)}")
    columns = list(MODES[mode])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            change = np.flatnonzero(held["candidate"].to_numpy()[1:] != held["candidate"].to_numpy()[:-1])
            if len(change):
                cut = int(change[-1]) + 1
                yield label(held.iloc[:cut])
                held = held.iloc[cut:].reset_index(drop=True)
        if held is not None and len(held):
            yield label(held)

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = pdf[columns].to_numpy(float), pdf["candidate"].to_numpy()
        bounds = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [len(ids)]])
        return pdf.assign(label=np.concatenate([density_labels(x[i:j], eps, min_samples) for i, j in zip(bounds, bounds[1:])]).astype("int64"))

    dealt = points.repartition(tasks, "candidate") if tasks else points.repartition("candidate")
    return dealt.sortWithinPartitions("candidate", "point").mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema) + ", label long")


def split_candidates(labelled: DataFrame) -> DataFrame:
    """Clusters as candidates of their own, named parent:cluster:label; noise is left out."""
    return labelled.where("label >= 0").select(F.concat_ws(":", F.col("candidate").cast("string"), F.lit("cluster"), F.col("label").cast("string")).alias("candidate"), *(c for c in labelled.columns if c not in ("candidate", "label")))


def bootstrap_candidates(frames: DataFrame, most_frames: int | None = None, eps: float = 1.5, min_samples: int = 3) -> DataFrame:
    """Clusters of the pixels of frames(frame, x, y, energy), as candidates; the first `most_frames` frames if given."""
    if most_frames is not None:
        frames = frames.join(frames.select("frame").distinct().orderBy("frame").limit(most_frames), "frame", "left_semi")
    points = frames.select(F.col("frame").alias("candidate"), (F.col("y") * 256 + F.col("x")).cast("long").alias("point"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.lit(0.0).alias("t"), F.col("energy").cast("double").alias("energy"))
    return split_candidates(candidate_labels(points, eps, min_samples, "xy"))


#: Values held as anchors: 2,048 vectors of 64.
ANCHOR_VALUES = 2**17


def core_crowd(vectors: DataFrame, eps: float, min_samples: int, values: int = ANCHOR_VALUES) -> DataFrame:
    """vectors(vec_id, embedding) with `crowd`: true for cores of one component that a bounded set of vectors, the anchors, shows to be so.

    Anchors with enough others near them are cores, and their largest component is taken. A vector with enough anchors near it is a core,
    and of that component if one of its anchors is near. Where this shows nothing, `crowd` is false.
    """
    first = vectors.where("embedding is not null and size(embedding) > 0").select(F.size("embedding")).first()
    dims = first[0] if first else 0
    least = vectors.where((F.size("embedding") == dims) & (F.size("embedding") > 0)).orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, values // max(dims, 1)))
    kept = [r for r in least.select("vec_id", "embedding").collect() if None not in r["embedding"] and np.isfinite(r["embedding"]).all()]
    ids, held = np.array([r["vec_id"] for r in kept], np.int64), np.array([r["embedding"] for r in kept], np.float64).reshape(len(kept), -1)
    squares = (held**2).sum(1)

    def near(own: np.ndarray, m: np.ndarray) -> np.ndarray:
        # pairs so near to eps that the product's rounding might decide are left to the exact distance
        sums = (m**2).sum(1)[:, None] + squares[None, :]
        return (sums - 2 * (m @ held.T) <= eps * eps - 1e-9 * (1 + sums)) & (own[:, None] != ids[None, :])

    between = near(ids, held) if len(ids) else np.zeros((0, 0), bool)
    core = between.sum(1) + 1 >= min_samples
    a, b = np.nonzero(between & core[:, None] & core[None, :])
    label = np.where(core, local_components(len(ids), a, b), len(ids))
    size = np.bincount(label, minlength=len(ids) + 1)[: len(ids)]
    some = bool(len(size)) and bool(size.max() > 0)
    member = label == size.argmax() if some else np.zeros(len(ids), bool)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            crowd, own = np.zeros(len(pdf), bool), pdf["vec_id"].to_numpy()
            fits = np.array([v is not None and len(v) == dims for v in pdf["embedding"]], bool)
            at = np.flatnonzero(fits) if some else np.zeros(0, int)
            for lo in range(0, len(at), 1024):
                part = at[lo : lo + 1024]
                hit = near(own[part], np.stack(pdf["embedding"].to_numpy()[part]).astype(np.float64))
                crowd[part] = (hit.sum(1) + 1 >= min_samples) & hit[:, member].any(1) | np.isin(own[part], ids[member])
            yield pdf.assign(crowd=crowd)

    return vectors.select("vec_id", "embedding").mapInPandas(run, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, embedding {vectors.schema['embedding'].dataType.simpleString()}, crowd boolean")


def descriptor_labels(vectors: DataFrame, eps: float, min_samples: int = 3, method: str = "dbscan") -> DataFrame:
    """(vec_id, label) of descriptor vectors by density, over all of them.

    Cores that anchors show to be of one component need no pairs among themselves (`core_crowd`); only the other vectors are joined, with
    all. Vectors within eps have norms within eps and projections on any unit direction within eps: buckets of the norm and of one fixed
    direction, each eps wide, meet their neighbours by equality, and the exact distance decides. Hierarchical density clustering
    isn't at hand.
    """
    from pyspark.sql import Window

    from hitweave.operators.components import components
    from hitweave.operators.embeddings import squared_distance
    from hitweave.session import written

    if method != "dbscan":
        raise ValueError(f"unknown method {method!r}; known: dbscan")
    spark = vectors.sparkSession
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    along = F.aggregate(F.transform("embedding", lambda v, i: v.cast("double") * F.when(F.pmod(i * 7919 + 13, F.lit(3)) == 0, -1.0).otherwise(1.0)), F.lit(0.0), lambda s, v: s + v) / F.sqrt(F.size("embedding").cast("double"))
    cell = lambda c: F.floor(c / eps)
    marked = written(spark, core_crowd(vectors.where("vec_id is not null and size(embedding) > 0"), eps, min_samples), "crowd")
    base = marked.select("vec_id", "embedding", cell(norm).alias("p"), cell(along).alias("q"), "crowd")
    crowd = base.where("crowd").select(F.col("vec_id").alias("a")).distinct()
    least = crowd.agg(F.min("a")).first()[0]
    step = lambda c: F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1))
    other = base.withColumnsRenamed({"vec_id": "b", "embedding": "_y"}).drop("crowd")
    alone = base.where("not crowd").drop("crowd").withColumn("p", step("p")).withColumn("q", step("q")).withColumnRenamed("vec_id", "a")
    near = alone.join(other, ["p", "q"]).where((F.col("a") != F.col("b")) & (squared_distance(F.col("embedding"), F.col("_y")) <= eps * eps + 1e-12)).select("a", "b")
    near = written(spark, near, "near")
    core = near.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") + 1 >= min_samples).select("a")
    if min_samples <= 1:
        core = vectors.select(F.col("vec_id").alias("a"))
    core = core.unionByName(crowd).distinct()
    # the crowd is one node, its least id
    nodes = core.join(crowd.withColumn("_crowd", F.lit(True)), "a", "left").select("a", F.when(F.col("_crowd"), F.lit(least)).otherwise(F.col("a")).alias("node"))
    end = lambda c: nodes.select(F.col("a").alias(c), F.col("node").alias(f"{c}_node"))
    found = components(spark, near.join(end("a"), "a").join(end("b"), "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))
    cores = nodes.join(found, "node", "left").select(F.col("a").alias("vec_id"), F.coalesce("component", "node").alias("label"))
    borders = near.join(core, "a", "left_anti").join(cores.withColumnsRenamed({"vec_id": "b", "label": "root"}), "b").withColumn("_r", F.row_number().over(Window.partitionBy("a").orderBy("b"))).where("_r = 1").select(F.col("a").alias("vec_id"), F.col("root").alias("label"))
    return vectors.select("vec_id").join(cores.unionByName(borders), "vec_id", "left").withColumn("label", F.coalesce("label", F.lit(-1).cast("long")))
