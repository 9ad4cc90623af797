"""Candidate clustering, clusterings of vectors and their quality, and chunked tables, against plain computations."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitweave.operators import candidates as cd
from hitweave.operators import learning as ln
from hitweave.sources import files


def plain_density(p, eps, least):
    d = np.sqrt(((p[:, None] - p[None]) ** 2).sum(2)) <= eps + 1e-12
    core, label, k = d.sum(1) >= least, np.full(len(p), -1), 0
    for i in range(len(p)):
        if core[i] and label[i] < 0:
            todo = [i]
            label[i] = k
            while todo:
                for j in np.flatnonzero(d[todo.pop()] & core & (label < 0)).tolist():
                    label[j] = k
                    todo.append(j)
            k += 1
    for i in np.flatnonzero(~core):
        near = np.flatnonzero(d[i] & core)
        if len(near):
            label[i] = label[near[0]]
    return label


def test_density_labels():
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 30, 200):
        for size in (2, 3, 4):
            p = r.integers(0, 12, (n, size)).astype(float)
            assert cd.density_labels(p, 1.5, 3, block=16).tolist() == plain_density(p, 1.5, 3).tolist()


def test_candidates(spark):
    r = np.random.default_rng(3)
    rows = [(int(c), k, *map(float, r.integers(0, 6, 3)), float(r.random())) for c in range(40) for k in range(int(r.integers(1, 30)))]
    points = spark.createDataFrame(rows, "candidate long, point long, x double, y double, t double, energy double")
    for mode, columns in cd.MODES.items():
        got = {(x["candidate"], x["point"]): x["label"] for x in cd.candidate_labels(points, mode=mode).collect()}
        for c in range(40):
            mine = [x for x in rows if x[0] == c]
            p = np.array([[x[2:][["x", "y", "t", "energy"].index(k)] for k in columns] for x in mine])
            assert [got[c, x[1]] for x in mine] == plain_density(p, 1.5, 3).tolist()
    with pytest.raises(ValueError, match="unknown features"):
        cd.candidate_labels(points, mode="z")
    parts = cd.split_candidates(cd.candidate_labels(points))
    assert all(x.count(":cluster:") == 1 for x in (y["candidate"] for y in parts.select("candidate").distinct().collect()))
    assert cd.bootstrap_candidates(points.select(F.col("candidate").alias("frame"), "x", "y", "energy"), 5).select(F.split_part("candidate", F.lit(":"), F.lit(1)).cast("int").alias("f")).agg(F.max("f")).first()[0] <= 4


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(8)
    centres = np.eye(3, 5) * 4
    x = np.concatenate([c + r.normal(0, 0.3, (40, 5)) * [1, 1, 2, 1, 1] for c in centres])
    return x, spark.createDataFrame([(i, [float(v) for v in row], i % 2) for i, row in enumerate(x)], "vec_id long, embedding array<double>, label int")


def test_mixture_and_driver(spark, vectors):
    x, df = vectors
    got = np.array([r["cluster"] for r in ln.gaussian_mixture(df, 3).orderBy("vec_id").collect()])
    assert [len(set(got[k : k + 40])) for k in (0, 40, 80)] == [1, 1, 1] and len(set(got.tolist())) == 3
    assert set(ln.cluster_embeddings(df, (3, 500))) == {"kmeans_3", "gmm_3", "density_unavailable_kmeans_fallback"}
    assert set(ln.cluster_embeddings(df.limit(5))) == {"kmeans_5"} and ln.cluster_embeddings(df.limit(1)) == {}
    sweep = {r["k"]: r for r in ln.size_sweep(df, (2, 3)).collect()}
    within = sum(((x[k : k + 40] - x[k : k + 40].mean(0)) ** 2).sum() for k in (0, 40, 80))
    assert sweep[3]["inertia"] == pytest.approx(within) and (sweep[3]["least"], sweep[3]["greatest"]) == (40, 40) and sweep[2]["inertia"] > within


def test_quality(spark, vectors):
    x, df = vectors
    label = np.repeat([0, 1, 2], 40)
    labels = spark.createDataFrame([(i, int(k)) for i, k in enumerate(label)] + [(999, -1)], "vec_id long, cluster long")
    got = ln.quality(df, labels).first()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    s = []
    for i in range(len(x)):
        a = d[i, (label == label[i]) & (np.arange(len(x)) != i)].mean()
        b = min(d[i, label == k].mean() for k in range(3) if k != label[i])
        s.append((b - a) / max(a, b))
    assert got["silhouette"] == pytest.approx(np.mean(s), abs=1e-6) and got["noise_fraction"] == pytest.approx(1 / 121) and got["n_clusters"] == 3
    c = np.array([x[label == k].mean(0) for k in range(3)])
    radius = [np.sqrt(((x[label == k] - c[k]) ** 2).sum(1)).mean() for k in range(3)]
    db = np.mean([max((radius[i] + radius[j]) / np.linalg.norm(c[i] - c[j]) for j in range(3) if j != i) for i in range(3)])
    within = sum(((x[label == k] - c[k]) ** 2).sum() for k in range(3))
    ch = 40 * ((c - x.mean(0)) ** 2).sum() * (120 - 3) / (within * 2)
    assert (got["davies_bouldin"], got["calinski_harabasz"]) == pytest.approx((db, ch))
    one = ln.quality(df, labels.withColumn("cluster", F.lit(0).cast("long"))).first()
    assert (one["silhouette"], one["davies_bouldin"], one["calinski_harabasz"]) == (0, 0, 0)


def test_components_and_scores(vectors):
    x, df = vectors
    model = ln.pca_model(df, 3)
    value, vector = np.linalg.eigh(np.cov(x.T))
    assert model[0] == pytest.approx(x.mean(0)) and model[2] == pytest.approx(value[::-1][:3])
    got = {r["vec_id"]: r for r in ln.pca_scores(df, model).collect()}
    z = (x - x.mean(0)) @ model[1].T
    error = np.linalg.norm(x - x.mean(0) - z @ model[1], axis=1) / np.linalg.norm(x, axis=1)
    assert all(got[i]["scores"] == pytest.approx(z[i]) and got[i]["error"] == pytest.approx(error[i]) for i in range(len(x)))


def test_batches_and_pairs(spark, vectors):
    _, df = vectors
    rows = ln.balanced_batches(df.select("vec_id", "label"), "label", "vec_id", 10, 3).collect()
    assert len(rows) == 30 and all(sum(r["batch"] == b and r["label"] == k for r in rows) == 5 for b in range(3) for k in range(2)) and all(r["vec_id"] % 2 == r["label"] for r in rows)
    sized = df.withColumn("size", F.when(F.col("vec_id") == 1, 1).otherwise(2))
    got = ln.neighbour_pairs(sized, 5, "label", "size", query_every=1, ratio=1.5).collect()
    assert got and all(r["a"] < r["b"] and (r["a"] + r["b"]) % 2 == 1 and 1 not in (r["a"], r["b"]) for r in got) and len({(r["a"], r["b"]) for r in got}) == len(got)


def test_tables_chunks_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([(i, "train" if i % 3 else "test", [float(i)]) for i in range(50)], "k long, split string, v array<double>")
    assert files.write_table(rows, f"{tmp_path}/t") == "parquet" and spark.read.parquet(f"{tmp_path}/t").count() == 50
    odd = spark.sql("SELECT 1 AS a, INTERVAL '1' DAY AS d, parse_json('[1]') AS j")
    assert files.write_table(odd.drop("j").withColumn("n", F.lit(None)), f"{tmp_path}/odd") in ("csv", "parquet")
    files.write_chunks(rows.coalesce(1), f"{tmp_path}/c", chunk=10)
    m = files.chunk_manifest(spark, f"{tmp_path}/c").collect()
    assert len(m) == 50 and all(r["chunk_row"] < 10 for r in m) and len({r["chunk_path"] for r in m}) == 6
    index = spark.createDataFrame([("a", f"a/{i}.t3pa", ".t3pa", 1000 * i, 10) for i in range(8)] + [(".", "x.info", ".info", 5, None)], "folder string, name string, extension string, bytes long, rows long")
    text = files.index_markdown(index)
    assert "9 files" in text and "80 rows" in text and "| a | 8 | 8 | 27.3 KB | 80 | a/7.t3pa (6.8 KB)" in text and "* .info: 1" in text
    assert "1 folders are left out" in files.index_markdown(index, 1)
    (tmp_path / "p.json").write_text(json.dumps({"eps": 5, "time_scale": 0.625}))
    assert files.clustering_params(str(tmp_path / "p.json")) == {"eps": 5.0, "min_samples": 3, "time_scale": 0.625} and files.clustering_params("/none") == files.clustering_params()


@pytest.mark.parametrize("values", [4 * 3, 4 * 40, cd.ANCHOR_VALUES])
def test_descriptor_labels(spark, monkeypatch, values):
    monkeypatch.setattr(cd.core_crowd, "__defaults__", (values,))
    r = np.random.default_rng(5)
    p = np.concatenate([r.normal(0, 1, (120, 4)), r.normal(6, 1, (60, 4)), r.uniform(-9, 9, (60, 4)), np.tile(r.normal(3, 1, (1, 4)), (5, 1))]).round(2)
    rows = [(int(i), [float(v) for v in x]) for i, x in zip(r.permutation(len(p)) * 3, p)]
    rows.sort()
    table = spark.createDataFrame([*rows, (9999, None), (10000, []), (10001, [0.0, 0.0])], "vec_id long, embedding array<double>")
    for least in (1, 3) if values == 160 else (3,):
        want = plain_density(np.array([x for _, x in rows]), 1.1, least)
        core = (np.sqrt(((np.array([x for _, x in rows])[:, None] - np.array([x for _, x in rows])[None]) ** 2).sum(2)) <= 1.1 + 1e-12).sum(1) >= least
        names = {k: rows[int(np.flatnonzero((want == k) & core)[0])][0] for k in set(want.tolist()) - {-1}}
        got = dict(map(tuple, cd.descriptor_labels(table, 1.1, least).collect()))
        assert [got.pop(i) for i, _ in rows] == [names.get(k, -1) for k in want.tolist()]
        assert len(got) == 3 and (least == 1 or set(got.values()) == {-1})


def test_descriptor_crowd_makes_no_pairs(spark, monkeypatch):
    from hitweave import session

    made, write = {}, session.written
    monkeypatch.setattr(session, "written", lambda spark, df, name: made.setdefault(name, write(spark, df, name)))
    p = np.random.default_rng(6).normal(0, 0.2, (1000, 4))
    table = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(p)], "vec_id long, embedding array<double>")
    assert {x["label"] for x in cd.descriptor_labels(table, 1.2).collect()} == {0}
    assert made["near"].count() < 10_000  # all 997916 pairs within 1.2 before
