"""Readers, clustering and audits on small hand-made inputs."""

import itertools
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitweave.operators import cluster as cl
from hitweave.operators import graph as gr
from hitweave.operators import sampling as sm
from hitweave.operators import spatial as sp
from hitweave.operators import voxels as vx
from hitweave.operators.components import components, dense_labels, local_components
from hitweave.sources import files

HEAD = "Index\tMatrix Index\tToA\tToT\tFToA\tOverflow\n"


def hits(spark, rows):
    """rows of (x, y, time in ticks, ...) as hits of source 0."""
    return spark.createDataFrame([(0, i, int(x), int(y), round(16 * t), 1) for i, (x, y, t) in enumerate(rows)], "source long, hit_id long, x long, y long, fine long, tot long")


def groups(df):
    out = {}
    for r in df.collect():
        if r["label"] >= 0:
            out.setdefault(r["label"], set()).add(r["hit_id"])
    return sorted(map(sorted, out.values()))


def test_hit_table(spark, tmp_path):
    (tmp_path / "a.t3pa").write_text(HEAD + "0\t0\t100\t1\t0\t0\n1\t1\t110\t3\t1\t0\n2\t256\t120\t7\t2\t0\n3\t511\t130\t11\t3\t0\n")
    rows = files.load_hits(spark, str(tmp_path)).orderBy("source_row").collect()
    assert [r["x"] for r in rows] == [0, 1, 0, 255] and [r["y"] for r in rows] == [0, 0, 1, 1]
    assert [r["time"] for r in rows] == [0, 9.9375, 19.875, 29.8125]
    assert rows[1]["energy"] == pytest.approx(np.log1p(3))
    assert files.count_rows(spark, str(tmp_path)).first()["rows"] == 4


def test_markers_and_columns(spark, tmp_path):
    (tmp_path / "a.t3pa").write_text(HEAD + "0\t256\t1000\t7\t0\t0\n1\t116\t0\t0\t0\t1\n2\t117\t87\t0\t0\t1\n3\t257\t1010\t9\t0\t0\n")
    rows = files.load_hits(spark, str(tmp_path)).orderBy("source_row").collect()
    assert [(r["source_row"], r["time"]) for r in rows] == [(0, 0.0), (3, 10.0)]
    assert files.load_hits(spark, str(tmp_path), markers=True).count() == 4
    assert files.load_hits(spark, str(tmp_path), most_rows=2, markers=True).count() == 2
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "c.t3pa").write_text("Index\tToA\n0\t1\n")
    with pytest.raises(ValueError, match="Matrix Index"):
        files.read_hit_table(spark, str(tmp_path / "b"))


def test_sidecar_index_and_zip(spark, tmp_path):
    (tmp_path / "run").mkdir()
    (tmp_path / "run" / "a.t3pa").write_text(HEAD + "0\t0\t1\t1\t0\t0\n")
    (tmp_path / "run" / "a.t3pa.info").write_text('"ChipboardID" ("Chipboard ID"):\nchar[9]\nG07-W0050\n\n"Acq time" ("Acquisition time"):\ndouble[1]\n\n20.0\n')
    got = {r["key"]: (r["raw"], r["number"]) for r in files.read_sidecars(spark, str(tmp_path)).collect()}
    assert got == {"chipboardid": ("G07-W0050", None), "acq_time": ("20.0", 20.0)}
    index = {r["name"]: r for r in files.index_folder(spark, str(tmp_path)).collect()}
    assert index["run/a.t3pa"]["rows"] == 1 and index["run/a.t3pa"]["metadata"]["acq_time"] == "20.0"
    assert index["run/a.t3pa.info"]["extension"] == ".t3pa.info" and index["run/a.t3pa"]["folder"] == "run"
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("raw_data/b.txt", "x")
        z.writestr("../c", "y")
    names = files.index_zip(spark, str(tmp_path))
    assert {r["name"] for r in names.collect()} == {"b.txt", "../c"}
    assert [(r["name"], r["reason"]) for r in files.unsafe_names(names).collect()] == [("../c", "unsafe")]


def test_frames_and_gold(spark, tmp_path):
    block = '%s {"sample":1,"set_index":%d,"acq_unix":1.5,"hw_t0_ns":0,"hw_t_proc_ns":0,"matrix":{"shape":[256,256],"nnz":1,"entries":[{"x":3,"y":4,"energy":2.5}]}}'
    (tmp_path / "dump.txt").write_text(block % ("a", 0) + "\n-----\n" + block % ("b", 1))
    rows = files.frame_hits(files.read_frames(spark, str(tmp_path / "dump.txt"))).orderBy("set_index").collect()
    assert [tuple(r) for r in rows] == [(1, 0, 3, 4, 0.0, 2.5), (1, 1, 3, 4, 0.0, 2.5)]
    assert files.read_gold(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "g.csv").write_text("source_path,notes\na,b\n")
    with pytest.raises(ValueError, match="gold_particle_id"):
        files.read_gold(spark, str(tmp_path / "g.csv"))


def test_dbscan_clouds(spark):
    cloud = [(0, 0, 0), (1, 0, 0.0625), (0, 1, 0.125), (1, 1, 0.25), (10, 10, 10), (10, 10, 10), (11, 10, 10.125), (80, 80, 0), (80, 80, 20), (200, 200, 200)]
    got = cl.dbscan(spark, hits(spark, cloud), eps=1.5, min_samples=2, time_scale=1.0, slab_ticks=1)
    assert groups(got) == [[0, 1, 2, 3], [4, 5, 6]]


def test_border_tie_break(spark):
    """A border hit between two cores of different clusters joins the one first by row, then column, then time."""
    rows = [(0, 10, 0), (0, 11, 0), (0, 12, 0), (0, 13, 0), (4, 13, 0), (8, 13, 0), (8, 12, 0), (8, 11, 0), (8, 10, 0)]
    got = {r["hit_id"]: r for r in cl.dbscan(spark, hits(spark, rows), eps=4.0, min_samples=4, time_scale=1.0).collect()}
    assert got[4]["kind"] == "border" and got[4]["label"] == got[3]["label"] == 0 and got[5]["label"] == 5


@pytest.mark.parametrize("min_samples", [2, 3, 5])
def test_dbscan_brute_force_across_slabs(spark, min_samples):
    r = np.random.default_rng(min_samples)
    pts = [(int(r.integers(0, 12)), int(r.integers(0, 12)), float(r.integers(0, 4000)) / 16) for _ in range(400)]
    got = {x["hit_id"]: x for x in cl.dbscan(spark, hits(spark, pts), eps=3.0, min_samples=min_samples, time_scale=1.0, slab_ticks=1).collect()}
    xyz = np.array(pts)
    near = ((xyz[:, None] - xyz[None]) ** 2).sum(-1) <= 9 + 1e-12
    core = near.sum(1) >= min_samples
    pairs = [(i, j) for i, j in itertools.combinations(range(400), 2) if near[i, j] and core[i] and core[j]]
    lab = local_components(400, np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]))
    for i in range(400):
        if core[i]:
            assert got[i]["kind"] == "core" and got[i]["label"] == lab[i]
        else:
            assert got[i]["kind"] == ("border" if (near[i] & core).any() else "noise")


def test_linker_and_voxels(spark):
    x, y, t = [0, 1, 2, 20, 21, 22, 10, 10, 10], [0, 0, 0, 20, 20, 20, 10, 10, 10], [0, 0.125, 0.25, 0, 0.125, 0.25, 0, 40, 80]
    assert groups(cl.link_stream(spark, hits(spark, list(zip(x, y, t))), 2.0, 2, 1.0)) == [[0, 1, 2], [3, 4, 5]]
    v = hits(spark, [(0, 0, 0), (1, 0, 1), (2, 1, 2), (10, 10, 0), (11, 10, 0), (50, 50, 100)])
    assert groups(cl.voxel_components(spark, v, 1.0, "corner", 2)) == [[0, 1, 2], [3, 4]]
    assert groups(cl.cluster(spark, v, "voxel-face", time_scale=1.0)) == [[3, 4]]
    with pytest.raises(ValueError):
        cl.cluster(spark, v, "nothing")


def test_continuity_and_contacts(spark):
    rows = [(0, 0, 0), (1, 0, 0), (10, 10, 0), (11, 10, 0), (20, 20, 0), (21, 21, 1), (50, 50, 0), (51, 51, 1)]
    labels = [0, 0, 0, 0, 1, 1, 2, 3]
    h = hits(spark, rows).join(spark.createDataFrame(list(enumerate(labels)), "hit_id long, label long"), "hit_id")
    got = {r["label"]: r["n_components"] for r in vx.components_by_particle(spark, h).collect()}
    assert got == {0: 2, 1: 1, 2: 1, 3: 1}
    assert [(r["a"], r["b"], r["contacts"]) for r in vx.touching_labels(h).collect()] == [(2, 3, 2)]


def test_edges(spark):
    h = hits(spark, [(0, 0, 0), (1, 0, 0.125), (6, 0, 0.1875), (6, 0, 0.25)])
    bits = 0
    for r in gr.multiscale_edges(h, (2, 2.0), (2, 7.0), 1, 8.0, 1.0).collect():
        assert r["src"] != r["dst"]
        bits |= r["edge_type"]
    assert bits == 15
    nodes = spark.createDataFrame([(0, i, 1.0) for i in range(5)], "source long, hit_id long, score double")
    edges = spark.createDataFrame([(0, 0, 1, 0.95, 0.01, 0.0), (0, 1, 0, 0.95, 0.01, 0.0), (0, 2, 3, 0.99, 8 / 128, 8.0)], "source long, src long, dst long, score double, dist_xy double, dt double")
    assert groups(gr.edge_components(spark, nodes, edges)) == [[0, 1], [2], [3], [4]]


def test_components_chain_star_and_empty(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)], "a long, b long")
    got = {}
    for r in components(spark, chain).collect():
        got.setdefault(r["component"], set()).add(r["node"])
    assert got == {0: set(range(41)), 100: set(range(100, 140))}
    assert components(spark, chain.where("a < 0")).count() == 0


def test_dense_labels(spark):
    df = spark.createDataFrame([(0, 0, 7), (0, 1, 3), (0, 2, 7), (0, 3, -1)], "source long, hit_id long, label long")
    assert [r["label"] for r in dense_labels(df, ["source"], "hit_id").orderBy("hit_id").collect()] == [0, 1, 0, -1]


def test_samples(spark):
    rows = spark.range(1000).withColumnRenamed("id", "key")
    split = {r["s"]: r["count"] for r in rows.select(sm.group_split(F.col("key")).alias("s")).groupBy("s").count().collect()}
    assert 60 < split["test"] < 140 and 60 < split["validation"] < 140
    alloc = sm.allocate(spark.createDataFrame([("a", 1), ("b", 5), ("c", 9)], "key string, capacity int"), 8).collect()
    assert sum(r["share"] for r in alloc) == 8 and {r["key"]: r["share"] for r in alloc}["a"] == 1
    with pytest.raises(ValueError):
        sm.top_fraction(rows, "key", "key", "key", 0)


def test_knn_is_by_distance_then_id(spark):
    h = hits(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (3, 0, 0)])
    got = [(r["src"], r["dst"]) for r in sp.knn_edges(h, 1, 5.0, 1.0).orderBy("src").collect()]
    assert got == [(0, 1), (1, 0), (2, 0), (3, 1)]


def test_round_trip_of_particles(spark, tmp_path):
    h = hits(spark, [(0, 0, 0), (1, 0, 0), (9, 9, 9)]).join(spark.createDataFrame([(0, 0), (1, 0), (2, -1)], "hit_id long, label long"), "hit_id")
    files.write_particles(h, h.groupBy("label").count(), str(tmp_path / "p"))
    assert files.read_particle(spark, str(tmp_path / "p"), 0, 0).count() == 2


def test_empty_hits(spark):
    none = hits(spark, [(0, 0, 0)]).where("hit_id < 0")
    assert cl.dbscan(spark, none).count() == 0 and cl.voxel_components(spark, none).count() == 0


def test_disjoint_pairs_go_on_past_equal_vectors(spark):
    """1,500 pairs at distance 0 share one id; the pairs behind them are found all the same, and pairs with an end run out."""
    from hitweave.operators.embeddings import disjoint_pairs

    rows = [(0, i, 0.0) for i in range(1, 1501)] + [(2000 + 2 * i, 2001 + 2 * i, 1.0 + i) for i in range(5)] + [(1, 2000, 0.5)]
    pairs = spark.createDataFrame(rows, "a long, b long, distance double")
    want = [(0, 1, 0.0), (2000, 2001, 1.0), (2002, 2003, 2.0), (2004, 2005, 3.0), (2006, 2007, 4.0), (2008, 2009, 5.0)]
    assert disjoint_pairs(pairs, 4) == want[:4] and disjoint_pairs(pairs, 20) == want


def test_windowed_clustering_equals_a_plain_one(spark):
    """Count windows clustered one by one; clusters that share a hit are one, noise of one window may be claimed by another."""
    r = np.random.default_rng(21)
    rows = sorted((int(r.integers(0, 700)), int(r.integers(0, 9)), int(r.integers(0, 9))) for _ in range(90))
    df = spark.createDataFrame([(0, i, x, y, f) for i, (f, x, y) in enumerate(rows)], "source long, hit_id long, x long, y long, fine long")
    p = np.array([(x, y, f / 10) for f, x, y in rows])
    for size, overlap, least in ((20, 8, 2), (16, 4, 3), (500, 0, 3)):
        parent = {}

        def root(k):
            while parent.setdefault(k, k) != k:
                k = parent[k]
            return k

        mine, start = {}, 0
        while True:
            ids = list(range(start, min(start + size, len(p))))
            near = np.sqrt(((p[ids][:, None] - p[ids][None]) ** 2).sum(2)) <= 5 + 1e-12
            core = near.sum(1) >= least
            label = {}
            for k in np.flatnonzero(core).tolist():
                if k not in label:
                    todo, label[k] = [k], k
                    while todo:
                        for j in np.flatnonzero(near[todo.pop()] & core).tolist():
                            if j not in label:
                                label[j] = k
                                todo.append(j)
            for k in np.flatnonzero(~core).tolist():
                at = [j for j in np.flatnonzero(near[k] & core).tolist()]
                if at:
                    label[k] = label[min(at, key=lambda j: (p[ids[j], 1] - p[ids[k], 1], p[ids[j], 0] - p[ids[k], 0], p[ids[j], 2], ids[j]))]
            for k, c in label.items():
                name = (start, c)
                if ids[k] in mine:
                    parent[root(name)] = root(mine[ids[k]])
                else:
                    mine[ids[k]] = name
                    root(name)
            if ids[-1] == len(p) - 1:
                break
            start += max(1, size - overlap)
        want = {}
        for i, name in mine.items():
            want.setdefault(root(name), []).append(i)
        got = groups(cl.windowed_dbscan(spark, df, 5.0, least, 0.625, size, overlap))
        assert got == sorted(sorted(v) for v in want.values())


def test_components_of_hubs(spark):
    """A star of more edges than a hub has, chained to another: one component, named by its least node."""
    edges = [(0, k) for k in range(1, 1500)] + [(5000, k) for k in range(1400, 3000)] + [(9000, 9001)]
    got = {r["node"]: r["component"] for r in components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in [*range(3000), 5000]} | {9000: 9000, 9001: 9000}


def test_object_matching_is_the_greedy_one(spark):
    from hitweave.operators.metrics import object_iou

    r = np.random.default_rng(2)
    rows = [(int(s), int(t), int(p)) for s in range(6) for t, p in zip(r.integers(-1, 9, 60) // (1 + s % 3), r.integers(-1, 14, 60) // (1 + s % 4))] + [(9, 1, 1), (9, 1, 1), (9, 1, 0), (9, 1, 0), (9, 3, 5), (9, 2, 5), (10, 4, -1)]
    got = {x["source"]: (x["objects"], x["matched"], x["mean_iou"]) for x in object_iou(spark.createDataFrame(rows, "source long, truth long, predicted long")).collect()}
    for s in {x[0] for x in rows}:
        t = np.array([x[1] for x in rows if x[0] == s])
        p = np.array([x[2] for x in rows if x[0] == s])
        used, found = set(), []
        for k in sorted(set(t[t >= 0].tolist())):
            ious = [(((t == k) & (p == m)).sum() / ((t == k) | (p == m)).sum(), -m) for m in set(p[p >= 0].tolist()) - used]
            if ious and max(ious)[0] >= 0.5:
                used.add(-max(ious)[1])
                found.append(max(ious)[0])
        assert got[s] == (len(set(t[t >= 0].tolist())), len(found), pytest.approx(np.mean(found) if found else 0, abs=1e-6))
    with pytest.raises(ValueError, match="one half"):
        object_iou(spark.createDataFrame(rows, "source long, truth long, predicted long"), least=0.3)
