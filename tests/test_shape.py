"""Particle shapes against plain computations over small particles."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hitweave.operators import order as od
from hitweave.operators import shape as sh


@pytest.fixture(scope="module")
def particles(spark):
    r = np.random.default_rng(3)
    rows = []
    for label in range(12):
        n = [1, 2, 3, 5, 9, 40][label % 6]
        at = r.integers(0, 200, 2)
        for k in range(n):
            rows.append((label % 3, len(rows), label, int(at[0] + r.integers(0, 3 + 2 * k)), int(at[1] + r.integers(0, 3 + k)), int(100_000 + r.integers(0, 40 * n)), int(r.integers(0, 300)), int(r.integers(0, 32))))
    rows += [(0, 10_000, -1, 1, 1, 5, 5, 5)]
    return rows, spark.createDataFrame(rows, "source long, hit_id long, label long, x long, y long, fine long, tot long, ftoa long")


def own(rows, label):
    a = np.array(sorted((r[5], r[1], r[3], r[4], r[6], r[7]) for r in rows if r[2] == label), float)
    return a[:, 2], a[:, 3], a[:, 0] / 16, np.log1p(a[:, 4]), a[:, 5], a[:, 1]


def pca(points, w):
    if len(points) < 2:
        return np.zeros(points.shape[1]), np.eye(points.shape[1])
    w = w / w.sum()
    c = points - (points * w[:, None]).sum(0)
    value, vector = np.linalg.eigh((c * w[:, None]).T @ c)
    return np.maximum(value[::-1], 0), vector[:, ::-1]


def test_geometry_frames_and_profiles(spark, particles):
    rows, hits = particles
    shapes = sh.geometry(hits)
    got = {r["label"]: r for r in shapes.collect()}
    vectors = {r["label"]: r["descriptor"] for r in sh.descriptors(hits).collect()}
    profiles = {r["label"]: r for r in sh.profiles(hits, shapes).collect()}
    turned = {r["hit_id"]: (r["u"], r["v"]) for r in sh.canonical(hits.where("label >= 0"), shapes).collect()}
    assert set(got) == set(vectors) == set(profiles) == set(range(12))
    for label, g in got.items():
        x, y, t, e, _, ids = own(rows, label)
        w = e + 1e-9
        value3, vector3 = pca(np.stack([x, y, t], 1), w)
        value2, vector2 = pca(np.stack([x, y], 1), w)
        assert [g["e1"], g["e2"], g["e3"]] == pytest.approx(value3, abs=1e-6) and [g["f1"], g["f2"]] == pytest.approx(value2, abs=1e-6)
        cx, cy = np.average(x, weights=w), np.average(y, weights=w)
        assert (g["cx"], g["cy"]) == pytest.approx((cx, cy)) and g["total_energy"] == pytest.approx(e.sum())
        theta = g["theta_xy"]
        if value2[0] - value2[1] > 1e-6:
            assert abs(math.sin(theta - math.atan2(vector2[1, 0], vector2[0, 0]))) < 1e-6 and -math.pi / 2 - 1e-9 <= theta <= math.pi / 2 + 1e-9
        u, v = math.cos(theta) * (x - cx) + math.sin(theta) * (y - cy), math.cos(theta) * (y - cy) - math.sin(theta) * (x - cx)
        assert np.allclose([turned[int(i)] for i in ids], np.stack([u, v], 1), atol=1e-8)
        for name, values, bins, lo in (("longitudinal", u, 16, u.min()), ("radial", np.abs(v), 8, 0.0)):
            want = np.zeros(bins)
            if np.isclose(lo, values.max()):
                want[0] = e.sum()
            else:
                want = np.histogram(values.round(9), bins, (round(lo, 9), values.round(9).max()), weights=e)[0]
            assert sum(profiles[label][name]) == pytest.approx(1.0 if e.sum() > 0 else 0.0)
            assert np.abs(np.array(profiles[label][name]) - want / e.sum()).max() < 1e-6
        d = vectors[label]
        assert len(d) == 38 and d[0] == pytest.approx(math.log1p(len(x))) and d[5] == pytest.approx(e.max() / (e.sum() + 1e-9)) and d[9:12] == pytest.approx(np.log1p(np.sqrt(value3)), abs=1e-5)


def test_view_descriptors(spark, particles):
    rows, hits = particles
    for r in sh.view_descriptors(hits).collect():
        x, y, t, e, _, _ = own(rows, r["label"])
        w = e + 1e-3
        points = np.stack([x / 128, y / 128, t], 1)
        value2, vector2 = pca(points[:, :2], w)
        value3, vector3 = pca(points, w)
        assert r["pca_xy_linearity"] == pytest.approx(value2[0] / (value2.sum() + 1e-12), abs=1e-5) and r["pca_xyt_planarity"] == pytest.approx(value3[:2].sum() / (value3.sum() + 1e-12), abs=1e-5)
        assert r["q_theta"] == pytest.approx(abs(vector2[0, 0]), abs=1e-5)
        assert r["time_span"] == pytest.approx(np.ptp(t)) and r["bbox_area"] == max(np.ptp(x), 1) * max(np.ptp(y), 1)
        if len(x) > 2:
            steps = np.sign(np.diff((points @ vector3[:, 0]).round(9)))
            assert r["time_monotonicity"] == pytest.approx(abs(steps.mean()), abs=0.2 if (steps == 0).any() else 1e-9)
        else:
            assert r["time_monotonicity"] == 0


def test_views(spark, particles):
    rows, hits = particles
    points, summaries = sh.view_dataset(hits, most=8, large=8, views_per_large=3)
    by = {}
    for r in points.collect():
        by.setdefault((r["label"], r["view_id"]), []).append(r)
    assert set(by) == {(k, v) for k in range(12) for v in range(3 if [1, 2, 3, 5, 9, 40][k % 6] > 8 else 1)}
    for (label, _), view in by.items():
        x, y, t, e, ftoa, ids = own(rows, label)
        assert len(view) == min(8, len(x)) and len({r["hit_id"] for r in view}) == len(view)
        at = {int(i): k for k, i in enumerate(ids)}
        cx, cy = np.average(x, weights=e + 1e-3), np.average(y, weights=e + 1e-3)
        ranks = sorted(r["rank_time"] for r in view)
        assert ranks == pytest.approx(np.linspace(0, 1, len(view)) if len(view) > 1 else [0])
        for r in view:
            k = at[r["hit_id"]]
            assert (r["x_centered"], r["y_centered"]) == pytest.approx(((x[k] - cx) / 128, (y[k] - cy) / 128)) and r["t_scaled"] == pytest.approx(t[k] - t.min())
            assert r["t_norm"] == pytest.approx((t[k] - t.min()) / max(np.ptp(t), 1)) and r["log_tot"] == pytest.approx(e[k] / math.log(1024)) and r["ftoa_norm"] == pytest.approx(ftoa[k] / 30)
            assert r["cos_theta"] ** 2 + r["sin_theta"] ** 2 == pytest.approx(1)
    for r in summaries.collect():
        n = [1, 2, 3, 5, 9, 40][r["label"] % 6]
        assert (r["n_hits"], r["view_n_hits"], r["large_flag"]) == (n, min(n, 8), float(n > 8)) and r["quality_flags"] == ("sampled" if n > 8 else "ok")
        assert r["log_n_hits"] == pytest.approx(math.log1p(n), abs=1e-5) and set(sh.SUMMARY) <= set(r.asDict())
    one = {r["hit_id"] for r in sh.views(hits, most=8, large=8).where("label = 5 and view_id = 0").collect()}
    assert one == {r["hit_id"] for r in sh.views(hits, most=8, large=8).where("label = 5 and view_id = 0").collect()}


def test_grids(spark):
    r = np.random.default_rng(1)
    rows = [(label, int(v), float(r.random())) for label in range(4) for v in r.choice(4 * 6 * 5, [1, 2, 9, 60][label], replace=False)]
    grid = spark.createDataFrame(rows, "label long, voxel int, value double")
    turn = {g["label"]: g for g in sh.grid_orientation(grid, (4, 6, 5)).collect()}
    move = {g["label"]: g for g in sh.grid_moments(grid, (4, 6, 5), most_shift=1.0).collect()}
    assert turn[0][1:] == (0, 0, 0, 1)
    for label in (2, 3):
        v, w = np.array([(x[1], x[2]) for x in rows if x[0] == label]).T
        x, y, t = v % 5, v // 5 % 6, v // 30
        value, vector = pca(np.stack([x, y], 1), w)
        assert turn[label]["theta_xy"] == pytest.approx(math.atan2(vector[1, 0], vector[0, 0]) % math.pi, abs=1e-6) and turn[label]["linearity_xy"] == pytest.approx(1 - value[1] / value[0])
        _, lead = pca(np.stack([x, y, t * 0.625], 1), w)
        assert turn[label]["tilt"] == pytest.approx(math.atan2(abs(lead[2, 0]), math.hypot(lead[0, 0], lead[1, 0])), abs=1e-6)
        u = np.stack([2 * x / 4 - 1, 2 * y / 5 - 1, 2 * t / 3 - 1], 1)
        centre = np.average(u, axis=0, weights=w)
        assert [move[label][c] for c in ("cx", "cy", "ct")] == pytest.approx(centre) and move[label]["energy"] == pytest.approx(w.sum())
        value, vector = pca(u[:, :2], w)
        theta = (math.atan2(vector[1, 0], vector[0, 0]) + math.pi / 2) % math.pi - math.pi / 2
        assert move[label]["theta_xy"] == pytest.approx(theta, abs=1e-6)
        along = (u[:, 0] - centre[0]) * math.cos(theta) + (u[:, 1] - centre[1]) * math.sin(theta)
        _, lead = pca(np.stack([along, u[:, 2]], 1), w)
        lead = lead[:, 0] * (-1 if lead[0, 0] < 0 else 1)
        assert move[label]["theta_time"] == pytest.approx(np.clip(math.atan2(lead[1], lead[0]), -1.2, 1.2), abs=1e-6)


def test_normalised_and_back(spark):
    rows = spark.createDataFrame([(i, float(i), 7.0) for i in range(5)], "k long, a double, b double")
    fit = sh.fit_moments(rows, ["a", "b"])
    z = sh.normalised(rows, fit, ["a", "b"])
    assert [r["a"] for r in z.orderBy("k").collect()] == pytest.approx([(i - 2) / math.sqrt(2) for i in range(5)]) and {r["b"] for r in z.collect()} == {0.0}
    assert [tuple(r) for r in sh.normalised(z, fit, ["a", "b"], back=True).orderBy("k").collect()] == [pytest.approx((i, i, 7.0)) for i in range(5)]
    with pytest.raises(ValueError, match="no moments for k"):
        sh.normalised(rows, fit, ["k"])


def test_ranks_and_neighbours_over_slabs_and_blocks(spark):
    """Places by slabs equal a plain sort, and rows near a block's bounds see their neighbours in the next block."""
    r = np.random.default_rng(9)
    rows = [(int(g), i, int(f)) for i, (g, f) in enumerate(zip(r.integers(0, 3, 400), r.integers(0, 300, 400)))]
    df = spark.createDataFrame(rows, "source long, hit_id long, fine long")
    placed = od.ranked(df, slab=F.floor(F.col("fine") / 37))
    got = {x["hit_id"]: (x["pos"], x["n"]) for x in placed.collect()}
    blocks = od.in_blocks(placed, 3, block=10)
    near = {x["hit_id"]: (x["a"], x["b"]) for x in blocks.select("hit_id", "_own", F.lag("hit_id", 3).over(od.block_window()).alias("a"), F.lead("hit_id", 3).over(od.block_window()).alias("b")).where("_own").collect()}
    for g in range(3):
        ids = [i for _, _, i in sorted((f, i, i) for s, i, f in rows if s == g)]
        for k, i in enumerate(ids):
            assert got[i] == (k, len(ids))
            assert near[i] == (ids[k - 3] if k >= 3 else None, ids[k + 3] if k + 3 < len(ids) else None)


def test_paths_equal_a_plain_computation(spark, particles):
    from hitweave.operators import paths as ph

    points, _ = sh.view_dataset(particles[1], most=20, large=20, views_per_large=2)
    points = points.select("label", "view_id", "hit_id", *(F.round(c, 8).alias(c) for c in ("x_centered", "y_centered", "t_norm", "log_tot"))).cache()
    pose = ph.poses(points)
    got, path = {(r["label"], r["view_id"]): r for r in pose.collect()}, {}
    for r in ph.canonical_paths(points, pose, 33).orderBy("step").collect():
        path.setdefault((r["label"], r["view_id"]), []).append([r[c] for c in ("x_can", "y_can", "x_local", "y_local", "t", "e")])
    by = {}
    for r in points.orderBy("hit_id").collect():
        by.setdefault((r["label"], r["view_id"]), []).append([r["x_centered"], r["y_centered"], r["t_norm"], r["log_tot"]])
    assert set(got) == set(by) == set(path)
    for key, rows in by.items():
        x, y, t, e = np.array(rows).T
        w = (e + 1e-3) / (e + 1e-3).sum()
        x0, y0 = x - (x * w).sum(), y - (y * w).sum()
        value, vector = pca(np.stack([x0, y0], 1), w)
        theta = math.atan2(vector[1, 0], vector[0, 0]) if len(x) >= 3 else 0.0
        along = x0 * math.cos(theta) + y0 * math.sin(theta)
        corr = ((along - (along * w).sum()) * (t - (t * w).sum()) * w).sum()
        if corr < 0 and len(x) >= 2 and abs(corr) > 1e-11:
            theta += math.pi
        assert got[key]["scale_xy"] == pytest.approx(max(np.percentile(np.hypot(x0, y0), 95), 1e-3), abs=1e-6)
        if len(x) < 3 or value[0] - value[1] < 1e-9 or abs(corr) <= 1e-11:
            continue
        assert math.cos(got[key]["theta_xy"] - theta) == pytest.approx(1, abs=1e-9)
        s = got[key]["scale_xy"]
        u, v = (math.cos(theta) * x0 + math.sin(theta) * y0) / s, (math.cos(theta) * y0 - math.sin(theta) * x0) / s
        order = np.lexsort((u.round(12), v.round(12), t))
        at, to = np.linspace(0, 1, len(x)), np.linspace(0, 1, 33)
        want = [np.clip(np.interp(to, at, c[order]), lo, hi) for c, lo, hi in ((u, -4, 4), (v, -4, 4), (x0 / s, -4, 4), (y0 / s, -4, 4), (t, 0, 1.5), (e, 0, 1.5))]
        assert np.abs(np.array(path[key]) - np.stack(want, 1)).max() < 1e-6
    lone = [k for k, rows in by.items() if len(rows) == 1]
    assert lone and all(len(path[k]) == 33 for k in lone)


def test_distances_of_paths_and_grids(spark):
    from hitweave.operators import paths as ph

    r = np.random.default_rng(2)
    a, b = r.random((7, 2)), r.random((7, 2))
    frame = lambda m: spark.createDataFrame([(1, k, float(x), float(y)) for k, (x, y) in enumerate(m)], "label long, step int, x double, y double")
    d = np.sqrt(((a[:, None] - b[None]) ** 2).sum(2))
    assert ph.chamfer(frame(a), frame(b), ["label"], ["x", "y"]).first()["chamfer"] == pytest.approx(d.min(1).mean() + d.min(0).mean(), abs=1e-5)
    assert ph.path_distance(frame(a), frame(b), ["label"], ["x", "y"]).first()["relative_l2"] == pytest.approx(math.sqrt(((a - b) ** 2).mean() + 1e-6) / math.sqrt((a**2).mean() + 1e-6), abs=1e-5)
    last = spark.createDataFrame([(1, 2, 0.5, 0), (1, 2, 0.25, 1), (1, 0, 1.0, 0)], "label long, voxel int, value double, at int")
    assert ph.dense(last, 4).first()["values"] == [1.0, 0.0, 0.75, 0.0] and ph.dense(last, 4, True, "at").first()["values"] == [1.0, 0.0, 0.25, 0.0]


def test_windows_apart(spark):
    from hitweave.operators.manifests import apart

    r = np.random.default_rng(4)
    rows = [(int(s), int(a), int(a + r.integers(5, 30)), int(r.integers(0, 20))) for s in range(3) for a in r.integers(0, 400, 60)]
    rows = sorted({(s, a): (s, a, b, n) for s, a, b, n in rows}.values())
    got = sorted(tuple(x) for x in apart(spark.createDataFrame(rows, "source long, start long, `end` long, n long"), "source", "start", "end", "n", 6, 3).collect())
    want = []
    for s in range(3):
        taken = []
        for _, a, b, n in sorted((x for x in rows if x[0] == s), key=lambda x: (-x[3], x[1])):
            if len(taken) < 6 and all(b + 3 <= u or a >= v + 3 for _, u, v, _ in taken):
                taken.append((s, a, b, n))
        want += taken
    assert got == sorted(want)


def test_voxel_slabs_equal_whole_sources(spark):
    """Components over narrow slabs of voxel times are those over one slab, for every connectivity."""
    from hitweave.operators.cluster import voxel_components

    r = np.random.default_rng(12)
    rows = [(int(s), 1000 * s + k, int(r.integers(0, 7)), int(r.integers(0, 7)), int(r.integers(0, 60 * 16))) for s in range(2) for k in range(400)]
    hits = spark.createDataFrame(rows, "source long, hit_id long, x long, y long, fine long")
    for connectivity in ("face", "edge", "corner"):
        whole = {x["hit_id"]: x["label"] for x in voxel_components(spark, hits, 1.0, connectivity).collect()}
        thin = {x["hit_id"]: x["label"] for x in voxel_components(spark, hits, 1.0, connectivity, slab_voxels=3).collect()}
        assert whole == thin and len(set(whole.values())) > 1


def test_suspicious_merges(spark):
    from hitweave.operators.geometry import suspicious_merges

    rows = [(0, k, 5 if k else 120, 0, 40 if k != 3 else 10, 0, 40, 0, 4000 if k != 2 else 10) for k in range(6)]
    parts = spark.createDataFrame(rows + [(1, 10, 150, 0, 40, 0, 3, 0, 4000), (1, 11, 150, 0, 40, 0, 3, 0, 4000)], "source long, label long, n_hits long, min_x long, max_x long, min_y long, max_y long, first_fine long, last_fine long")
    axes = spark.createDataFrame([(k, 0.1) for k in range(6)] + [(10, 0.34), (11, 0.36)], "label long, linearity double")
    got = lambda least: sorted(r["label"] for r in suspicious_merges(parts, axes, least=least).collect())
    assert got(100) == [0, 10] and got(130) == [10] and got(1) == [0, 10]


def test_path_losses_in_tasks(spark, monkeypatch):
    from hitweave import session
    from hitweave.operators import paths as ph
    from hitweave.plans import proxy

    h = proxy.labelled(spark, "/root/testdata/sf0.001")
    made, write = set(), session.written
    monkeypatch.setattr(ph, "written", lambda spark, df, name: made.add(name) or write(spark, df, name))
    by, columns = ["label", "view_id"], ["x_can", "y_can", "t", "e"]
    for most in (3, 64):
        p = write(spark, sh.view_dataset(h, most=most, large=most, views_per_large=2)[0], "views")
        path = write(spark, ph.canonical_paths(p, ph.poses(p), 16), "paths")
        other = path.select(*by, "step", F.col("x_local").alias("x_can"), F.col("y_local").alias("y_can"), "t", "e")
        want = ph.path_distance(path, other, by, columns).join(ph.chamfer(path, other, by, columns), by)
        made.clear()
        got = ph.path_losses(spark, h, most=most, large=most, together=7)
        assert got.schema == want.schema or [f.dataType for f in got.schema] == [f.dataType for f in want.schema]
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert ("paths" in made) == (most == 3)  # particles of one whole view leave no paths, as they did before
    assert ph.path_losses(spark, h.limit(0)).count() == 0
