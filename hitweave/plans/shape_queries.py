"""Queries over particle shapes, views, paths and grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from hitweave.operators import paths as ph
from hitweave.operators import shape as sh
from hitweave.operators import voxels as vx
from hitweave.operators.edge_windows import rounded
from hitweave.plans.proxy import LABELS, labelled, query
from hitweave.session import written

WR = "WITH RECURSIVE "


def _rounded(df, digits=5):
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


@query()
def particle_geometry(spark, d):
    return _rounded(sh.geometry(labelled(spark, d)))


@query()
def canonical_hits(spark, d):
    h = labelled(spark, d)
    return sh.canonical(h.where("label >= 0"), sh.geometry(h)).select("label", "hit_id", F.round("u", 4).alias("u"), F.round("v", 4).alias("v"))


@query()
def density_profiles(spark, d):
    h = labelled(spark, d)
    r = lambda c: F.transform(c, lambda v: F.round(v, 5)).alias(c)
    return sh.profiles(h, sh.geometry(h)).select("label", r("longitudinal"), r("radial"))


@query()
def shape_descriptors(spark, d):
    return sh.descriptors(labelled(spark, d)).select("label", F.transform("descriptor", lambda v: F.round(v, 5)).alias("descriptor"))


@query()
def view_descriptors(spark, d):
    return _rounded(sh.view_descriptors(labelled(spark, d)))


@query()
def view_points(spark, d):
    return _rounded(sh.view_dataset(labelled(spark, d), most=8, large=8, views_per_large=2)[0])


@query()
def view_summaries(spark, d):
    return sh.view_dataset(labelled(spark, d), most=8, large=8, views_per_large=2)[1]


@query(f"""{WR}{LABELS}, o AS (SELECT *, ln(1+tot) AS e FROM lab WHERE label>=0), g AS (SELECT label, sum((e+1e-9)*x)/sum(e+1e-9) AS cx, sum((e+1e-9)*y)/sum(e+1e-9) AS cy, min(fine) AS lo, max(fine)-min(fine) AS span FROM o GROUP BY label)
SELECT o.label, hit_id, round((x-cx)/255.0,6) AS dx, round((y-cy)/255.0,6) AS dy, round(CASE WHEN span>0 THEN (fine-lo)/span ELSE 0.0::DOUBLE END,6) AS t, round(ln(1+e),6) AS e FROM o JOIN g ON o.label=g.label""")
def candidate_features(spark, d):
    return sh.candidate_features(labelled(spark, d))


@query()
def grid_orientation(spark, d):
    return _rounded(sh.grid_orientation(vx.energy_grid(labelled(spark, d))), 4)


@query()
def grid_moments(spark, d):
    return _rounded(sh.grid_moments(vx.energy_grid(labelled(spark, d))), 4)


@query("""WITH m AS (SELECT avg(l_quantity::DOUBLE) AS a, stddev_pop(l_quantity::DOUBLE) AS s, avg(l_extendedprice::DOUBLE) AS b, stddev_pop(l_extendedprice::DOUBLE) AS t FROM lineitem)
SELECT l_orderkey AS orderkey, l_linenumber AS line, l_partkey AS part, round((l_quantity::DOUBLE-a)/s,5) AS quantity, round((l_extendedprice::DOUBLE-b)/t,5) AS price FROM lineitem, m""")
def normalised_rows(spark, d):
    r = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_quantity").cast("double").alias("quantity"), F.col("l_extendedprice").cast("double").alias("price"))
    return _rounded(sh.normalised(r, sh.fit_moments(r, ["quantity", "price"]), ["quantity", "price"]))


# ---- paths


def _views(spark, d):
    return sh.view_dataset(labelled(spark, d), most=64, large=64, views_per_large=2)[0]


@query()
def view_poses(spark, d):
    return _rounded(ph.poses(_views(spark, d)), 4)


@query()
def canonical_paths(spark, d):
    p = written(spark, _views(spark, d), "views")
    return _rounded(ph.canonical_paths(p, ph.poses(p), 16), 4)


@query()
def path_losses(spark, d):
    return ph.path_losses(spark, labelled(spark, d))


# ---- grids as data sets

_PART = "part AS (SELECT source, label, count(*) AS n_hits FROM lab WHERE label>=0 GROUP BY source, label)"
_GRID = """box AS (SELECT label, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(fine) AS f0, max(fine) AS f1 FROM lab WHERE label>=0 GROUP BY label),
cell AS (SELECT lab.label, CAST(floor((fine-(f0+f1)/2.0)/10.0+16) AS BIGINT) AS t, CAST(floor((y-(y0+y1)/2.0)+32) AS BIGINT) AS v, CAST(floor((x-(x0+x1)/2.0)+32) AS BIGINT) AS u, ln(1+tot)/6.931471805599453 AS e FROM lab JOIN box ON lab.label=box.label),
grid AS (SELECT label, (t*64+v)*64+u AS voxel, round(sum(e),6) AS value FROM cell WHERE t BETWEEN 0 AND 31 AND v BETWEEN 0 AND 63 AND u BETWEEN 0 AND 63 GROUP BY 1, 2)"""
_SPLIT = "CASE WHEN {u}<0.1 THEN 'test' WHEN {u}<0.2 THEN 'validation' ELSE 'train' END".format(u="('0x'||substr(sha1('0:'||source),1,8))::BIGINT/4294967295.0::DOUBLE")
_BITS = ", ".join(f"round(sum(value/total*CASE WHEN ((voxel*2654435761+{b}*40503+voxel*voxel*97)>>7)%2=0 THEN -1 ELSE 1 END),7) AS s{b}" for b in range(8))
_GROUPS = f"""{_PART}, {_GRID}, tot AS (SELECT label, greatest(sum(value),1e-8) AS total, count(*) AS n FROM grid GROUP BY label), sums AS (SELECT grid.label, any_value(n) AS n, {_BITS} FROM grid JOIN tot ON grid.label=tot.label GROUP BY grid.label),
grp AS (SELECT part.label, concat_ws('|', {_SPLIT}, CASE WHEN n_hits<=4 THEN '2-4' WHEN n_hits<=10 THEN '5-10' WHEN n_hits<=50 THEN '11-50' ELSE '51+' END, 'occ'||least(7,CAST(floor(log2(n)+1e-9) AS BIGINT)),
'sig'||lpad(lower(to_hex({"+".join(f"CASE WHEN s{b}>=0 THEN {1 << b} ELSE 0 END" for b in range(8))})),2,'0')) AS "group" FROM part JOIN sums ON part.label=sums.label)"""


def _parts(spark, d):
    return labelled(spark, d).where("label >= 0").groupBy("source", "label").agg(F.count("*").alias("n_hits"))


@query(f"{WR}{LABELS}, {_GROUPS} SELECT * FROM grp")
def representative_groups(spark, d):
    return ph.representative_groups(vx.energy_grid(labelled(spark, d)), _parts(spark, d))


@query(f"""{WR}{LABELS}, {_GROUPS}, cap AS (SELECT "group" AS key, count(*) AS capacity FROM grp GROUP BY 1), units AS (SELECT key, unnest(range(1, capacity+1)) AS round, ('0x'||substr(sha1('0:'||key),1,15))::BIGINT AS hh FROM cap),
chosen AS (SELECT key FROM (SELECT key, row_number() OVER (ORDER BY round, hh, key) AS place FROM units) WHERE place<=200), share AS (SELECT key, count(*) AS q FROM chosen GROUP BY key),
pos AS (SELECT label, "group", row_number() OVER (PARTITION BY "group" ORDER BY label)-1 AS i, count(*) OVER (PARTITION BY "group") AS n FROM grp) SELECT label, "group" FROM pos JOIN share ON pos."group"=share.key WHERE ((i+1)*q)//n > (i*q)//n""")
def compressed_subset(spark, d):
    return ph.compressed_subset(written(spark, ph.representative_groups(vx.energy_grid(labelled(spark, d)), _parts(spark, d)), "groups"), 200)


@query(f"""{WR}{LABELS}, {_PART}, {_GRID}, total AS (SELECT label, sum(e) AS total FROM cell GROUP BY label), kept AS (SELECT label, sum(value) AS kept, string_agg(voxel::VARCHAR, ',' ORDER BY voxel) AS voxels FROM grid GROUP BY label)
SELECT source, part.label, n_hits, {_SPLIT} AS split, voxels, round(CASE WHEN total>0 THEN kept/total ELSE 1.0 END,4) AS kept_fraction, round(CASE WHEN total>0 THEN kept/total ELSE 1.0 END,4)<0.999 AS cropped FROM part JOIN total ON part.label=total.label JOIN kept ON part.label=kept.label WHERE n_hits>=2""")
def grid_dataset(spark, d):
    h = labelled(spark, d)
    grid = written(spark, vx.energy_grid(h), "grid")
    return ph.grid_dataset(grid, vx.grid_coverage(h, grid), _parts(spark, d)).drop("values").withColumn("voxels", F.array_join("voxels", ","))


_MIRROR = "mir AS (SELECT label, (voxel//64)*64+63-voxel%64 AS voxel, value FROM grid), j AS (SELECT coalesce(a.label,b.label) AS label, coalesce(a.value,0.0) AS a, coalesce(b.value,0.0) AS b FROM grid a FULL JOIN mir b ON a.label=b.label AND a.voxel=b.voxel)"


@query(f"""{WR}{LABELS}, {_GRID}, {_MIRROR}, top AS (SELECT label, greatest(max(value),1e-8) AS top FROM grid GROUP BY label), w AS (SELECT j.*, 1.0+CASE WHEN a>0 THEN 1.0 ELSE 0.0 END+4.0*a/top AS w FROM j JOIN top ON j.label=top.label)
SELECT label, round(sqrt(sum((a-b)*(a-b))/greatest(sum(a*a),1e-8)),6) AS relative_l2, round(sqrt(sum(w*(a-b)*(a-b))/greatest(sum(w*a*a),1e-8)),6) AS weighted_l2 FROM w GROUP BY label""")
def mirror_losses(spark, d):
    grid = written(spark, vx.energy_grid(labelled(spark, d)), "grid")
    v = F.col("voxel")
    return ph.grid_losses(grid, grid.withColumn("voxel", (F.floor(v / 64) * 64 + 63 - v % 64).cast("int")))


@query(f"""{WR}{LABELS}, {_GRID}, occ AS (SELECT label, voxel%64 AS u, voxel//64%64 AS v, voxel//4096 AS t FROM grid WHERE value>0), dil AS (SELECT DISTINCT label, u+i AS u, v+j AS v, t+k AS t FROM occ, (VALUES (-1),(0),(1)) a(i), (VALUES (-1),(0),(1)) b(j), (VALUES (-1),(0),(1)) cc(k))
SELECT label, count(*) AS n FROM dil WHERE u BETWEEN 0 AND 63 AND v BETWEEN 0 AND 63 AND t BETWEEN 0 AND 31 GROUP BY label""")
def dilated_support(spark, d):
    return ph.dilated(vx.energy_grid(labelled(spark, d)), (32, 64, 64)).groupBy("label").agg(F.count("*").alias("n"))


@query(f"""{WR}{LABELS}, {_GRID}, small AS (SELECT label, ((voxel//4096//8)*8+(voxel//64%64)//8)*8+(voxel%64)//8 AS voxel, round(sum(value),6) AS value FROM grid GROUP BY 1, 2), c AS (SELECT label FROM grid GROUP BY label)
SELECT small.label, string_agg(voxel||':'||round(value,3)::DECIMAL(12,3), ',' ORDER BY voxel) FILTER (value<>0) AS dense FROM small GROUP BY small.label""".replace(", c AS (SELECT label FROM grid GROUP BY label)", ""))
def dense_grids(spark, d):
    small = vx.down_bin(vx.energy_grid(labelled(spark, d)), factors=(8, 8, 8))
    wide = ph.dense(small, 4 * 8 * 8)
    value = lambda k: F.get("values", k)
    cells = F.filter(F.sequence(F.lit(0), F.lit(4 * 8 * 8 - 1)), lambda k: value(k) != 0)
    text = F.transform(cells, lambda k: F.concat(k.cast("string"), F.lit(":"), rounded(value(k), 3).cast("decimal(12,3)").cast("string")))
    return wide.select("label", F.nullif(F.array_join(text, ","), F.lit("")).alias("dense"))


@query()
def vector_pair_distances(spark, d):
    return ph.pair_distances(spark.read.parquet(f"{d}/embeddings.parquet"), "label")
