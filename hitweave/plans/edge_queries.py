"""Queries over edge windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from hitweave.operators import edge_windows as ew
from hitweave.operators.cluster import dbscan
from hitweave.operators.order import block_window, in_blocks, ranked
from hitweave.plans.proxy import HITS, LABELS, hits, labelled, query
from hitweave.session import written

W, WR = "WITH ", "WITH RECURSIVE "


_WINDOW = {"size": 512, "overlap": 128, "least": 16}


@query(f"""{WR}{LABELS}, rk AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY fine, hit_id)-1 AS pos, count(*) OVER (PARTITION BY source) AS cnt FROM lab),
wn AS (SELECT *, unnest(range(greatest(0,CAST(floor((pos-512)/384.0) AS BIGINT)+1), least(greatest(0,CAST(ceil((cnt-512)/384.0) AS BIGINT)), pos//384)+1)) AS "window" FROM rk WHERE cnt>=16)
SELECT source*16777216+"window" AS source, source AS origin, "window", count(*) AS n_hits, count(DISTINCT CASE WHEN label>=0 THEN label END) AS particles FROM wn GROUP BY wn.source, "window" HAVING count(*)>=16""")
def edge_window_hits(spark, d):
    return ew.windows(labelled(spark, d), 512, 128, 16).groupBy("source", "origin", "window").agg(F.count("*").alias("n_hits"), F.count_distinct(F.when(F.col("label") >= 0, F.col("label"))).alias("particles"))


@query()
def edge_window_manifest(spark, d):
    return ew.window_manifest(labelled(spark, d), **_WINDOW)


@query()
def edge_window_nodes(spark, d):
    return ew.train_normalised(ew.window_nodes(labelled(spark, d), **_WINDOW), None, ew.NODE)


@query(f"""{W}{HITS}, e AS (SELECT a.source, a.hit_id AS src, b.hit_id AS dst, (b.x-a.x)/128.0::DOUBLE AS dx, (b.y-a.y)/128.0::DOUBLE AS dy, (b.fine-a.fine)/10.0::DOUBLE AS dt, ln(1+a.tot)/6.931471805599453 AS ea, ln(1+b.tot)/6.931471805599453 AS eb, a.x=b.x AND a.y=b.y AS same
FROM (SELECT *, lead(hit_id) OVER (PARTITION BY source ORDER BY fine, hit_id) AS nxt FROM h) a JOIN h b ON a.nxt=b.hit_id AND a.source=b.source)
SELECT source, src, dst, round(dx,6) AS dx, round(dy,6) AS dy, round(dt,6) AS dt, round(abs(dt),6) AS abs_dt, round(sqrt(dx*dx+dy*dy),6) AS dist_xy, round(sqrt(dx*dx+dy*dy+dt*dt),6) AS dist_xyt, round(eb-ea,6) AS energy_step, round(abs(eb-ea),6) AS abs_energy_step,
round(least((eb+1e-6)/(ea+1e-6),10.0),6) AS energy_ratio, CASE WHEN same THEN 1.0::DOUBLE ELSE 0.0 END AS same_pixel, 0.0::DOUBLE AS is_near, 0.0::DOUBLE AS is_far, 1.0::DOUBLE AS is_time, 0.0::DOUBLE AS is_pixel FROM e""")
def edge_vectors(spark, d):
    h = hits(spark, d)
    # each hit keeps its own measures and looks up those of the next hit_id
    near = in_blocks(ranked(h.select("source", "hit_id", "x", "y", "fine", "tot")), 1).withColumn("dst", F.lead("hit_id").over(block_window())).where("_own and dst is not null")
    edges = near.select("source", F.col("hit_id").alias("src"), "dst", F.lit(4).alias("edge_type"), *(F.col(c).alias(f"s_{c}") for c in ("x", "y", "fine", "tot")))
    return ew.edge_figures(edges.join(ew.end(h, "d", "dst"), ["source", "dst"]))


@query()
def repaired_components(spark, d):
    h = hits(spark, d)
    rough = written(spark, dbscan(spark, h, eps=12.0, time_scale=2.5), "rough")
    return ew.repaired(ew.node_vectors(h), rough.select("source", "hit_id", "label"))


@query()
def threshold_sweep(spark, d):
    h = hits(spark, d)
    scored = h.select("source", "hit_id", "x", "y", "fine", F.round((F.col("tot") % 11) / 10.0, 2).alias("score"), F.col("order_id").alias("truth"))
    return ew.threshold_sweep_hits(spark, scored)


@query()
def mixed_windows(spark, d):
    return ew.mixed_windows(spark, labelled(spark, d).where("label >= 0"), 20)
