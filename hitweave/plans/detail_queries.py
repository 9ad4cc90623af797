"""Queries over scalar functions, totals, grids of several sizes, grouping metrics and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from hitweave import functions as fn
from hitweave.operators import embeddings as em
from hitweave.operators import geometry as gm
from hitweave.operators import metrics as mt
from hitweave.operators import particles as pt
from hitweave.operators import paths as ph
from hitweave.operators import voxels as vx
from hitweave.plans.hit_queries import _NOISE, _TRUTH, _compared, _particles
from hitweave.plans.proxy import HITS, LABELS, PARTICLES, hits, labelled, labels, query
from hitweave.session import written

W, WR = "WITH ", "WITH RECURSIVE "


@query("SELECT l_orderkey AS orderkey, l_linenumber AS line, l_partkey AS part, l_suppkey AS supplier, CAST(round_even(l_quantity/4.0,0) AS BIGINT) AS even, round(abs(atan2(sin(2*(l_partkey%7-l_suppkey%5)),cos(2*(l_partkey%7-l_suppkey%5))))/2,6) AS angle, CASE WHEN l_partkey%3=0 THEN 0.0::DOUBLE ELSE round(l_quantity::DOUBLE/(l_partkey%3),6) END AS ratio FROM lineitem")
def rounding_and_angles(spark, d):
    t = spark.read.parquet(f"{d}/lineitem.parquet")
    n = F.col("l_partkey") % 3
    ratio = F.when(n == 0, F.when(F.col("l_quantity") > 20, F.lit(float("nan"))).otherwise(F.lit(float("inf")))).otherwise(F.col("l_quantity").cast("double") / F.when(n == 0, 1).otherwise(n))
    angle = gm.angle_distance((F.col("l_partkey") % 7).cast("double"), (F.col("l_suppkey") % 5).cast("double"))
    return t.select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.rint(F.col("l_quantity") / 4.0).cast("long").alias("even"), F.round(angle, 6).alias("angle"), F.round(fn.finite(ratio), 6).alias("ratio"))


@query(f"{W}{HITS} SELECT source, hit_id, x::DOUBLE AS x, y::DOUBLE AS y, toa::DOUBLE AS toa, round(ln(1+tot),6) AS energy FROM h")
def hits_matrix(spark, d):
    return hits(spark, d).select("source", "hit_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("toa").cast("double").alias("toa"), F.round(pt.log_energy(F.col("tot")), 6).alias("energy"))


@query(f"{W}{HITS}, a AS (SELECT source, count(*) AS n, count(*)-count(DISTINCT (x,y)) AS rp, avg(tot) AS m, (max(fine)-min(fine))/16.0 AS span FROM h GROUP BY source) SELECT count(*) AS sources, CAST(sum(n) AS BIGINT) AS n_hits, CAST(sum(rp) AS BIGINT) AS repeated_pixels, round(avg(m),5) AS mean_tot, round(median(span),5) AS median_span FROM a")
def preprocessing_totals(spark, d):
    a = pt.preprocessing_audit(hits(spark, d))
    return a.agg(F.count("*").alias("sources"), F.sum("n_hits").alias("n_hits"), F.sum("repeated_pixels").alias("repeated_pixels"), F.round(F.avg("tot_mean"), 5).alias("mean_tot"), F.round(F.percentile("span_ticks", F.lit(0.5)), 5).alias("median_span"))


_COVER = """box AS (SELECT label, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(fine) AS f0, max(fine) AS f1 FROM lab WHERE label>=0 GROUP BY label),
at AS (SELECT lab.label, (fine-(f0+f1)/2.0)/10.0 AS t, y-(y0+y1)/2.0 AS v, x-(x0+x1)/2.0 AS u, ln(1+tot) AS e FROM lab JOIN box ON lab.label=box.label)""".replace("at AS", "spot AS")


@query(f"""{WR}{LABELS}, {_COVER}, g AS (SELECT * FROM (VALUES (8,16,16),(16,32,32),(32,64,64)) t(nt,ny,nx)), c AS (SELECT nt, label, count(*) AS n, count(*) FILTER (ok) AS k, sum(e) AS e, coalesce(sum(e) FILTER (ok),0) AS ke FROM (SELECT g.nt, label, e,
floor(t+nt/2.0) BETWEEN 0 AND nt-1 AND floor(v+ny/2.0) BETWEEN 0 AND ny-1 AND floor(u+nx/2.0) BETWEEN 0 AND nx-1 AS ok FROM spot, g) GROUP BY nt, label)
SELECT CAST(nt AS INTEGER) AS bins, round(avg((k=n)::INT),6) AS particles, round(sum(k)/sum(n),6) AS hits, round(sum(ke)/sum(e),6) AS energy FROM c GROUP BY nt""".replace(", c AS (SELECT nt", ", cv AS (SELECT nt").replace("FROM c GROUP BY nt", "FROM cv GROUP BY nt"))
def coverage_of_grids(spark, d):
    return vx.coverage_of_grids(labelled(spark, d), [(8, 16, 16), (16, 32, 32), (32, 64, 64)])


@query("""WITH e AS (SELECT vec_id, label, abs(unnest(embedding::DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS d FROM embeddings), u AS (SELECT vec_id, label, d, v/greatest(sum(v) OVER (PARTITION BY vec_id),1e-12) AS v FROM e), m AS (SELECT label, d, sum(v) AS s, sum(v*v) AS ss, count(*) AS n FROM u GROUP BY 1, 2)
SELECT label, max(n) AS n, round(sqrt(sum((s/n)*(s/n))),4) AS centroid_norm, round(sqrt(greatest(sum(ss/n)-sum((s/n)*(s/n)),0)),4) AS rms FROM m GROUP BY label HAVING max(abs(s))<1e6""".replace(" HAVING max(abs(s))<1e6", ""))
def unit_sum_moments(spark, d):
    v = spark.read.parquet(f"{d}/embeddings.parquet").withColumn("embedding", F.transform("embedding", lambda x: F.abs(x.cast("double"))))
    return em.group_moments(ph.unit_sum(v))


@query(f"""{WR}{_TRUTH}, q AS (SELECT * FROM cmp WHERE truth>=0 AND predicted>=0), cell AS (SELECT truth AS t, predicted AS p, count(*)::DOUBLE AS n FROM cmp GROUP BY 1, 2), s1 AS (SELECT sum(n*(n-1)/2) AS s FROM cell), al AS (SELECT sum(n) AS total FROM cell),
a1 AS (SELECT sum(n*(n-1)/2) AS a FROM (SELECT sum(n) AS n FROM cell GROUP BY t)), b1 AS (SELECT sum(n*(n-1)/2) AS b FROM (SELECT sum(n) AS n FROM cell GROUP BY p)), ari AS (SELECT round((s-a*b/(total*(total-1)/2))/((a+b)/2-a*b/(total*(total-1)/2)),6) AS ari FROM s1, al, a1, b1),
s2 AS (SELECT sum(n*(n-1)/2) AS s FROM cell WHERE t>=0 AND p>=0), a2 AS (SELECT sum(n*(n-1)/2) AS a FROM (SELECT sum(n) AS n FROM cell WHERE t>=0 GROUP BY t)), b2 AS (SELECT sum(n*(n-1)/2) AS b FROM (SELECT sum(n) AS n FROM cell WHERE p>=0 GROUP BY p)), f1 AS (SELECT round(2*s/(a+b),6) AS f1 FROM s2, a2, b2),
sp AS (SELECT round(avg((n>1)::INT),6) AS split_rate FROM (SELECT count(DISTINCT predicted) AS n FROM q GROUP BY truth)), mg AS (SELECT round(avg((n>1)::INT),6) AS merge_rate FROM (SELECT count(DISTINCT truth) AS n FROM q GROUP BY predicted)),
en AS (SELECT round(abs(sum(energy) FILTER (predicted>=0)-sum(energy) FILTER (truth>=0))/sum(energy) FILTER (truth>=0),6) AS energy_error FROM cmp)
SELECT ari, f1, split_rate, merge_rate, energy_error, round(ari+0.35*f1-0.35*split_rate-0.35*merge_rate-0.10*energy_error,5) AS selection FROM ari, f1, sp, mg, en""")
def grouping_metrics(spark, d):
    rows = written(spark, _compared(spark, d), "compared")
    one = mt.adjusted_rand(rows).select("ari").join(F.broadcast(mt.pair_f1(rows).select("f1"))).join(F.broadcast(mt.split_merge(rows))).join(F.broadcast(mt.energy_error(rows)))
    return one.withColumn("selection", F.round(mt.selection_score(F.col("ari"), F.col("f1"), F.lit(0.0), F.col("split_rate"), F.col("merge_rate"), F.col("energy_error")), 5))


@query(f"""{WR}{PARTICLES}, {_NOISE}, qq AS (SELECT a.source, greatest(b.min_x-a.max_x,a.min_x-b.max_x,0) AS gx, greatest(b.min_y-a.max_y,a.min_y-b.max_y,0) AS gy, greatest(b.first_fine-a.last_fine,a.first_fine-b.last_fine,0)/10.0 AS gt FROM part a JOIN part b ON a.source=b.source AND a.label<b.label),
sp AS (SELECT source, count(*) AS splits FROM qq WHERE gx*gx+gy*gy+gt*gt<=6.25*6.25+1e-12 GROUP BY source), mg AS (SELECT source, count(*) AS merges FROM part WHERE n_hits>=8 GROUP BY source)
SELECT noise.source, coalesce(splits,0) AS splits, coalesce(merges,0) AS merges, round(1-greatest(0,0.02-noise_fraction)/0.02-greatest(0,noise_fraction-0.25)/0.75-0.015*coalesce(splits,0)-0.05*coalesce(merges,0),6) AS score FROM noise LEFT JOIN sp ON noise.source=sp.source LEFT JOIN mg ON noise.source=mg.source""")
def penalised_score(spark, d):
    p = written(spark, _particles(spark, d), "parts")
    splits = gm.near_particles(p, 6.25).groupBy("source").agg(F.count("*").alias("splits"))
    merges = p.where("n_hits >= 8").groupBy("source").agg(F.count("*").alias("merges"))
    rows = pt.noise_summary(labels(spark, d)).join(splits, "source", "left").join(merges, "source", "left").na.fill(0, ["splits", "merges"])
    return rows.select("source", "splits", "merges", F.round(mt.clustering_score(F.col("noise_fraction"), F.col("splits"), F.col("merges")), 6).alias("score"))


@query(f"{WR}{LABELS}, {_NOISE}, s AS (SELECT source, round(1-greatest(0,0.02-noise_fraction)/0.02-greatest(0,noise_fraction-0.25)/0.75,6) AS score, noise_fraction FROM noise) SELECT source, score, row_number() OVER (ORDER BY score DESC, round(abs(noise_fraction-0.10),9), source) AS place FROM s ORDER BY place LIMIT 10".replace(", s AS", ", sc AS").replace("FROM s ORDER", "FROM sc ORDER"))
def ranked_sources(spark, d):
    s = pt.noise_summary(labels(spark, d)).withColumn("score", F.round(mt.clustering_score(F.col("noise_fraction"), F.lit(0), F.lit(0)), 6))
    return mt.ranked_parameters(s, "source", 10)

