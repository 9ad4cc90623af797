"""Queries over hits, clusters, particles, windows and agreement."""

from __future__ import annotations

from pyspark.sql import functions as F

from hitweave import functions as fn
from hitweave.operators import cluster as cl
from hitweave.operators import metrics as mt
from hitweave.operators import particles as pt
from hitweave.operators import spatial as sp
from hitweave.operators import voxels as vx
from hitweave.operators import windows as wd
from hitweave.operators.geometry import near_particles
from hitweave.operators.order import group_minimum
from hitweave.plans.proxy import HITS, LABELS, PAIRS, PARTICLES, ROWS, hits, labelled, labels, query, rows

W, WR = "WITH ", "WITH RECURSIVE "


def _particles(spark, d):
    return pt.particles(hits(spark, d), labels(spark, d))


# ---- scans and projections


@query(f"{W}{ROWS} SELECT hit_id, matrix_index, matrix_index%256 AS x, matrix_index//256 AS y FROM r")
def hits_decode(spark, d):
    m = F.col("matrix_index")
    return rows(spark, d).select("hit_id", "matrix_index", fn.pixel_x(m).cast("long").alias("x"), fn.pixel_y(m).cast("long").alias("y"))


@query(f"{W}{ROWS} SELECT hit_id, fine, round(toa-ftoa/16.0,6) AS ticks, round(25*fine/16.0,6) AS ns FROM r")
def hits_fine_time(spark, d):
    toa, ftoa = F.col("toa"), F.col("ftoa")
    return rows(spark, d).select("hit_id", fn.fine_time(toa, ftoa).alias("fine"), F.round(toa - ftoa / 16.0, 6).alias("ticks"), F.round(fn.time_ns(toa, ftoa), 6).alias("ns"))


@query(f"{W}{HITS} SELECT source, hit_id, x, y, fine-min(fine) OVER (PARTITION BY source) AS relative, round(ln(1+tot),6) AS energy FROM h")
def hits_clean(spark, d):
    return group_minimum(hits(spark, d), "source", "fine", "first_fine").select("source", "hit_id", "x", "y", (F.col("fine") - F.col("first_fine")).alias("relative"), F.round(pt.log_energy(F.col("tot")), 6).alias("energy"))


@query(f"{W}{ROWS} SELECT source, count(*) AS n_rows, CAST(sum(overflow) AS BIGINT) AS n_markers FROM r GROUP BY source")
def marker_counts(spark, d):
    return rows(spark, d).groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("overflow").alias("n_markers"))


@query(f"{W}{ROWS}, m AS (SELECT source, hit_id, toa, lead(toa) OVER (PARTITION BY source ORDER BY toa, hit_id) AS next_toa FROM r WHERE overflow<>0) SELECT *, next_toa-toa AS gap_ticks FROM m WHERE next_toa IS NOT NULL")
def marker_gaps(spark, d):
    return pt.marker_gaps(rows(spark, d))


# ---- clustering


@query(f"{W}{PAIRS} SELECT source, a, b FROM p WHERE a<b")
def eps_pairs(spark, d):
    return sp.radius_pairs(hits(spark, d), directed=False).select("source", "a", "b")


@query(f"{W}{PAIRS} SELECT h.hit_id, count(p.b) AS degree FROM h LEFT JOIN p ON h.hit_id=p.a GROUP BY h.hit_id")
def neighbor_degree(spark, d):
    n = sp.radius_pairs(hits(spark, d)).groupBy(F.col("a").alias("hit_id")).agg(F.count("*").alias("degree"))
    return hits(spark, d).select("hit_id").join(n, "hit_id", "left").select("hit_id", F.coalesce("degree", F.lit(0)).alias("degree"))


@query(f"{W}{PAIRS} SELECT a AS hit_id FROM p GROUP BY a HAVING count(*)>=2")
def core_points(spark, d):
    return cl.dbscan_rows(spark, hits(spark, d), min_samples=3).where("kind = 'core' and first").select("hit_id")


@query(f"{WR}{LABELS} SELECT hit_id, label FROM lab")
def dbscan_labels(spark, d):
    return cl.dbscan(spark, hits(spark, d)).select("hit_id", "label")


_MIN3 = f"""{PAIRS}, core AS (SELECT a AS hit_id FROM p GROUP BY a HAVING count(*)>=2), cp AS (SELECT p.a, p.b FROM p JOIN core c1 ON p.a=c1.hit_id JOIN core c2 ON p.b=c2.hit_id),
c(n, root) AS (SELECT hit_id, hit_id FROM core UNION SELECT cp.b, c.root FROM c JOIN cp ON c.n=cp.a), k AS (SELECT n AS hit_id, min(root) AS label FROM c GROUP BY n),
border AS (SELECT p.a AS hit_id, arg_min(k.label, ROW(p.dy, p.dx, p.df, p.b)) AS label FROM p JOIN k ON p.b=k.hit_id WHERE p.a NOT IN (SELECT hit_id FROM core) GROUP BY p.a)
SELECT h.hit_id, coalesce(k.label, border.label, -1) AS label, CASE WHEN k.label IS NOT NULL THEN 'core' WHEN border.label IS NOT NULL THEN 'border' ELSE 'noise' END AS kind
FROM h LEFT JOIN k USING (hit_id) LEFT JOIN border USING (hit_id)"""


@query(WR + _MIN3)
def dbscan_min3_labels(spark, d):
    return cl.dbscan(spark, hits(spark, d), min_samples=3).select("hit_id", "label", "kind")


@query(f"{WR}{LABELS} SELECT hit_id, CASE WHEN label>=0 AND count(*) OVER (PARTITION BY label)>=3 THEN label ELSE -1 END AS label FROM lab")
def stream_link_labels(spark, d):
    return cl.link_stream(spark, hits(spark, d), min_samples=3).select("hit_id", "label")


def _voxel_sql(most: int) -> str:
    return f"""{WR}{HITS}, v AS (SELECT *, CAST(floor(fine/16.0+1e-9) AS BIGINT) AS vt FROM h), cell AS (SELECT source, x, y, vt, min(hit_id) AS cell, count(*) AS n FROM v GROUP BY ALL),
o AS (SELECT i, j, k FROM (VALUES (-1),(0),(1)) a(i), (VALUES (-1),(0),(1)) b(j), (VALUES (-1),(0),(1)) c(k) WHERE abs(i)+abs(j)+abs(k) BETWEEN 1 AND {most}),
s AS (SELECT source, cell, x+i AS x, y+j AS y, vt+k AS vt FROM cell, o), e AS (SELECT s.cell AS a, cell.cell AS b FROM s JOIN cell ON s.source=cell.source AND s.x=cell.x AND s.y=cell.y AND s.vt=cell.vt),
c(m, root) AS (SELECT cell, cell FROM cell UNION SELECT e.b, c.root FROM c JOIN e ON c.m=e.a), g AS (SELECT m AS cell, min(root) AS root FROM c GROUP BY m),
size AS (SELECT root, sum(n) AS hits FROM g JOIN cell USING (cell) GROUP BY root)
SELECT v.hit_id, CASE WHEN size.hits>=2 THEN g.root ELSE -1 END AS label FROM v JOIN cell ON v.source=cell.source AND v.x=cell.x AND v.y=cell.y AND v.vt=cell.vt JOIN g ON g.cell=cell.cell JOIN size USING (root)"""


@query(_voxel_sql(1))
def voxel_cc_face(spark, d):
    return cl.voxel_components(spark, hits(spark, d), 1.0, "face").select("hit_id", "label")


@query(_voxel_sql(2))
def voxel_cc_edge(spark, d):
    return cl.voxel_components(spark, hits(spark, d), 1.0, "edge").select("hit_id", "label")


@query(_voxel_sql(3))
def voxel_cc_corner(spark, d):
    return cl.voxel_components(spark, hits(spark, d), 1.0, "corner").select("hit_id", "label")


@query(f"""{W}{HITS}, s AS (SELECT *, CASE WHEN fine-lag(fine) OVER (PARTITION BY source ORDER BY fine, hit_id)>50 THEN 1 ELSE 0 END AS st FROM h),
q AS (SELECT *, CAST(sum(st) OVER (PARTITION BY source ORDER BY fine, hit_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM s) SELECT source, session, count(*) AS n_hits, min(fine) AS first_fine, max(fine) AS last_fine FROM q GROUP BY source, session""")
def session_ids(spark, d):
    return cl.sessions(hits(spark, d)).groupBy("source", "session").agg(F.count("*").alias("n_hits"), F.min("fine").alias("first_fine"), F.max("fine").alias("last_fine"))


@query(f"{WR}{PARTICLES} SELECT n_hits, count(*) AS n_particles FROM part GROUP BY n_hits")
def cluster_sizes(spark, d):
    return _particles(spark, d).groupBy("n_hits").agg(F.count("*").alias("n_particles"))


# ---- particles and reports


@query(f"{WR}{PARTICLES} SELECT * FROM part")
def flagship_particles(spark, d):
    h = hits(spark, d)
    return pt.particles(h, cl.dbscan_rows(spark, h))


@query(f"{WR}{PARTICLES} SELECT source, label, n_hits, CAST(coalesce(sum(n_hits) OVER (PARTITION BY source ORDER BY label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS BIGINT) AS \"offset\" FROM part")
def particle_offsets(spark, d):
    return pt.offsets(_particles(spark, d))


_NOISE = "noise AS (SELECT source, count(*) AS n_hits, count(*) FILTER (label<0) AS n_noise, round(avg(CASE WHEN label<0 THEN 1.0::DOUBLE ELSE 0.0 END),6) AS noise_fraction, count(DISTINCT CASE WHEN label>=0 THEN label END) AS n_particles FROM lab GROUP BY source)"


@query(f"{WR}{LABELS}, {_NOISE} SELECT * FROM noise")
def noise_summary(spark, d):
    return pt.noise_summary(labels(spark, d))


@query(f"""{WR}{PARTICLES}, {_NOISE}, j AS (SELECT part.*, noise.n_hits AS rows_, noise.noise_fraction AS nf FROM part JOIN noise USING (source)),
g AS (SELECT source, count(*) AS n_particles, max(n_hits) AS max_hits, round(quantile_cont(n_hits,0.5),6) AS median_hits, round(quantile_cont(n_hits,0.95),6) AS p95_hits, round(quantile_cont(n_hits,0.99),6) AS p99_hits,
round(max(n_hits/rows_),6) AS largest_fraction, count(*) FILTER ((last_fine-first_fine)/16.0>3) AS n_long, count(*) FILTER ((max_x-min_x>=255 AND max_y-min_y>=255) OR n_hits>=greatest(1,floor(rows_*0.5))) AS n_wide, any_value(nf) AS noise_fraction FROM j GROUP BY source)
SELECT *, concat_ws(';', CASE WHEN n_long>0 THEN 'long_particles='||n_long END, CASE WHEN n_wide>0 THEN 'wide_particles='||n_wide END, CASE WHEN noise_fraction>0.25 THEN 'high_noise' END, CASE WHEN noise_fraction<0.001 THEN 'low_noise' END) AS warnings FROM g""")
def shard_audit(spark, d):
    return pt.shard_audit(_particles(spark, d), pt.noise_summary(labels(spark, d)), long_ticks=3.0)


@query(f"{WR}{PARTICLES} SELECT CASE WHEN n_hits<=3 THEN '1-3' WHEN n_hits<=10 THEN '4-10' WHEN n_hits<=50 THEN '11-50' WHEN n_hits<=512 THEN '51-512' ELSE '>512' END AS bucket, count(*) AS n FROM part GROUP BY 1")
def size_histogram(spark, d):
    return _particles(spark, d).groupBy(pt.size_bucket(F.col("n_hits")).alias("bucket")).agg(F.count("*").alias("n"))


@query(f"{WR}{PARTICLES} SELECT source, label, n_hits, last_fine-first_fine AS span FROM part ORDER BY span DESC, label LIMIT 25")
def longest_particles(spark, d):
    return _particles(spark, d).select("source", "label", "n_hits", (F.col("last_fine") - F.col("first_fine")).alias("span")).orderBy(F.col("span").desc(), "label").limit(25)


@query(f"""{W}{ROWS}, n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY hit_id) AS i, count(*) OVER (PARTITION BY source) AS c FROM r)
SELECT source, count(*) AS rows_scanned, CAST(sum(tot) AS BIGINT) AS tot_sum, round(avg(tot),6) AS tot_mean, max(tot) AS tot_max, min(toa) AS toa_min, max(toa) AS toa_max, CAST(sum(overflow) AS BIGINT) AS overflow_count, any_value(c>3000) AS scan_limited FROM n WHERE i<=3000 GROUP BY source""")
def file_candidates(spark, d):
    return pt.file_candidates(rows(spark, d), 3000)


_FILES = "SELECT source%3 AS folder, 'f'||source AS path, count(*)*24 AS bytes, count(*) AS rows, CAST(min(toa) AS VARCHAR) AS start FROM r GROUP BY source"


@query(f"""{W}{ROWS}, f AS ({_FILES}), t AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY bytes DESC, path) AS i FROM f), l AS (SELECT folder, string_agg(path, ',' ORDER BY i) AS largest FROM t WHERE i<=5 GROUP BY folder)
SELECT f.folder, count(*) AS files, count(*) FILTER (rows>0) AS files_with_rows, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(rows) AS BIGINT) AS rows, min(start) AS first_start, max(start) AS last_start, any_value(largest) AS largest FROM f JOIN l USING (folder) GROUP BY f.folder""")
def folder_report(spark, d):
    files = rows(spark, d).groupBy("source").agg((F.count("*") * 24).alias("bytes"), F.count("*").alias("rows"), F.min("toa").cast("string").alias("start")).select((F.col("source") % 3).alias("folder"), F.concat(F.lit("f"), F.col("source").cast("string")).alias("path"), "bytes", "rows", "start")
    return pt.folder_report(files)


@query(f"""{W}{HITS} SELECT order_id AS frame, count(*) AS nnz, round(count(*)/65536.0::DOUBLE,9) AS density, round(sum(tot::DOUBLE),6) AS energy_sum, round(max(tot::DOUBLE),6) AS energy_max, round(min(tot::DOUBLE),6) AS energy_min, round(avg(tot::DOUBLE),6) AS energy_mean FROM h GROUP BY order_id""")
def frame_stats(spark, d):
    return pt.frame_stats(hits(spark, d).select(F.col("order_id").alias("frame"), F.col("tot").cast("double").alias("energy")))


@query(f"{W}{HITS} SELECT source, count(*) AS n_hits, count(*)-count(DISTINCT (x,y)) AS repeated_pixels, round(avg(tot),6) AS tot_mean, round(quantile_cont(tot,0.95),6) AS tot_p95, round((max(fine)-min(fine))/16.0,6) AS span_ticks FROM h GROUP BY source")
def preprocessing_audit(spark, d):
    return pt.preprocessing_audit(hits(spark, d))


@query(f"""{W}{HITS}, m AS (SELECT 'tot' AS measure, tot::DOUBLE AS v FROM h UNION ALL SELECT 'log', ln(1+tot) FROM h UNION ALL SELECT 'scaled', ln(1+tot)/6.931471805599453 FROM h)
SELECT measure, round(min(v),6) AS "min", round(quantile_cont(v,0.5),6) AS p50, round(quantile_cont(v,0.9),6) AS p90, round(quantile_cont(v,0.99),6) AS p99, round(max(v),6) AS "max" FROM m GROUP BY measure""")
def energy_quantiles(spark, d):
    return pt.energy_quantiles(hits(spark, d))


# ---- audits


@query(f"""{WR}{LABELS}, v AS (SELECT *, CAST(floor(fine/16.0+1e-9) AS BIGINT) AS vt FROM lab WHERE label>=0), cell AS (SELECT label, x, y, vt, min(hit_id) AS cell FROM v GROUP BY ALL),
o AS (SELECT i, j, q FROM (VALUES (-1),(0),(1)) a(i), (VALUES (-1),(0),(1)) b(j), (VALUES (-1),(0),(1)) cc(q) WHERE abs(i)+abs(j)+abs(q)>=1), s AS (SELECT label, cell, x+i AS x, y+j AS y, vt+q AS vt FROM cell, o),
e AS (SELECT s.cell AS a, cell.cell AS b FROM s JOIN cell ON s.label=cell.label AND s.x=cell.x AND s.y=cell.y AND s.vt=cell.vt),
w(m, root) AS (SELECT cell, cell FROM cell UNION SELECT e.b, w.root FROM w JOIN e ON w.m=e.a), g AS (SELECT m AS cell, min(root) AS root FROM w GROUP BY m)
SELECT label, count(DISTINCT root) AS n_components, count(*) AS n_voxels FROM cell JOIN g USING (cell) GROUP BY label""")
def voxel_components_per_particle(spark, d):
    return vx.components_by_particle(spark, labelled(spark, d))


@query(f"""{WR}{LABELS}, cell AS (SELECT DISTINCT source, x, y, CAST(floor(fine/16.0+1e-9) AS BIGINT) AS vt, label FROM lab WHERE label>=0),
o AS (SELECT i, j, q FROM (VALUES (-1),(0),(1)) a(i), (VALUES (-1),(0),(1)) b(j), (VALUES (-1),(0),(1)) cc(q) WHERE abs(i)+abs(j)+abs(q)>=1), s AS (SELECT source, label, x+i AS x, y+j AS y, vt+q AS vt FROM cell, o)
SELECT least(s.label,cell.label) AS a, greatest(s.label,cell.label) AS b, count(*) AS contacts FROM s JOIN cell ON s.source=cell.source AND s.x=cell.x AND s.y=cell.y AND s.vt=cell.vt AND s.label<>cell.label GROUP BY 1, 2""")
def touching_pairs(spark, d):
    return vx.touching_labels(labelled(spark, d))



@query(f"""{WR}{PARTICLES}, q AS (SELECT a.source, a.label AS a, b.label AS b, greatest(b.min_x-a.max_x,a.min_x-b.max_x,0) AS gx, greatest(b.min_y-a.max_y,a.min_y-b.max_y,0) AS gy, greatest(b.first_fine-a.last_fine,a.first_fine-b.last_fine,0)/10.0 AS gt
FROM part a JOIN part b ON a.source=b.source AND a.label<b.label) SELECT source, a, b, round(sqrt(gx*gx+gy*gy+gt*gt),6) AS box_distance FROM q WHERE gx*gx+gy*gy+gt*gt<=6.25*6.25+1e-12""")
def near_cluster_pairs(spark, d):
    return near_particles(_particles(spark, d), 6.25)


@query(f"""{WR}{PARTICLES}, q AS (SELECT source, quantile_cont(n_hits,0.99) AS p99 FROM part GROUP BY source) SELECT part.source, label, n_hits FROM part JOIN q USING (source) WHERE n_hits>=greatest(5,p99) AND greatest(max_x-min_x,max_y-min_y)>3 AND (last_fine-first_fine)/10.0>3""")
def suspicious_merges(spark, d):
    parts = _particles(spark, d)
    p99 = parts.groupBy("source").agg(F.percentile("n_hits", F.lit(0.99)).alias("p99"))
    return parts.join(p99, "source").where((F.col("n_hits") >= F.greatest(F.lit(5), "p99")) & (F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")) > 3) & ((F.col("last_fine") - F.col("first_fine")) / 10.0 > 3)).select("source", "label", "n_hits")


# ---- windows


@query(f"{WR}{LABELS} SELECT source, CAST(floor(fine/4000.0) AS BIGINT) AS bucket, count(*) AS n_hits, count(DISTINCT CASE WHEN label>=0 THEN label END) AS n_particles, round(avg(CASE WHEN label<0 THEN 1.0::DOUBLE ELSE 0.0 END),6) AS noise_fraction FROM lab GROUP BY 1, 2")
def tumbling_hits(spark, d):
    return wd.tumbling(labelled(spark, d), 4000)


@query(f"""{W}{HITS}, q AS (SELECT source, fine, row_number() OVER (PARTITION BY source ORDER BY fine, hit_id)-1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM h),
e AS (SELECT *, unnest(range(greatest(0,CAST(floor((pos-512)/384.0) AS BIGINT)+1), least(greatest(0,CAST(ceil((n-512)/384.0) AS BIGINT)), pos//384)+1)) AS "window" FROM q) SELECT source, "window", count(*) AS n_hits, min(fine) AS first_fine, max(fine) AS last_fine FROM e GROUP BY 1, 2""")
def overlap_windows(spark, d):
    return wd.overlapping_windows(hits(spark, d), 512, 128, 1)


@query(f"""{W}{HITS} SELECT source, hit_id, round(least(greatest(coalesce((fine-lag(fine) OVER w)/16.0,0),0),10),6) AS dt_prev, round(least(greatest(coalesce((lead(fine) OVER w-fine)/16.0,0),0),10),6) AS dt_next FROM h WINDOW w AS (PARTITION BY source ORDER BY fine, hit_id)""")
def dt_prev_next(spark, d):
    return wd.neighbour_gaps(hits(spark, d))


@query(f"{WR}{LABELS} SELECT label, hit_id, round(CASE WHEN count(*) OVER (PARTITION BY label)>1 THEN (row_number() OVER (PARTITION BY label ORDER BY fine, hit_id)-1)/(count(*) OVER (PARTITION BY label)-1) ELSE 0.0::DOUBLE END,6) AS rank FROM lab WHERE label>=0")
def time_rank(spark, d):
    return wd.time_rank(labelled(spark, d).where("label >= 0"))


@query(f"""{WR}{LABELS}, g AS (SELECT label, hit_id, fine, lead(fine) OVER (PARTITION BY label ORDER BY fine, hit_id)-fine AS gap FROM lab WHERE label>=0)
SELECT label, max(gap) AS max_gap, round(quantile_cont(gap,0.5),6) AS median_gap, arg_min(hit_id, ROW(-gap, fine, hit_id)) AS before FROM g WHERE gap IS NOT NULL GROUP BY label""")
def largest_gap(spark, d):
    return wd.largest_gap(labelled(spark, d))


@query(f"""{WR}{LABELS}, g AS (SELECT label, sign(lead(x) OVER (PARTITION BY label ORDER BY fine, hit_id)-x) AS s FROM lab WHERE label>=0)
SELECT label, count(*) AS steps, round(abs(avg(s)),6) AS monotonicity FROM g WHERE s IS NOT NULL GROUP BY label HAVING count(*)>1""")
def monotonicity(spark, d):
    return wd.monotonicity(labelled(spark, d))


@query(f"""{W}{HITS}, q AS (SELECT source, hit_id, row_number() OVER (PARTITION BY source ORDER BY hit_id)-1 AS i, count(*) OVER (PARTITION BY source) AS n FROM h) SELECT source, hit_id FROM q WHERE ((i+1)*least(10,n))//n > (i*least(10,n))//n""")
def even_selection(spark, d):
    return wd.evenly(hits(spark, d).select("source", "hit_id"), "source", "hit_id", 10)


# ---- agreement with the order that a hit was made from

_TRUTH = f"{LABELS}, cmp AS (SELECT source, hit_id, order_id AS truth, label AS predicted, ln(1+tot) AS energy FROM lab)"
_CELLS = "cell AS (SELECT truth AS t, predicted AS p, count(*)::DOUBLE AS n FROM cmp GROUP BY 1, 2)"


def _compared(spark, d):
    return labelled(spark, d).select("source", "hit_id", F.col("order_id").alias("truth"), F.col("label").alias("predicted"), pt.log_energy(F.col("tot")).alias("energy"))


_ARI = f"""{_CELLS}, s AS (SELECT sum(n*(n-1)/2) AS s, sum(n) AS total FROM cell), a AS (SELECT sum(n*(n-1)/2) AS a FROM (SELECT sum(n) AS n FROM cell GROUP BY t)), b AS (SELECT sum(n*(n-1)/2) AS b FROM (SELECT sum(n) AS n FROM cell GROUP BY p)),
ari AS (SELECT CAST(total AS BIGINT) AS n_hits, round((s-a*b/(total*(total-1)/2))/((a+b)/2-a*b/(total*(total-1)/2)),6) AS ari FROM s, a, b)"""


@query(f"{WR}{_TRUTH}, {_ARI} SELECT * FROM ari")
def adjusted_rand(spark, d):
    return mt.adjusted_rand(_compared(spark, d))


@query(f"{WR}{_TRUTH}, {_ARI} SELECT x.*, ari.* FROM (SELECT round(avg(((truth<0)=(predicted<0))::INT),6) AS same_noise, round(avg((truth<0)::INT),6) AS truth_noise, round(avg((predicted<0)::INT),6) AS predicted_noise FROM cmp) x, ari")
def label_agreement(spark, d):
    return mt.label_agreement(_compared(spark, d))


@query(f"""{WR}{_TRUTH}, {_CELLS}, s AS (SELECT sum(n*(n-1)/2) AS s FROM cell WHERE t>=0 AND p>=0), a AS (SELECT sum(n*(n-1)/2) AS a FROM (SELECT sum(n) AS n FROM cell WHERE t>=0 GROUP BY t)), b AS (SELECT sum(n*(n-1)/2) AS b FROM (SELECT sum(n) AS n FROM cell WHERE p>=0 GROUP BY p))
SELECT round(s/b,6) AS precision, round(s/a,6) AS recall, round(2*s/(a+b),6) AS f1 FROM s, a, b""")
def pair_f1(spark, d):
    return mt.pair_f1(_compared(spark, d))


@query(f"""{WR}{_TRUTH}, q AS (SELECT * FROM cmp WHERE truth>=0 AND predicted>=0) SELECT (SELECT round(avg((n>1)::INT),6) FROM (SELECT count(DISTINCT predicted) AS n FROM q GROUP BY truth)) AS split_rate, (SELECT round(avg((n>1)::INT),6) FROM (SELECT count(DISTINCT truth) AS n FROM q GROUP BY predicted)) AS merge_rate""")
def split_merge_rate(spark, d):
    return mt.split_merge(_compared(spark, d))


@query(f"{WR}{_TRUTH} SELECT round(abs(sum(energy) FILTER (predicted>=0)-sum(energy) FILTER (truth>=0))/sum(energy) FILTER (truth>=0),6) AS energy_error FROM cmp")
def energy_error(spark, d):
    return mt.energy_error(_compared(spark, d))


@query(f"""{WR}{LABELS}, {_NOISE} SELECT source, round(1-greatest(0,0.02-noise_fraction)/0.02-greatest(0,noise_fraction-0.25)/0.75,6) AS score FROM noise""")
def clustering_score(spark, d):
    return pt.noise_summary(labels(spark, d)).select("source", F.round(mt.clustering_score(F.col("noise_fraction"), F.lit(0), F.lit(0)), 6).alias("score"))


@query(f"""{WR}{LABELS}, {_NOISE}, b AS (SELECT 'hits' AS bucketing, CASE WHEN n_hits<=3900 THEN 'few' ELSE 'many' END AS bucket, noise_fraction, n_particles FROM noise UNION ALL SELECT 'parity', CAST(source%2 AS VARCHAR), noise_fraction, n_particles FROM noise)
SELECT bucketing, bucket, count(*) AS n, round(avg(noise_fraction),6) AS noise_fraction, round(avg(n_particles),6) AS n_particles FROM b GROUP BY 1, 2""")
def bucketed_means(spark, d):
    return mt.bucketed_means(pt.noise_summary(labels(spark, d)), ["noise_fraction", "n_particles"], {"hits": F.when(F.col("n_hits") <= 3900, "few").otherwise("many"), "parity": F.col("source") % 2})


@query(f"""{WR}{_TRUTH}, oc AS (SELECT source, truth, predicted, count(*) AS n FROM cmp WHERE truth>=0 AND predicted>=0 GROUP BY 1, 2, 3), ot AS (SELECT source, truth, count(*) AS tn FROM cmp WHERE truth>=0 GROUP BY 1, 2), op AS (SELECT source, predicted, count(*) AS pn FROM cmp WHERE predicted>=0 GROUP BY 1, 2),
sc AS (SELECT oc.source, oc.truth, oc.predicted, n/(tn+pn-n) AS iou FROM oc JOIN ot ON oc.source=ot.source AND oc.truth=ot.truth JOIN op ON oc.source=op.source AND oc.predicted=op.predicted WHERE n/(tn+pn-n)>=0.5),
bt AS (SELECT *, row_number() OVER (PARTITION BY source, truth ORDER BY iou DESC, predicted) AS i FROM sc), tk AS (SELECT *, row_number() OVER (PARTITION BY source, predicted ORDER BY truth) AS j FROM bt WHERE i=1), mt AS (SELECT source, count(*) AS matched, round(avg(iou),6) AS mean_iou FROM tk WHERE j=1 GROUP BY source)
SELECT q.source, q.objects, coalesce(matched,0) AS matched, coalesce(mean_iou,0.0) AS mean_iou FROM (SELECT source, count(*) AS objects FROM ot GROUP BY source) q LEFT JOIN mt ON q.source=mt.source""")
def object_iou(spark, d):
    return mt.object_iou(_compared(spark, d))
