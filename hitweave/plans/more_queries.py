"""Queries over samples, edge graphs, geometry, voxels, embeddings, events, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from hitweave import functions as fn
from hitweave.operators import embeddings as em
from hitweave.operators import geometry as gm
from hitweave.operators import graph as gr
from hitweave.operators import particles as pt
from hitweave.operators import sampling as sm
from hitweave.operators import spatial as sp
from hitweave.operators import voxels as vx
from hitweave.plans.hit_queries import _particles
from hitweave.plans.proxy import HITS, LABELS, PARTICLES, hits, labelled, labels, query
from hitweave.session import written
from hitweave.sources.files import tree_digest, union_rows, verify_manifest

W, WR = "WITH ", "WITH RECURSIVE "


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _h(key: str, digits: int) -> str:
    return f"('0x'||substr(sha1({key}),1,{digits}))::BIGINT"


# ---- splits and samples


@query(f"SELECT o_custkey AS custkey, CASE WHEN u<0.1 THEN 'test' WHEN u<0.2 THEN 'validation' ELSE 'train' END AS split, count(*) AS n FROM (SELECT o_custkey, {_h(chr(39) + '7:' + chr(39) + '||o_custkey', 8)}/4294967295.0::DOUBLE AS u FROM orders) GROUP BY 1, 2")
def group_split(spark, d):
    return _table(spark, d, "orders").groupBy(F.col("o_custkey").alias("custkey"), sm.group_split(F.col("o_custkey"), 7).alias("split")).agg(F.count("*").alias("n"))


_SIZES = "s AS (SELECT o_custkey AS custkey, count(*)*100 AS n FROM orders GROUP BY 1), t AS (SELECT *, CASE WHEN n<100 THEN 'tiny' WHEN n<2000 THEN 'small' WHEN n<50000 THEN 'medium' WHEN n<500000 THEN 'large' ELSE 'huge' END AS tier FROM s)"


def _sizes(spark, d):
    s = _table(spark, d, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg((F.count("*") * 100).alias("n"))
    return s.withColumn("tier", sm.size_tier(F.col("n")))


@query(f"WITH {_SIZES} SELECT tier, count(*) AS files, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY tier")
def size_tiers(spark, d):
    return _sizes(spark, d).groupBy("tier").agg(F.count("*").alias("files"), F.sum("n").alias("n"))


@query(f"WITH {_SIZES}, q AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY {_h(chr(39) + '3:' + chr(39) + '||custkey', 15)}, custkey) AS i FROM t) SELECT custkey, n, tier FROM q WHERE i <= CASE tier WHEN 'small' THEN 2 WHEN 'medium' THEN 4 ELSE 0 END")
def stratified_sample(spark, d):
    return sm.stratified(_sizes(spark, d), "tier", "custkey", {"small": 2, "medium": 4}, 3)


@query(f"""{WR}{PARTICLES}, q AS (SELECT label, n_hits, CASE WHEN n_hits<=3 THEN '1-3' WHEN n_hits<=10 THEN '4-10' ELSE '11+' END AS bucket FROM part), zz AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY {_h(chr(39) + '5:' + chr(39) + '||label', 15)}, label) AS i FROM q)
SELECT label, n_hits, bucket FROM zz WHERE i <= CASE bucket WHEN '1-3' THEN 30 WHEN '4-10' THEN 20 ELSE 10 END""")
def bucket_quota(spark, d):
    n = F.col("n_hits")
    q = _particles(spark, d).select("label", "n_hits", F.when(n <= 3, "1-3").when(n <= 10, "4-10").otherwise("11+").alias("bucket"))
    return sm.stratified(q, "bucket", "label", {"1-3": 30, "4-10": 20, "11+": 10}, 5)


@query(f"""{WR}{PARTICLES}, q AS (SELECT source, label, energy_sum, row_number() OVER (PARTITION BY source ORDER BY energy_sum DESC, label) AS i, count(*) OVER (PARTITION BY source) AS n FROM part) SELECT source, label, energy_sum FROM q WHERE i <= ceil(n*0.05)""")
def top_fraction(spark, d):
    return sm.top_fraction(_particles(spark, d).select("source", "label", "energy_sum"), "source", "energy_sum", "label", 0.05)


@query(f"""WITH o AS (SELECT o_orderkey AS orderkey, o_orderkey%3=0 AS mixed FROM orders), q AS (SELECT *, row_number() OVER (ORDER BY {_h(chr(39) + '2:' + chr(39) + '||orderkey', 15)}, orderkey) AS i FROM o WHERE mixed)
SELECT orderkey, mixed FROM o WHERE NOT mixed UNION ALL SELECT orderkey, mixed FROM q WHERE i <= (SELECT round_even(count(*)*0.2/(1-0.2),0) FROM o WHERE NOT mixed)""")
def ratio_selection(spark, d):
    o = _table(spark, d, "orders").select(F.col("o_orderkey").alias("orderkey"), (F.col("o_orderkey") % 3 == 0).alias("mixed"))
    return sm.ratio_selection(o, "mixed", "orderkey", 0.2, 2)


@query(f"""WITH g AS (SELECT o_custkey AS key, count(*) AS capacity, {_h(chr(39) + '0:' + chr(39) + '||o_custkey', 15)} AS h FROM orders GROUP BY 1), u AS (SELECT key, h, unnest(range(1, capacity+1)) AS rnd FROM g),
p AS (SELECT key, row_number() OVER (ORDER BY rnd, h, key) AS i FROM u), s AS (SELECT key, count(*) AS share FROM p WHERE i<=1000 GROUP BY key) SELECT g.key, g.capacity, coalesce(s.share,0) AS share FROM g LEFT JOIN s USING (key)""")
def quota_allocation(spark, d):
    return sm.allocate(_table(spark, d, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count("*").alias("capacity")), 1000)


@query(f"""{WR}{PARTICLES}, q AS (SELECT label, n_hits, -ln(({_h(chr(39) + '1:' + chr(39) + '||label', 12)}+1)/281474976710657.0::DOUBLE)/least(n_hits,300) AS k FROM part) SELECT label, n_hits FROM q ORDER BY k, label LIMIT 200""")
def weighted_sample(spark, d):
    return sm.weighted_sample(_particles(spark, d).select("label", "n_hits"), F.least("n_hits", F.lit(300)), "label", 200, 1)


@query(f"""{WR}{LABELS}, q AS (SELECT label, hit_id, count(*) OVER (PARTITION BY label) AS n, ntile(4) OVER (PARTITION BY label ORDER BY fine, hit_id) AS tile, {_h(chr(39) + '0:' + chr(39) + '||hit_id', 15)} AS hh FROM lab WHERE label>=0),
zz AS (SELECT *, row_number() OVER (PARTITION BY label, tile ORDER BY hh, hit_id) AS i FROM q) SELECT label, hit_id FROM zz WHERE n<=4 OR i=1""")
def time_strata(spark, d):
    return sm.time_strata(labelled(spark, d), 4)


@query("WITH q AS (SELECT c_custkey AS custkey, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS i FROM customer) SELECT custkey FROM q WHERE i<=20")
def top_rows(spark, d):
    return _table(spark, d, "customer").orderBy(F.col("c_acctbal").desc(), "c_custkey").limit(20).select(F.col("c_custkey").alias("custkey"))


# ---- edge graphs

_GAP2 = "((b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y))+((b.fine-a.fine)/10.0)*((b.fine-a.fine)/10.0)"


def _near(radius: float) -> str:
    wide = int(-(-radius * 10 // 1))
    return f"(SELECT a.source, a.hit_id AS a, b.hit_id AS b, sqrt({_GAP2}) AS dist FROM (SELECT *, (fine+64)//{wide} AS tb FROM h) a JOIN (SELECT h.*, (fine+64)//{wide}+o.o AS tb FROM h, (VALUES (-1),(0),(1)) o(o)) b ON a.source=b.source AND a.tb=b.tb WHERE a.hit_id<>b.hit_id AND {_GAP2}<={radius * radius}+1e-12)"


def _knn(k: int, radius: float) -> str:
    return f"(SELECT source, a AS src, b AS dst, dist FROM (SELECT *, row_number() OVER (PARTITION BY source, a ORDER BY dist, b) AS i FROM {_near(radius)}) WHERE i<={k})"


_TIME = "(SELECT x.source, x.hit_id AS src, y.hit_id AS dst FROM tt x JOIN (SELECT tt.*, i+o.o AS j FROM tt, (VALUES (-4),(-3),(-2),(-1),(1),(2),(3),(4)) o(o)) y ON x.source=y.source AND x.i=y.j)"
_TT = "tt AS (SELECT source, hit_id, row_number() OVER (PARTITION BY source ORDER BY fine, hit_id) AS i FROM h)"
_PIXEL = "(SELECT a.source, a.hit_id AS src, b.hit_id AS dst FROM h a JOIN h b ON a.source=b.source AND a.x=b.x AND a.y=b.y AND a.hit_id<>b.hit_id AND abs(a.fine-b.fine)<=128)"
_EDGES = f"""{HITS}, {_TT}, u AS (SELECT source, src, dst, 1 AS bit FROM {_knn(12, 3.5)} UNION ALL SELECT source, src, dst, 2 FROM {_knn(8, 7.0)} UNION ALL SELECT source, src, dst, 4 FROM {_TIME} UNION ALL SELECT source, src, dst, 8 FROM {_PIXEL}),
e AS (SELECT source, src, dst, CAST(bit_or(bit) AS INTEGER) AS edge_type FROM u WHERE src<>dst GROUP BY 1, 2, 3)"""


@query(f"{W}{HITS} SELECT source, src, dst, round(dist,6) AS dist FROM {_knn(8, 7.0)}")
def knn_edges(spark, d):
    return sp.knn_edges(hits(spark, d), 8, 7.0).withColumn("dist", F.round("dist", 6))


@query(f"{W}{HITS}, {_TT} SELECT * FROM {_TIME}")
def time_edges(spark, d):
    return sp.time_edges(hits(spark, d))


@query(f"{W}{HITS} SELECT * FROM {_PIXEL}")
def same_pixel_edges(spark, d):
    return sp.same_pixel_edges(hits(spark, d))


@query(f"{W}{_EDGES} SELECT * FROM e")
def multiscale_edges(spark, d):
    return gr.multiscale_edges(hits(spark, d))


@query(f"""{W}{_EDGES} SELECT e.source, src, dst, round((b.x-a.x)/128.0,6) AS dx, round((b.y-a.y)/128.0,6) AS dy, round((b.fine-a.fine)/16.0,6) AS dt, round(sqrt(((b.x-a.x)/128.0)^2+((b.y-a.y)/128.0)^2),6) AS dist_xy,
round(ln(1+b.tot)-ln(1+a.tot),6) AS energy_step, round(least((ln(1+b.tot)+1e-6)/(ln(1+a.tot)+1e-6),10),6) AS energy_ratio, (edge_type&1)::INT AS is_near, ((edge_type>>1)&1)::INT AS is_far, ((edge_type>>2)&1)::INT AS is_time, ((edge_type>>3)&1)::INT AS is_pixel
FROM e JOIN h a ON e.src=a.hit_id JOIN h b ON e.dst=b.hit_id""")
def edge_attributes(spark, d):
    return gr.attributed_edges(hits(spark, d))


_LABELLED_EDGES = f"""{LABELS}, ed AS (SELECT * FROM {_knn(8, 7.0)}), el AS (SELECT ed.source, src, dst, a.label AS src_label, b.label AS dst_label, CASE WHEN a.label<0 OR b.label<0 THEN -1 WHEN a.label=b.label THEN 1 ELSE 0 END AS label FROM ed JOIN lab a ON ed.src=a.hit_id JOIN lab b ON ed.dst=b.hit_id)"""


@query(f"{WR}{_LABELLED_EDGES} SELECT source, src, dst, label FROM el")
def edge_labels(spark, d):
    return gr.edge_labels(sp.knn_edges(hits(spark, d), 8, 7.0), labels(spark, d)).select("source", "src", "dst", "label")


@query(f"""{WR}{_LABELLED_EDGES}, raw AS (SELECT *, CASE WHEN label=1 THEN 1.0::DOUBLE/count(*) FILTER (label=1) OVER (PARTITION BY source, src_label) WHEN label=0 THEN 1.0::DOUBLE/count(*) FILTER (label=0) OVER (PARTITION BY source) ELSE 0 END AS w FROM el)
SELECT source, src, dst, label, round(w*count(*) FILTER (label>=0) OVER (PARTITION BY source)/sum(w) OVER (PARTITION BY source),6) AS weight FROM raw""")
def edge_weights(spark, d):
    return gr.edge_weights(gr.edge_labels(sp.knn_edges(hits(spark, d), 8, 7.0), labels(spark, d)))


@query(f"{WR}{LABELS}, g AS (SELECT source, label, count(*) AS size FROM lab GROUP BY 1, 2), t AS (SELECT source, count(*) AS groups_, sum(size) AS n FROM g GROUP BY 1) SELECT lab.source, hit_id, round(n/(size*groups_)::DOUBLE,6) AS weight FROM lab JOIN g USING (source, label) JOIN t USING (source)")
def object_weights(spark, d):
    return gr.object_weights(labels(spark, d).select("source", "hit_id", "label"))


@query(f"""{W}{HITS}, q AS (SELECT *, row_number() OVER (PARTITION BY source, a ORDER BY dist, b) AS i FROM {_near(4.0)}), g AS (SELECT a, count(*) FILTER (dist<=2.0) AS wi, count(*) AS wo, max(dist) FILTER (i<=4) AS kth FROM q GROUP BY a)
SELECT h.source, h.hit_id, coalesce(wi,0) AS within_inner, coalesce(wo,0) AS within_outer, round(coalesce(kth,0),6) AS kth_distance FROM h LEFT JOIN g ON h.hit_id=g.a""")
def local_density(spark, d):
    return gr.local_density(hits(spark, d))


@query(f"""{W}{HITS} SELECT source, hit_id, round((x-127.5)/128.0,6) AS fx, round((y-127.5)/128.0,6) AS fy, round((fine-min(fine) OVER (PARTITION BY source))/16.0,6) AS ft, round(ln(1+tot)/6.931471805599453,6) AS fe, round(least(greatest(ftoa/30.0,0),4),6) AS ff FROM h""")
def node_features(spark, d):
    return gr.node_features(hits(spark, d))


@query(f"""{WR}{HITS}, nd AS (SELECT source, hit_id, (hit_id%10)/10.0 AS score FROM h), ed AS (SELECT k.source, k.src, k.dst, ((k.src+2*k.dst)%100)/100.0 AS score, sqrt(((b.x-a.x)/128.0)^2+((b.y-a.y)/128.0)^2) AS dist_xy, (b.fine-a.fine)/16.0 AS dt FROM {_knn(4, 5.0)} k JOIN h a ON k.src=a.hit_id JOIN h b ON k.dst=b.hit_id),
act AS (SELECT hit_id FROM nd WHERE score>=0.2), ok AS (SELECT e.src, e.dst FROM ed e LEFT JOIN ed r ON e.src=r.dst AND e.dst=r.src JOIN act x ON e.src=x.hit_id JOIN act y ON e.dst=y.hit_id WHERE (CASE WHEN r.src IS NULL THEN e.score>=0.55 ELSE (e.score+r.score)/2>=0.5 END) AND NOT (e.dist_xy>7/128.0 AND abs(e.dt)>7)),
bi AS (SELECT src AS a, dst AS b FROM ok UNION SELECT dst, src FROM ok), c(n, root) AS (SELECT hit_id, hit_id FROM act UNION SELECT bi.b, c.root FROM c JOIN bi ON c.n=bi.a), k2 AS (SELECT n AS hit_id, min(root) AS label FROM c GROUP BY n)
SELECT nd.source, nd.hit_id, coalesce(k2.label,-1) AS label FROM nd LEFT JOIN k2 USING (hit_id)""")
def edge_components(spark, d):
    h = hits(spark, d)
    nodes = h.select("source", "hit_id", (F.col("hit_id") % 10 / 10.0).alias("score"))
    side = lambda p, k: h.select(F.col("hit_id").alias(k), *(F.col(c).alias(f"{p}_{c}") for c in ("x", "y", "fine")))
    e = sp.knn_edges(h, 4, 5.0).join(side("s", "src"), "src").join(side("t", "dst"), "dst")
    dx, dy = (F.col("t_x") - F.col("s_x")) / 128.0, (F.col("t_y") - F.col("s_y")) / 128.0
    edges = e.select("source", "src", "dst", ((F.col("src") + 2 * F.col("dst")) % 100 / 100.0).alias("score"), F.sqrt(dx * dx + dy * dy).alias("dist_xy"), ((F.col("t_fine") - F.col("s_fine")) / 16.0).alias("dt"))
    return gr.edge_components(spark, nodes, edges, 0.5, 0.2)


@query(f"""{WR}{_LABELLED_EDGES}, s AS (SELECT label, ((src+3*dst)%1000)/1000.0::DOUBLE AS score FROM el WHERE label>=0), kk AS (SELECT unnest(range(1,20)) AS k), g AS (SELECT k, sum(label) FILTER (least(19,floor(score*20+1e-9))>=k)::DOUBLE AS tp, count(*) FILTER (least(19,floor(score*20+1e-9))>=k)::DOUBLE AS chosen, sum(label)::DOUBLE AS pos FROM s, kk GROUP BY k)
SELECT round(k/20.0::DOUBLE,2) AS threshold, round(coalesce(tp/chosen,0),6) AS precision, round(coalesce(tp/pos,0),6) AS recall, round(coalesce(2*tp/(chosen+pos),0),6) AS f1 FROM (SELECT k, coalesce(tp,0) AS tp, nullif(chosen,0) AS chosen, nullif(pos,0) AS pos FROM g)""")
def pr_curve(spark, d):
    from hitweave.operators.metrics import precision_recall_curve

    e = gr.edge_labels(sp.knn_edges(hits(spark, d), 8, 7.0), labels(spark, d))
    return precision_recall_curve(e.select("label", ((F.col("src") + 3 * F.col("dst")) % 1000 / 1000.0).alias("score")))


# ---- geometry, voxels, paths


@query(f"""{WR}{LABELS}, w AS (SELECT label, ln(1+tot)+1e-9 AS w, x::DOUBLE AS x, y::DOUBLE AS y FROM lab WHERE label>=0), g AS (SELECT label, count(*) AS n, sum(w) AS s, sum(w*x)/sum(w) AS cx, sum(w*y)/sum(w) AS cy, sum(w*x*x)/sum(w) AS xx, sum(w*y*y)/sum(w) AS yy, sum(w*x*y)/sum(w) AS xy FROM w GROUP BY label),
m AS (SELECT label, n, cx, cy, CASE WHEN n>1 THEN greatest(xx-cx*cx,0) ELSE 0 END AS vxx, CASE WHEN n>1 THEN greatest(yy-cy*cy,0) ELSE 0 END AS vyy, CASE WHEN n>1 THEN xy-cx*cy ELSE 0 END AS vxy FROM g), rr AS (SELECT *, sqrt((vxx-vyy)^2+4*vxy^2) AS sp FROM m)
SELECT label, n, round(cx,5) AS cx, round(cy,5) AS cy, round(vxx,5) AS vxx, round(vyy,5) AS vyy, round(vxy,5) AS vxy, round(CASE WHEN sp<1e-6 THEN 0 WHEN atan2(2*vxy,vxx-vyy)/2<-1.5707 THEN atan2(2*vxy,vxx-vyy)/2+pi() ELSE atan2(2*vxy,vxx-vyy)/2 END,4) AS theta, round(CASE WHEN sp<1e-6 THEN 0 ELSE sp/(vxx+vyy+1e-9) END,4) AS q_theta FROM rr""")
def weighted_moments(spark, d):
    return gm.weighted_moments(labelled(spark, d))


@query(f"""{WR}{LABELS}, q AS (SELECT label, ln(1+tot) AS e, x, min(x) OVER (PARTITION BY label) AS lo, max(x) OVER (PARTITION BY label) AS hi FROM lab WHERE label>=0), b AS (SELECT label, e, CASE WHEN hi=lo THEN 0 ELSE least(15, floor((x-lo)*16/(hi-lo)))::INT END AS bin FROM q), g AS (SELECT label, bin, sum(e) AS e FROM b GROUP BY 1, 2)
SELECT label, bin, round(e/sum(e) OVER (PARTITION BY label),6) AS share FROM g""")
def longitudinal_profile(spark, d):
    return gm.longitudinal_profile(labelled(spark, d))


@query()
def principal_axes(spark, d):
    return gm.principal_axes(labelled(spark, d)).select("label", "n", *(F.round(c, 3).alias(c) for c in ("linearity", "vx", "vy", "vt")))


@query()
def suspicious_splits(spark, d):
    h = labelled(spark, d)
    return gm.suspicious_splits(pt.particles(hits(spark, d), labels(spark, d)), gm.principal_axes(h))


@query(f"""{WR}{LABELS}, q AS (SELECT label, x, y, fine, row_number() OVER w -1 AS i, count(*) OVER (PARTITION BY label) AS n FROM lab WHERE label>=0 WINDOW w AS (PARTITION BY label ORDER BY fine, y, x, hit_id)), s AS (SELECT DISTINCT label, n, unnest(range(16)) AS step FROM q),
pp AS (SELECT label, step, step*(n-1)/15.0::DOUBLE AS at, least(floor(step*(n-1)/15.0::DOUBLE+1e-9)::BIGINT, n-1) AS i FROM s), zz AS (SELECT pp.label, pp.step, a.x+coalesce((b.x-a.x)*(pp.at-pp.i),0) AS x, a.y+coalesce((b.y-a.y)*(pp.at-pp.i),0) AS y, (a.fine+coalesce((b.fine-a.fine)*(pp.at-pp.i),0))/16.0 AS t FROM pp JOIN q a ON pp.label=a.label AND pp.i=a.i LEFT JOIN q b ON pp.label=b.label AND pp.i+1=b.i)
SELECT label, step::INT AS step, round(x-avg(x) OVER (PARTITION BY label)+1e-7,4) AS x, round(y-avg(y) OVER (PARTITION BY label)+1e-7,4) AS y, round(t-avg(t) OVER (PARTITION BY label)+1e-7,4) AS t FROM zz""")
def resampled_paths(spark, d):
    return gm.resampled_paths(labelled(spark, d), 16)


_GRID = f"""{LABELS}, bx AS (SELECT label, (min(x)+max(x))/2.0 AS mx, (min(y)+max(y))/2.0 AS my, (min(fine)+max(fine))/2.0 AS mf FROM lab WHERE label>=0 GROUP BY label),
v AS (SELECT label, floor((fine-mf)/10.0+16)::INT AS t, floor((y-my)+32)::INT AS v, floor((x-mx)+32)::INT AS u, ln(1+tot)/6.931471805599453 AS e FROM lab JOIN bx USING (label)),
grid AS (SELECT label, (t*64+v)*64+u AS voxel, round(sum(e),6) AS value FROM v WHERE t BETWEEN 0 AND 31 AND v BETWEEN 0 AND 63 AND u BETWEEN 0 AND 63 GROUP BY 1, 2)"""


@query(f"{WR}{_GRID} SELECT * FROM grid")
def energy_grid(spark, d):
    return vx.energy_grid(labelled(spark, d))


@query(f"{WR}{_GRID}, t AS (SELECT label, sum(ln(1+tot)/6.931471805599453) AS total FROM lab WHERE label>=0 GROUP BY label), kk AS (SELECT label, sum(value) AS kept, count(*) AS n FROM grid GROUP BY label) SELECT label, coalesce(n,0) AS n_voxels, round(CASE WHEN total>0 THEN coalesce(kept,0)/total ELSE 1 END,4) AS kept_fraction FROM t LEFT JOIN kk USING (label)")
def grid_coverage(spark, d):
    h = labelled(spark, d)
    return vx.grid_coverage(h, vx.energy_grid(h))


@query(f"{WR}{_GRID} SELECT label, (((voxel//4096)//4*32+(voxel//64)%64//2)*32+voxel%64//2)::INT AS voxel, round(sum(value),6) AS value FROM grid GROUP BY 1, 2")
def voxel_downbin(spark, d):
    return vx.down_bin(vx.energy_grid(labelled(spark, d)))


@query(f"""{WR}{LABELS}, kc AS (SELECT source, x//2 AS cx, y//2 AS cy, CAST(floor(fine/16.0) AS BIGINT) AS ct, tot, label FROM lab), v AS (SELECT source, cx, cy, ct, label, count(*) AS n FROM kc WHERE label>=0 GROUP BY ALL), m AS (SELECT source, cx, cy, ct, arg_min(label, ROW(-n, label)) AS label FROM v GROUP BY ALL)
SELECT s.*, coalesce(m.label,-1) AS label FROM (SELECT source, cx, cy, ct, count(*) AS n_hits, CAST(sum(tot) AS BIGINT) AS tot_sum, round(avg(tot),6) AS tot_mean FROM kc GROUP BY source, cx, cy, ct) s LEFT JOIN m USING (source, cx, cy, ct)""")
def window_voxels(spark, d):
    return vx.window_voxels(labelled(spark, d))


@query(f"""{WR}{PARTICLES}, t AS (SELECT *, source%4<>0 AS train FROM part), m AS (SELECT avg(n_hits) FILTER (train) AS m1, stddev_pop(n_hits) FILTER (train) AS s1, avg(energy_sum) FILTER (train) AS m2, stddev_pop(energy_sum) FILTER (train) AS s2 FROM t)
SELECT label, n_hits, energy_sum, train, round((n_hits-m1)/s1,6) AS z_n_hits, round((energy_sum-m2)/s2,6) AS z_energy_sum FROM t, m""")
def standardised_particles(spark, d):
    p = _particles(spark, d).select("label", "n_hits", "energy_sum", (F.col("source") % 4 != 0).alias("train"))
    return vx.standardised(p, ["n_hits", "energy_sum"], "train")


# ---- embeddings


@query("""WITH q AS (SELECT vec_id, embedding FROM embeddings WHERE vec_id%100=0), p AS (SELECT q.vec_id AS a, e.vec_id AS b, list_distance(list_transform(q.embedding, lambda v: v::DOUBLE), list_transform(e.embedding, lambda v: v::DOUBLE)) AS distance FROM q, embeddings e WHERE q.vec_id<>e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY distance, b) AS rank FROM p) SELECT a, b, round(distance,5) AS distance, rank::INT AS rank FROM r WHERE rank<=10""")
def vector_neighbours(spark, d):
    return em.nearest(_table(spark, d, "embeddings"), 10)


@query("""WITH e AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS d FROM embeddings), m AS (SELECT label, d, avg(v) AS m, avg(v*v) AS q, count(*) AS n FROM e GROUP BY 1, 2)
SELECT label, max(n) AS n, round(sqrt(sum(m*m)),4) AS centroid_norm, round(sqrt(greatest(sum(q)-sum(m*m),0)),4) AS rms FROM m GROUP BY label""")
def vector_group_moments(spark, d):
    return em.group_moments(_table(spark, d, "embeddings"))


@query("""WITH e AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS d FROM embeddings), m AS (SELECT label, d, avg(v) AS m FROM e GROUP BY 1, 2), s AS (SELECT e.label, vec_id, sum((v-m)*(v-m)) AS dd FROM e JOIN m USING (label, d) GROUP BY 1, 2)
SELECT label, arg_min(vec_id, ROW(round(dd,9), vec_id)) AS vec_id, round(sqrt(min(dd)),4) AS distance FROM s GROUP BY label""")
def vector_medoids(spark, d):
    return em.medoids(_table(spark, d, "embeddings"))


@query("""WITH n AS (SELECT unnest(range(6)) AS i), p AS (SELECT a.i AS i, b.i AS j FROM n a, n b WHERE a.i<b.i) SELECT i::INT AS i, j::INT AS j, round(corr(embedding[i+1]::DOUBLE, embedding[j+1]::DOUBLE),5) AS r FROM p, embeddings GROUP BY i, j""")
def vector_correlations(spark, d):
    return em.correlations(_table(spark, d, "embeddings"), 6)


@query("""WITH p AS (SELECT embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), b AS (SELECT min(x)-0.03*(max(x)-min(x)) AS x0, max(x)+0.03*(max(x)-min(x)) AS x1, min(y)-0.03*(max(y)-min(y)) AS y0, max(y)+0.03*(max(y)-min(y)) AS y1 FROM p)
SELECT least(19,floor((x-x0)/(x1-x0)*20))::INT AS bx, least(19,floor((y-y0)/(y1-y0)*20))::INT AS "by", count(*) AS n FROM p, b GROUP BY 1, 2""")
def vector_histogram(spark, d):
    p = _table(spark, d, "embeddings").select(F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y"))
    return em.histogram_2d(p, "x", "y", 20)


@query()
def vector_kmeans(spark, d):
    return em.kmeans(_table(spark, d, "embeddings"), 8)


@query()
def vector_components(spark, d):
    return em.principal_components(_table(spark, d, "embeddings"), 4)


@query()
def vector_pairs(spark, d):
    pairs = em.nearest(_table(spark, d, "embeddings"), 5).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "distance").distinct()
    return spark.createDataFrame(em.disjoint_pairs(written(spark, pairs, "pairs"), 20), "a long, b long, distance double")


# ---- events


@query("SELECT event_type, time_bucket(INTERVAL '1 hour', ts) AS start, count(*) AS n, round(sum(value),4) AS total FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    e = _table(spark, d, "events")
    return e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").alias("start"), "n", "total")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts-lag(ts) OVER w>INTERVAL '30 minutes' THEN 1 ELSE 0 END AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, d):
    e = _table(spark, d, "events")
    return e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n")).select("user_id", "first_ts", "last_ts", "n")


# ---- sets, manifests, scalar functions

_SUPPLIERS = "SELECT s_name AS path, s_suppkey AS size, sha256(s_name) AS sha256 FROM supplier"


@query(f"""WITH a AS ({_SUPPLIERS} WHERE s_suppkey%7<>0), b AS (SELECT path, CASE WHEN size%5=0 THEN size+1 ELSE size END AS size, CASE WHEN size%11=0 THEN '0' ELSE sha256 END AS sha256 FROM ({_SUPPLIERS}) WHERE size%6<>0)
SELECT path, problem FROM (SELECT coalesce(a.path,b.path) AS path, CASE WHEN a.path IS NULL THEN 'missing' WHEN b.path IS NULL THEN 'unexpected' WHEN a.size<>b.size THEN 'size' WHEN a.sha256<>b.sha256 THEN 'sha256' END AS problem FROM a FULL JOIN b ON a.path=b.path) WHERE problem IS NOT NULL""")
def manifest_verify(spark, d):
    s = _table(spark, d, "supplier").select(F.col("s_name").alias("path"), F.col("s_suppkey").alias("size"), F.sha2("s_name", 256).alias("sha256"))
    other = s.where("size % 6 <> 0").select("path", F.when(F.col("size") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"), F.when(F.col("size") % 11 == 0, "0").otherwise(F.col("sha256")).alias("sha256"))
    return verify_manifest(s.where("size % 7 <> 0"), other)


@query(f"WITH s AS ({_SUPPLIERS}) SELECT size%4 AS component, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, sha256(string_agg(path||' '||size||' '||sha256, chr(10) ORDER BY path||' '||size||' '||sha256)) AS tree_sha256 FROM s GROUP BY 1")
def tree_digests(spark, d):
    s = _table(spark, d, "supplier").select((F.col("s_suppkey") % 4).alias("component"), F.col("s_name").alias("path"), F.col("s_suppkey").alias("size"), F.sha2("s_name", 256).alias("sha256"))
    return tree_digest(s)


@query("SELECT r_name AS name, r_regionkey AS region, NULL::BIGINT AS nation FROM region UNION ALL SELECT n_name, NULL, n_nationkey FROM nation")
def key_union(spark, d):
    return union_rows(_table(spark, d, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").cast("long").alias("region")), _table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("nation"))).select("name", "region", "nation")


@query("SELECT c_custkey AS custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def set_difference(spark, d):
    return _table(spark, d, "customer").select(F.col("c_custkey").alias("custkey")).join(_table(spark, d, "orders").select(F.col("o_custkey").alias("custkey")), "custkey", "left_anti")


@query("""SELECT p_partkey AS partkey, CASE WHEN s='' THEN 'unknown' ELSE s END AS slug, CASE WHEN n<1024 THEN n||' B' WHEN n<1048576 THEN printf('%.1f KB', n/1024.0::DOUBLE) WHEN n<1073741824 THEN printf('%.1f MB', n/1048576.0::DOUBLE) ELSE printf('%.1f GB', n/1073741824.0::DOUBLE) END AS size,
CAST(((p_partkey::HUGEINT*2654435761)%4294967296)%12 AS BIGINT) AS slot, coalesce(try_cast(trunc(try_cast(p_type AS DOUBLE)) AS BIGINT), -7) AS number FROM (SELECT *, regexp_replace(regexp_replace(lower(p_name),'[^a-z0-9]+','_','g'),'^_+|_+$','','g') AS s, p_partkey*p_partkey*300 AS n FROM part)""")
def scalar_functions(spark, d):
    p = _table(spark, d, "part")
    k = F.col("p_partkey")
    return p.select(k.alias("partkey"), fn.slug(F.col("p_name")).alias("slug"), fn.human_bytes(k * k * 300).alias("size"), fn.label_slot(k, 12).alias("slot"), fn.int_or(F.col("p_type"), -7).alias("number"))


# ---- parameters and parity


@query(f"{WR}{LABELS} SELECT hit_id, label FROM lab")
def windowed_labels(spark, d):
    from hitweave.operators.cluster import windowed_dbscan

    return windowed_dbscan(spark, hits(spark, d), size=1024, overlap=256).select("hit_id", "label")


@query()
def parameter_stability(spark, d):
    from hitweave.operators.tuning import stability

    return stability(spark, hits(spark, d))


@query()
def parameter_grid(spark, d):
    from hitweave.operators.tuning import EPS_GRID, MIN_SAMPLES_GRID, TIME_SCALE_GRID, grid_scores

    return grid_scores(spark, hits(spark, d), EPS_GRID, MIN_SAMPLES_GRID, TIME_SCALE_GRID)


@query(f"{WR}{PARTICLES} SELECT source, count(*) AS n, round(avg(n_hits),6) AS mean, round(quantile_cont(n_hits,0.1),6) AS p10, round(quantile_cont(n_hits,0.5),6) AS p50, round(quantile_cont(n_hits,0.9),6) AS p90, round(max(n_hits)::DOUBLE,6) AS max FROM part GROUP BY source")
def size_summary(spark, d):
    from hitweave.operators.tuning import summary

    return summary(_particles(spark, d).withColumn("n_hits", F.col("n_hits").cast("double")), "n_hits", "source")


@query("SELECT least(a,b) AS a, greatest(a,b) AS b, count(*) AS seen FROM (SELECT o_custkey%50 AS a, o_orderkey%50 AS b FROM orders) WHERE a<>b GROUP BY 1, 2")
def unordered_pairs(spark, d):
    o = _table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("a"), (F.col("o_orderkey") % 50).alias("b")).where("a <> b")
    return o.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("seen"))
