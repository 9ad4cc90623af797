"""Queries over manifests and reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from hitweave.operators import manifests as mf
from hitweave.operators import particles as pt
from hitweave.operators import sampling as sm
from hitweave.operators.geometry import near_particles
from hitweave.operators.order import ranked
from hitweave.plans.hit_queries import _NOISE, _particles
from hitweave.plans.proxy import HITS, LABELS, PARTICLES, ROWS, hits, labelled, labels, query, rows

W, WR = "WITH ", "WITH RECURSIVE "
_h = lambda key, digits=15: f"('0x'||substr(sha1({key}),1,{digits}))::BIGINT"


_INDEX = "idx AS (SELECT source, 'f'||source AS path, CASE WHEN source%4=3 THEN '.txt' ELSE '.t3pa' END AS extension, CASE WHEN source%5=0 THEN 'n/a' ELSE CAST(count(*) AS VARCHAR) END AS rows FROM r GROUP BY source)"


def _index(spark, d):
    s = F.col("source")
    return rows(spark, d).groupBy("source").agg(F.count("*").alias("n")).select("source", F.concat(F.lit("f"), s.cast("string")).alias("path"), F.when(s % 4 == 3, ".txt").otherwise(".t3pa").alias("extension"), F.when(s % 5 == 0, "n/a").otherwise(F.col("n").cast("string")).alias("rows"))


@query(f"{W}{ROWS}, {_INDEX} SELECT source, path, extension, rows FROM idx WHERE extension='.t3pa' AND coalesce(try_cast(rows AS BIGINT),0)>0")
def indexed_files(spark, d):
    return mf.indexed_files(_index(spark, d))


_MANIFEST = f"""{_NOISE}, man AS (SELECT 'f'||source||'.npz' AS path, source, CASE source%7 WHEN 0 THEN 'error' WHEN 1 THEN NULL WHEN 2 THEN '' ELSE 'ok' END AS status, CASE WHEN {_h("'0:'||source", 8)}/4294967295.0::DOUBLE<0.1 THEN 'test'
WHEN {_h("'0:'||source", 8)}/4294967295.0::DOUBLE<0.2 THEN 'validation' ELSE 'train' END AS split, n_hits, n_particles, noise_fraction, CASE WHEN source%9=4 THEN 'long_particles=1;suspicious_merged_clusters=2' WHEN source%9=5 THEN 'high_noise' END AS warnings FROM noise)"""


def _manifest(spark, d):
    s = F.col("source")
    return pt.noise_summary(labels(spark, d)).select(
        F.concat(F.lit("f"), s.cast("string"), F.lit(".npz")).alias("path"), "source", F.when(s % 7 == 0, "error").when(s % 7 == 1, None).when(s % 7 == 2, "").otherwise("ok").alias("status"), sm.group_split(s, 0).alias("split"), "n_hits", "n_particles", "noise_fraction",
        F.when(s % 9 == 4, "long_particles=1;suspicious_merged_clusters=2").when(s % 9 == 5, "high_noise").alias("warnings"),
    )


@query(f"{WR}{LABELS}, {_MANIFEST} SELECT path, source, status FROM man WHERE (status IS NULL OR status IN ('','ok')) AND source%11<>3")
def discovered_shards(spark, d):
    m = _manifest(spark, d)
    return mf.discovered_shards(m.select("path", "source", "status"), m.where("source % 11 <> 3").select("path"))


@query(f"{WR}{LABELS}, {_MANIFEST} SELECT path, n_hits FROM man WHERE status='ok' AND split='train' ORDER BY {_h(chr(39) + '0:' + chr(39) + '||path')}, path LIMIT 5")
def manifest_sample(spark, d):
    return mf.manifest_rows(_manifest(spark, d), "train", 5).select("path", "n_hits")


@query(f"{WR}{LABELS}, {_MANIFEST} SELECT path, n_hits, n_particles FROM man WHERE NOT (n_particles<2 AND n_hits>=256) AND coalesce(warnings,'') NOT LIKE '%suspicious_merged_clusters%'")
def trusted_shards(spark, d):
    return mf.trusted(_manifest(spark, d)).select("path", "n_hits", "n_particles")


@query(f"{WR}{PARTICLES} SELECT source, label, n_hits FROM part WHERE n_hits BETWEEN 3 AND 64")
def particle_templates(spark, d):
    return _particles(spark, d).where("n_hits between 3 and 64").select("source", "label", "n_hits")


@query(f"{W}{HITS}, z AS (SELECT source, hit_id, CAST(round_even((fine-min(fine) OVER (PARTITION BY source))/16.0*16.0,0) AS BIGINT) AS z_fine FROM h) SELECT * FROM z WHERE z_fine>=4000 AND z_fine<12000")
def hits_of_time_slab(spark, d):
    return mf.time_slab(hits(spark, d), 4000, 12000).select("source", "hit_id", "z_fine")


@query(f"{W}{HITS} SELECT source, hit_id, x, y, round((toa-min(toa) OVER (PARTITION BY source))/1e6,9) AS coarse, round(ln(1+tot),6) AS energy FROM h")
def hits_coarse_time(spark, d):
    h = hits(spark, d)
    return h.join(h.groupBy("source").agg(F.min("toa").alias("t0")), "source").select("source", "hit_id", "x", "y", F.round((F.col("toa") - F.col("t0")) / 1e6, 9).alias("coarse"), F.round(pt.log_energy(F.col("tot")), 6).alias("energy"))


_NEAR = """q AS (SELECT a.source, a.label AS a, b.label AS b, a.n_hits AS a_hits, b.n_hits AS b_hits, a.energy_sum AS a_energy, b.energy_sum AS b_energy, greatest(b.min_x-a.max_x,a.min_x-b.max_x,0) AS gx, greatest(b.min_y-a.max_y,a.min_y-b.max_y,0) AS gy, greatest(b.first_fine-a.last_fine,a.first_fine-b.last_fine,0)/10.0 AS gt
FROM part a JOIN part b ON a.source=b.source AND a.label<b.label), near AS (SELECT * FROM q WHERE gx*gx+gy*gy+gt*gt<=6.25*6.25+1e-12)"""


@query(f"{WR}{PARTICLES}, {_NEAR} SELECT source, a, b FROM near WHERE greatest(a_hits,b_hits)/greatest(least(a_hits,b_hits),1e-9)<=2 AND greatest(a_energy,b_energy)/greatest(least(a_energy,b_energy),1e-9)<=1.5")
def comparable_pairs(spark, d):
    p = _particles(spark, d)
    side = lambda k: p.select(F.col("label").alias(k), F.col("n_hits").alias(f"{k}_hits"), F.col("energy_sum").alias(f"{k}_energy"))
    return mf.comparable(near_particles(p, 6.25).join(side("a"), "a").join(side("b"), "b"), 2.0, 1.5).select("source", "a", "b")


@query(f"""{WR}{PARTICLES}, {_NEAR}, dist AS (SELECT near.source, a, b, min((u.x-v.x)*(u.x-v.x)+(u.y-v.y)*(u.y-v.y)+((u.fine-v.fine)/10.0)*((u.fine-v.fine)/10.0)) AS s FROM near JOIN lab u ON u.label=a JOIN lab v ON v.label=b GROUP BY 1, 2, 3)
SELECT source, a, b, CASE WHEN s<=100+1e-12 THEN round(sqrt(s),6) END AS closest FROM dist""")
def closest_hits(spark, d):
    return mf.closest(labelled(spark, d), near_particles(_particles(spark, d), 6.25), 10.0)


@query(f"{WR}{LABELS}, {_NOISE} SELECT source FROM noise WHERE noise_fraction<=0.3 AND n_particles>=100")
def passing_sources(spark, d):
    return mf.passing(pt.noise_summary(labels(spark, d)), {"noise_fraction": ("<=", 0.3), "n_particles": (">=", 100)}).select("source")


_TUMBLE = "win AS (SELECT source, CAST(floor(fine/4000.0) AS BIGINT) AS bucket, count(*) AS n_hits, count(DISTINCT CASE WHEN label>=0 THEN label END) AS n_particles, avg(CASE WHEN label<0 THEN 1.0::DOUBLE ELSE 0.0 END) AS noise FROM lab GROUP BY 1, 2), winid AS (SELECT *, source*1000000+bucket AS id FROM win)"


def _windows(spark, d):
    return labelled(spark, d).groupBy("source", F.floor(F.col("fine") / 4000).alias("bucket")).agg(F.count("*").alias("n_hits"), F.count_distinct(F.when(F.col("label") >= 0, F.col("label"))).alias("n_particles"), F.avg(F.when(F.col("label") < 0, 1.0).otherwise(0.0)).alias("noise")).withColumn("id", F.col("source") * 1_000_000 + F.col("bucket"))


@query(f"""{WR}{LABELS}, {_TUMBLE}, cv AS (SELECT *, row_number() OVER (ORDER BY n_particles DESC, n_hits DESC, id)-1 AS i FROM winid WHERE n_hits>=50 AND n_particles>=2 AND noise<0.85), tv AS (SELECT count(*) AS n FROM cv)
SELECT id, n_hits, n_particles FROM cv, tv WHERE n<=4 OR i IN (SELECT CAST(floor(kk*least(n-1,32)/3.0) AS BIGINT) FROM range(4) rr(kk), tv)""")
def visual_windows(spark, d):
    w = _windows(spark, d).where("n_hits >= 50 and n_particles >= 2 and noise < 0.85")
    return mf.spread_picks(w, [F.col("n_particles"), F.col("n_hits")], "id", 4).select("id", "n_hits", "n_particles")


@query(f"{WR}{LABELS}, {_MANIFEST} SELECT split, count(*) AS rows, count(DISTINCT source) AS n_source, CAST(sum(n_hits) AS BIGINT) AS sum_n_hits, CAST(sum(n_particles) AS BIGINT) AS sum_n_particles, round(avg(noise_fraction),6) AS mean_noise_fraction FROM man WHERE status='ok' GROUP BY split")
def manifest_summary(spark, d):
    return mf.summary(_manifest(spark, d), "split", ["source"], ["n_hits", "n_particles"], ["noise_fraction"])


@query(f"""{WR}{PARTICLES}, {_NOISE}, j AS (SELECT part.*, noise.n_hits AS rows_, noise.noise_fraction AS nf FROM part JOIN noise USING (source)), g AS (SELECT source, count(*) AS n_particles, max(n_hits) AS max_hits, round(max(n_hits/rows_),6) AS lf, count(*) FILTER ((last_fine-first_fine)/16.0>3) AS n_long,
count(*) FILTER ((max_x-min_x>=255 AND max_y-min_y>=255) OR n_hits>=greatest(1,floor(rows_*0.5))) AS n_wide, any_value(nf) AS nf FROM j GROUP BY source)
SELECT count(*) AS shards, CAST(sum(n_particles) AS BIGINT) AS particles, count(*) FILTER (n_long>0 OR n_wide>0 OR nf>0.25 OR nf<0.001) AS with_warnings, max(max_hits) AS max_hits, round(max(lf),6) AS largest_fraction, round(avg(nf),6) AS mean_noise, CAST(sum(n_long) AS BIGINT) AS long_particles FROM g""")
def audit_totals(spark, d):
    return mf.audit_summary(pt.shard_audit(_particles(spark, d), pt.noise_summary(labels(spark, d)), long_ticks=3.0))


@query("SELECT o_orderpriority AS stage, round(avg(o_totalprice) FILTER (o_orderstatus='F'),6) AS \"F\", round(avg(o_totalprice) FILTER (o_orderstatus='O'),6) AS \"O\", round(avg(o_totalprice) FILTER (o_orderstatus='P'),6) AS \"P\" FROM orders GROUP BY 1")
def metric_pivot(spark, d):
    long = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_orderpriority").alias("stage"), F.col("o_orderstatus").alias("set")).agg(F.avg("o_totalprice").alias("v"))
    return mf.wide(long, "stage", "set", ["F", "O", "P"], "v")


_RUNS = "runs AS (SELECT source, CASE source%3 WHEN 0 THEN 'grid' WHEN 1 THEN 'pairs' ELSE 'linker' END AS backend, CASE WHEN source%8=7 THEN 'failed' ELSE 'ok' END AS status, n_hits AS hits, n_particles AS particles, (n_hits%97+1)/100.0::DOUBLE AS seconds, CASE WHEN source%3<>2 THEN 1.0-noise_fraction END AS ari FROM noise)"


def _runs(spark, d):
    s = F.col("source")
    return pt.noise_summary(labels(spark, d)).select("source", F.when(s % 3 == 0, "grid").when(s % 3 == 1, "pairs").otherwise("linker").alias("backend"), F.when(s % 8 == 7, "failed").otherwise("ok").alias("status"), F.col("n_hits").alias("hits"), F.col("n_particles").alias("particles"), ((F.col("n_hits") % 97 + 1) / 100.0).alias("seconds"), F.when(s % 3 != 2, 1.0 - F.col("noise_fraction")).alias("ari"))


@query(f"""{WR}{LABELS}, {_NOISE}, {_RUNS} SELECT backend, count(*) FILTER (status='ok') AS cases, CAST(coalesce(sum(hits) FILTER (status='ok'),0) AS BIGINT) AS total_hits, round(coalesce(sum(seconds) FILTER (status='ok'),0.0),6) AS total_seconds,
round(coalesce(sum(hits) FILTER (status='ok')/sum(seconds) FILTER (status='ok'),0.0),4) AS hits_per_second, round(min(ari),6) AS min_ari FROM runs GROUP BY backend""")
def throughput(spark, d):
    return mf.throughput(_runs(spark, d))


@query(f"{W}{HITS} SELECT source, round((max(fine)-min(fine))/16.0*25.0*1e-9,12) AS seconds FROM h GROUP BY source")
def physical_span(spark, d):
    return mf.physical_span(hits(spark, d))


@query(f"""{WR}{LABELS}, {_NOISE}, {_RUNS}, fl AS (SELECT source, count(*) AS rows FROM r GROUP BY source), cs AS (SELECT 'largest' AS "case", arg_max(source, ROW(rows, -source)) AS source FROM fl UNION ALL SELECT 'slowest_per_hit', arg_min(source, ROW(hits/seconds, source)) FROM runs WHERE hits>1000
UNION ALL SELECT 'max_particles', arg_max(source, ROW(particles, -source)) FROM runs) SELECT "case", cs.source, fl.rows FROM cs JOIN fl ON cs.source=fl.source""")
def benchmark_cases(spark, d):
    return mf.cases(rows(spark, d).groupBy("source").agg(F.count("*").alias("rows")), _runs(spark, d))


@query(f"""{WR}{LABELS}, {_NOISE}, {_RUNS}, fl AS (SELECT source, count(*) AS rows FROM r GROUP BY source) SELECT runs.source, backend, rows, round(seconds/((max(fine)-min(fine))/16.0*25.0*1e-9),4) AS real_time_ratio FROM runs JOIN fl ON runs.source=fl.source JOIN h ON h.source=runs.source GROUP BY runs.source, backend, rows, seconds""")
def benchmark_reference(spark, d):
    spans = hits(spark, d).groupBy("source").agg(((F.max("fine") - F.min("fine")) / 16.0 * 25.0 * 1e-9).alias("span"))
    files = rows(spark, d).groupBy("source").agg(F.count("*").alias("rows"))
    return _runs(spark, d).join(files, "source").join(spans, "source").select("source", "backend", "rows", F.round(F.col("seconds") / F.col("span"), 4).alias("real_time_ratio"))


@query(f"""{WR}{PARTICLES}, m AS (SELECT 'n_hits' AS measure, n_hits::DOUBLE AS v FROM part UNION ALL SELECT 'span', (last_fine-first_fine)::DOUBLE FROM part UNION ALL SELECT 'width', (max_x-min_x)::DOUBLE FROM part)
SELECT measure, round(avg(v),6) AS mean, round(quantile_cont(v,0.5),6) AS p50, round(quantile_cont(v,0.95),6) AS p95, round(max(v),6) AS "max" FROM m GROUP BY measure""")
def manifest_diagnostics(spark, d):
    p = _particles(spark, d).select("n_hits", (F.col("last_fine") - F.col("first_fine")).alias("span"), (F.col("max_x") - F.col("min_x")).alias("width"))
    return mf.diagnostics(p, ["n_hits", "span", "width"])


@query("SELECT o_orderstatus AS status, count(*) AS n, count(DISTINCT o_custkey) AS customers, round(min(o_totalprice),4) AS least, round(max(o_totalprice),4) AS greatest, round(avg(o_totalprice),4) AS mean, round(median(o_totalprice),4) AS median FROM orders GROUP BY 1")
def sample_summary(spark, d):
    r = lambda c, name: F.round(c, 4).alias(name)
    return spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"), r(F.min("o_totalprice"), "least"), r(F.max("o_totalprice"), "greatest"), r(F.avg("o_totalprice"), "mean"), r(F.percentile("o_totalprice", F.lit(0.5)), "median"))


@query(f"{WR}{LABELS} SELECT label, x, y, fine AS z, count(*) AS n_hits, round(sum(ln(1+tot)),6) AS energy_sum, round(avg(ln(1+tot)),6) AS energy_mean FROM lab WHERE label>=0 GROUP BY label, x, y, fine")
def particle_voxels(spark, d):
    return mf.particle_voxels(labelled(spark, d))


@query(f"SELECT o_orderkey AS orderkey, o_orderstatus AS status FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_h(chr(39) + '4:' + chr(39) + '||o_orderkey')}, o_orderkey) AS i FROM orders) WHERE i<=7")
def samples_per_group(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("orderkey"), F.col("o_orderstatus").alias("status"))
    return mf.per_group(o, "status", "orderkey", 7, 4)


_U = _h("'0:'||id", 8) + "/4294967295.0::DOUBLE"


@query(f"{WR}{LABELS}, {_TUMBLE} SELECT id, CASE WHEN {_U}<0.1 THEN 'test' WHEN {_U}<0.2 THEN 'validation' ELSE 'train' END AS split FROM winid")
def window_splits(spark, d):
    return _windows(spark, d).select("id", mf.window_split(F.col("source"), F.col("id"), "random-window").alias("split"))


@query(f"{WR}{LABELS}, {_TUMBLE}, pk AS (SELECT id, row_number() OVER (ORDER BY source, bucket)-1 AS pos, count(*) OVER () AS n FROM winid) SELECT id FROM pk WHERE pos IN (SELECT CAST(floor(kk*(n-1)/6.0) AS BIGINT) FROM range(7) rr(kk), (SELECT max(n) AS n FROM pk))")
def evaluation_picks(spark, d):
    w = ranked(_windows(spark, d).select("id", "source", "bucket", F.lit(0).alias("all")), "all", ("source", "bucket"), F.col("source"))
    return mf.even_places(w, w.count(), 7).select("id")


@query(f"""{WR}{PARTICLES}, ms AS (SELECT label, 'energy_sum' AS measure, energy_sum::DOUBLE AS v FROM part UNION ALL SELECT label, 'n_hits', n_hits::DOUBLE FROM part), mk AS (SELECT measure, q, quantile_cont(v, q) AS mark FROM ms, (VALUES (0.005::DOUBLE),(0.5),(0.995)) tq(q) GROUP BY measure, q)
SELECT ms.measure, q, arg_min(label, ROW(round(abs(v-mark),9), label)) AS label FROM ms JOIN mk ON ms.measure=mk.measure GROUP BY ms.measure, q""".replace("quantile_cont(v, q)", "CASE q WHEN 0.005 THEN quantile_cont(v,0.005) WHEN 0.5 THEN quantile_cont(v,0.5) ELSE quantile_cont(v,0.995) END"))
def representative_particles(spark, d):
    return mf.representatives(_particles(spark, d), "label", ["energy_sum", "n_hits"])


@query(f"{WR}{LABELS}, {_NOISE} SELECT source, noise_fraction FROM noise ORDER BY noise_fraction DESC, source LIMIT 3")
def worst_sources(spark, d):
    return pt.noise_summary(labels(spark, d)).select("source", "noise_fraction").orderBy(F.col("noise_fraction").desc(), "source").limit(3)


@query()
def windows_apart(spark, d):
    w = labelled(spark, d).withColumn("k", F.explode(F.array(F.floor(F.col("fine") / 1000), F.floor(F.col("fine") / 1000) - 1))).groupBy("source", "k").agg(F.count("*").alias("n_hits")).select("source", (F.col("k") * 1000).alias("start"), (F.col("k") * 1000 + 2000).alias("end"), "n_hits")
    return mf.apart(w, "source", "start", "end", "n_hits", 4, 500)


@query(f"{WR}{PARTICLES}, ck AS (SELECT label, n_hits, 'chunk'||(label//1000000007)%5 AS chunk_path, label AS chunk_row FROM part) SELECT a.label, a.chunk_path, a.n_hits, b.energy_sum FROM ck a JOIN part b ON a.chunk_row=b.label")
def chunk_rows(spark, d):
    p = _particles(spark, d)
    at = F.concat(F.lit("chunk"), (F.expr("label div 1000000007") % 5).cast("string"))
    manifest = p.select("label", "n_hits", at.alias("chunk_path"), F.col("label").alias("chunk_row"))
    return mf.probe_chunks(manifest, p.select(at.alias("chunk_path"), F.col("label").alias("chunk_row"), "energy_sum")).select("label", "chunk_path", "n_hits", "energy_sum")
