"""Queries over candidates, clusterings of vectors and their quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from hitweave.operators import candidates as cd
from hitweave.operators import learning as ln
from hitweave.plans.proxy import HITS, hits, query
from hitweave.session import written

W, WR = "WITH ", "WITH RECURSIVE "


def _vectors(spark, d):
    return spark.read.parquet(f"{d}/embeddings.parquet")


def _points(spark, d):
    return hits(spark, d).select(F.col("order_id").alias("candidate"), F.col("hit_id").alias("point"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), (F.col("fine") / 16.0).alias("t"), F.log1p("tot").alias("energy"))


def _candidate_sql(distance: str) -> str:
    return f"""{WR}{HITS}, pr AS (SELECT a.order_id AS o, a.hit_id AS a, b.hit_id AS b FROM h a JOIN h b ON a.order_id=b.order_id AND a.hit_id<>b.hit_id AND {distance}<=2.25+1e-12), core AS (SELECT a AS id FROM pr GROUP BY a HAVING count(*)>=2),
lk AS (SELECT pr.a, pr.b FROM pr JOIN core c1 ON pr.a=c1.id JOIN core c2 ON pr.b=c2.id), cc(n, root) AS (SELECT id, id FROM core UNION SELECT lk.b, cc.root FROM cc JOIN lk ON cc.n=lk.a), rt AS (SELECT n AS id, min(root) AS root FROM cc GROUP BY n),
bd AS (SELECT pr.a AS id, arg_min(rt.root, pr.b) AS root FROM pr JOIN rt ON pr.b=rt.id WHERE pr.a NOT IN (SELECT id FROM core) GROUP BY pr.a), al AS (SELECT * FROM rt UNION ALL SELECT * FROM bd)
SELECT h.order_id AS candidate, h.hit_id AS point, CASE WHEN al.root IS NULL THEN -1 ELSE dense_rank() OVER (PARTITION BY h.order_id, al.root IS NULL ORDER BY al.root)-1 END AS label FROM h LEFT JOIN al ON h.hit_id=al.id"""


@query(_candidate_sql("(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)"))
def candidate_labels_xy(spark, d):
    return cd.candidate_labels(_points(spark, d), mode="xy").select("candidate", "point", "label")


@query(_candidate_sql("(a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)+((a.fine-b.fine)/16.0)*((a.fine-b.fine)/16.0)"))
def candidate_labels_xyt(spark, d):
    return cd.candidate_labels(_points(spark, d), mode="xyt").select("candidate", "point", "label")


@query()
def candidate_labels_xyte(spark, d):
    return cd.candidate_labels(_points(spark, d), mode="xyte").select("candidate", "point", "label")


@query()
def bootstrap_candidates(spark, d):
    return cd.bootstrap_candidates(hits(spark, d).select(F.col("order_id").alias("frame"), "x", "y", F.col("tot").cast("double").alias("energy"))).groupBy("candidate").agg(F.count("*").alias("n_hits"), F.round(F.sum("energy"), 4).alias("energy"))


_V = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), pr AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id<>b.vec_id AND list_sum(list_transform(list_zip(a.e,b.e), lambda z: (z[1]-z[2])*(z[1]-z[2])))<=1.44+1e-12)"


@query(f"""{WR}{_V}, core AS (SELECT a AS id FROM pr GROUP BY a HAVING count(*)>=2), lk AS (SELECT pr.a, pr.b FROM pr JOIN core c1 ON pr.a=c1.id JOIN core c2 ON pr.b=c2.id), cc(n, root) AS (SELECT id, id FROM core UNION SELECT lk.b, cc.root FROM cc JOIN lk ON cc.n=lk.a),
rt AS (SELECT n AS id, min(root) AS root FROM cc GROUP BY n), bd AS (SELECT pr.a AS id, arg_min(rt.root, pr.b) AS root FROM pr JOIN rt ON pr.b=rt.id WHERE pr.a NOT IN (SELECT id FROM core) GROUP BY pr.a), al AS (SELECT * FROM rt UNION ALL SELECT * FROM bd)
SELECT vec_id, coalesce(al.root,-1) AS label FROM v LEFT JOIN al ON v.vec_id=al.id""")
def descriptor_labels(spark, d):
    return cd.descriptor_labels(_vectors(spark, d), 1.2)


@query()
def vector_mixture(spark, d):
    return ln.gaussian_mixture(_vectors(spark, d), 8)


@query()
def vector_clusterings(spark, d):
    found = ln.cluster_embeddings(_vectors(spark, d), (8, 12))
    out = None
    for name, labels in found.items():
        part = ln.cluster_counts(labels).select(F.lit(name).alias("method"), "cluster", "n")
        out = part if out is None else out.unionByName(part)
    return out


_QUALITY = """WITH e AS (SELECT vec_id, label, unnest(embedding::DOUBLE[]) AS v, generate_subscripts(embedding, 1) AS d FROM embeddings), c AS (SELECT label, d, avg(v) AS m, count(*) AS n FROM e GROUP BY label, d), g AS (SELECT d, avg(v) AS m FROM e GROUP BY d),
x AS (SELECT e.label, e.vec_id, sum((v-m)*(v-m)) AS q FROM e JOIN c ON e.label=c.label AND e.d=c.d GROUP BY 1, 2), s AS (SELECT label, sum(q) AS within, avg(sqrt(q)) AS radius, count(*) AS n FROM x GROUP BY label),
b AS (SELECT c.label, sum((c.m-g.m)*(c.m-g.m)) AS q FROM c JOIN g ON c.d=g.d GROUP BY c.label), ap AS (SELECT a.label AS a, z.label AS z, sqrt(sum((a.m-z.m)*(a.m-z.m))) AS dist FROM c a JOIN c z ON a.d=z.d AND a.label<>z.label GROUP BY 1, 2),
db AS (SELECT avg(r) AS db FROM (SELECT a, max((u.radius+w.radius)/dist) AS r FROM ap JOIN s u ON a=u.label JOIN s w ON z=w.label GROUP BY a))
SELECT CAST(sum(n) AS BIGINT) AS n_items, count(*) AS n_clusters, 0.0::DOUBLE AS noise_fraction, round(any_value(db),4) AS davies_bouldin, round(sum(n*b.q)*(sum(n)-count(*))/(sum(within)*(count(*)-1)),4) AS calinski_harabasz FROM s JOIN b ON s.label=b.label, db"""


@query(_QUALITY)
def vector_quality(spark, d):
    v = _vectors(spark, d)
    return ln.quality(v, v.select("vec_id", F.col("label").cast("long").alias("cluster"))).select("n_items", "n_clusters", "noise_fraction", F.round("davies_bouldin", 4).alias("davies_bouldin"), F.round("calinski_harabasz", 4).alias("calinski_harabasz"))


@query()
def vector_size_sweep(spark, d):
    return ln.size_sweep(_vectors(spark, d))


@query()
def vector_scores(spark, d):
    v = _vectors(spark, d)
    return ln.pca_scores(v, ln.pca_model(v, 4)).select("vec_id", F.transform("scores", lambda x: F.round(x, 4)).alias("scores"), F.round("error", 4).alias("error"))


@query()
def comparable_vectors(spark, d):
    v = _vectors(spark, d).withColumn("size", F.col("vec_id") % 13 + 1)
    return ln.neighbour_pairs(v, 8, "label", "size")


@query()
def balanced_batches(spark, d):
    return ln.balanced_batches(written(spark, _vectors(spark, d).select("vec_id", "label"), "keys"), "label", "vec_id", 64, 10)
