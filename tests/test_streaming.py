"""Streams give what the batch operators give, for sessions that the watermark has closed."""

from pyspark.sql import functions as F

from hitweave.operators import cluster as cl
from hitweave.plans.proxy import hits
from hitweave.streaming import live


def test_live_clusters_equal_batch(spark, tmp_path):
    batch = hits(spark, "/root/testdata/sf0.001").select("source", "hit_id", "x", "y", "fine")
    last = batch.agg(F.max("fine")).first()[0]
    far = spark.createDataFrame([(s, -s - 1, 0, 0, last + 10_000_000) for s in range(3)], batch.schema)
    batch.unionByName(far).repartition(1).sortWithinPartitions("fine").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    live.run_once(live.live_clusters(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {r["hit_id"]: r["label"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["hit_id"]: r["label"] for r in cl.dbscan(spark, batch).collect()}
    assert got == want


def test_live_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = live.live_windows(stream, "ts", "event_type", "value", "1 hour").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("SELECT sum(n) FROM w").first()[0] == events.count()
