"""Streaming forms: sessions of hits closed by a watermark, tumbling and sliding windows, marker gaps, and clustering of closed sessions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitweave.operators.cluster import slab_labels


def as_timestamp(fine: Column) -> Column:
    """A sixteenth of a tick is one microsecond of event time, so that session gaps are exact."""
    return F.timestamp_micros(fine.cast("bigint"))


def live_sessions(hits: DataFrame, gap: int = 50, late: str = "1 millisecond") -> DataFrame:
    """Sessions of a stream (source, hit_id, x, y, fine, ...): hits at most `gap` sixteenths apart; emitted once the watermark passes."""
    timed = hits.withColumn("ts", as_timestamp(F.col("fine"))).withWatermark("ts", late)
    return timed.groupBy("source", F.session_window("ts", f"{gap} microseconds").alias("w")).agg(F.count("*").alias("n_hits"), F.min("fine").alias("first_fine"), F.max("fine").alias("last_fine"), F.collect_list(F.struct("hit_id", "x", "y", "fine")).alias("hits"))


def live_clusters(hits: DataFrame, eps: float = 5.0, min_samples: int = 2, time_scale: float = 0.625, late: str = "1 millisecond") -> DataFrame:
    """(source, hit_id, label) of a stream: no cluster crosses a gap over eps, so each closed session is clustered by itself, exactly."""
    unit = 16.0 * time_scale
    closed = live_sessions(hits, int(eps * unit), late).select("source", "hits")

    def run(batches):
        for pdf in batches:
            out = []
            for source, rows in zip(pdf["source"], pdf["hits"]):
                part = pd.DataFrame([dict(r) if isinstance(r, dict) else r.asDict() for r in rows])
                part["source"], part["own"] = source, True
                got = slab_labels(part, eps, unit, min_samples)
                out.append(pd.DataFrame({"source": got["source"], "hit_id": got["hit_id"], "label": got["root"]}))
            yield pd.concat(out) if out else pd.DataFrame({"source": [], "hit_id": [], "label": []}).astype("int64")

    return closed.mapInPandas(run, "source long, hit_id long, label long")


def live_windows(events: DataFrame, time: str, by: str, value: str, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by tumbling or sliding windows of event time."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, to a Parquet table, with exactly-once commits."""
    df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
