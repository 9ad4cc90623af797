"""Manifests and reports: which files and rows are taken, summaries over them, and ranked or spread picks of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitweave.operators.sampling import stable_int


def indexed_files(index: DataFrame, extension: str = ".t3pa") -> DataFrame:
    """Index rows of one extension that hold rows; a count that is no number is 0."""
    return index.where((F.col("extension") == extension) & (F.coalesce(F.expr("try_cast(rows AS BIGINT)"), F.lit(0)) > 0))


def discovered_shards(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Manifest rows that aren't marked as failed and whose file is in the listing; all of the listing where the manifest has no row."""
    fine = manifest.where(F.col("status").isNull() | F.col("status").isin("", "ok")).join(listing.select("path"), "path", "left_semi")
    none = manifest.limit(1).agg((F.count("*") == 0).alias("_none"))
    bare = listing.join(F.broadcast(none)).where("_none").select(*(F.col(c) if c in listing.columns else F.lit(None).cast(manifest.schema[c].dataType).alias(c) for c in manifest.columns))
    return fine.select(*manifest.columns).unionByName(bare)


def manifest_rows(manifest: DataFrame, split: str | None = None, most: int | None = None, key: str = "path", seed: int = 0) -> DataFrame:
    """Rows with status ok, of one split if given; of these the `most` of least hash if given (a top-k, not a sort)."""
    kept = manifest.where("status = 'ok'")
    kept = kept.where(F.col("split") == split) if split else kept
    if most is None:
        return kept
    return kept.withColumn("_h", stable_int(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 15)).orderBy("_h", key).limit(most).drop("_h")


def trusted(shards: DataFrame, many_rows: int = 256) -> DataFrame:
    """Shards whose labels may teach: not those of many rows with fewer than two particles, nor with a warning of merged clusters."""
    bad = (F.col("n_particles") < 2) & (F.col("n_hits") >= many_rows) | F.coalesce(F.col("warnings"), F.lit("")).contains("suspicious_merged_clusters")
    return shards.where(~F.coalesce(bad, F.lit(False)))


def time_slab(hits: DataFrame, start: int, end: int) -> DataFrame:
    """Hits whose time in sixteenths since their source's first, rounded half to even, is in [start, end)."""
    first = hits.groupBy("source").agg(F.min("fine").alias("_first"))
    z = F.rint((F.col("fine") - F.col("_first")) / 16.0 * 16.0).cast("long")
    return hits.join(first, "source").withColumn("z_fine", z).where((F.col("z_fine") >= start) & (F.col("z_fine") < end)).drop("_first")


def comparable(pairs: DataFrame, hits_ratio: float = 2.0, energy_ratio: float = 2.0) -> DataFrame:
    """Pairs whose sizes and energies (a_, b_) are within the ratios of each other."""
    ratio = lambda c: F.greatest(f"a_{c}", f"b_{c}") / F.greatest(F.least(f"a_{c}", f"b_{c}"), F.lit(1e-9))
    return pairs.where((ratio("hits") <= hits_ratio) & (ratio("energy") <= energy_ratio))


def passing(rows: DataFrame, gates: dict[str, tuple[str, float]]) -> DataFrame:
    """Rows that meet every gate: column -> (">=" or "<=", bound)."""
    ok: Column = F.lit(True)
    for c, (sign, bound) in gates.items():
        ok = ok & (F.col(c) >= bound if sign == ">=" else F.col(c) <= bound)
    return rows.where(ok)


def spread_picks(rows: DataFrame, keys: list[Column], id_: str, most: int, reach: int = 8) -> DataFrame:
    """`most` rows spread evenly over the first most * reach + 1 in falling order of the keys (all, where there are no more than `most`);
    a top-k, then a sort of that many rows."""
    head = rows.orderBy(*(k.desc() for k in keys), id_).limit(most * reach + 1)
    placed = head.withColumn("_i", F.row_number().over(Window.orderBy(*(k.desc() for k in keys), id_)) - 1)
    last = F.least(F.max("_i").over(Window.partitionBy(F.lit(0))), F.lit(most * reach))
    steps = placed.withColumn("_last", last)
    place = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.floor(k * F.col("_last") / max(most - 1, 1)))
    return steps.where((F.col("_last") < most) | F.array_contains(place, F.col("_i"))).drop("_i", "_last")


def summary(manifest: DataFrame, by: str, counts: list[str], sums: list[str], means: list[str]) -> DataFrame:
    """Per value of `by` among ok rows: rows, counts by value, sums and means."""
    return manifest.where("status = 'ok'").groupBy(by).agg(F.count("*").alias("rows"), *(F.count_distinct(c).alias(f"n_{c}") for c in counts), *(F.sum(c).alias(f"sum_{c}") for c in sums), *(F.round(F.avg(c), 6).alias(f"mean_{c}") for c in means))


def audit_summary(audit: DataFrame) -> DataFrame:
    """One row over shard audits: shards, particles, shards with warnings, extremes and means."""
    return audit.agg(F.count("*").alias("shards"), F.sum("n_particles").alias("particles"), F.count_if(F.col("warnings") != "").alias("with_warnings"), F.max("max_hits").alias("max_hits"), F.round(F.max("largest_fraction"), 6).alias("largest_fraction"), F.round(F.avg("noise_fraction"), 6).alias("mean_noise"), F.sum("n_long").alias("long_particles"))


def wide(rows: DataFrame, row: str, column: str, values: list[str], value: str) -> DataFrame:
    """Long rows (row, column, value) with a column for each of the given values."""
    return rows.groupBy(row).pivot(column, values).agg(F.round(F.first(value), 6))


def throughput(runs: DataFrame) -> DataFrame:
    """Per backend over its good runs: cases, hits, seconds, hits a second, and the least agreement of any run."""
    good = F.col("status").isin("ok", "manifest_baseline")
    g = runs.groupBy("backend").agg(F.count_if(good).alias("cases"), F.sum(F.when(good, F.col("hits")).otherwise(0)).alias("total_hits"), F.sum(F.when(good, F.col("seconds")).otherwise(0.0)).alias("_s"), F.min("ari").alias("min_ari"))
    return g.select("backend", "cases", "total_hits", F.round("_s", 6).alias("total_seconds"), F.round(F.when(F.col("_s") > 0, F.col("total_hits") / F.col("_s")).otherwise(0.0), 4).alias("hits_per_second"), F.round("min_ari", 6).alias("min_ari"))


def physical_span(hits: DataFrame, tick_ns: float = 25.0) -> DataFrame:
    """Per source: seconds between its first and last hit."""
    return hits.groupBy("source").agg(F.round((F.max("fine") - F.min("fine")) / 16.0 * tick_ns * 1e-9, 12).alias("seconds"))


def diagnostics(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column: mean, median, 95th percentile and maximum, over counted values."""
    each = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v")) for c in columns))).alias("m")).groupBy("m.measure", "m.v").count()
    return each.groupBy("measure").agg(F.round(F.sum(F.col("v") * F.col("count")) / F.sum("count"), 6).alias("mean"), *(F.round(F.percentile("v", F.lit(p), F.col("count")), 6).alias(f"p{int(100 * p)}") for p in (0.5, 0.95)), F.round(F.max("v"), 6).alias("max"))


def cases(files: DataFrame, runs: DataFrame, least_rows: int = 1000) -> DataFrame:
    """(case, source): the largest file, the slowest run of one of more than `least_rows`, and the run with the most particles."""
    pick = lambda name, df, c: df.agg(c.alias("source")).select(F.lit(name).alias("case"), "source")
    out = pick("largest", files, F.max_by("source", F.struct("rows", -F.col("source")))).unionByName(pick("slowest_per_hit", runs.where(F.col("hits") > least_rows), F.min_by("source", F.struct(F.col("hits") / F.col("seconds"), F.col("source")))))
    return out.unionByName(pick("max_particles", runs, F.max_by("source", F.struct("particles", -F.col("source"))))).join(files.select("source", "rows"), "source").select("case", "source", "rows")


def even_places(rows: DataFrame, n: int, k: int) -> DataFrame:
    """Of rows with places `pos` from 0 to n - 1, the k evenly spaced ones, ends included."""
    wanted = rows.sparkSession.createDataFrame([(i,) for i in sorted({int(j * (n - 1) / max(k - 1, 1)) for j in range(k)})], "pos long")
    return rows.join(F.broadcast(wanted), "pos", "left_semi")


def representatives(rows: DataFrame, key: str, columns: list[str], at: tuple[float, ...] = (0.005, 0.5, 0.995)) -> DataFrame:
    """Per column and quantile: the row whose value is nearest to it, ties by key."""
    each = rows.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v")) for c in columns))).alias("m")).select(key, "m.*")
    counted = each.groupBy("measure", "v").agg(F.count("*").alias("n"), F.min(key).alias("least"))
    marks = counted.groupBy("measure").agg(F.array(*(F.struct(F.lit(q).alias("q"), F.percentile("v", F.lit(q), F.col("n")).alias("mark")) for q in at)).alias("marks")).select("measure", F.explode("marks").alias("m")).select("measure", "m.*")
    gap = F.round(F.abs(F.col("v") - F.col("mark")), 9)
    return counted.join(marks, "measure").groupBy("measure", "q").agg(F.min_by("least", F.struct(gap, "least")).alias(key))


def apart(windows: DataFrame, by: str, start: str, end: str, score: str, most: int, gap: int = 0) -> DataFrame:
    """Windows taken in falling order of score (ties by start) where they keep `gap` from those taken, at most `most` of each group.

    The choice is sequential, but a window taken can only shut out those that overlap it: of a group no more than the first
    most * (1 + overlaps) windows in order can matter, and the rank by score keeps to that many before the grouped step.
    """
    import pandas as pd

    length = windows.agg(F.max(F.col(end) - F.col(start)), F.min(F.col(end) - F.col(start))).first()
    if length[0] is None:
        return windows.limit(0)
    near = windows.groupBy(by, F.floor(F.col(start) / max(1, length[0] + gap)).alias("_b")).count().agg(F.max("count")).first()[0]
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.col(score).desc(), start))
    head = windows.withColumn("_rank", rank).where(F.col("_rank") <= most * (1 + 3 * near)).drop("_rank")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: list[tuple] = []
        rows = []
        for i, (a, b) in zip(pdf.sort_values([score, start], ascending=[False, True]).index, pdf.sort_values([score, start], ascending=[False, True])[[start, end]].itertuples(index=False)):
            if len(taken) < most and all(b + gap <= x or a >= y + gap for x, y in taken):
                taken.append((a, b))
                rows.append(i)
        return pdf.loc[rows]

    return head.groupBy(by).applyInPandas(choose, head.schema)


def closest(hits: DataFrame, pairs: DataFrame, radius: float, time_scale: float = 0.625) -> DataFrame:
    """pairs(source, a, b) of labels with the least distance of their hits, null where it is over `radius`; by a bucketed join of near
    hits, never all hits of one with all of the other."""
    from hitweave.operators.spatial import radius_pairs

    near = radius_pairs(hits.where("label >= 0"), radius, time_scale, directed=True, keep=("label",)).where("a_label < b_label")
    least = near.groupBy("source", F.col("a_label").alias("a"), F.col("b_label").alias("b")).agg(F.round(F.min("dist"), 6).alias("closest"))
    return pairs.select("source", "a", "b").join(least, ["source", "a", "b"], "left")


def probe_chunks(manifest: DataFrame, chunks: DataFrame) -> DataFrame:
    """Manifest rows with the chunk row that they name."""
    return manifest.join(chunks, ["chunk_path", "chunk_row"])


def particle_voxels(hits: DataFrame) -> DataFrame:
    """Per label, pixel and sixteenth of a tick: hits, sum and mean of log ToT."""
    from hitweave.operators.particles import log_energy

    e = log_energy(F.col("tot"))
    return hits.where("label >= 0").groupBy("label", "x", "y", F.col("fine").alias("z")).agg(F.count("*").alias("n_hits"), F.round(F.sum(e), 6).alias("energy_sum"), F.round(F.avg(e), 6).alias("energy_mean"))


def window_split(group: Column, row: Column, strategy: str = "group-source", seed: int = 0, validation: float = 0.1, test: float = 0.1) -> Column:
    """Split of a window: by its source's hash (group-source), or by its own (random-window)."""
    from hitweave.operators.sampling import group_split

    if strategy == "group-source":
        return group_split(group, seed, validation, test)
    if strategy == "random-window":
        return group_split(row, seed, validation, test)
    raise ValueError(f"unknown split strategy {strategy!r}")


def per_group(rows: DataFrame, by: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """At most n rows of each group, those of least hash."""
    h = stable_int(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 15)
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(by).orderBy(h, key))).where(F.col("_r") <= n).drop("_r")
