"""Aggregates over labelled hits: particles, offsets, file and folder reports, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitweave.operators.cluster import label_of_ids
from hitweave.operators.order import before_slabs


def log_energy(tot: Column) -> Column:
    return F.log1p(F.greatest(tot, F.lit(0)).cast("double"))


def particles(hits: DataFrame, labels: DataFrame) -> DataFrame:
    """One row a (source, label): hits, energy, extent in time and pixels; noise is left out."""
    return (
        hits.join(label_of_ids(labels.where("label >= 0")), ["source", "hit_id"])
        .groupBy("source", "label")
        .agg(
            F.count("*").alias("n_hits"), F.round(F.sum(log_energy(F.col("tot"))), 6).alias("energy_sum"), F.min("fine").alias("first_fine"), F.max("fine").alias("last_fine"),
            F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"),
        )
    )


def offsets(parts: DataFrame) -> DataFrame:
    """Running start of each particle's hits in its source, in label order (compressed sparse rows)."""
    slabbed = parts.select("source", "label", "n_hits", F.shiftright("label", 34).alias("_slab"))
    before = before_slabs(slabbed, ["source"], "_slab", F.sum("n_hits"), "_before")
    w = Window.partitionBy("source", "_slab").orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    return slabbed.withColumn("_inner", F.coalesce(F.sum("n_hits").over(w), F.lit(0))).join(before, ["source", "_slab"]).select("source", "label", "n_hits", (F.col("_before") + F.col("_inner")).alias("offset"))


def noise_summary(labels: DataFrame) -> DataFrame:
    """Per source: hits, noise hits, share of noise, particles."""
    return labels.groupBy("source").agg(
        F.count("*").alias("n_hits"), F.count_if(F.col("label") < 0).alias("n_noise"), F.round(F.avg(F.when(F.col("label") < 0, 1.0).otherwise(0.0)), 6).alias("noise_fraction"),
        F.count_distinct(F.when(F.col("label") >= 0, F.col("label"))).alias("n_particles"),
    )


def size_bucket(n: Column) -> Column:
    return F.when(n <= 3, "1-3").when(n <= 10, "4-10").when(n <= 50, "11-50").when(n <= 512, "51-512").otherwise(">512")


def shard_audit(parts: DataFrame, totals: DataFrame, long_ticks: float = 100.0, full_span: int = 255, large_share: float = 0.5) -> DataFrame:
    """Per source: quantiles of particle sizes, the largest share, long and wide particles, and a warning text."""
    joined = parts.join(totals.select("source", F.col("n_hits").alias("rows"), "noise_fraction"), "source")
    q = lambda p: F.round(F.percentile("n_hits", F.lit(p)), 6)
    wide = ((F.col("max_x") - F.col("min_x") >= full_span) & (F.col("max_y") - F.col("min_y") >= full_span)) | (F.col("n_hits") >= F.greatest(F.lit(1), F.floor(F.col("rows") * large_share)))
    out = joined.groupBy("source").agg(
        F.count("*").alias("n_particles"), F.max("n_hits").alias("max_hits"), q(0.5).alias("median_hits"), q(0.95).alias("p95_hits"), q(0.99).alias("p99_hits"),
        F.round(F.max(F.col("n_hits") / F.col("rows")), 6).alias("largest_fraction"), F.count_if((F.col("last_fine") - F.col("first_fine")) / 16.0 > long_ticks).alias("n_long"), F.count_if(wide).alias("n_wide"),
        F.first("noise_fraction").alias("noise_fraction"),
    )
    return out.withColumn("warnings", F.concat_ws(";", F.when(F.col("n_long") > 0, F.concat(F.lit("long_particles="), F.col("n_long").cast("string"))), F.when(F.col("n_wide") > 0, F.concat(F.lit("wide_particles="), F.col("n_wide").cast("string"))), F.when(F.col("noise_fraction") > 0.25, F.lit("high_noise")), F.when(F.col("noise_fraction") < 0.001, F.lit("low_noise"))))


def file_candidates(rows: DataFrame, most_rows: int) -> DataFrame:
    """Per file over its first `most_rows` rows in file order: rows, whether that limit cut, ToT and ToA figures, sum of Overflow."""
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy("source").orderBy("hit_id")))
    total = rows.groupBy("source").agg((F.count("*") > most_rows).alias("scan_limited"))
    return ranked.where(F.col("_n") <= most_rows).groupBy("source").agg(
        F.count("*").alias("rows_scanned"), F.sum("tot").alias("tot_sum"), F.round(F.avg("tot"), 6).alias("tot_mean"), F.max("tot").alias("tot_max"), F.min("toa").alias("toa_min"), F.max("toa").alias("toa_max"), F.sum("overflow").alias("overflow_count")
    ).join(total, "source")


def folder_report(files: DataFrame) -> DataFrame:
    """Per folder: files, sum of bytes and rows, bounds of the start text, and the five largest files."""
    top = files.withColumn("_n", F.row_number().over(Window.partitionBy("folder").orderBy(F.col("bytes").desc(), "path"))).where("_n <= 5")
    largest = top.groupBy("folder").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "path"))), lambda s: s["path"]), ",").alias("largest"))
    return files.groupBy("folder").agg(F.count("*").alias("files"), F.count_if(F.col("rows") > 0).alias("files_with_rows"), F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"), F.min("start").alias("first_start"), F.max("start").alias("last_start")).join(largest, "folder")


def frame_stats(entries: DataFrame, width: int = 256, height: int = 256) -> DataFrame:
    """Per frame: occupied pixels, density, sum, largest, least and mean energy (0 for an empty frame)."""
    e = F.col("energy")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return entries.groupBy("frame").agg(F.count(e).alias("nnz"), F.round(F.count(e) / (width * height), 9).alias("density"), zero(F.sum(e)).alias("energy_sum"), zero(F.max(e)).alias("energy_max"), zero(F.min(e)).alias("energy_min"), zero(F.avg(e)).alias("energy_mean"))


def preprocessing_audit(hits: DataFrame) -> DataFrame:
    """Per source: hits, hits on a pixel already hit, mean and p95 ToT, span."""
    return hits.groupBy("source").agg(F.count("*").alias("n_hits"), (F.count("*") - F.count_distinct("x", "y")).alias("repeated_pixels"), F.round(F.avg("tot"), 6).alias("tot_mean"), F.round(F.percentile("tot", F.lit(0.95)), 6).alias("tot_p95"), F.round((F.max("fine") - F.min("fine")) / 16.0, 6).alias("span_ticks"))


def energy_quantiles(hits: DataFrame) -> DataFrame:
    """min, p50, p90, p99, max of ToT, its log, and the log over log(1024)."""
    # values are counted first, so that the quantiles see one row a value of ToT
    counts = hits.groupBy("tot").count()
    measures = (("tot", F.col("tot").cast("double")), ("log", log_energy(F.col("tot"))), ("scaled", log_energy(F.col("tot")) / F.lit(6.931471805599453)))
    each = counts.select("count", F.explode(F.array(*(F.struct(F.lit(n).alias("measure"), v.alias("v")) for n, v in measures))).alias("m")).select("count", "m.*")
    return each.groupBy("measure").agg(F.round(F.min("v"), 6).alias("min"), *(F.round(F.percentile("v", F.lit(p), F.col("count")), 6).alias(f"p{int(100 * p)}") for p in (0.5, 0.9, 0.99)), F.round(F.max("v"), 6).alias("max"))


def marker_gaps(rows: DataFrame) -> DataFrame:
    """Rows that are device markers paired with the next marker of their source, and the ticks between."""
    w = Window.partitionBy("source").orderBy("toa", "hit_id")
    marks = rows.where("overflow <> 0").withColumn("next_toa", F.lead("toa").over(w))
    return marks.where("next_toa is not null").select("source", "hit_id", "toa", "next_toa", (F.col("next_toa") - F.col("toa")).alias("gap_ticks"))
