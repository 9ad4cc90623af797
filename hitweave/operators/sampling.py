"""Splits, strata, quotas and ranked picks, all decided by hashes so that they repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hitweave.operators.order import ranked


def stable_int(key: Column, digits: int = 8) -> Column:
    """The first hexadecimal digits of a key's SHA-1 as an integer."""
    return F.conv(F.substring(F.sha1(key.cast("string")), 1, digits), 16, 10).cast("long")


def group_split(key: Column, seed: int = 0, validation: float = 0.1, test: float = 0.1) -> Column:
    """train, validation or test by the hash of seed and key alone: a group is never divided."""
    u = stable_int(F.concat(F.lit(f"{seed}:"), key.cast("string"))) / F.lit(float(0xFFFFFFFF))
    return F.when(u < test, "test").when(u < test + validation, "validation").otherwise("train")


def size_tier(rows: Column) -> Column:
    return F.when(rows < 100, "tiny").when(rows < 2000, "small").when(rows < 50_000, "medium").when(rows < 500_000, "large").otherwise("huge")


def stratified(rows: DataFrame, tier: str, key: str, quotas: dict[str, int], seed: int = 0) -> DataFrame:
    """The first rows of each stratum by hash, as many as its quota; a stratum without a quota gives none."""
    rank = F.row_number().over(Window.partitionBy(tier).orderBy(stable_int(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 15), key))
    quota = F.coalesce(*(F.when(F.col(tier) == t, q) for t, q in quotas.items()), F.lit(0))
    # the greatest quota bounds the ranks before each row's own does: tasks keep that many rows a stratum, and only these are shuffled
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= max(quotas.values(), default=0)).where(F.col("_rank") <= quota).drop("_rank")


def ratio_selection(rows: DataFrame, flag: str, key: str, ratio: float, seed: int = 0) -> DataFrame:
    """All rows without the flag, and flagged rows (first by hash) so that they make up `ratio` of the result."""
    if ratio <= 0:
        return rows.where(~F.col(flag))
    if ratio >= 1:
        return rows.where(F.col(flag))
    quota = rows.where(~F.col(flag)).agg(F.rint(F.count("*") * ratio / (1 - ratio)).cast("long")).first()[0]
    return rows.where(~F.col(flag)).unionByName(first_by_hash(rows.where(F.col(flag)), key, quota, seed).select(*rows.columns))


def first_by_hash(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The n rows of least hash (ties by key): ranks come from the counts of 1,024 hash ranges, then within a range."""
    hashed = rows.withColumn("_h", stable_int(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 15)).withColumn("_all", F.lit(0))
    return ranked(hashed, "_all", ("_h", key), F.shiftright("_h", 50)).where(F.col("pos") < n).select(*rows.columns)


def allocate(groups: DataFrame, target: int, seed: int = 0) -> DataFrame:
    """Round-robin shares of `target` over groups(key, capacity), groups in the order of their hash: in each round every group that
    has room gets one, until the target is met.

    Found in closed form: the last full round follows from the counts of capacities, and only the groups with room in the round
    after it are ranked, for what is left.
    """
    counts = groups.where("capacity > 0").groupBy("capacity").agg(F.count("*").alias("k"))
    w, whole = Window.partitionBy(F.lit(0)).orderBy("capacity").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(F.lit(0))
    curve = counts.select("capacity", F.sum(F.col("capacity") * F.col("k")).over(w).alias("given"), (F.sum("k").over(whole) - F.sum("k").over(w)).alias("open"), F.sum("k").over(whole).alias("all"))
    at = curve.where(F.col("given") + F.col("capacity") * F.col("open") <= target).orderBy(F.col("capacity").desc()).first()
    total = counts.agg(F.sum("k")).first()[0] or 0
    full, given, still = (at["capacity"], at["given"] + at["capacity"] * at["open"], at["open"]) if at else (0, 0, total)
    more, rest = divmod(target - given, still) if still else (0, 0)
    full += more
    share = groups.select("key", "capacity", F.least("capacity", F.lit(full)).alias("share"))
    if not rest:
        return share
    extra = first_by_hash(groups.where(F.col("capacity") > full), "key", rest, seed).select("key", F.lit(1).alias("_more"))
    return share.join(extra, "key", "left").select("key", "capacity", (F.col("share") + F.coalesce("_more", F.lit(0))).alias("share"))


def top_fraction(rows: DataFrame, by: str, value: str, key: str, fraction: float) -> DataFrame:
    """The ceil(n * fraction) largest of each group, at least one."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")
    n = F.count("*").over(Window.partitionBy(by))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.col(value).desc(), key))
    return rows.withColumn("_keep", rank <= F.ceil(n * fraction)).where("_keep").drop("_keep")


def weighted_sample(rows: DataFrame, weight: Column, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement, chance in proportion to weight (exponential keys from a hash); a top-k, not a full sort."""
    u = (stable_int(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 12) + 1) / F.lit(float(16**12 + 1))
    return rows.withColumn("_k", -F.log(u) / weight).orderBy("_k", key).limit(n).drop("_k")


def time_strata(hits: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """At most `most` hits of each label: all of a small one, else the least hash of each of `most` equal-count time strata."""
    w = Window.partitionBy("label").orderBy("fine", "hit_id")
    n = F.count("*").over(Window.partitionBy("label"))
    dealt = hits.where("label >= 0").select("label", "hit_id", "fine", n.alias("_n"), F.ntile(most).over(w).alias("_tile"), stable_int(F.concat(F.lit(f"{seed}:"), F.col("hit_id").cast("string")), 15).alias("_h"))
    first = F.row_number().over(Window.partitionBy("label", "_tile").orderBy("_h", "hit_id"))
    return dealt.withColumn("_first", first).where((F.col("_n") <= most) | (F.col("_first") == 1)).select("label", "hit_id")
