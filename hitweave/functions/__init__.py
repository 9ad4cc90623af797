"""Scalar functions of the library."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

TICK_NS, SUBTICKS, WIDTH = 25, 16, 256


def pixel_x(matrix_index: Column) -> Column:
    return F.pmod(matrix_index, F.lit(WIDTH))


def pixel_y(matrix_index: Column) -> Column:
    return F.floor(matrix_index / WIDTH).cast("int")


def fine_time(toa: Column, ftoa: Column) -> Column:
    """Sixteenths of a tick: exact integer form of ToA - FToA / 16."""
    return SUBTICKS * toa - ftoa


def time_ns(toa: Column, ftoa: Column) -> Column:
    return (fine_time(toa, ftoa) * TICK_NS) / SUBTICKS


def interval_gap(a_low: Column, a_high: Column, b_low: Column, b_high: Column) -> Column:
    return F.greatest(b_low - a_high, a_low - b_high, F.lit(0))


def slug(text: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s == "", "unknown").otherwise(s)


def human_bytes(n: Column) -> Column:
    """Whole bytes under 1024, else one decimal in KB, MB, GB or TB."""
    step = lambda k, unit: F.concat(F.format_string("%.1f", n / float(1024**k)), F.lit(f" {unit}"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, step(1, "KB")).when(n < 1024**3, step(2, "MB")).when(n < 1024**4, step(3, "GB")).otherwise(step(4, "TB"))


def int_or(text: Column, default: int) -> Column:
    """Integer part of a number in text, or the default."""
    return F.coalesce(text.try_cast("double").try_cast("bigint"), F.lit(default).cast("bigint"))


def finite(v: Column) -> Column:
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), 0.0).otherwise(v)


def label_slot(label: Column, slots: int) -> Column:
    """(label * 2654435761) mod 2^32 mod slots: a steady colour slot of a label."""
    return F.pmod(F.pmod(label.cast("decimal(20,0)") * F.lit(2654435761).cast("decimal(20,0)"), F.lit(2**32).cast("decimal(20,0)")), F.lit(slots).cast("decimal(20,0)")).cast("bigint")


def flat_index(t: Column, y: Column, x: Column, ny: int, nx: int) -> Column:
    return (t * ny + y) * nx + x


def register(spark: SparkSession) -> None:
    """SQL names for functions that have no built-in form."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION comb2(n DOUBLE) RETURNS DOUBLE RETURN n * (n - 1) / 2")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION interval_gap(a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE) RETURNS DOUBLE RETURN greatest(c - b, a - d, 0)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION fine_time(toa BIGINT, ftoa BIGINT) RETURNS BIGINT RETURN 16 * toa - ftoa")
