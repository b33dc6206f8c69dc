"""Scalar functions of names, times and numbers."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def natural_key(s: Column) -> Column:
    """All digits of a name as one number; 0 where there are none or too many."""
    return F.coalesce(F.regexp_replace(s, "[^0-9]", "").try_cast("bigint"), F.lit(0).cast("bigint"))


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"\.[^.]*$", "")


def clock(seconds: Column) -> Column:
    """MM:SS."""
    return F.format_string("%02d:%02d", F.floor(seconds / 60).cast("long"), F.floor(F.pmod(seconds, F.lit(60))).cast("long"))


def focal(p: Column, gamma: float = 2.0) -> Column:
    """Focal loss of the true class's probability."""
    return -F.pow(1 - p, F.lit(gamma)) * F.ln(F.greatest(p, F.lit(1e-12)))


def cross_entropy(p: Column, label: Column, smoothing: float = 0.1) -> Column:
    """Of an array of class probabilities, the label's share smoothed over all classes."""
    logs = F.transform(p, lambda v: F.ln(F.greatest(v, F.lit(1e-12))))
    mean = F.aggregate(logs, F.lit(0.0), lambda a, b: a + b) / F.size(p)
    return -((1 - smoothing) * F.get(logs, label) + smoothing * mean)


def distance(x: Column, y: Column) -> Column:
    """Euclidean, of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(x, y, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))


def triplet(near: Column, far: Column, margin: float = 1.0) -> Column:
    """Hinge loss of the distance to the hardest equal and to the hardest other example."""
    return F.greatest(near - far + margin, F.lit(0.0))


def warm_up(n: Column, full: int = 800) -> Column:
    return F.least(n / F.lit(float(full)), F.lit(1.0))


def register(spark: SparkSession) -> None:
    """SQL functions of the same names."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION natural_key(s STRING) RETURNS BIGINT RETURN coalesce(try_cast(regexp_replace(s, '[^0-9]', '') AS BIGINT), 0)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION iou(a0 DOUBLE, a1 DOUBLE, b0 DOUBLE, b1 DOUBLE) RETURNS DOUBLE RETURN CASE WHEN greatest(a1, b1) > least(a0, b0) THEN greatest(0, least(a1, b1) - greatest(a0, b0)) / (greatest(a1, b1) - least(a0, b0)) ELSE 0 END")
