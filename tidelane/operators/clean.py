"""Cleaning, standardisation, label mapping, splits and perturbations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane import shipping


def alias_column(df: DataFrame, wrong: str, right: str) -> DataFrame:
    """Renames ``wrong`` to ``right`` only where ``right`` is missing."""
    return df.withColumnRenamed(wrong, right) if wrong in df.columns and right not in df.columns else df


def numeric_rows(df: DataFrame, columns: list[str], kind: str = "double") -> DataFrame:
    """Casts columns; rows with a value that isn't a number go (repeated header lines among them)."""
    cast = df.withColumns({c: F.expr(f"try_cast(trim(`{c}`) AS {kind})") for c in columns})
    return cast.na.drop(subset=columns)


def finite(x: Column) -> Column:
    """NaN and infinities become 0."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(x)


def at_least(df: DataFrame, key: str, rows: int) -> DataFrame:
    return df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key))).where(F.col("_n") >= rows).drop("_n")


def standardize(df: DataFrame, columns: list[str], key: str | None = None, floor: float = 1e-6) -> DataFrame:
    """Adds <column>_z: minus the mean, over the population deviation (1 where under ``floor``), per key or overall."""
    aggs = [f(c).alias(f"_{c}_{n}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]
    stats = df.groupBy(key).agg(*aggs) if key else df.agg(*aggs)
    joined = df.join(stats, key) if key else df.join(F.broadcast(stats))  # one row
    z = {f"{c}_z": (F.col(c) - F.col(f"_{c}_m")) / F.when(F.col(f"_{c}_s") < floor, 1.0).otherwise(F.col(f"_{c}_s")) for c in columns}
    return joined.withColumns(z).select(*df.columns, *z)


def dense_labels(df: DataFrame, label: str, name: str, background=None) -> DataFrame:
    """Distinct labels in order as 0, 1, ...; a background label comes first."""
    first = F.lit(0) if background is None else F.when(F.col(label) == background, 0).otherwise(1)
    ids = df.select(label).distinct().withColumn(name, F.row_number().over(Window.orderBy(first, label)) - 1)  # one row per label
    return df.join(F.broadcast(ids), label)


def distinct_on(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_k = 1").drop("_k")


def fixed_split(df: DataFrame, key: str, train: int = 6, dev: int = 2) -> DataFrame:
    """Keys in order: the first ``train`` tenths, the next ``dev`` tenths, the rest. One row per key."""
    keys = df.select(key).distinct()
    place = keys.withColumn("dense_id", F.dense_rank().over(Window.orderBy(key)).cast("long") - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy()))
    split = F.when(10 * F.col("dense_id") < train * F.col("_n"), "train").when(10 * F.col("dense_id") < (train + dev) * F.col("_n"), "dev").otherwise("test")
    return place.select(key, "dense_id", split.alias("split"))


def hash_split(df: DataFrame, key: str, folds: int, seed: int) -> DataFrame:
    """A fold for each key, by the digest of (seed, key): the same at every layout and in any engine."""
    digest = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long")
    return df.select(key).distinct().withColumn("fold", F.pmod(digest, F.lit(folds).cast("long")))


def normalise_labels(c: Column, replace: dict[str, str]) -> Column:
    """Strips labels and replaces known misspellings."""
    c = F.trim(c)
    out = c
    for wrong, right in replace.items():
        out = F.when(c == wrong, F.lit(right)).otherwise(out)
    return out


def perturb(df: DataFrame, key: str, order: list[str], x: str, kind: str, amount: float, seed: int = 0) -> DataFrame:
    """Robustness conditions on a column: noise, dropout, clip (at a value), saturate (at a quantile of the magnitude),
    hold, drift (a line and a sine, ``amount`` deviations high), bias, scale, burst. Random ones hash key and place."""
    w = Window.partitionBy(key).orderBy(*order)
    i = F.row_number().over(w) - 1
    df = df.withColumn("_i", i)
    u = lambda k: (F.pmod(F.xxhash64(F.col(key), F.col("_i"), F.lit(seed + k)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    v = F.col(x)
    if kind == "noise":  # amount: signal-to-noise ratio in dB
        spread = F.stddev_pop(x).over(Window.partitionBy(key)) * 10 ** (-amount / 20)
        out = v + spread * F.sqrt(-2 * F.ln(u(1))) * F.cos(2 * 3.141592653589793 * u(2))
    elif kind == "dropout":
        out = F.when(u(1) >= amount, v)
    elif kind == "burst":  # amount: share of the places, in one stretch
        n = F.count(F.lit(1)).over(Window.partitionBy(key))
        start = F.floor(n * (1 - amount) * (F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1000)) / 1000.0))
        out = F.when((F.col("_i") < start) | (F.col("_i") >= start + n * amount), v)
    elif kind == "clip":
        out = F.least(F.lit(amount), F.greatest(F.lit(-amount), v))
    elif kind == "saturate":  # amount: quantile of |x|, per key
        most = F.percentile(F.abs(v), F.lit(amount)).over(Window.partitionBy(key))
        out = F.least(most, F.greatest(-most, v))
    elif kind == "drift":
        at = F.try_divide(F.col("_i").cast("double"), F.count(F.lit(1)).over(Window.partitionBy(key)) - 1)
        out = v + amount * F.stddev_pop(x).over(Window.partitionBy(key)) * (F.coalesce(at, F.lit(0.0)) + 0.5 * F.sin(2 * 3.141592653589793 * F.coalesce(at, F.lit(0.0))))
    elif kind == "hold":  # every amount-th value, held
        out = F.last(F.when(F.col("_i") % int(amount) == 0, v), True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    elif kind == "bias":
        out = v + amount
    elif kind == "scale":
        out = v * amount
    else:
        raise ValueError(f"unknown condition {kind!r}")
    return df.withColumn(x, out).drop("_i")


def jitter(df: DataFrame, key: str, order: list[str], time: str, share: float, seed: int = 0) -> DataFrame:
    """Times with each step changed at random by up to ``share`` of the median step, no step under a fifth of that; the
    whole span stays as it was. Draws hash key and place."""
    w = Window.partitionBy(key).orderBy(*order)
    whole = Window.partitionBy(key)
    df = df.withColumn("_i", F.row_number().over(w)).withColumn("_d", F.col(time) - F.lag(time).over(w))
    df = df.withColumn("_m", F.percentile("_d", 0.5).over(whole)).withColumn("_a", F.min(time).over(whole)).withColumn("_b", F.max(time).over(whole))
    u = F.pmod(F.xxhash64(F.col(key), F.col("_i"), F.lit(seed)), F.lit(1 << 30)) / float(1 << 29) - 1
    df = df.withColumn("_c", F.coalesce(F.sum(F.when(F.col("_d").isNotNull(), F.greatest(F.col("_d") + u * share * F.col("_m"), 0.2 * F.col("_m")))).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
    scaled = F.col("_a") + F.col("_c") * F.coalesce(F.try_divide(F.col("_b") - F.col("_a"), F.max("_c").over(whole)), F.lit(0.0))
    return df.withColumn(time, scaled).drop("_i", "_d", "_m", "_a", "_b", "_c")


def apply_to_series(df: DataFrame, key: str, order: list[str], column: str, change) -> DataFrame:
    """The hook for users' own conditions: ``change`` maps a key's values (a numpy array, in order) to as many values."""
    import numpy as np

    def run(frame):
        frame = frame.sort_values(order, kind="stable", ignore_index=True)
        frame[column] = np.asarray(change(frame[column].to_numpy(np.float64)), np.float64)
        return frame

    shipping.ship(df.sparkSession)
    return df.groupBy(key).applyInPandas(run, df.schema)
