"""Features of windows held as arrays, and changes of windows for training."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelane import shipping
from tidelane.operators.fusion import let


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def mean(x: Column) -> Column:
    return total(x) / F.size(x)


def std(x: Column) -> Column:
    """Population deviation."""
    return F.sqrt(let(mean(x), lambda m: mean(F.transform(x, lambda v: (v - m) * (v - m)))))


def percentile(x: Column, q: float) -> Column:
    """Linear between neighbours of the sorted values."""
    s, at = F.sort_array(x), (F.size(x) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    below, above = F.get(s, low), F.get(s, F.least(low + 1, F.size(x) - 1))
    return below + (above - below) * (at - low)


def energy(x: Column) -> Column:
    return mean(F.transform(x, lambda v: v * v))


def zero_crossings(x: Column) -> Column:
    """Half the summed steps of the sign around the mean, over the length."""
    signs = let(mean(x), lambda m: F.transform(x, lambda v: F.signum(v - m)))
    steps = let(signs, lambda s: total(F.transform(s, lambda v, i: F.when(i == 0, 0.0).otherwise(F.abs(v - F.get(s, i - 1))))))
    return steps / (2 * F.size(x))


def correlation(x: Column, y: Column) -> Column:
    """0 where a side is constant."""
    both = mean(F.zip_with(x, y, lambda a, b: a * b)) - mean(x) * mean(y)
    return F.coalesce(F.try_divide(both, std(x) * std(y)), F.lit(0.0))


def dominant_frequency(x: Column) -> Column:
    """Bin (from 1) of the largest Fourier amplitude, by explicit sums: for windows of a few hundred values."""
    n, m = F.size(x), mean(x)
    turn = lambda k, i: F.lit(-6.283185307179586) * k * i / n

    def power(k: Column) -> Column:
        re = total(F.transform(x, lambda v, i: (v - m) * F.cos(turn(k, i))))
        im = total(F.transform(x, lambda v, i: (v - m) * F.sin(turn(k, i))))
        return re * re + im * im

    powers = F.transform(F.sequence(F.lit(1), F.floor(n / 2).cast("int")), power)
    return F.array_position(powers, F.array_max(powers))


def channel(x: Column) -> dict[str, Column]:
    """Mean, deviation, least, largest, median, energy, zero crossings and quartile range of a channel."""
    return {
        "mean": mean(x), "std": std(x), "min": F.array_min(x), "max": F.array_max(x), "median": percentile(x, 0.5),
        "energy": energy(x), "zcr": zero_crossings(x), "iqr": percentile(x, 0.75) - percentile(x, 0.25),
    }


def robust(x: Column) -> dict[str, Column]:
    return {"mean": mean(x), "std": std(x), "min": F.array_min(x), "max": F.array_max(x), "p25": percentile(x, 0.25), "p75": percentile(x, 0.75)}


def norm3(x: Column, y: Column, z: Column) -> Column:
    squares = F.zip_with(x, y, lambda a, b: a * a + b * b)
    return F.transform(F.zip_with(squares, z, lambda a, b: a + b * b), lambda v: F.sqrt(v))


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("dominant", "power", "low", "mid", "high")]))
def spectrum(x: pd.Series, rate: pd.Series) -> pd.DataFrame:
    """Frequency and amplitude of the largest Fourier amplitude but the constant's, and the sums of three bands (from 0.5,
    3 and 10 up to 25 Hz, open at the upper end), for whole batches of windows of a length."""
    out = np.zeros((len(x), 5))
    sizes = x.map(len).to_numpy()
    for n in np.unique(sizes[sizes > 1]):
        at = np.flatnonzero(sizes == n)
        size = np.abs(np.fft.rfft(np.stack(x.iloc[at].to_list()), axis=1))
        f = np.fft.rfftfreq(n)[None, :] * rate.iloc[at].to_numpy()[:, None]
        top = size[:, 1:].argmax(axis=1) + 1
        bands = [(size * ((f >= a) & (f < b))).sum(axis=1) for a, b in ((0.5, 3), (3, 10), (10, 25))]
        out[at] = np.stack([f[np.arange(len(at)), top], size[np.arange(len(at)), top], *bands], axis=1)
    return pd.DataFrame(out, columns=["dominant", "power", "low", "mid", "high"])


def handcrafted(df: DataFrame, channels: list[str], rate: float = 100.0) -> DataFrame:
    """The 64 figures of a window of six channels, three of acceleration and three of turn rate: eight of each channel;
    mean, deviation and largest of either norm; either's mean summed magnitude; correlations of the acceleration's axes;
    dominant frequency, its amplitude and three bands of the acceleration's norm."""
    shipping.ship(df.sparkSession)
    columns = {}
    for c in channels:
        x = F.col(c)
        columns |= {f"{c}_mean": mean(x), f"{c}_std": std(x), f"{c}_min": F.array_min(x), f"{c}_max": F.array_max(x), f"{c}_median": percentile(x, 0.5), f"{c}_energy": energy(x), f"{c}_zcr": zero_crossings(x), f"{c}_span": F.array_max(x) - F.array_min(x)}
    for name, part in (("acc", channels[:3]), ("gyro", channels[3:])):
        norm = norm3(*map(F.col, part))
        columns |= {f"{name}_mean": mean(norm), f"{name}_std": std(norm), f"{name}_max": F.array_max(norm), f"{name}_sma": sum((mean(F.transform(c, F.abs)) for c in part[1:]), mean(F.transform(part[0], F.abs)))}
    columns |= {f"corr_{i}{j}": correlation(F.col(channels[i]), F.col(channels[j])) for i, j in ((0, 1), (0, 2), (1, 2))}
    out = df.withColumns(columns).withColumn("_f", spectrum(norm3(*map(F.col, channels[:3])), F.lit(float(rate))))
    return out.select(*df.columns, *columns, *[F.col(f"_f.{n}").alias(f"freq_{n}") for n in ("dominant", "power", "low", "mid", "high")])


def unpivoted(df: DataFrame, keep: list[str], channels: list[str], norms: dict[str, tuple[str, str, str]] | None = None) -> DataFrame:
    """keep, channel and x: a row for each channel of a row, the norms of three channels among them."""
    norm = {n: F.sqrt(sum((F.col(c).cast("double") ** 2 for c in part[1:]), F.col(part[0]).cast("double") ** 2)) for n, part in (norms or {}).items()}
    pairs = [F.struct(F.lit(n).alias("channel"), v.alias("x")) for n, v in ({c: F.col(c).cast("double") for c in channels} | norm).items()]
    return df.select(*keep, F.explode(F.array(*pairs)).alias("_c")).select(*keep, "_c.*")


def audit(df: DataFrame, group: str, channels: list[str], norms: dict[str, tuple[str, str, str]] | None = None) -> DataFrame:
    """Of each channel: n, mean, std, min, max, p25, median, p75, the shares of zeros and of missing or non-finite values, and
    the variance between the classes of ``group`` over that within them. All channels in one pass over unpivoted rows; the
    ratio comes from sums by (channel, class), which are few."""
    rows = unpivoted(df, [group], channels, norms)
    fine = F.when(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")), F.col("x"))
    rows = rows.withColumn("_x", fine)
    q = F.percentile("_x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    figures = rows.groupBy("channel").agg(
        F.count("_x").alias("n"), F.avg("_x").alias("mean"), F.stddev_pop("_x").alias("std"), F.min("_x").alias("min"), F.max("_x").alias("max"), q.alias("q"),
        F.avg((F.col("_x") == 0).cast("double")).alias("zeros"), F.avg(F.col("_x").isNull().cast("double")).alias("missing"),
    )
    by = rows.groupBy("channel", group).agg(F.count("_x").alias("k"), F.avg("_x").alias("mu"), F.var_pop("_x").alias("v"))
    total = by.groupBy("channel").agg(F.sum(F.col("k") * F.col("mu") * F.col("mu")).alias("sq"), (F.sum(F.col("k") * F.col("mu")) / F.sum("k")).alias("o"), F.sum("k").alias("k"), F.sum(F.col("k") * F.col("v")).alias("within"))
    ratio = F.coalesce(F.try_divide(F.col("sq") - F.col("k") * F.col("o") * F.col("o"), F.col("within")), F.lit(0.0))
    return figures.join(total, "channel").select("channel", "n", "mean", "std", "min", "max", *[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(("p25", "median", "p75"))], "zeros", "missing", ratio.alias("ratio"))


def rotate(x: Column, by: Column) -> Column:
    """The window turned by some places."""
    k = F.pmod(by, F.size(x)).cast("int")
    return F.concat(F.slice(x, F.size(x) - k + 1, k), F.slice(x, F.lit(1), F.size(x) - k))


def warp(x: Column, factor: Column) -> Column:
    """The window read at another speed, linear between values and flat beyond the end."""
    n = F.size(x)

    def at(_, i: Column) -> Column:
        p = F.least(i * factor, n - 1.0)
        low = F.floor(p).cast("int")
        a, b = F.get(x, low), F.get(x, F.least(low + 1, n - 1))
        return a + (b - a) * (p - low)

    return F.transform(x, at)


def _draw(key: str, seed: int):
    """Numbers between 0 and 1 that depend on key, seed and k alone."""
    return lambda k: (F.pmod(F.xxhash64(F.col(key), F.lit(seed + k)), F.lit(1 << 30)) + 0.5) / float(1 << 30)


def _normal(u1: Column, u2: Column) -> Column:
    return F.sqrt(-2 * F.ln(u1)) * F.cos(2 * 3.141592653589793 * u2)


def augment(df: DataFrame, x: str, key: str, seed: int = 0, p: float = 0.5, snr_db: float = 20.0) -> DataFrame:
    """Amplitude and noise each with probability ``p``, turn and speed each with half of it; what is drawn depends on key
    and seed alone."""
    u = _draw(key, seed)
    spread = F.sqrt(energy(F.col("_s")) / 10 ** (snr_db / 10) + 1e-10)
    noise = lambda i, k: (F.pmod(F.xxhash64(F.col(key), i, F.lit(seed + k)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    df = df.withColumn("_s", F.when(u(1) < p, F.transform(F.col(x), lambda v: v * (0.8 + 0.4 * u(2)))).otherwise(F.col(x)))
    df = df.withColumn("_s", F.when(u(3) < p, let(spread, lambda s: F.transform(F.col("_s"), lambda v, i: v + s * _normal(noise(i, 9), noise(i, 10))))).otherwise(F.col("_s")))
    df = df.withColumn("_s", F.when(u(4) < p / 2, rotate(F.col("_s"), F.floor(u(5) * 61 - 30))).otherwise(F.col("_s")))
    return df.withColumn(x, F.when(u(6) < p / 2, warp(F.col("_s"), 0.9 + 0.2 * u(7))).otherwise(F.col("_s"))).drop("_s")


def mixup(df: DataFrame, x: str, y: str, key: str, *, alpha: float = 0.3, seed: int = 0, groups: int = 64) -> DataFrame:
    """Each window with that of a partner: weight w from Beta(alpha, alpha), labels as y_a, y_b and w.

    Partners are the next in the hashed order of a bucket, so no window meets more than one. Beta draws are Johnk's: the
    first of eight pairs of powers with a sum of at most 1 (else their shares, which is nearly never needed).
    """
    from pyspark.sql import Window

    u = _draw(key, seed)
    w = Window.partitionBy("_b").orderBy("_h", key)
    tries = [F.struct(F.pow(u(100 + 2 * k), F.lit(1 / alpha)).alias("a"), F.pow(u(101 + 2 * k), F.lit(1 / alpha)).alias("b")) for k in range(8)]
    found = F.element_at(F.concat(F.filter(F.array(*tries), lambda t: t["a"] + t["b"] <= 1), F.array(tries[0])), 1)
    share = let(found, lambda t: F.coalesce(F.try_divide(t["a"], t["a"] + t["b"]), F.lit(0.5)))
    df = df.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed))).withColumn("_b", F.pmod("_h", F.lit(groups)))
    pair = F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    other = F.coalesce(F.lead(pair).over(w), F.first(pair).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    df = df.withColumn("_o", other).withColumn("weight", share)
    return df.select(key, F.zip_with(x, "_o.x", lambda a, b: F.col("weight") * a + (1 - F.col("weight")) * b).alias(x), F.col(y).alias("y_a"), F.col("_o.y").alias("y_b"), "weight")
