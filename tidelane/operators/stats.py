"""Statistics: calibration, ranks, cohorts, distribution shift, paired effects, bootstrap, completeness."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane import storage
from tidelane.operators import sequence

EDGE = 1e-6


def calibration_bins(df: DataFrame, p: str, y: str, bins: int = 5) -> DataFrame:
    """Equal bins, closed on the left (the last on both sides); probabilities clipped away from 0 and 1."""
    clipped = F.least(F.lit(1 - EDGE), F.greatest(F.lit(EDGE), F.col(p)))
    b = F.least(F.lit(bins - 1), F.floor(clipped * bins)).cast("int")
    return df.select(clipped.alias("p"), F.col(y).cast("double").alias("y"), b.alias("bin")).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("rate"))


def calibration_summary(df: DataFrame, p: str, y: str, bins: int = 5) -> DataFrame:
    """ECE, MCE, Brier score, negative log-likelihood and gap."""
    binned = calibration_bins(df, p, y, bins).agg(
        (F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n")).alias("ece"), F.max(F.abs(F.col("mean_p") - F.col("rate"))).alias("mce")
    )
    q, t = F.least(F.lit(1 - EDGE), F.greatest(F.lit(EDGE), F.col(p))), F.col(y).cast("double")
    whole = df.agg(F.avg((q - t) * (q - t)).alias("brier"), F.avg(-(t * F.ln(q) + (1 - t) * F.ln(1 - q))).alias("nll"), (F.avg(q) - F.avg(t)).alias("gap"), F.count(F.lit(1)).alias("n"))
    return binned.join(F.broadcast(whole))  # one row each


def rank_auroc(df: DataFrame, score: str, y: str) -> DataFrame:
    """Mann-Whitney AUROC with average ranks; 0 with one class only. Ranks are sums over distinct scores, in ranges."""
    by = df.groupBy(score).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("pos"))
    ranked = sequence.running_totals(by, score, ["n"]).withColumnRenamed("n_below", "below")
    total = ranked.agg(F.sum(F.col("pos") * (F.col("below") + (F.col("n") + 1) / 2.0)).alias("r"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    return total.select(F.when((F.col("p") == 0) | (F.col("q") == 0), 0.0).otherwise((F.col("r") - F.col("p") * (F.col("p") + 1) / 2.0) / (F.col("p") * F.col("q"))).alias("auroc"))


def js_distance(df: DataFrame, side: str, category: str) -> DataFrame:
    """Jensen-Shannon distance (base 2) between the category shares of side 'a' and side 'b'."""
    counts = df.groupBy(category).agg(*[F.sum((F.col(side) == s).cast("double")).alias(s) for s in ("a", "b")])
    total = Window.partitionBy()
    share = counts.select(*[(F.col(s) / F.sum(s).over(total) + 1e-12).alias(s) for s in ("a", "b")])
    m = (F.col("a") + F.col("b")) / 2
    return share.agg(F.sqrt(F.greatest(F.lit(0.0), F.sum((F.col("a") * F.log2(F.col("a") / m) + F.col("b") * F.log2(F.col("b") / m)) / 2))).alias("js"))


def ks_statistic(df: DataFrame, side: str, x: str) -> DataFrame:
    """Largest distance of the two empirical distributions, and its asymptotic p-value."""
    counts = df.groupBy(x).agg(*[F.sum((F.col(side) == s).cast("double")).alias(s) for s in ("a", "b")])
    whole = counts.agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    up = sequence.running_totals(counts, x, ["a", "b"]).join(F.broadcast(whole))  # one row
    gap = F.abs((F.col("a_below") + F.col("a")) / F.col("na") - (F.col("b_below") + F.col("b")) / F.col("nb"))
    return up.select(gap.alias("gap"), "na", "nb").agg(F.max("gap").alias("ks"), F.first("na").alias("na"), F.first("nb").alias("nb")).select("ks", kolmogorov_p(F.col("ks"), F.col("na"), F.col("nb")).alias("p_value"))


def kolmogorov_p(statistic: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p-value of a Kolmogorov-Smirnov statistic: the alternating series, between 0 and 1."""
    t2 = statistic * statistic * n * m / (n + m)
    odd = lambda k: F.when(k % 2 == 1, 1.0).otherwise(-1.0)
    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda a, k: a + odd(k) * F.exp(-2.0 * k * k * t2))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2 * total))


#: Pairs up to which signed ranks are tested by their exact null distribution, if none are tied or zero.
EXACT_PAIRS = 50


def normal_tail(z: Column, terms: int = 200) -> Column:
    """Probability of a standard normal value over ``z``: the odd series about 0; beyond 8 on either side as at 8."""
    x = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    step = lambda a, k: F.struct((a["term"] * x * x / (2 * k + 1)).alias("term"), (a["sum"] + a["term"] * x * x / (2 * k + 1)).alias("sum"))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.struct(x.alias("term"), x.alias("sum")), step)["sum"]
    return F.greatest(F.lit(0.0), 0.5 - series * F.exp(-x * x / 2) / F.sqrt(F.lit(2 * np.pi)))


def signed_rank_tail(n: Column, w: Column) -> Column:
    """Probability that signed ranks 1 to ``n`` sum to ``w`` or more: subsets by sum, one rank after another."""
    sums = F.sequence(F.lit(0), F.lit(EXACT_PAIRS * (EXACT_PAIRS + 1) // 2))
    start = F.transform(sums, lambda s: F.when(s == 0, 1.0).otherwise(0.0))
    ways = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), start, lambda a, k: F.transform(a, lambda v, s: v + F.when(s >= k, F.get(a, s - k)).otherwise(0.0)))
    return F.aggregate(F.transform(ways, lambda v, s: F.when(s >= w, v).otherwise(0.0)), F.lit(0.0), lambda a, v: a + v) / F.pow(F.lit(2.0), n)


def paired_effect(df: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's d of the paired difference (0 without spread), Wilcoxon's W+ (zeros left out, average ranks) and the one-sided
    p-value that a is over b: exact up to 50 pairs without ties or zeros, else normal with ties corrected."""
    diff = df.select((F.col(a) - F.col(b)).alias("d"))
    whole = diff.agg(F.count("d").alias("n"), F.avg("d").alias("mean_diff"), F.coalesce(F.stddev_samp("d"), F.lit(0.0)).alias("sd"))
    by = diff.where("d <> 0").groupBy(F.abs("d").alias("m")).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("d") > 0).cast("long")).alias("up"))
    rank = F.col("n_below") + (F.col("n") + 1) / 2.0
    ranked = sequence.running_totals(by, "m", ["n"]).select((rank * F.col("up")).alias("r"), "n", (F.pow(F.col("n").cast("double"), 3) - F.col("n")).alias("t"))
    plus = ranked.agg(F.coalesce(F.sum("r"), F.lit(0.0)).alias("w_plus"), F.coalesce(F.sum("n"), F.lit(0)).alias("k"), F.coalesce(F.sum("t"), F.lit(0.0)).alias("ties"))
    d = F.when(F.col("sd") < 1e-12, 0.0).otherwise(F.col("mean_diff") / F.col("sd"))
    k, w = F.col("k").cast("double"), F.col("w_plus")
    spread = F.sqrt(k * (k + 1) * (2 * k + 1) / 24 - F.col("ties") / 48)
    near = normal_tail(F.coalesce(F.try_divide(w - k * (k + 1) / 4, spread), F.lit(0.0)))
    exact = (F.col("k") <= EXACT_PAIRS) & (F.col("ties") == 0) & (F.col("k") == F.col("n"))
    p = F.when(F.col("k") == 0, 1.0).when(exact, signed_rank_tail(F.col("k"), w)).otherwise(near)
    return whole.join(F.broadcast(plus)).select("n", "mean_diff", d.alias("cohen_d"), "w_plus", p.alias("p_value"))  # one row each


#: Whole values in these parts keep sums of resamples exact. Draws of a task, on average at most.
PARTS, DRAWS = 1_000_000_000, 5_000_000


def poisson_limits() -> list[int]:
    """Of 2^32 equally likely numbers, how many lie below each count of a Poisson variable of mean 1."""
    out, term, total = [], math.exp(-1), 0.0
    for k in range(13):
        total += term
        term /= k + 1
        out.append(min(1 << 32, int(total * (1 << 32))))
    return out


def bootstrap_ci(df: DataFrame, x: str, key: str, *, resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """mean and the 2.5 and 97.5 percentiles of resampled means, in one plan.

    A row's weight in a resample is a Poisson count of mean 1, drawn by the digest of (seed, resample, key): rows need
    neither be numbered nor brought together. Rows are written once and dealt to tasks by their number of draws. Sums are of
    whole parts and aggregate before they are shuffled; what is gathered are the resamples' means. An empty table gives no row.
    """
    rows = df.where(F.col(x).isNotNull()).select(F.col(key).cast("string").alias("_key"), F.floor(F.col(x) * PARTS + 0.5).cast("long").alias("_x"))
    rows = storage.materialize(rows, "resampled")
    tasks = max(1, -(-rows.count() * resamples // DRAWS))
    each = rows.repartition(tasks).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    # The digest's first eight hexadecimal digits are the number; they compare as text like the numbers do. No filter on
    # the weight: pushed below, it would make every digest anew for each of its comparisons.
    limits, weight = [t for t in poisson_limits() if t < 1 << 32], F
    for k, t in enumerate(limits):
        weight = weight.when(F.col("_u") < f"{t:08x}", k)
    drawn = each.withColumn("_u", F.md5(F.concat_ws(":", F.lit(str(seed)), "_b", "_key"))).withColumn("_w", weight.otherwise(len(limits)).cast("long"))
    means = drawn.groupBy("_b").agg((F.try_divide(F.sum(F.col("_w") * F.col("_x")), F.sum("_w")) / PARTS).alias("m")).where(F.col("m").isNotNull())
    whole = rows.agg((F.sum("_x") / F.count("_x") / PARTS).alias("mean")).where(F.col("mean").isNotNull())
    ends = means.agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
    return whole.join(F.broadcast(ends))  # one row each


def variance_ratio(df: DataFrame, group: str, x: str) -> DataFrame:
    """Between-class over within-class sums of squares."""
    by = df.groupBy(group).agg(F.count(x).alias("n"), F.avg(x).alias("mu"), F.var_pop(x).alias("v"))
    overall = F.sum(F.col("n") * F.col("mu")) / F.sum("n")
    total = by.agg(F.sum(F.col("n") * F.col("mu") * F.col("mu")).alias("q"), overall.alias("o"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("within"))
    return total.select(F.coalesce(F.try_divide(F.col("q") - F.col("n") * F.col("o") * F.col("o"), F.col("within")), F.lit(0.0)).alias("ratio"))
