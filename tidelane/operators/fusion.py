"""Fusion of class probabilities from several scales. Input: key columns, and one array per scale (columns named p3, p5, p8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane.operators import sequence

#: Weights of the scales in the fixed modes, and base weights and shifts of the local mode.
FIXED = {"weighted_long": (0.15, 0.30, 0.55), "weighted_balanced": (0.25, 0.35, 0.40)}
BASE, SHIFT = (0.20, 0.35, 0.45), (0.30, -0.08, -0.22)


def argmax(p: Column) -> Column:
    """Class of the largest probability; the first of equals."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def top(p: Column, k: int = 1) -> Column:
    return F.element_at(F.sort_array(p, False), k)


def margin(p: Column) -> Column:
    return top(p) - top(p, 2)


def let(x: Column, f) -> Column:
    """``f`` of ``x``, which is evaluated once however often ``f`` uses it inside lambdas."""
    return F.element_at(F.transform(F.array(x), f), 1)


def softmax(z: Column) -> Column:
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda a, b: a + b)
    return let(F.array_max(z), lambda m: let(F.transform(z, lambda v: F.exp(v - m)), lambda e: let(total(e), lambda s: F.transform(e, lambda v: v / s))))


def _times(w: Column):
    return lambda v: v * w


def weighted(scales: list[str], weights: list[Column]) -> Column:
    """Weighted mean of the scales' arrays, weights renormalised."""
    total = weights[0]
    for w in weights[1:]:
        total = total + w
    scaled = [F.transform(F.col(s), _times(w / total)) for s, w in zip(scales, weights, strict=True)]
    out = scaled[0]
    for x in scaled[1:]:
        out = F.zip_with(out, x, lambda a, b: a + b)
    return out


def average(scales: list[str]) -> Column:
    return weighted(scales, [F.lit(1.0)] * len(scales))


def fixed(scales: list[str], mode: str) -> Column:
    return weighted(scales, [F.lit(x) for x in FIXED[mode]])


def local_boundary(df: DataFrame, key: str, order: list[str], *, base: tuple = BASE, shift: tuple = SHIFT, least: float = 0.05, name: str = "fused") -> DataFrame:
    """Near a change of the short scale's class, weight moves from the long scales to the short one."""
    df = sequence.with_boundary(df.withColumn("_c", argmax(F.col("p3"))), key, order, "_c", name="_m")
    weights = [F.greatest(F.lit(least), F.lit(b) + F.lit(s) * F.col("_m")) for b, s in zip(base, shift, strict=True)]
    return df.withColumn(name, weighted(["p3", "p5", "p8"], weights)).drop("_c", "_m")


def _disagree() -> Column:
    """1 minus the largest share of the three scales' votes."""
    a, b, c = (argmax(F.col(p)) for p in ("p3", "p5", "p8"))
    same = (a == b).cast("int") + (a == c).cast("int") + (b == c).cast("int")
    return F.when(same == 3, 0.0).when(same == 1, 1 - 2 / 3).otherwise(1 - 1 / 3)


def dynamic_boundary(df: DataFrame, key: str, order: list[str], name: str = "fused") -> DataFrame:
    """A boundary score from class changes, a small margin, fast movement and disagreement moves the weights."""
    w = Window.partitionBy(key).orderBy(*order)
    df = df.withColumn("_c", argmax(F.col("p3")))
    before = F.lag("p3").over(w)
    move = F.when(before.isNotNull(), F.aggregate(F.zip_with("p3", before, lambda a, b: F.abs(a - b)), F.lit(0.0), lambda a, b: a + b) / F.size("p3")).otherwise(0.0)
    df = df.withColumn("_v", move).withColumn("_e", sequence.moving_average("_v", key, order, 5))
    changed = F.greatest(F.coalesce((F.lag("_c").over(w) != F.col("_c")).cast("double"), F.lit(0.0)), F.coalesce((F.lead("_c").over(w) != F.col("_c")).cast("double"), F.lit(0.0)))
    clip = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    df = df.withColumn("_s", F.greatest(changed, clip((0.18 - margin(F.col("p3"))) / 0.18), clip(F.col("_e") / 0.12), _disagree()))
    s = F.col("_s")
    weights = [F.lit(BASE[0]) + 0.35 * s, F.lit(BASE[1]) + 0.05 * (1 - F.abs(2 * s - 1)), F.lit(BASE[2]) - 0.30 * s]
    return df.withColumn(name, weighted(["p3", "p5", "p8"], [F.greatest(F.lit(0.05), x) for x in weights])).drop("_c", "_v", "_e", "_s")


def confident_conflict(df: DataFrame, key: str, order: list[str], name: str = "fused") -> DataFrame:
    """Where the scales disagree and the short one is clearly surer, it gains weight."""
    m3, m5, m8 = (margin(F.col(p)) for p in ("p3", "p5", "p8"))
    gate = (_disagree() > 0) & (m3 >= 0.12) & (m3 - F.least(m5, m8) >= 0.05) & (top(F.col("p3")) - F.least(top(F.col("p5")), top(F.col("p8"))) >= 0.03)
    df = df.withColumn("_g", gate.cast("double")).withColumn("_s", sequence.moving_average("_g", key, order, 3))
    weights = [F.greatest(F.lit(0.05), F.lit(b) + F.lit(x) * F.col("_s")) for b, x in zip(BASE, (0.28, -0.08, -0.20), strict=True)]
    return df.withColumn(name, weighted(["p3", "p5", "p8"], weights)).drop("_g", "_s")


FUSIONS = {
    "average": lambda df, key, order: df.withColumn("fused", average(["p3", "p5", "p8"])),
    "weighted_long": lambda df, key, order: df.withColumn("fused", fixed(["p3", "p5", "p8"], "weighted_long")),
    "weighted_balanced": lambda df, key, order: df.withColumn("fused", fixed(["p3", "p5", "p8"], "weighted_balanced")),
    "local_boundary": local_boundary, "dynamic_boundary": dynamic_boundary, "confident_conflict": confident_conflict,
}


def fuse(df: DataFrame, key: str, order: list[str], mode: str = "local_boundary") -> DataFrame:
    """Adds ``fused``; unknown modes average."""
    return FUSIONS.get(mode, FUSIONS["average"])(df, key, order)


def _mean(probs: Column, classes: int) -> Column:
    """Aggregate: mean of arrays place by place, null where there is none. Sums of fixed length, which aggregate where the
    rows are; collected or exploded places would be sorted and spilled."""
    n = F.max(F.size(probs))
    return F.when(n > 0, F.slice(F.array(*[F.avg(F.get(probs, F.lit(c))) for c in range(classes)]).cast("array<double>"), 1, n))


def ensemble(df: DataFrame, keys: list[str], probs: str = "probs") -> DataFrame:
    """Mean probabilities of several models' rows (one per model) of each window."""
    classes = max(0, df.agg(F.max(F.size(probs))).first()[0] or 0)
    return df.groupBy(*keys).agg(_mean(F.col(probs), classes).alias(probs)).where(F.col(probs).isNotNull())


def orchestrate(df: DataFrame, key: str, order: list[str], mode: str = "local_boundary") -> DataFrame:
    """From rows (key, order, scale, model, probs) to ``fused``: models averaged within a scale; scales without a row fall
    away. All three are fused by ``mode``, fewer are averaged, one stays as it is."""
    of = {s: F.when(F.col("scale") == s, F.col("probs")) for s in ("p3", "p5", "p8")}
    sizes = df.agg(*[F.max(F.size(p)).alias(s) for s, p in of.items()]).first()
    there = {s: (sizes[s] or 0) > 0 for s in of}
    wide = df.groupBy(key, *order).agg(*[_mean(p, max(0, sizes[s] or 0)).alias(s) for s, p in of.items()])
    have = [s for s in ("p3", "p5", "p8") if there[s]]
    if len(have) == 3:
        whole = wide.where(F.col("p3").isNotNull() & F.col("p5").isNotNull() & F.col("p8").isNotNull())
        return fuse(whole, key, order, mode)
    some = wide.where(" OR ".join(f"{s} IS NOT NULL" for s in have) or "false")
    if len(have) == 2:
        both = F.zip_with(*have, lambda a, b: (a + b) / 2)
        return some.withColumn("fused", F.coalesce(both, *have))
    return some.withColumn("fused", F.col(have[0]) if have else F.lit(None).cast("array<double>"))
