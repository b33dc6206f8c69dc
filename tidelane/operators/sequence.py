"""Ordered operators on per-key sequences, as window expressions: one sort by key serves them all.

Each takes a column, and the key and order columns; edges are those of the key's own sequence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _w(key, order):
    return Window.partitionBy(key).orderBy(*([order] if isinstance(order, (str, Column)) else order))


def place(key, order) -> Column:
    """Place in the sequence, from 0."""
    return F.row_number().over(_w(key, order)) - 1


def size(key) -> Column:
    return F.count(F.lit(1)).over(Window.partitionBy(key))


def moving_average(x, key, order, width: int) -> Column:
    """Mean over ``width`` places, the ends repeated outwards. Even widths reach one place further back than ahead."""
    back, ahead = width // 2, width - 1 - width // 2
    w = _w(key, order)
    whole = Window.partitionBy(key).orderBy(*([order] if isinstance(order, (str, Column)) else order)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    i, n = place(key, order), size(key)
    total = F.sum(x).over(w.rowsBetween(-back, ahead))
    total = total + F.greatest(F.lit(0), F.lit(back) - i) * F.first(x).over(whole) + F.greatest(F.lit(0), i + F.lit(ahead) - (n - 1)) * F.last(x).over(whole)
    return total / F.lit(float(width))


def _framed(x, key, order, width: int, pad: str) -> Column:
    """Sorted array of the ``width`` values around a place; outside are zeros or repeated ends."""
    width += pad == "zero" and width % 2 == 0
    back, ahead = width // 2, width - 1 - width // 2
    w = _w(key, order)
    inside = F.collect_list(x).over(w.rowsBetween(-back, ahead))
    i, n = place(key, order), size(key)
    if pad == "zero":
        return F.sort_array(F.concat(inside, F.array_repeat(F.lit(0.0), (F.lit(width) - F.size(inside)).cast("int"))))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, after = F.greatest(F.lit(0), F.lit(back) - i).cast("int"), F.greatest(F.lit(0), i + F.lit(ahead) - (n - 1)).cast("int")
    return F.sort_array(F.concat(F.array_repeat(F.first(x).over(whole), before), inside, F.array_repeat(F.last(x).over(whole), after)))


def median_filter(x, key, order, width: int, pad: str = "zero") -> Column:
    """Running median. ``zero`` pads with zeros (even widths grow by one); ``edge`` repeats the ends."""
    sorted_ = _framed(x, key, order, width, pad)
    n = width + (pad == "zero" and width % 2 == 0)
    return F.get(sorted_, F.lit(n // 2)) if n % 2 else (F.get(sorted_, F.lit(n // 2 - 1)) + F.get(sorted_, F.lit(n // 2))) / 2


def gradient(x, key, order) -> Column:
    """Central differences, one-sided at the ends; 0 for a single value."""
    w = _w(key, order)
    before, after = F.lag(x).over(w), F.lead(x).over(w)
    sides = before.isNotNull().cast("int") + after.isNotNull().cast("int")
    here = F.col(x) if isinstance(x, str) else x
    return F.when(sides == 0, 0.0).otherwise((F.coalesce(after, here) - F.coalesce(before, here)) / sides)


def change(state, key, order) -> Column:
    """1 where a run of equal states begins."""
    return F.coalesce((F.lag(state).over(_w(key, order)) != F.col(state)).cast("int"), F.lit(1))


def run_id(state, key, order) -> Column:
    """Number of the run of equal states that a row is in, from 1. Needs ``change`` as a column named ``chg``."""
    return F.sum("chg").over(_w(key, order).rowsBetween(Window.unboundedPreceding, 0))


def runs(df: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """``df`` with ``run_id``."""
    return df.withColumn("chg", change(state, key, order)).withColumn("run_id", run_id(state, key, order)).drop("chg")


def boundary_mask(state, key, order, reach: int = 3) -> Column:
    """Nearness to a change of state: 1 within ``reach`` places of one, then a three-place mean. ``df`` needs ``mark``, see ``with_boundary``."""
    return F.max("chg").over(_w(key, order).rowsBetween(-reach, reach))


def with_boundary(df: DataFrame, key: str, order: list[str], state: str, reach: int = 3, smooth: int = 3, name: str = "boundary") -> DataFrame:
    w = _w(key, order)
    marked = df.withColumn("chg", F.coalesce((F.lag(state).over(w) != F.col(state)).cast("double"), F.lit(0.0)))
    marked = marked.withColumn("mark", F.max("chg").over(w.rowsBetween(-reach, reach)))
    return marked.withColumn(name, F.least(F.lit(1.0), F.greatest(F.lit(0.0), moving_average("mark", key, order, smooth)))).drop("chg", "mark")


def count_windows(df: DataFrame, key: str, order: list[str], width: int, step: int) -> DataFrame:
    """A row for each (window, row) pair: ``win_id`` from 0 and ``i``, the row's place. Windows count rows, not time.

    Each row lies in at most ceil(width / step) windows, so rows are multiplied by that and nothing is joined.
    """
    placed = df.withColumn("i", place(key, order)).withColumn("n", size(key)).where(F.col("n") >= width)
    lowest = F.greatest(F.lit(0), F.ceil((F.col("i") - width + 1) / F.lit(float(step)))).cast("long")
    highest = F.least(F.floor((F.col("n") - width) / F.lit(float(step))), F.floor(F.col("i") / F.lit(float(step)))).cast("long")
    return placed.withColumn("lo", lowest).withColumn("hi", highest).where("lo <= hi").withColumn("win_id", F.explode(F.sequence("lo", "hi"))).drop("lo", "hi", "n")


def last_n(df: DataFrame, key: str, order: list, n: int) -> DataFrame:
    """The last ``n`` rows of each key; ``order`` runs from newest to oldest."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def budget_gate(df: DataFrame, key: str, order: list, amount: str, cap: float) -> DataFrame:
    """Rows of each key while what came before is under ``cap`` (so the last may overshoot); all where cap <= 0."""
    if cap <= 0:
        return df
    before = F.coalesce(F.sum(amount).over(_w(key, order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return df.withColumn("_before", before).where(F.col("_before") < cap).drop("_before")


def median_period(df: DataFrame, key: str, order: str, time: str, name: str = "period") -> DataFrame:
    """Median of the positive steps of ``time`` for each key."""
    steps = df.withColumn("_d", F.col(time) - F.lag(time).over(_w(key, order)))
    return steps.groupBy(key).agg(F.median(F.when(F.col("_d") > 0, F.col("_d"))).alias(name))


def interpolate(df: DataFrame, key: str, order: list[str], x: str, name: str) -> DataFrame:
    """Gaps of ``x`` filled linearly by place; ends extended flat; then the key's median, then 0."""
    w = _w(key, order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    df = df.withColumn("_i", place(key, order)).withColumn("_at", F.when(F.col(x).isNotNull(), F.col("_i")))
    df = df.withColumns({"_a": F.last(x, True).over(back), "_ia": F.last("_at", True).over(back), "_b": F.first(x, True).over(ahead), "_ib": F.first("_at", True).over(ahead)})
    line = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_i") - F.col("_ia")) / F.nullif(F.col("_ib") - F.col("_ia"), F.lit(0))
    filled = F.coalesce(F.col(x), line, F.col("_a"), F.col("_b"), F.median(x).over(Window.partitionBy(key)), F.lit(0.0))
    return df.withColumn(name, filled).drop("_i", "_at", "_a", "_ia", "_b", "_ib")


def hold(x, key, order) -> Column:
    """The last known value at or before a row."""
    return F.last(x, ignorenulls=True).over(_w(key, order).rowsBetween(Window.unboundedPreceding, 0))


def renormalised(columns: list[str]) -> dict[str, Column]:
    """Class columns over their sum; the same share for all where that isn't above 0."""
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    return {c: F.when(total <= 0, 1.0 / len(columns)).otherwise(F.try_divide(F.col(c), total)) for c in columns}


def smoothed_shares(df: DataFrame, key, order, columns: list[str], *, average: int = 1, median: int = 1) -> DataFrame:
    """Class columns by moving average, then by running median, edges repeated; each followed by renormalising."""
    for width, f in ((average, lambda c, n: moving_average(c, key, order, n)), (median, lambda c, n: median_filter(c, key, order, n, "edge"))):
        if width > 1:
            df = df.withColumns({c: f(c, width) for c in columns})
            df = df.withColumns(renormalised(columns))
    return df


def synthetic_time(key, order, step_ms: int = 10) -> Column:
    """Arrival place times the nominal step, for samples whose own times can't be used."""
    return place(key, order) * step_ms


def running_totals(df: DataFrame, by: str, columns: list[str], ranges: int = 64) -> DataFrame:
    """Adds <column>_below, the sum over all rows with a smaller ``by``. Rows have distinct ``by``.

    Values are cut into ranges at approximate quantiles (one small row); sums run within a range and begin at the total of
    the ranges before it, so no task has all values.
    """
    cuts = df.agg(F.percentile_approx(by, F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), 10_000).alias("_cuts"))
    ranged = df.join(F.broadcast(cuts)).withColumn("_range", F.size(F.filter("_cuts", lambda c: c <= F.col(by)))).drop("_cuts")
    totals = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_{c}") for c in columns])  # a row a range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_range", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in columns])
    within = Window.partitionBy("_range").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(starts), "_range")
    return out.withColumns({f"{c}_below": F.col(f"_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0)) for c in columns}).drop("_range", *[f"_{c}" for c in columns])
