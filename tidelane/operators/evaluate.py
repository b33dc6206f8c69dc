"""Scores of predicted against gold intervals: per user, per class, overall, boundary errors. Undefined ratios are 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelane.operators import intervals


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def matches(pred: DataFrame, gold: DataFrame, key: str, above: float = 0.5) -> DataFrame:
    return intervals.greedy_match(intervals.candidates(pred, gold, [key, "class_idx"], above), key)


def _scored(df: DataFrame, empty_f1: float = 0.0) -> DataFrame:
    f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    none = (F.col("tp") + F.col("fp") + F.col("fn")) == 0
    return df.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")), "f1": F.when(none, F.lit(empty_f1)).otherwise(f1)})


def per_user(pred: DataFrame, gold: DataFrame, matched: DataFrame, key: str, empty_f1: float = 0.0, users: DataFrame | None = None) -> DataFrame:
    """Only users with gold intervals count, or those of ``users``; without gold and predictions F1 is ``empty_f1``."""
    count = lambda df, name: df.groupBy(key).agg(F.count(F.lit(1)).alias(name))
    golds = count(gold, "n_gold")
    spine = (golds if users is None else users.select(key).distinct().join(golds, key, "left")).join(count(pred, "n_pred"), key, "left").join(count(matched, "tp"), key, "left").na.fill(0)
    return _scored(spine.select(key, "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gold") - F.col("tp")).alias("fn")), empty_f1)


def grouped(pred: DataFrame, gold: DataFrame, matched: DataFrame, key: str) -> DataFrame:
    """The same counts by user, by class and overall in one pass of grouping sets (``level`` 1, 2, 3)."""
    rows = [df.select(key, "class_idx", *[F.lit(int(i == k)).alias(n) for k, n in enumerate(("g", "p", "m"))]) for i, df in enumerate((gold, pred.join(gold.select(key).distinct(), key, "left_semi"), matched))]
    all_ = rows[0].unionByName(rows[1]).unionByName(rows[2])
    sets = all_.groupingSets([[key], ["class_idx"], []], key, "class_idx").agg(F.grouping_id().alias("gid"), F.sum("m").alias("tp"), (F.sum("p") - F.sum("m")).alias("fp"), (F.sum("g") - F.sum("m")).alias("fn"))
    return _scored(sets.withColumn("level", F.when(F.col("gid") == 1, 1).when(F.col("gid") == 2, 2).otherwise(3)).drop("gid"))


def boundary_errors(matched: DataFrame, by: list[str]) -> DataFrame:
    """IoU and errors of starts, ends and durations in seconds, predicted minus gold."""
    start, end = (F.col("p0") - F.col("g0")) / 1000.0, (F.col("p1") - F.col("g1")) / 1000.0
    aggs = [
        F.count(F.lit(1)).alias("n"), F.avg("iou").alias("mean_iou"), F.median("iou").alias("median_iou"), F.avg(F.abs(start)).alias("start_mae"), F.avg(F.abs(end)).alias("end_mae"),
        F.avg(start).alias("start_bias"), F.avg(end).alias("end_bias"), F.avg(F.abs(end - start)).alias("duration_mae"),
    ]
    return matched.groupBy(*by).agg(*aggs) if by else matched.agg(*aggs)


def correct_rows(pred: DataFrame, matched: DataFrame, key: str) -> DataFrame:
    hit = matched.select(key, "pred_id", F.lit(1).alias("hit"))
    return pred.join(hit, [key, "pred_id"], "left").withColumn("correct", F.coalesce("hit", F.lit(0))).drop("hit")


def eligible(found: DataFrame, least_ms: int, ignored: tuple = ()) -> DataFrame:
    """Intervals that count in an evaluation: long enough, and of no class in ``ignored``."""
    out = found.where(F.col("end_ms") - F.col("start_ms") >= least_ms)
    return out.where(~F.col("class_idx").isin(*ignored)) if ignored else out


def record_scores(pred: DataFrame, gold: DataFrame, spans: DataFrame, key: str, *, least_ms: int = 0, ignored: tuple = (), above: float = 0.5) -> DataFrame:
    """One row: tp, fp, fn, F1, mean IoU and boundary error (s) of the matches, false and all records per hour.

    ``spans`` has the recorded time of each key in ms (span_ms). Means without a match are null.
    """
    p, g = eligible(pred, least_ms, ignored), eligible(gold, least_ms, ignored)
    error = F.avg((F.abs(F.col("p0") - F.col("g0")) + F.abs(F.col("p1") - F.col("g1"))) / 2) / 1000
    hit = matches(p, g, key, above).agg(F.count(F.lit(1)).alias("tp"), F.avg("iou").alias("miou"), error.alias("boundary_mae_s"))
    counts = [df.agg(F.count(F.lit(1)).alias(n)) for df, n in ((p, "n_pred"), (g, "n_gold"))]
    hours = spans.agg((F.sum("span_ms") / 3.6e6).alias("hours"))
    row = hit.join(counts[0]).join(counts[1]).join(hours)  # one row each
    row = row.select("tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gold") - F.col("tp")).alias("fn"), "miou", "boundary_mae_s", "n_pred", "hours")
    return row.select("tp", "fp", "fn", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), "miou", "boundary_mae_s", ratio(F.col("fp"), F.col("hours")).alias("fp_per_hour"), ratio(F.col("n_pred"), F.col("hours")).alias("records_per_hour"))
