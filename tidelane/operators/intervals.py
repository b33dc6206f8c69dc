"""Interval joins and matching. Joins are equi-joins on the key (and a time bucket where intervals are long)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidelane import shipping


def label_points(points: DataFrame, labels: DataFrame, key: str, time: str, point_id: list[str], *, state: str = "state", background: int = 0, bucket_ms: int = 86_400_000) -> DataFrame:
    """The class of the last label row (by ``row_no``) whose closed interval holds each point; else ``background``.

    Labels are copied to the time buckets they touch, so the join is by key and bucket whatever a label's length.
    """
    touched = F.explode(F.sequence(F.floor(F.col("start_ms") / bucket_ms), F.floor(F.col("end_ms") / bucket_ms)))
    cut = labels.where("start_ms <= end_ms").select(F.col(key).alias("_k"), "start_ms", "end_ms", F.col(state).alias("_state"), "row_no", touched.alias("_b"))
    held = points.withColumn("_pb", F.floor(F.col(time) / bucket_ms)).withColumn("_row", F.monotonically_increasing_id())  # repeated points stay apart
    joined = held.join(cut, (held[key] == cut["_k"]) & (held["_pb"] == cut["_b"]) & (F.col(time) >= F.col("start_ms")) & (F.col(time) <= F.col("end_ms")), "left")
    return joined.groupBy(*points.columns, "_row").agg(F.coalesce(F.max_by("_state", "row_no"), F.lit(background)).cast("int").alias("label")).drop("_row")


def slices(points: DataFrame, labels: DataFrame, key: str, time: str, *, bucket_ms: int = 86_400_000) -> DataFrame:
    """Every (label row, point) pair with the point in the closed interval."""
    touched = F.explode(F.sequence(F.floor(F.col("start_ms") / bucket_ms), F.floor(F.col("end_ms") / bucket_ms)))
    cut = labels.where("start_ms <= end_ms").withColumnRenamed(key, "_k").withColumn("_b", touched)
    held = points.withColumn("_pb", F.floor(F.col(time) / bucket_ms))
    joined = held.join(cut, (held[key] == cut["_k"]) & (held["_pb"] == cut["_b"]) & (F.col(time) >= F.col("start_ms")) & (F.col(time) <= F.col("end_ms")))
    return joined.drop("_k", "_b", "_pb")


def iou(a0, a1, b0, b1) -> Column:
    """Overlap over hull of two intervals; 0 without a hull."""
    inside = F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))
    hull = F.greatest(a1, b1) - F.least(a0, b0)
    return F.when(hull > 0, inside / hull).otherwise(0.0)


def candidates(pred: DataFrame, gold: DataFrame, keys: list[str], above: float = 0.5, *, bucket_ms: int = 86_400_000) -> DataFrame:
    """Pairs of predicted and gold intervals (pred_id, gold_id) with the same keys and an IoU over ``above``.

    Both are copied to the time buckets they touch; a pair counts in the first bucket that both touch.
    """
    bucket = lambda c: F.floor(F.col(c) / bucket_ms)
    p = pred.select(*keys, "pred_id", F.col("start_ms").alias("p0"), F.col("end_ms").alias("p1")).where("p0 <= p1").withColumn("_b", F.explode(F.sequence(bucket("p0"), bucket("p1"))))
    g = gold.select(*keys, "gold_id", F.col("start_ms").alias("g0"), F.col("end_ms").alias("g1")).where("g0 <= g1").withColumn("_b", F.explode(F.sequence(bucket("g0"), bucket("g1"))))
    pairs = p.join(g, [*keys, "_b"]).where((F.col("p0") < F.col("g1")) & (F.col("g0") < F.col("p1")) & (F.col("_b") == F.greatest(bucket("p0"), bucket("g0")))).drop("_b")
    return pairs.withColumn("iou", iou(F.col("p0"), F.col("p1"), F.col("g0"), F.col("g1"))).where(F.col("iou") > above)


def greedy_match(pairs: DataFrame, key: str, *, ties: str = "asc") -> DataFrame:
    """One-to-one matches by falling IoU. Where pairs don't compete, as with disjoint intervals, they pass in SQL;
    only competing ones of a key go through a sequential choice."""
    by_pred, by_gold = Window.partitionBy(key, "pred_id"), Window.partitionBy(key, "gold_id")
    marked = pairs.withColumn("_n", F.greatest(F.count(F.lit(1)).over(by_pred), F.count(F.lit(1)).over(by_gold)))
    marked = marked.withColumn("_n", F.max("_n").over(Window.partitionBy(key)))
    alone = marked.where("_n = 1").drop("_n")
    up = ties == "asc"

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["iou", "pred_id", "gold_id"], ascending=[False, up, up], ignore_index=True)
        preds, golds, keep = set(), set(), []
        for p, g in zip(frame["pred_id"], frame["gold_id"], strict=True):
            keep.append(p not in preds and g not in golds)
            if keep[-1]:
                preds.add(p)
                golds.add(g)
        return frame[keep]

    contested = marked.where("_n > 1").drop("_n")
    shipping.ship(alone.sparkSession)
    return alone.unionByName(contested.groupBy(key).applyInPandas(choose, contested.schema))


def align_linear(grid: DataFrame, samples: DataFrame, key: str, time: str, x: str, name: str) -> DataFrame:
    """``x`` of ``samples`` interpolated linearly at the times of ``grid``; flat outside their range."""
    both = grid.select(key, time, F.lit(None).cast("double").alias(x), F.lit(1).alias("_g")).unionByName(samples.select(key, time, F.col(x).cast("double").alias(x), F.lit(0).alias("_g")))
    at = F.when(F.col("_g") == 0, F.struct(F.col(time).alias("t"), F.col(x).alias("x")))
    w = Window.partitionBy(key).orderBy(time, "_g")
    both = both.withColumn("_at", at)
    both = both.withColumn("_a", F.last("_at", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_b", F.first("_at", True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    line = F.col("_a.x") + (F.col("_b.x") - F.col("_a.x")) * (F.col(time) - F.col("_a.t")) / F.nullif(F.col("_b.t") - F.col("_a.t"), F.lit(0))
    exact = F.when(F.col("_a.t") == F.col(time), F.col("_a.x"))
    return both.where("_g = 1").select(key, time, F.coalesce(exact, line, F.col("_a.x"), F.col("_b.x")).alias(name))


def band(points: DataFrame, centers: DataFrame, key: str, time: str, center: str, half_ms: int) -> DataFrame:
    """Points within a closed band around each centre; buckets as wide as the band give the join a second key."""
    width = 2 * half_ms
    near = centers.withColumnRenamed(key, "_k").withColumn("_b", F.explode(F.sequence(F.floor((F.col(center) - half_ms) / width), F.floor((F.col(center) + half_ms) / width))))
    held = points.withColumn("_pb", F.floor(F.col(time) / width))
    return held.join(near, (held[key] == near["_k"]) & (held["_pb"] == near["_b"]) & (F.abs(F.col(time) - F.col(center)) <= half_ms)).drop("_k", "_b", "_pb")


def around_middle(points: DataFrame, found: DataFrame, key: str, time: str, *, half_ms: int = 2500, rows: int = 500) -> DataFrame:
    """Of each interval (``seg_id`` within a key) the points within ``half_ms`` of its middle; where there are none, its
    first ``rows`` points."""
    inside = slices(points, found, key, time)
    middle = (F.col("start_ms") + F.col("end_ms")) / 2
    w = Window.partitionBy(key, "seg_id")
    near = inside.withColumn("_near", F.abs(F.col(time) - middle) <= half_ms).withColumn("_any", F.max("_near").over(w)).withColumn("_k", F.row_number().over(w.orderBy(time)))
    return near.where(F.col("_near") | (~F.col("_any") & (F.col("_k") <= rows))).drop("_near", "_any", "_k")
