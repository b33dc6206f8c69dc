"""Segments: from runs to merged, resolved, ranked intervals. Times are milliseconds, durations seconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelane.operators import sequence


def from_states(df: DataFrame, key: str, order: list[str], state: str, prob: str, time: str, pad_ms: int) -> DataFrame:
    """A segment per run of a state above 0: padded ends, mean probability as confidence, first and last place."""
    run = sequence.runs(df.withColumn("_i", sequence.place(key, order)), key, order, state)
    out = run.groupBy(key, "run_id").agg(
        F.first(state).alias("class_idx"), (F.min(time) - pad_ms).alias("start_ms"), (F.max(time) + pad_ms).alias("end_ms"), F.avg(prob).alias("confidence"), F.min("_i").cast("long").alias("start_idx"), F.max("_i").cast("long").alias("end_idx")
    )
    return out.where("class_idx > 0").withColumn("duration_sec", (F.col("end_ms") - F.col("start_ms")) / 1000.0).drop("run_id")


def midpoint_runs(df: DataFrame, key: str, order: list[str], state: str, prob: str, time: str, end: str) -> DataFrame:
    """A segment per run, background included; neighbours meet half-way between their nearest places, the first begins
    at 0 and the last ends at ``end``."""
    run = sequence.runs(df, key, order, state).groupBy(key, "run_id").agg(F.first(state).alias("state"), F.min(time).alias("_a"), F.max(time).alias("_b"), F.avg(prob).alias("confidence"), F.max(end).alias("_end"), F.count(F.lit(1)).alias("steps"))
    w = Window.partitionBy(key).orderBy("run_id")
    start = F.coalesce((F.lag("_b").over(w) + F.col("_a")) / 2.0, F.lit(0.0))
    stop = F.coalesce((F.col("_b") + F.lead("_a").over(w)) / 2.0, F.col("_end").cast("double"))
    return run.withColumn("start", start).withColumn("end", stop).select(key, "run_id", "state", "start", "end", "confidence", "steps")


def merge_same_class(segments: DataFrame, key: str, gap_ms: float) -> DataFrame:
    """Joins a segment to the one before it if that has its class and ends less than ``gap_ms`` earlier.

    The end is the last one's; confidences are averaged pairwise in order, so later ones weigh more.
    """
    w = Window.partitionBy(key).orderBy("start_ms", "class_idx", "end_ms")
    broken = (F.lag("class_idx").over(w) != F.col("class_idx")) | (F.col("start_ms") - F.lag("end_ms").over(w) >= gap_ms)
    grouped = segments.withColumn("_b", F.coalesce(broken.cast("int"), F.lit(1))).withColumn("island", F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    row = F.struct("start_ms", "end_ms", F.col("confidence").alias("c"))
    merged = grouped.groupBy(key, "island", "class_idx").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    confidence = F.aggregate(F.slice("rows", 2, F.greatest(F.size("rows"), F.lit(1))), F.element_at("rows", 1)["c"], lambda a, r: (a + r["c"]) / 2)
    return merged.select(
        key, "class_idx", F.element_at("rows", 1)["start_ms"].alias("start_ms"), F.element_at("rows", -1)["end_ms"].alias("end_ms"), confidence.alias("confidence"), F.size("rows").cast("long").alias("n_merged")
    ).withColumn("duration_sec", (F.col("end_ms") - F.col("start_ms")) / 1000.0)


def resolve_overlaps(segments: DataFrame, key: str, *, raise_confidence: bool = False, strict: bool = False) -> DataFrame:
    """Left fold by start: overlapping segments of a class join; of two classes the surer one takes its half from the
    floor of the middle on, else what is left after the earlier one stays. ``strict`` keeps empty halves too."""
    row = F.struct(*[F.col(c).cast(t).alias(c) for c, t in (("start_ms", "long"), ("class_idx", "int"), ("end_ms", "long"), ("confidence", "double"))])
    grouped = segments.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    kind = "array<struct<start_ms:bigint,class_idx:int,end_ms:bigint,confidence:double>>"

    def made(start, of, end, confidence):
        return F.array(F.struct(start.alias("start_ms"), of["class_idx"].alias("class_idx"), end.alias("end_ms"), confidence.alias("confidence")))

    def fold(kept, x):
        last = F.element_at(kept, -1)
        rest = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))
        middle = F.floor((x["start_ms"] + last["end_ms"]) / 2.0).cast("long")
        same = F.concat(rest, made(last["start_ms"], last, F.greatest(last["end_ms"], x["end_ms"]), F.greatest(last["confidence"], x["confidence"]) if raise_confidence else last["confidence"]))
        half = F.concat(rest, made(last["start_ms"], last, middle, last["confidence"]), made(middle, x, x["end_ms"], x["confidence"]))
        half = half if strict else F.when(x["end_ms"] > middle, half).otherwise(kept)
        later = F.when(x["end_ms"] > last["end_ms"], F.concat(kept, made(last["end_ms"], x, x["end_ms"], x["confidence"]))).otherwise(kept)
        met = F.when(x["class_idx"] == last["class_idx"], same).when(x["confidence"] > last["confidence"], half).otherwise(later)
        return F.when(F.size(kept) == 0, F.array(x)).when(x["start_ms"] >= last["end_ms"], F.concat(kept, F.array(x))).otherwise(met)

    folded = grouped.select(key, F.explode(F.aggregate("rows", F.array().cast(kind), fold)).alias("r"))
    return folded.select(key, "r.*").withColumn("duration_sec", (F.col("end_ms") - F.col("start_ms")) / 1000.0)


def min_duration(segments: DataFrame, seconds: float) -> DataFrame:
    return segments.where(F.col("duration_sec") >= seconds)


def min_confidence(segments: DataFrame, least: float) -> DataFrame:
    """Applied after ranking; 0 or less keeps all."""
    return segments.where(F.col("confidence") >= least) if least > 0 else segments


def top_k_diverse(segments: DataFrame, key: str, k: int) -> DataFrame:
    """The best of each class before any second of a class, by confidence; at most ``k`` of each key."""
    by_class = Window.partitionBy(key, "class_idx").orderBy(F.desc("confidence"), "start_ms", "end_ms")
    over_all = Window.partitionBy(key).orderBy(F.col("_c") > 1, F.desc("confidence"), "start_ms", "end_ms")
    ranked = segments.withColumn("_c", F.row_number().over(by_class)).withColumn("_r", F.row_number().over(over_all))
    return ranked.where(F.col("_r") <= k).drop("_c", "_r")


def top_k_plain(segments: DataFrame, key: str, k: int) -> DataFrame:
    """By confidence, then duration."""
    w = Window.partitionBy(key).orderBy(F.desc("confidence"), F.desc("duration_sec"), "start_ms", "class_idx")
    return segments.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")
