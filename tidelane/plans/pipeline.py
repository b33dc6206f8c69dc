"""Post-processing by policy, and sweeps over policies, which are rows of one plan."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelane import storage
from tidelane.config import FULL, Policy
from tidelane.operators import decode, evaluate, fusion, intervals, scan, segments, sequence, whole


def decoded(steps: DataFrame, key: str, order: list[str], classes: int, policy: Policy = FULL) -> DataFrame:
    """``steps`` with ``smoothed`` probabilities, the ``path`` and ``prob``, the path's smoothed probability."""
    names = [f"_p{i}" for i in range(classes)]
    df = steps.withColumns({n: F.element_at("probs", i + 1) for i, n in enumerate(names)})
    if policy.smooth > 1:
        df = df.withColumns({n: sequence.moving_average(n, key, order, policy.smooth) for n in names})
    if policy.median > 1:
        df = df.withColumns({n: sequence.median_filter(n, key, order, policy.median) for n in names})
    df = df.withColumn("smoothed", F.array(*names)).drop(*names)
    if policy.viterbi:
        matrix = decode.transitions(classes, policy.self_stay, policy.enter, policy.leave, policy.cross)
        df = decode.with_path(df, key, order, "smoothed", matrix=matrix)
    else:
        df = df.withColumn("path", fusion.argmax(F.col("smoothed")))
    return df.withColumn("prob", F.element_at("smoothed", F.col("path") + 1))


def post_process(steps: DataFrame, key: str, order: list[str], classes: int, policy: Policy = FULL, *, signal: DataFrame | None = None, pad_ms: int = 1500) -> DataFrame:
    """Segments of a table of steps (key, t_ms, probs), by a policy; each of its parts can be off.

    smooth -> median -> decode -> runs -> merge -> refine -> resolve -> least duration -> top-k -> least confidence.
    """
    df = decoded(steps, key, order, classes, policy)
    out = segments.from_states(df, key, order, "path", "prob", "t_ms", pad_ms).select(key, "class_idx", "start_ms", "end_ms", "confidence", "duration_sec")
    if policy.merge_gap > 0:
        out = segments.merge_same_class(out, key, policy.merge_gap * 1000).drop("n_merged")
    if policy.refine and signal is not None:
        out = refine(out, signal, key)
    if policy.resolve:
        out = segments.resolve_overlaps(out, key)
    if policy.min_duration > 0:
        out = segments.min_duration(out, policy.min_duration)
    if policy.top_k > 0:
        out = segments.top_k_diverse(out, key, policy.top_k)
    return segments.min_confidence(out, policy.min_confidence)


def refine(found: DataFrame, signal: DataFrame, key: str, *, reach_ms: int = 15_000, least: int = 100, smooth: int = 200) -> DataFrame:
    """Moves starts to the steepest change of smoothed motion energy near them, ends to its steepest fall.

    ``signal`` has key, t_ms, seq, ax, ay, az. A side needs more than ``least`` samples; both sides stay if they cross.
    """
    energy = signal.withColumn("_e", F.sqrt(sum((F.col(c).cast("double") ** 2 for c in ("ax", "ay", "az")), F.lit(0.0))))
    energy = energy.withColumn("_e", sequence.moving_average("_e", key, ["t_ms", "seq"], smooth)).select(key, "t_ms", "seq", "_e")
    rest = [c for c in found.columns if c not in (key, "start_ms", "end_ms", "duration_sec")]
    sid = F.struct("start_ms", "end_ms", *rest)
    sides = found.withColumn("_sid", sid).select(key, "_sid", F.explode(F.array(F.struct(F.lit("s").alias("side"), F.col("start_ms").alias("center")), F.struct(F.lit("e").alias("side"), F.col("end_ms").alias("center")))).alias("_x")).select(key, "_sid", "_x.*")
    near = intervals.band(energy, sides, key, "t_ms", "center", reach_ms)
    near = near.withColumn("_slice", F.struct(key, "_sid", "side"))
    near = near.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("_slice"))).where(F.col("_n") > least)
    near = near.withColumn("_g", sequence.gradient("_e", "_slice", ["t_ms", "seq"]))
    best = near.groupBy(key, "_sid", "side", "center").agg(F.max_by("t_ms", F.struct(F.abs("_g"), -F.col("seq"))).alias("up"), F.min_by("t_ms", F.struct("_g", "seq")).alias("down"))
    best = best.withColumn("at", F.when(F.col("side") == "s", F.col("up")).otherwise(F.col("down"))).where(F.abs(F.col("at") - F.col("center")) < reach_ms)
    wide = best.groupBy(key, "_sid").agg(F.max(F.when(F.col("side") == "s", F.col("at"))).alias("_s"), F.max(F.when(F.col("side") == "e", F.col("at"))).alias("_t"))
    out = found.withColumn("_sid", sid).join(wide, [key, "_sid"], "left")
    start, end = F.coalesce("_s", "start_ms"), F.coalesce("_t", "end_ms")
    out = out.withColumn("_a", F.when(start < end, start).otherwise(F.col("start_ms"))).withColumn("_b", F.when(start < end, end).otherwise(F.col("end_ms")))
    return out.select(key, *rest, F.col("_a").alias("start_ms"), F.col("_b").alias("end_ms"), ((F.col("_b") - F.col("_a")) / 1000.0).alias("duration_sec"))


SEGMENT = ["_unit", "class_idx", "start_ms", "end_ms", "confidence", "duration_sec"]


def _long_segments(steps: DataFrame, key: str, order: list[str], classes: int, pairs: list[tuple], moves: list[tuple], ways: list[tuple], pad_ms: int) -> DataFrame:
    """The segments of each way, by windows and scans: a column for each pair of smoothing widths, all transition settings of
    a pair decoded at once."""
    df = steps.withColumns({f"_p{i}": F.element_at("probs", i + 1) for i in range(classes)})
    made = []
    for n, (smooth, median) in enumerate(pairs):
        names = [f"_s{n}_{i}" for i in range(classes)]
        df = df.withColumns({c: sequence.moving_average(f"_p{i}", key, order, smooth) if smooth > 1 else F.col(f"_p{i}") for i, c in enumerate(names)})
        if median > 1:
            df = df.withColumns({c: sequence.median_filter(c, key, order, median) for c in names})
        made.append(F.struct(F.lit(n).alias("pair"), F.array(*names).alias("smoothed")))
    df = df.withColumn("_i", sequence.place(key, order)).select(key, "_i", "t_ms", F.explode(F.array(*made)).alias("_x")).select(F.struct(F.col("_x.pair"), F.col(key).alias("key")).alias("_unit"), "_i", "t_ms", "_x.smoothed")
    if moves:
        df = decode.with_paths(df, "_unit", ["_i"], "smoothed", [decode.transitions(classes, *m) for m in moves])
    else:
        df = df.withColumn("paths", F.array().cast("array<int>"))
    paths = F.concat(F.array(fusion.argmax(F.col("smoothed"))), "paths")
    some = F.array(*[F.struct(F.lit(n).alias("way"), F.lit(pair).alias("pair"), F.get("_all", F.lit(move + 1)).alias("path")) for n, (pair, move) in enumerate(ways)])
    df = df.withColumn("_all", paths).withColumn("_w", F.explode(F.filter(some, lambda w: w["pair"] == F.col("_unit.pair"))))
    df = df.select(F.struct(F.col("_w.way"), F.col("_unit.key").alias("key")).alias("_unit"), "_i", "t_ms", F.col("_w.path").alias("path"), F.get("smoothed", F.col("_w.path")).alias("prob"))
    return segments.from_states(df, "_unit", ["_i"], "path", "prob", "t_ms", pad_ms).select(*SEGMENT)


def _whole_segments(chunks: DataFrame, key: str, classes: int, pairs: list[tuple], moves: list[tuple], ways: list[tuple], pad_ms: int) -> DataFrame:
    """The same of chunks that are whole keys (key, rows), where they lie."""
    matrices = [decode.transitions(classes, *m) for m in moves]

    def cut(c: dict) -> Iterator[dict]:
        size = scan.lengths(c["rows"])
        places, rows = whole.Places(size), c["rows"].flatten()
        t, p = rows.field("t_ms").to_numpy(), rows.field("probs").flatten().to_numpy().astype(np.float64).reshape(len(places.key), classes)
        for n, (smooth, median) in enumerate(pairs):
            x = places.average(p, smooth) if smooth > 1 else p
            x = places.median(x, median) if median > 1 else x
            used = [move for pair, move in ways if pair == n and move >= 0]
            paths = decode.whole_paths(x, size, [matrices[m] for m in used]) if used else None
            for way, (pair, move) in enumerate(ways):
                if pair == n:
                    found = whole.runs(places.key, x.argmax(axis=1) if move < 0 else paths[:, used.index(move)], x, t)
                    at = np.flatnonzero(found.label > 0)
                    confidence = found.sums[at, found.label[at]] / found.n[at]
                    yield {"way": np.full(len(at), way), key: c[key].take(pa.array(found.key[at])), "class_idx": found.label[at], "start_ms": found.t0[at] - pad_ms, "end_ms": found.t1[at] + pad_ms, "confidence": confidence}

    time = chunks.schema["rows"].dataType.elementType["t_ms"].dataType
    schema = T.StructType([T.StructField("way", T.IntegerType()), chunks.schema[key], T.StructField("class_idx", T.IntegerType()), T.StructField("start_ms", time), T.StructField("end_ms", time), T.StructField("confidence", T.DoubleType())])
    found = scan.each(chunks.select(key, "rows"), cut, schema).withColumn("_unit", F.struct("way", F.col(key).alias("key")))
    return found.withColumn("duration_sec", (F.col("end_ms") - F.col("start_ms")) / 1000.0).select(*SEGMENT)


def post_process_all(steps: DataFrame, key: str, order: list[str], classes: int, policies: list[Policy], *, signal: DataFrame | None = None, pad_ms: int = 1500) -> DataFrame:
    """The segments of ``post_process`` under each of ``policies``, with ``ord``, the policy's place in the list.

    Keys of one chunk are smoothed, decoded and cut into segments where they lie, in every way that a policy asks for; longer
    ones by windows and scans. Segments are written once. From there on policies are rows, grouped by (ord, key), whose
    parameters are columns.
    """
    pairs = list(dict.fromkeys((p.smooth, p.median) for p in policies))
    moves = list(dict.fromkeys((p.self_stay, p.enter, p.leave, p.cross) for p in policies if p.viterbi))
    # Policies that share a path share its segments: one row for each path, then one for each policy of it.
    ways = list(dict.fromkeys((pairs.index((p.smooth, p.median)), moves.index((p.self_stay, p.enter, p.leave, p.cross)) if p.viterbi else -1) for p in policies))
    probs = F.slice(F.transform("probs", lambda v: v.cast("double")), 1, classes)
    sound = F.col("t_ms").isNotNull() & (F.size(probs) == classes) & F.forall(probs, lambda v: v.isNotNull() & ~F.isnan(v))
    chunks = storage.materialize(scan.packed(steps, key, order, {"t_ms": F.col("t_ms"), "probs": probs}, sound), "packed")
    found, long = _whole_segments(chunks.where("whole"), key, classes, pairs, moves, ways, pad_ms), chunks.where("NOT whole")
    if not long.isEmpty():
        rows = long.select(key, F.explode("rows").alias("_r")).select(key, F.col("_r._i").alias("_place"), "_r.t_ms", "_r.probs")
        found = found.unionByName(_long_segments(rows, key, ["_place"], classes, pairs, moves, ways, pad_ms))
    found = storage.materialize(found, "segments")
    rows = [F.struct(F.lit(n).alias("ord"), F.lit(ways.index((pairs.index((p.smooth, p.median)), moves.index((p.self_stay, p.enter, p.leave, p.cross)) if p.viterbi else -1))).alias("way"), F.lit(float(p.merge_gap)).alias("gap"), F.lit(p.refine and signal is not None).alias("refine"), F.lit(p.resolve).alias("resolve"), F.lit(float(p.min_duration)).alias("least"), F.lit(p.top_k).alias("top_k"), F.lit(float(p.min_confidence)).alias("sure")) for n, p in enumerate(policies)]
    found = found.withColumn("_c", F.explode(F.filter(F.array(*rows), lambda c: c["way"] == F.col("_unit.way"))))
    unit = F.struct("_c.ord", F.col("_unit.key").alias("key"), "_c.gap", "_c.refine", "_c.resolve", "_c.least", "_c.top_k", "_c.sure")
    found = found.withColumn("_unit", unit).drop("_c")
    only = lambda name, f: f(found.where(name)).unionByName(found.where(~name).select(*SEGMENT))
    if any(p.merge_gap > 0 for p in policies):
        found = only(F.col("_unit.gap") > 0, lambda df: segments.merge_same_class(df, "_unit", F.col("_unit.gap") * 1000).drop("n_merged"))
    if signal is not None and any(p.refine for p in policies):
        moved = refine(found.where("_unit.refine").withColumn(key, F.col("_unit.key")), signal, key).drop(key)
        found = moved.unionByName(found.where("NOT _unit.refine"))
    if any(p.resolve for p in policies):
        found = only(F.col("_unit.resolve"), lambda df: segments.resolve_overlaps(df, "_unit"))
    found = found.where((F.col("_unit.least") <= 0) | (F.col("duration_sec") >= F.col("_unit.least")))
    if any(p.top_k > 0 for p in policies):
        found = only(F.col("_unit.top_k") > 0, lambda df: segments.top_k_diverse(df, "_unit", F.col("_unit.top_k")))
    found = found.where((F.col("_unit.sure") <= 0) | (F.col("confidence") >= F.col("_unit.sure")))
    return found.select("_unit.ord", F.col("_unit.key").alias(key), "class_idx", "start_ms", "end_ms", "confidence", "duration_sec")


def sweep(steps: DataFrame, gold: DataFrame, key: str, order: list[str], classes: int, policies: list[Policy], **options) -> DataFrame:
    """Mean user F1 and micro F1 of each policy, all of them in one plan."""
    pred = storage.materialize(post_process_all(steps, key, order, classes, policies, **options), "sweep")
    number = F.row_number().over(Window.partitionBy("ord", key).orderBy("start_ms", "class_idx")).cast("long")
    pred = pred.withColumn("pred_id", F.shiftleft(F.col("ord").cast("long"), 32) + number)
    pairs = intervals.candidates(pred, gold, [key, "class_idx"]).withColumn("_unit", F.struct(F.shiftright("pred_id", 32).cast("int").alias("ord"), F.col(key).alias("key")))
    hits = intervals.greedy_match(pairs, "_unit").groupBy("_unit.ord", F.col("_unit.key").alias(key)).agg(F.count(F.lit(1)).alias("tp"))
    made = pred.groupBy("ord", key).agg(F.count(F.lit(1)).alias("n_pred"))
    names = F.explode(F.array(*[F.struct(F.lit(n).alias("ord"), F.lit(p.name).alias("policy")) for n, p in enumerate(policies)])).alias("_p")
    spine = gold.groupBy(key).agg(F.count(F.lit(1)).alias("n_gold")).select(key, "n_gold", names).select(key, "n_gold", "_p.*")
    users = spine.join(made, ["ord", key], "left").join(hits, ["ord", key], "left").na.fill(0, ["n_pred", "tp"])
    f1 = evaluate.ratio(2 * F.col("tp"), F.col("n_pred") + F.col("n_gold"))
    return users.groupBy("ord", "policy").agg(F.avg(f1).alias("mean_f1"), evaluate.ratio(2 * F.sum("tp"), F.sum("n_pred") + F.sum("n_gold")).alias("micro_f1"))


def best_policy(scores: DataFrame) -> DataFrame:
    """The policy with the highest (mean F1, micro F1); the first of equals."""
    return scores.agg(F.max_by("policy", F.struct("mean_f1", "micro_f1", -F.col("ord"))).alias("policy"))


def coordinate_ascent(start: Policy, grid: dict[str, list], score, rounds: int = 5) -> Policy:
    """Sets one field after another to its best value while that strictly improves ``score(policies) -> list``."""
    best, value = start, score([start])[0]
    for _ in range(rounds):
        before = value
        for name, values in grid.items():
            tried = [best.derive(f"{name}={v}", **{name: v}) for v in values]
            got = score(tried)
            top = max(range(len(got)), key=lambda i: (got[i], -i))
            if got[top] > value:
                best, value = tried[top], got[top]
        if value <= before:
            break
    return best
