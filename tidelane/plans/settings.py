"""Choice of record-layer settings in two stages: all settings are rows of one plan.

A sequence setting is (smooth, median, stay, run): widths of the moving average and the median, the decoder's probability of
staying, and the least run. Smoothing is a column a pair of widths; every pair's rows are decoded for all probabilities of
staying at once; least runs and merge gaps are rows of tables of runs, which are far fewer than steps. A record setting adds
(gap, least, sure): the merge gap, the least length and the least confidence.

A key of one chunk of steps is worked at whole, for all settings, where it lies, and only counts leave the task: steps times
settings are never written or shuffled. Longer keys go through tables of runs, which are cut where steps are decoded.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelane import storage
from tidelane.operators import decode, evaluate, intervals, scan, sequence, whole

#: The grids of either stage (gaps and lengths in the unit of the data's times are the caller's).
SMOOTH, MEDIAN, STAY, RUN = (1, 3, 5, 7), (1, 3, 5), (0.35, 0.50, 0.65, 0.80, 0.90, 0.97), (1, 2, 3, 5)
SURE, KEPT = (0.0, 0.15, 0.25, 0.35, 0.45, 0.55), 40
SEQUENCE = ["smooth", "median", "stay", "run"]


def smoothed(steps: DataFrame, key: str, order: list[str], columns: list[str], smooth: tuple, median: tuple) -> DataFrame:
    """Rows of ``steps`` for each pair of widths: smooth, median and ``probs`` in place of ``columns``."""
    made = []
    for a in smooth:
        averaged = [f"_a{a}_{k}" for k in range(len(columns))]
        steps = sequence.smoothed_shares(steps.withColumns({n: F.col(c) for n, c in zip(averaged, columns, strict=True)}), key, order, averaged, average=a)
        for m in median:
            both = [f"_a{a}_m{m}_{k}" for k in range(len(columns))]
            steps = sequence.smoothed_shares(steps.withColumns({n: F.col(c) for n, c in zip(both, averaged, strict=True)}), key, order, both, median=m)
            made.append(F.struct(F.lit(a).alias("smooth"), F.lit(m).alias("median"), F.array(*both).alias("probs")))
    rest = [c for c in steps.columns if not c.startswith("_a") and c not in columns]
    return steps.select(*rest, F.explode(F.array(*made)).alias("_s")).select(*rest, "_s.*")


def decoded_runs(steps: DataFrame, key: str, order: list[str], time: str, columns: list[str], truth: str, *, smooth: tuple = SMOOTH, median: tuple = MEDIAN, stay: tuple = STAY, run: tuple = RUN) -> DataFrame:
    """Runs of every sequence setting: setting (its number in order), its fields, key, class_idx, start_idx, end_idx (places,
    the end excluded), t0 and t1 (first and last time), n, sums (of probabilities by class) and hits (rows whose ``truth``
    is the class)."""
    states = len(columns)
    placed = steps.select(key, *order, F.col(time).alias("_t"), F.col(truth).alias("_truth"), *columns, sequence.place(key, order).cast("long").alias("_i"))
    rows = smoothed(placed, key, order, columns, smooth, median).withColumn("_unit", F.struct("smooth", "median", F.col(key).alias("key")))
    matrices = [decode.uniform_transitions(states, p) for p in stay]
    paths = decode.with_paths(rows.select("_unit", "_i", "_t", "_truth", "probs"), "_unit", ["_i"], "probs", matrices, eps=1e-12, clip=True)
    pieces = cut_runs(paths, states, len(stay)).withColumn("_unit", F.struct("_unit.*", "_stay"))
    arrays = lambda f: F.array(*[f(k) for k in range(states)])
    runs = sequence.runs(pieces, "_unit", ["start_idx"], "_label").groupBy("_unit", F.col("run_id").alias("_run")).agg(
        F.first("_label").alias("_label"), F.sum("_n").alias("_n"), arrays(lambda k: F.sum(F.get("_sums", F.lit(k)))).alias("_sums"),
        arrays(lambda k: F.sum(F.get("hits", F.lit(k)))).alias("hits"), F.min("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx"), F.min("t0").alias("t0"), F.max("t1").alias("t1"),
    )
    runs = storage.materialize(runs, "runs").withColumn("_least", F.explode(F.array(*[F.lit(r) for r in run]))).withColumn("_unit", F.struct("_unit.*", "_least"))
    more = {"hits": arrays(lambda k: F.sum(F.get("hits", F.lit(k)))), "start_idx": F.min("start_idx"), "end_idx": F.max("end_idx"), "t0": F.min("t0"), "t1": F.max("t1")}
    fixed = decode.repaired_runs(runs, "_unit", states, F.col("_unit._least"), 2, more)
    place = lambda values, x: F.array_position(F.array(*[F.lit(v) for v in values]), x) - 1
    number = ((place(smooth, F.col("_unit.smooth")) * len(median) + place(median, F.col("_unit.median"))) * len(stay) + F.col("_unit._stay")) * len(run) + place(run, F.col("_unit._least"))
    fields = [F.col("_unit.smooth"), F.col("_unit.median"), F.get(F.array(*[F.lit(v) for v in stay]), F.col("_unit._stay")).alias("stay"), F.col("_unit._least").alias("run")]
    return fixed.select(number.cast("long").alias("setting"), *fields, F.col("_unit.key").alias(key), F.col("_label").alias("class_idx"), "start_idx", "end_idx", "t0", "t1", F.col("_n").alias("n"), F.col("_sums").alias("sums"), "hits")


def cut_runs(paths: DataFrame, states: int, count: int) -> DataFrame:
    """Pieces of runs of rows with ``count`` paths each, where the rows lie: _unit, _stay (the path's number), _label, _n, _sums,
    hits, start_idx, end_idx, t0 and t1. A run is several pieces where rows don't follow one another in a batch."""
    unit, time = paths.schema["_unit"], paths.schema["_t"].dataType
    whole_ = T.StructType([unit, *T.StructType.fromDDL("_stay int, _label int, _n long, _sums array<double>, hits array<long>, start_idx long, end_idx long"), T.StructField("t0", time), T.StructField("t1", time)])

    def cut(c: dict) -> Iterator[dict]:
        place, row = c["_i"].to_numpy(), c["_unit"].flatten()
        codes = [pc.fill_null(v.dictionary_encode().indices, -1).to_numpy(zero_copy_only=False) for v in row]
        new = np.concatenate([[True], np.diff(place) != 1])
        for v in codes:
            new[1:] |= np.diff(v) != 0
        flat = c["probs"].flatten()
        p, given = (v.to_numpy(zero_copy_only=False).reshape(-1, states) for v in (pc.fill_null(flat, 0.0), pc.is_valid(flat)))
        label = c["paths"].flatten().to_numpy().reshape(-1, count)
        truth = pc.fill_null(c["_truth"], -1).to_numpy(zero_copy_only=False)
        hit = (truth[:, None] == np.arange(states)).astype(np.int64)
        known = pc.is_valid(c["_t"]).to_numpy(zero_copy_only=False)
        times = pc.fill_null(c["_t"], 0).to_numpy(zero_copy_only=False)
        low, high = (-np.inf, np.inf) if times.dtype.kind == "f" else (np.iinfo(times.dtype).min, np.iinfo(times.dtype).max)
        for k in range(count):
            head = new.copy()
            head[1:] |= label[1:, k] != label[:-1, k]
            at = np.flatnonzero(head)
            last, none = np.append(at[1:], len(place)) - 1, ~np.logical_or.reduceat(known, at)
            sums = pa.array(whole.sums(np.cumsum(head) - 1, p, len(at)).ravel(), mask=~np.logical_or.reduceat(given, at, axis=0).ravel())
            yield {
                "_unit": c["_unit"].take(pa.array(at)), "_stay": np.full(len(at), k), "_label": label[at, k], "_n": np.diff(np.append(at, len(place))), "_sums": pa.ListArray.from_arrays(np.arange(0, len(sums) + 1, states, dtype=np.int32), sums), "hits": list(np.add.reduceat(hit, at, axis=0)),
                "start_idx": place[at], "end_idx": place[last] + 1, "t0": pa.array(np.minimum.reduceat(np.where(known, times, high), at), mask=none), "t1": pa.array(np.maximum.reduceat(np.where(known, times, low), at), mask=none),
            }

    return scan.each(paths, cut, whole_)


def records(runs: DataFrame, key: str, spans: DataFrame) -> DataFrame:
    """Runs with start_ms and end_ms: half-way to their neighbours, 0 at the first, the key's ``span_ms`` at the last."""
    w = Window.partitionBy("setting", key).orderBy("start_idx")
    start = F.coalesce((F.lag("t1").over(w) + F.col("t0")) / 2.0, F.lit(0.0))
    end = (F.col("t1") + F.lead("t0").over(w)) / 2.0
    return runs.withColumns({"start_ms": start, "_end": end}).join(spans.select(key, "span_ms"), key).withColumn("end_ms", F.coalesce("_end", F.col("span_ms").cast("double"))).drop("_end", "span_ms")


def merged(found: DataFrame, key: str, gaps: tuple) -> DataFrame:
    """``records`` for each merge gap: setting, gap, key, class_idx, start_ms, end_ms and confidence, the class's mean
    probability over all that a record reaches across."""
    each = found.withColumn("gap", F.explode(F.array(*[F.lit(float(g)) for g in gaps]))).withColumn("_unit", F.struct("setting", "gap", F.col(key).alias("key")))
    links = decode.chained(each, "_unit", F.col("gap"), "class_idx", "start_ms", "end_ms")
    states = F.size(F.first("sums"))
    total = F.transform(F.sequence(F.lit(0), states - 1), lambda k: F.aggregate(F.collect_list("sums"), F.lit(0.0), lambda a, s: a + F.get(s, k)))
    groups = links.groupBy("_unit", "_head").agg(F.min_by("class_idx", "chunk").alias("class_idx"), F.min_by("start_ms", "chunk").alias("start_ms"), F.max_by("end_ms", "chunk").alias("end_ms"), F.min("start_idx").alias("start_idx"), total.alias("sums"), F.sum("n").alias("n"))
    return groups.select("_unit.setting", "_unit.gap", F.col("_unit.key").alias(key), "class_idx", "start_ms", "end_ms", "start_idx", (F.get("sums", F.col("class_idx")) / F.col("n")).alias("confidence"))


COUNTS = ["tp", "overlap", "records"]


def counts(pred: DataFrame, gold: DataFrame, key: str, by: list[str], conditions: list[tuple[float, float]], *, ignored: tuple = (), above: float = 0.5) -> DataFrame:
    """For each ``by`` and each condition (least, sure: least length, least confidence): tp, overlap (sum of their IoU in
    multiples of 1 / FIXED) and records.

    Intervals of a side are disjoint, so pairs over half IoU don't compete and are the same under every condition: they are
    found once, and conditions only choose among them.
    """
    wide = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("least"), F.lit(float(b)).alias("sure")) for a, b in conditions])).alias("_c")
    pred, gold = _kept(pred, ignored), _kept(gold, ignored)
    named = pred.withColumn("pred_id", F.struct(*by, "start_idx", "confidence"))
    pairs = intervals.candidates(named, gold, [key, "class_idx"], above).select("pred_id.*", "iou", (F.col("p1") - F.col("p0")).alias("p"), (F.col("g1") - F.col("g0")).alias("g"), wide).select("*", "_c.*")
    sure = (F.col("p") >= F.col("least")) & ((F.col("sure") <= 0) | (F.col("confidence") >= F.col("sure")))
    fixed = F.floor(F.col("iou") * F.lit(whole.FIXED) + 0.5).cast(T.DecimalType(20, 0))
    hit = pairs.where(sure & (F.col("g") >= F.col("least"))).groupBy(*by, "least", "sure").agg(F.count(F.lit(1)).alias("tp"), F.sum(fixed).alias("overlap"))
    made = pred.select(*by, "confidence", (F.col("end_ms") - F.col("start_ms")).alias("p"), wide).select("*", "_c.*").groupBy(*by, "least", "sure").agg(F.sum(sure.cast("long")).alias("records"))
    return made.join(hit, [*by, "least", "sure"], "left").select(*by, "least", "sure", "tp", F.col("overlap").cast(T.DecimalType(30, 0)).alias("overlap"), "records")


def _kept(found: DataFrame, ignored: tuple) -> DataFrame:
    return found.where(~F.col("class_idx").isin(*ignored)) if ignored else found


def whole_counts(chunks: DataFrame, columns: list[str], chosen: dict[int, tuple], gaps: tuple, lengths: tuple, sure: tuple, *, ignored: tuple = ()) -> DataFrame:
    """Of ``chunks`` that are whole keys (rows, span_ms, gold) for each setting of ``chosen`` (number: fields), gap and condition:
    the counts of ``counts``, and right and known, the steps that the setting gets right and those that count."""
    gaps, lengths, sure, states = ([float(v) for v in dict.fromkeys(gaps)], *(sorted({float(v) for v in x}) for x in (lengths, sure)), len(columns))
    where, marks = [(a, b) for a in lengths for b in sure], whole.Conditions(lengths, sure)
    pairs = {w: [(n, *f[2:]) for n, f in chosen.items() if f[:2] == w] for w in sorted({f[:2] for f in chosen.values()})}

    def count(c: dict) -> Iterator[dict]:
        size = scan.lengths(c["rows"])
        places, rows = whole.Places(size), c["rows"].flatten()
        t, p = rows.field("_t").to_numpy().astype(np.float64), np.stack([rows.field(x).to_numpy().astype(np.float64) for x in columns], axis=1)
        truth, span = pc.fill_null(rows.field("_truth"), -1).to_numpy(zero_copy_only=False), c["span_ms"].to_numpy(zero_copy_only=False).astype(np.float64)
        of = c["gold"].flatten()
        gold = whole.Gold(np.repeat(np.arange(len(size)), pc.fill_null(c["gold"].value_lengths(), 0).to_numpy(zero_copy_only=False)), *(of.field(x).to_numpy(zero_copy_only=False) for x in ("start_ms", "end_ms", "class_idx")))
        counted = np.isin(truth, [k for k in range(states) if k not in ignored])
        averaged, out = {}, []
        for (smooth, median), settings in pairs.items():
            if smooth not in averaged:
                averaged = {smooth: whole.shares(places.average(p, smooth)) if smooth > 1 else p}
            x = whole.shares(places.median(averaged[smooth], median, "edge")) if median > 1 else averaged[smooth]
            stays = list(dict.fromkeys(stay for _, stay, _ in settings))
            paths = decode.whole_paths(x, size, [decode.uniform_transitions(states, v) for v in stays], 1e-12, True)
            for k, stay in enumerate(stays):
                runs = whole.runs(places.key, paths[:, k], x, t)
                for number, _, least in (v for v in settings if v[1] == stay):
                    fixed = runs.repaired(least)
                    right = int((counted & (np.repeat(fixed.label, fixed.n) == truth)).sum())
                    found = whole.records(fixed, span)
                    for gap in gaps:
                        made = found.merged(gap)
                        made = made.at(np.flatnonzero(~np.isin(made.label, ignored)))
                        length, sure_ = made.end - made.start, made.confidence()
                        at, value, true = gold.overlaps(made)
                        hit = marks.of(np.minimum(length[at], true), sure_[at])
                        out += zip(itertools.repeat(number), itertools.repeat(gap), where, marks.count(hit).tolist(), marks.total(hit, value).tolist(), marks.count(marks.of(length, sure_)).tolist(), itertools.repeat(right), itertools.repeat(int(counted.sum())))
        number, gap, condition, tp, overlap, records, right, known = zip(*out, strict=True)
        yield {"setting": number, "gap": gap, "least": [a for a, _ in condition], "sure": [b for _, b in condition], "tp": tp, "overlap": overlap, "records": records, "right": right, "known": known}

    return scan.each(chunks.select("rows", "span_ms", "gold"), count, "setting long, gap double, least double, sure double, tp long, overlap long, records long, right long, known long")


def scored(found: DataFrame, gold: DataFrame, hours: Column, lengths: tuple, *, ignored: tuple = ()) -> DataFrame:
    """Summed counts of (setting, gap, least, sure) with fp, fn, f1, miou, records_per_hour and accuracy."""
    wide = F.explode(F.array(*[F.lit(float(a)) for a in dict.fromkeys(lengths)])).alias("least")
    golds = _kept(gold, ignored).select((F.col("end_ms") - F.col("start_ms")).alias("g"), wide).groupBy("least").agg(F.sum((F.col("g") >= F.col("least")).cast("long")).alias("golds"))
    out = found.join(golds, "least", "left").na.fill(0, ["golds"])
    fp, fn = F.col("records") - F.col("tp"), F.col("golds") - F.col("tp")
    miou = F.try_divide(F.col("overlap").cast("double"), F.lit(whole.FIXED) * F.col("tp"))
    return out.select("setting", "gap", "least", "sure", "tp", fp.alias("fp"), fn.alias("fn"), evaluate.ratio(2 * F.col("tp"), F.col("records") + F.col("golds")).alias("f1"), miou.alias("miou"), evaluate.ratio(F.col("records"), hours).alias("records_per_hour"), evaluate.ratio(F.col("right"), F.col("known")).alias("accuracy"))


def ranked(scored: DataFrame) -> list[Column]:
    """Best first: F1, mean IoU (a missing one is the lowest), fewest records; then in the order of the grid."""
    return [F.desc("f1"), F.desc(F.coalesce("miou", F.lit(-1.0))), F.asc("records_per_hour")]


def two_stage(steps: DataFrame, gold: DataFrame, spans: DataFrame, key: str, order: list[str], time: str, columns: list[str], truth: str, *, gaps: tuple, lengths: tuple, least: float = 0.0, sure: tuple = SURE, kept: int = KEPT, ignored: tuple = (), **grid) -> DataFrame:
    """Scores of all sequence settings (stage 1), then of the ``kept`` best with every record setting (stage 2).

    ``steps`` has key, order, time, a column a class and ``truth``; ``gold`` key, gold_id, class_idx, start_ms, end_ms;
    ``spans`` key and span_ms. ``accuracy`` is the share of steps that a sequence setting gets right.
    """
    fields = {n: grid.get(n, default) for n, default in zip(SEQUENCE, (SMOOTH, MEDIAN, STAY, RUN), strict=True)}
    numbers = dict(enumerate(itertools.product(*fields.values())))
    names = [f"_c{k}" for k in range(len(columns))]
    sound = ~F.greatest(*[F.coalesce(F.isnan(F.col(c).cast("double")), F.lit(True)) for c in columns], F.col(time).isNull())
    packed = scan.packed(steps, key, order, {"_t": F.col(time), "_truth": F.col(truth), **{n: F.col(c) for n, c in zip(names, columns, strict=True)}}, sound)
    true = _kept(gold, ignored).where("start_ms <= end_ms").groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col("start_ms").cast("double").alias("start_ms"), F.col("end_ms").cast("double").alias("end_ms"), "class_idx"))).alias("gold"))
    chunks = storage.materialize(packed.join(spans.select(key, "span_ms"), key).join(true, key, "left"), "packed")
    short, long = chunks.where("whole"), chunks.where("NOT whole").select(key, F.explode("rows").alias("_r")).select(key, F.col("_r._i").alias("_place"), *[F.col(f"_r.{n}").alias(n) for n in ("_t", "_truth", *names)])
    found = None if long.isEmpty() else storage.materialize(records(decoded_runs(long, key, ["_place"], "_t", names, "_truth", **fields), key, spans), "records")
    hours = F.lit(float(spans.agg(F.sum("span_ms") / 3.6e6).first()[0] or 0.0))

    def stage(number: int, chosen: dict[int, tuple], gaps: tuple, lengths: tuple, sure: tuple) -> DataFrame:
        parts = whole_counts(short, names, chosen, gaps, lengths, sure, ignored=ignored).withColumn("overlap", F.col("overlap").cast(T.DecimalType(30, 0)))
        if found is not None:
            some = found.where(F.col("setting").isin(*chosen))
            made = some.withColumns({"confidence": F.get("sums", F.col("class_idx")) / F.col("n"), "gap": F.lit(0.0)}) if number == 1 else storage.materialize(merged(some, key, gaps), "merged")
            classes = [k for k in range(len(columns)) if k not in ignored]
            known = sum((F.get("hits", F.lit(k)) for k in classes), F.lit(0))
            right = F.when(F.col("class_idx").isin(*classes), F.get("hits", F.col("class_idx"))).otherwise(0)
            each = F.explode(F.array(*[F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("gap", "least", "sure"), c, strict=True)]) for c in itertools.product(gaps, lengths, sure)]))
            steps_ = some.groupBy("setting").agg(F.sum(right).alias("right"), F.sum(known).alias("known")).select("setting", each.alias("_c"), "right", "known").select("setting", "_c.*", "right", "known")
            parts = parts.unionByName(counts(made, gold, key, ["setting", "gap"], list(itertools.product(lengths, sure)), ignored=ignored), allowMissingColumns=True).unionByName(steps_, allowMissingColumns=True)
        summed = parts.groupBy("setting", "gap", "least", "sure").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*COUNTS, "right", "known")])
        return storage.materialize(scored(summed, gold, hours, lengths, ignored=ignored).withColumn("stage", F.lit(number)), f"stage-{number}")

    one = stage(1, numbers, (0.0,), (least,), (0.0,))
    best = [r.setting for r in one.orderBy(*ranked(one), "setting").limit(kept).collect()]
    every = one.unionByName(stage(2, {n: numbers[n] for n in best}, gaps, lengths, sure)) if best else one
    value = lambda k: F.get(F.array(*[F.lit(f[k]) for f in numbers.values()]), F.col("setting").cast("int"))
    return every.select("stage", "setting", *[value(k).alias(n) for k, n in enumerate(SEQUENCE)], "gap", "least", "sure", "tp", "fp", "fn", "f1", "miou", "records_per_hour", "accuracy")


def best_of(scored: DataFrame) -> DataFrame:
    """The one best setting of both stages."""
    return scored.orderBy(*ranked(scored), "stage", "setting", "gap", "least", "sure").limit(1)
