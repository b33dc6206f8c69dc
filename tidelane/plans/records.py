"""Queries over readers, record-layer scores, features, losses, model scoring and two-stage choice of settings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelane import config, shipping
from tidelane.functions import scalars, tables
from tidelane.operators import clean, evaluate, features, fusion, intervals, segments, sequence
from tidelane.plans import base, ordered, pipeline, settings
from tidelane.plans.base import KEY, ORDER
from tidelane.sources import readers

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


r6 = lambda c: F.round(c, 6)


def best_settings(scores: DataFrame, most: int) -> DataFrame:
    """The first ``most`` settings by F1, mean IoU and fewest records; a missing IoU is the lowest."""
    return scores.orderBy(F.desc("f1"), F.desc(F.coalesce("miou", F.lit(-1.0))), "records", "setting").limit(most)


def recommended(scores: DataFrame) -> DataFrame:
    """The policy with the highest mean, then the lowest deviation, then the first in order of preference (``rank``)."""
    return scores.agg(F.max_by("policy", F.struct("mean", -F.col("std"), -F.col("rank"))).alias("policy"))


def score_windows(df: DataFrame, x: str, scorer: Callable[[], Callable[[np.ndarray], np.ndarray]], key: str) -> DataFrame:
    """key and ``probs`` of windows by a model: ``scorer()`` is called once a task and gives a function of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = scorer()
        for batch in batches:
            p = np.asarray(model(np.stack(batch.column(1).to_pylist()) if batch.num_rows else np.zeros((0, 1))), np.float64).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(p), pa.list_(pa.float64()))], names=[key, "probs"])

    shipping.ship(df.sparkSession)
    return df.select(key, x).mapInArrow(run, f"{key} {dict(df.dtypes)[key]}, probs array<double>")


def onnx_scorer(data: bytes):
    """A scorer of an ONNX network (first input, first output), opened once a task."""

    def opened():
        import onnxruntime

        session = onnxruntime.InferenceSession(data, providers=["CPUExecutionProvider"])
        name = session.get_inputs()[0].name
        return lambda x: session.run(None, {name: x.astype(np.float32)})[0]

    return opened


# Readers


@query("SELECT CAST(user_id AS VARCHAR) AS user_id, epoch_us(ts) // 1000 AS t_ms, CAST(value AS FLOAT) AS ax, CAST(event_id AS FLOAT) AS gz FROM events WHERE epoch_us(ts) // 1000 > 0")
def tsv_signals(spark, sf):
    """Events written as tab-separated recordings, one text a user (with broken lines among them), and read again."""
    ev = base.events(spark, sf)
    line = F.concat_ws("\t", F.col("t_ms").cast("string"), F.col("value").cast("string"), F.lit("1"), F.lit("2"), F.lit("3"), F.lit("4"), F.col("event_id").cast("string"))
    head = "\t".join((*readers.SIGNAL[:6], "GYRO_"))
    text = ev.withColumn("line", line).groupBy(F.col("user_id").cast("string").alias("user_id")).agg(F.concat(F.lit(f"﻿{head}\n{head}\nbroken\tline\n-5\t1\t1\t1\t1\t1\t1\n"), F.array_join(F.collect_list("line"), "\r\n")).alias("text"))
    return readers.parse_signal(text).select("user_id", "t_ms", "ax", "gz")


@query("""WITH a AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS label FROM (SELECT DISTINCT event_type FROM events))
SELECT CAST(user_id AS VARCHAR) AS subject, event_type AS activity, CAST(label AS INTEGER) AS label, event_id AS line_no, (row_number() OVER (PARTITION BY CAST(user_id AS VARCHAR) ORDER BY event_id) - 1) / 20.0::DOUBLE AS t_s, value AS x FROM events JOIN a USING (event_type)""")
def line_records(spark, sf):
    e = base.table(spark, sf, "events")
    lines = e.select(F.col("event_id").alias("line_no"), F.concat_ws(",", F.col("user_id").cast("string"), "event_type", F.col("event_id").cast("string"), F.col("value").cast("string"), F.lit("0.5"), F.lit("1;;")).alias("value"))
    bad = lines.limit(1).select("line_no", F.lit("1,view,7,not a number,0,0;").alias("value"))
    return readers.line_records(lines.unionByName(bad)).select("subject", "activity", "label", "line_no", "t_s", "x")


@query("SELECT event_id, value AS a, CASE WHEN event_type <> 'view' THEN CAST(user_id AS DOUBLE) END AS b FROM events")
def spaced_records(spark, sf):
    e = base.table(spark, sf, "events")
    lines = e.select(F.col("event_id").alias("line_no"), F.concat_ws("  ", F.lit(" 9"), F.col("value").cast("string"), F.when(F.col("event_type") == "view", F.lit("NaN")).otherwise(F.col("user_id").cast("string"))).alias("value"))
    return readers.spaced_records(lines, {"a": 1, "b": 2}).select(F.col("line_no").alias("event_id"), "a", "b")


@query("SELECT event_id, CAST(CAST(floor(value * 100) AS BIGINT) % 65536 - CASE WHEN CAST(floor(value * 100) AS BIGINT) % 65536 >= 32768 THEN 65536 ELSE 0 END AS DOUBLE) / 32768 * 16 AS acc_x, (CAST(event_id AS BIGINT) % 30000) / 32768.0::DOUBLE * 2000 AS gyro_x FROM events")
def binary_frames(spark, sf):
    """Frames of 20 bytes built from events, with stray bytes between them, and decoded."""
    e = base.table(spark, sf, "events")
    word = lambda c: F.concat(F.substring(F.lpad(F.hex(c), 4, "0"), 3, 2), F.substring(F.lpad(F.hex(c), 4, "0"), 1, 2))
    raw = F.floor(F.col("value") * 100).cast("long") % 65536
    body = F.concat(F.lit("00AA5561"), word(raw), F.lit("0" * 8), word(F.col("event_id").cast("long") % 30000), F.lit("0" * 20))
    df = e.select("event_id", F.unhex(body).alias("content"))
    return readers.frames(df).select("event_id", F.col("accX").alias("acc_x"), F.col("gyroX").alias("gyro_x"))


@query("SELECT event_id, CAST(CAST(floor(value * 100) AS BIGINT) % 65536 - CASE WHEN CAST(floor(value * 100) AS BIGINT) % 65536 >= 32768 THEN 65536 ELSE 0 END AS DOUBLE) / 32768 * 16 AS acc_x, (CAST(event_id AS BIGINT) % 30000) / 32768.0::DOUBLE * 2000 AS gyro_x FROM events")
def notified_frames(spark, sf):
    """The same frames, a user's bytes cut into notifications of seven bytes: hardly a frame lies whole in one."""
    e = base.table(spark, sf, "events")
    word = lambda c: F.concat(F.substring(F.lpad(F.hex(c), 4, "0"), 3, 2), F.substring(F.lpad(F.hex(c), 4, "0"), 1, 2))
    body = F.concat(F.lit("00AA5561"), word(F.floor(F.col("value") * 100).cast("long") % 65536), F.lit("0" * 8), word(F.col("event_id").cast("long") % 30000), F.lit("0" * 20))
    w = Window.partitionBy("user_id").orderBy("event_id")
    placed = e.select("user_id", "event_id", body.alias("b"), (F.row_number().over(w) - 1).alias("r"))
    size = 22  # bytes of a frame with its two stray ones
    bytes_ = placed.select("user_id", "event_id", "r", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: F.substring(F.col("b"), 2 * k + 1, F.lit(2)))).alias("k", "h"))
    at = bytes_.withColumn("seq", F.floor((F.col("r") * size + F.col("k")) / 7))
    notes = at.groupBy("user_id", "seq").agg(F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "k", "h"))), lambda x: x["h"]), "")).alias("content"))
    found = readers.notified_frames(notes, "user_id", ["seq"])
    numbered = found.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy("seq", "i")) - 1)
    return numbered.join(placed.select("user_id", "r", "event_id"), ["user_id", "r"]).select("event_id", F.col("accX").alias("acc_x"), F.col("gyroX").alias("gyro_x"))


@query(f"WITH {base.EV} SELECT user_id, event_id, CAST((row_number() OVER (PARTITION BY user_id ORDER BY t_ms, event_id) - 1) * 10 AS BIGINT) AS t_ms FROM ev")
def synthetic_event_time(spark, sf):
    return base.events(spark, sf).select("user_id", "event_id", sequence.synthetic_time(KEY, ORDER).cast("long").alias("t_ms"))


# Features, losses, conditions

_CH = ("ax", "ay", "az", "gx", "gy", "gz")
_X = ", ".join(f"list_transform(embedding[{1 + 10 * k}:{10 + 10 * k}], lambda v: CAST(v AS DOUBLE)) AS {c}" for k, c in enumerate(_CH))
_POP = lambda c: (
    f"list_avg({c}) AS {c}_mean, list_stddev_pop({c}) AS {c}_std, list_min({c}) AS {c}_min, list_max({c}) AS {c}_max, list_median({c}) AS {c}_median, list_avg(list_transform({c}, lambda v: v * v)) AS {c}_energy, "
    f"list_sum(list_transform(generate_series(2, 10), lambda i: abs(sign({c}[i] - list_avg({c})) - sign({c}[i - 1] - list_avg({c}))))) / 20.0::DOUBLE AS {c}_zcr, list_max({c}) - list_min({c}) AS {c}_span"
)
_NORM = lambda n, a, b, c: f"list_transform(generate_series(1, 10), lambda i: sqrt({a}[i] * {a}[i] + {b}[i] * {b}[i] + {c}[i] * {c}[i])) AS {n}"
_CORR = lambda p, q: f"(list_avg(list_transform(generate_series(1, 10), lambda i: {p}[i] * {q}[i])) - list_avg({p}) * list_avg({q})) / nullif(list_stddev_pop({p}) * list_stddev_pop({q}), 0)"
_AMP = "list_transform(generate_series(0, 5), lambda k: sqrt(pow(list_sum(list_transform(generate_series(1, 10), lambda i: an[i] * cos(2 * pi() * k * (i - 1) / 10))), 2) + pow(list_sum(list_transform(generate_series(1, 10), lambda i: an[i] * sin(2 * pi() * k * (i - 1) / 10))), 2))) AS amp"
_NAMES = [f"{c}_{n}" for c in _CH for n in ("mean", "std", "min", "max", "median", "energy", "zcr", "span")]
_NAMES += [f"{s}_{n}" for s in ("acc", "gyro") for n in ("mean", "std", "max", "sma")] + ["corr_01", "corr_02", "corr_12"] + [f"freq_{n}" for n in ("dominant", "power", "low", "mid", "high")]


@query(f"""WITH c AS (SELECT vec_id, {_X} FROM embeddings), n AS (SELECT *, {_NORM('an', 'ax', 'ay', 'az')}, {_NORM('gn', 'gx', 'gy', 'gz')} FROM c), s AS (SELECT *, {_AMP} FROM n),
f AS (SELECT vec_id, {', '.join(map(_POP, _CH))}, list_avg(an) AS acc_mean, list_stddev_pop(an) AS acc_std, list_max(an) AS acc_max, list_avg(list_transform(ax, lambda v: abs(v))) + list_avg(list_transform(ay, lambda v: abs(v))) + list_avg(list_transform(az, lambda v: abs(v))) AS acc_sma,
 list_avg(gn) AS gyro_mean, list_stddev_pop(gn) AS gyro_std, list_max(gn) AS gyro_max, list_avg(list_transform(gx, lambda v: abs(v))) + list_avg(list_transform(gy, lambda v: abs(v))) + list_avg(list_transform(gz, lambda v: abs(v))) AS gyro_sma,
 coalesce({_CORR('ax', 'ay')}, 0) AS corr_01, coalesce({_CORR('ax', 'az')}, 0) AS corr_02, coalesce({_CORR('ay', 'az')}, 0) AS corr_12,
 2.0::DOUBLE * list_position(amp[2:], list_max(amp[2:])) AS freq_dominant, list_max(amp[2:]) AS freq_power, amp[2] AS freq_low, amp[3] + amp[4] + amp[5] AS freq_mid, amp[6] AS freq_high FROM s)
SELECT vec_id, {', '.join(f'round({n}, 5) AS {n}' for n in _NAMES)} FROM f""")
def window_features_64(spark, sf):
    e = base.table(spark, sf, "embeddings").select("vec_id", *[F.slice("embedding", 1 + 10 * k, 10).cast("array<double>").alias(c) for k, c in enumerate(_CH)])
    out = features.handcrafted(e, list(_CH), rate=20.0)
    return out.select("vec_id", *[F.round(n, 5).alias(n) for n in _NAMES])


@query("""WITH p AS (SELECT vec_id, label % 5 AS y, list_transform(embedding[1:5], lambda v: exp(CAST(v AS DOUBLE))) AS e FROM embeddings), q AS (SELECT vec_id, y, list_transform(e, lambda v: v / list_sum(e)) AS p FROM p)
SELECT vec_id, round(-(0.9::DOUBLE * ln(p[y + 1]) + 0.1::DOUBLE * list_avg(list_transform(p, lambda v: ln(v)))), 6) AS ce, round(-pow(1 - p[y + 1], 2) * ln(p[y + 1]), 6) AS focal FROM q""")
def training_losses(spark, sf):
    e = base.table(spark, sf, "embeddings").select("vec_id", (F.col("label") % 5).cast("int").alias("y"), fusion.softmax(F.slice("embedding", 1, 5).cast("array<double>")).alias("p"))
    return e.select("vec_id", r6(scalars.cross_entropy(F.col("p"), F.col("y"))).alias("ce"), r6(scalars.focal(F.get("p", F.col("y")))).alias("focal"))


@query("""WITH c AS (SELECT label, list(CAST(embedding[1] AS DOUBLE)) AS xs FROM embeddings GROUP BY label), o AS (SELECT label, min(embedding[1])::DOUBLE AS lo, max(embedding[1])::DOUBLE AS hi FROM embeddings GROUP BY label),
f AS (SELECT e.vec_id, greatest(abs(e.embedding[1]::DOUBLE - o.lo), abs(e.embedding[1]::DOUBLE - o.hi)) AS near FROM embeddings e JOIN o USING (label)),
g AS (SELECT e.vec_id, min(abs(e.embedding[1]::DOUBLE - m.mu)) AS far FROM embeddings e JOIN (SELECT label, avg(CAST(embedding[1] AS DOUBLE)) AS mu FROM embeddings GROUP BY label) m ON e.label <> m.label GROUP BY 1)
SELECT vec_id, round(greatest(near - far + 1, 0), 6) AS triplet FROM f JOIN g USING (vec_id)""")
def triplet_losses(spark, sf):
    """The hardest equal example by the extremes of its class, against the nearest other class's mean, on one dimension."""
    e = base.table(spark, sf, "embeddings").select("vec_id", "label", F.get("embedding", F.lit(0)).cast("double").alias("x"))
    by = e.groupBy("label").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("mu"))  # a row per class
    near = e.join(F.broadcast(by), "label").withColumn("near", F.greatest(F.abs(F.col("x") - F.col("lo")), F.abs(F.col("x") - F.col("hi"))))
    other = F.broadcast(by.select(F.col("label").alias("l2"), F.col("mu").alias("m2")))
    far = e.join(other, F.col("label") != F.col("l2")).groupBy("vec_id").agg(F.min(F.abs(F.col("x") - F.col("m2"))).alias("far"))
    return near.join(far, "vec_id").select("vec_id", r6(scalars.triplet(F.col("near"), F.col("far"))).alias("triplet"))


@query("""WITH q AS (SELECT user_id, quantile_cont(abs(value), 0.9) AS m FROM events GROUP BY 1) SELECT event_id, round(greatest(-m, least(m, value)), 6) AS value FROM events JOIN q USING (user_id)""")
def saturated_signal(spark, sf):
    ev = base.events(spark, sf).select("user_id", "event_id", "t_ms", "value")
    return clean.perturb(ev, KEY, ORDER, "value", "saturate", 0.9).select("event_id", r6("value").alias("value"))


@query(f"WITH {base.IX}, s AS (SELECT user_id, stddev_pop(value) AS s FROM ev GROUP BY 1) SELECT event_id, round(value + 0.5::DOUBLE * s * (CASE WHEN n > 1 THEN i / (n - 1)::DOUBLE ELSE 0 END + 0.5::DOUBLE * sin(2 * 3.141592653589793::DOUBLE * CASE WHEN n > 1 THEN i / (n - 1)::DOUBLE ELSE 0 END)), 6) AS value FROM ix JOIN s USING (user_id)")
def drifting_signal(spark, sf):
    ev = base.events(spark, sf).select("user_id", "event_id", "t_ms", "value")
    return clean.perturb(ev, KEY, ORDER, "value", "drift", 0.5).select("event_id", r6("value").alias("value"))


@query(f"WITH {base.IX} SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY i) AS value FROM ix")
def user_hook(spark, sf):
    """A user's own change of each series (here: the largest value so far), by the hook."""
    ev = base.events(spark, sf).select("user_id", "event_id", "t_ms", "value")
    return clean.apply_to_series(ev, KEY, ORDER, "value", np.maximum.accumulate).select("event_id", "value")


@query()
def jittered_times(spark, sf):
    ev = base.events(spark, sf).select("user_id", "event_id", F.col("t_ms").cast("double").alias("t_ms"))
    return clean.jitter(ev, KEY, ORDER, "t_ms", 0.3)


@query()
def mixed_windows(spark, sf):
    e = base.table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    return features.mixup(e, "x", "label", "vec_id")


def _norm_sql(name: str, body: str) -> str:
    part = lambda v: body.replace("{v}", v)
    at = lambda a: f"list_transform(generate_series(-2, 2), lambda d: {a}[CAST(greatest(0, least(ix.n - 1, i + d)) AS BIGINT) + 1])"
    return f"""WITH {base.IX}, l AS (SELECT user_id, list(value ORDER BY i) AS a, list(CAST(state AS DOUBLE) * 10 ORDER BY i) AS b FROM ix GROUP BY user_id), v AS (SELECT ix.user_id, event_id, {part(at('a'))} AS x, {part(at('b'))} AS y FROM ix JOIN l ON ix.user_id = l.user_id)
SELECT user_id, event_id, round(CASE WHEN x + y <= 0 THEN 0.5 ELSE x / (x + y) END, 6) AS {name} FROM v"""


def _shares(spark, sf, **widths):
    ev = base.events(spark, sf).withColumns({"p0": F.col("value"), "p1": F.col("state") * 10.0})
    return sequence.smoothed_shares(ev, KEY, ORDER, ["p0", "p1"], **widths)


@query(_norm_sql("share", "list_sum({v}) / 5"))
def moving_avg_renormalised(spark, sf):
    return _shares(spark, sf, average=5).select("user_id", "event_id", r6("p0").alias("share"))


@query(_norm_sql("share", "list_sort({v})[3]"))
def median_renormalised(spark, sf):
    return _shares(spark, sf, median=5).select("user_id", "event_id", r6("p0").alias("share"))


# Models and scales


@query(f"WITH {ordered._SCALES} SELECT user_id, event_id, {', '.join(f'round((p3[{s + 1}] + p5[{s + 1}] + p8[{s + 1}]) / 3, 6) AS f{s}' for s in range(5))} FROM sc")
def seed_ensemble(spark, sf):
    p = ordered.posteriors(spark, sf)
    rows = p.select("user_id", "event_id", F.explode(F.array("p3", "p5", "p8")).alias("probs"))
    return fusion.ensemble(rows, ["user_id", "event_id"]).select("user_id", "event_id", *[r6(F.element_at("probs", s + 1)).alias(f"f{s}") for s in range(5)])


def _by_scale(spark, sf, scales: tuple[str, ...]):
    p = ordered.posteriors(spark, sf)
    tagged = F.array(*[F.struct(F.lit(s).alias("scale"), F.lit(m).alias("model"), F.col(s).alias("probs")) for s in scales for m in (0, 1)])
    return p.select("user_id", "t_ms", "event_id", F.explode(tagged).alias("r")).select("user_id", "t_ms", "event_id", "r.*")


@query(ordered.SQL["fusion_weighted_long"])
def multi_scale_fusion(spark, sf):
    f = fusion.orchestrate(_by_scale(spark, sf, ("p3", "p5", "p8")), KEY, ORDER, "weighted_long")
    return f.select("user_id", "event_id", *[r6(F.element_at("fused", s + 1)).alias(f"f{s}") for s in range(5)])


@query(f"WITH {ordered._SCALES} SELECT user_id, event_id, {', '.join(f'round(p5[{s + 1}], 6) AS f{s}' for s in range(5))} FROM sc")
def single_scale(spark, sf):
    f = fusion.orchestrate(_by_scale(spark, sf, ("p5",)), KEY, ORDER)
    return f.select("user_id", "event_id", *[r6(F.element_at("fused", s + 1)).alias(f"f{s}") for s in range(5)])


@query("""WITH w AS (SELECT vec_id, list_transform(generate_series(0, 4), lambda c: exp(-list_sum(list_transform(generate_series(1, 64), lambda i: pow(CAST(embedding[i] AS DOUBLE) - (CASE WHEN (i - 1) % 5 = c THEN 0.2::DOUBLE ELSE 0 END), 2))))) AS e FROM embeddings)
SELECT vec_id, round(list_max(e) / list_sum(e), 6) AS confidence, CAST(list_position(e, list_max(e)) - 1 AS INTEGER) AS class_idx FROM w""")
def centroid_scorer(spark, sf):
    """The default scorer: a softmax of negative squared distances to fixed centroids, in batches."""
    e = base.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    centroids = np.where(np.arange(64)[None, :] % 5 == np.arange(5)[:, None], 0.2, 0.0)

    def scorer():
        def run(x: np.ndarray) -> np.ndarray:
            z = -((x[:, None, :] - centroids) ** 2).sum(axis=2)
            e = np.exp(z - z.max(axis=1, keepdims=True))
            return e / e.sum(axis=1, keepdims=True)

        return run

    p = score_windows(e, "x", scorer, "vec_id")
    return p.select("vec_id", r6(F.array_max("probs")).alias("confidence"), fusion.argmax(F.col("probs")).alias("class_idx"))


@query()
def mlp_window_classifier(spark, sf):
    """A multilayer perceptron on standardised windows; macro F1 and accuracy on a fifth that it didn't see."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    from tidelane.plans.experiments import macro_f1

    e = base.table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"), *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)])
    fold = F.pmod(F.xxhash64("vec_id"), F.lit(5))
    classes = e.agg(F.max("label")).first()[0] + 1
    stages = [VectorAssembler(inputCols=[f"x{i}" for i in range(64)], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), MultilayerPerceptronClassifier(labelCol="label", layers=[64, 32, classes], maxIter=40, seed=7)]
    return macro_f1(Pipeline(stages=stages).fit(e.where(fold != 0)).transform(e.where(fold == 0)), "label", "prediction")


# Scores and settings

_SPAN = "span AS (SELECT sum(s) / 3.6e6 AS hours FROM (SELECT max(t_ms) - min(t_ms) AS s FROM ev GROUP BY user_id))"
_KEEP = "end_ms - start_ms >= 3600000 AND class_idx NOT IN (4)"


def _spans(spark, sf):
    return base.events(spark, sf).groupBy("user_id").agg((F.max("t_ms") - F.min("t_ms")).alias("span_ms"))


@query(f"""WITH {base.PAIRS}, {_SPAN}, m AS (SELECT count(*) AS tp, avg(iou) AS miou, avg((abs(p0 - g0) + abs(p1 - g1)) / 2.0) / 1000 AS mae FROM cand WHERE iou > 0.5 AND class_idx NOT IN (4) AND p1 - p0 >= 3600000 AND g1 - g0 >= 3600000),
p AS (SELECT count(*) AS p FROM pred WHERE {_KEEP}), g AS (SELECT count(*) AS g FROM gold WHERE {_KEEP})
SELECT tp, p - tp AS fp, g - tp AS fn, round(2.0::DOUBLE * tp / (p + g), 6) AS f1, round(miou, 6) AS miou, round(mae, 3) AS boundary_mae_s, round((p - tp) / hours, 6) AS fp_per_hour, round(p / hours, 6) AS records_per_hour FROM m, p, g, span""")
def record_layer_scores(spark, sf):
    gold, pred = base.gold_and_pred(spark, sf)
    s = evaluate.record_scores(pred, gold, _spans(spark, sf), KEY, least_ms=3_600_000, ignored=(4,))
    return s.select("tp", "fp", "fn", r6("f1").alias("f1"), r6("miou").alias("miou"), F.round("boundary_mae_s", 3).alias("boundary_mae_s"), r6("fp_per_hour").alias("fp_per_hour"), r6("records_per_hour").alias("records_per_hour"))


@query(f"""WITH {base.PAIRS}, u AS (SELECT DISTINCT user_id FROM ev), g AS (SELECT user_id, count(*) AS g FROM gold WHERE class_idx = 1 GROUP BY 1), p AS (SELECT user_id, count(*) AS p FROM pred WHERE class_idx = 1 GROUP BY 1), t AS (SELECT user_id, count(*) AS t FROM matched WHERE class_idx = 1 GROUP BY 1)
SELECT user_id, round(CASE WHEN coalesce(g, 0) + coalesce(p, 0) = 0 THEN 1 ELSE 2.0::DOUBLE * coalesce(t, 0) / (coalesce(g, 0) + coalesce(p, 0)) END, 6) AS f1 FROM u LEFT JOIN g USING (user_id) LEFT JOIN p USING (user_id) LEFT JOIN t USING (user_id)""")
def tuning_f1(spark, sf):
    """F1 of one class by user, 1 where neither side has it."""
    gold, pred = (df.where("class_idx = 1") for df in base.gold_and_pred(spark, sf))
    u = evaluate.per_user(pred, gold, evaluate.matches(pred, gold, KEY), KEY, 1.0, base.events(spark, sf))
    return u.select("user_id", r6("f1").alias("f1"))


_GRID = [(g * 10 + d, g, d) for g in range(2) for d in range(3)]


@query(f"""WITH {base.PAIRS}, s AS (SELECT * FROM (VALUES {', '.join(f"({k}, {d * 7200000})" for k, _, d in _GRID[:3])}) t(setting, least)),
p AS (SELECT setting, count(*) AS records FROM pred, s WHERE end_ms - start_ms >= least GROUP BY 1), m AS (SELECT setting, count(*) AS tp, avg(iou) AS miou FROM matched, s WHERE p1 - p0 >= least GROUP BY 1), r AS (SELECT setting, round(2.0::DOUBLE * tp / (records + (SELECT count(*) FROM gold)), 6) AS f1, round(miou, 6) AS miou, records FROM p JOIN m USING (setting)),
b AS (SELECT setting FROM r ORDER BY f1 DESC, miou DESC, records, setting LIMIT 2), e AS (SELECT setting * 100 + k AS setting, CAST(greatest(least, k * 3600000) AS BIGINT) AS least FROM s JOIN b USING (setting), (SELECT unnest([1, 3]) AS k)),
p2 AS (SELECT setting, count(*) AS records FROM pred, e WHERE end_ms - start_ms >= least GROUP BY 1), m2 AS (SELECT setting, count(*) AS tp, avg(iou) AS miou FROM matched, e WHERE p1 - p0 >= least GROUP BY 1)
SELECT 1 AS stage, setting, f1, miou, records FROM r UNION ALL SELECT 2, setting, round(2.0::DOUBLE * tp / (records + (SELECT count(*) FROM gold)), 6), round(miou, 6), records FROM p2 JOIN m2 USING (setting)""")
def two_stage_grid(spark, sf):
    """Least durations in a first stage, the two best of them with two more conditions in a second."""
    gold, pred = base.gold_and_pred(spark, sf)
    matched = evaluate.matches(pred, gold, KEY).select((F.col("p1") - F.col("p0")).alias("length"), "iou")
    n_gold = gold.agg(F.count(F.lit(1)).alias("g"))

    def scored(settings: DataFrame) -> DataFrame:
        s = F.broadcast(settings.select("setting", "least"))  # a few rows
        p = pred.select((F.col("end_ms") - F.col("start_ms")).alias("length")).join(s, F.expr("length >= least")).groupBy("setting").agg(F.count(F.lit(1)).alias("records"))
        m = matched.join(s, F.expr("length >= least")).groupBy("setting").agg(F.count(F.lit(1)).alias("tp"), F.avg("iou").alias("miou"))
        f1 = r6(evaluate.ratio(2 * F.col("tp"), F.col("records") + F.col("g")))
        return p.join(m, "setting").join(F.broadcast(n_gold)).select("setting", f1.alias("f1"), r6("miou").alias("miou"), "records")

    first = spark.createDataFrame([(k, d * 7_200_000) for k, _, d in _GRID[:3]], "setting int, least long")
    one = scored(first)
    more = spark.createDataFrame([(1, 3_600_000), (3, 10_800_000)], "k int, more long")
    wide = first.join(best_settings(one, 2).select("setting"), "setting", "left_semi").join(F.broadcast(more)).select((F.col("setting") * 100 + F.col("k")).alias("setting"), F.greatest("least", "more").alias("least"))
    return one.withColumn("stage", F.lit(1)).unionByName(scored(wide).withColumn("stage", F.lit(2)))


_DIMS = ", ".join(f"('c{k}', CAST(embedding[{k + 1}] AS DOUBLE))" for k in range(18))
_NORMED = ", ".join(f"('{n}', sqrt({' + '.join(f'pow(CAST(embedding[{k}] AS DOUBLE), 2)' for k in at)}))" for n, at in (("acc", (1, 2, 3)), ("gyro", (4, 5, 6))))


@query(f"""WITH u AS (SELECT label, t.c AS channel, t.x FROM embeddings, LATERAL (VALUES {_DIMS}, {_NORMED}) t(c, x)),
b AS (SELECT channel, label, count(*) AS k, avg(x) AS mu, var_pop(x) AS v FROM u GROUP BY ALL), g AS (SELECT channel, sum(k * mu) / sum(k) AS o FROM b GROUP BY 1), r AS (SELECT channel, sum(k * (mu - o) * (mu - o)) / sum(k * v) AS ratio FROM b JOIN g USING (channel) GROUP BY 1)
SELECT channel, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS min, round(max(x), 6) AS max, round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS p75,
 round(avg((x = 0)::DOUBLE), 6) AS zeros, 0.0::DOUBLE AS missing, round(any_value(ratio), 6) AS ratio FROM u JOIN r USING (channel) GROUP BY channel""")
def channel_audit(spark, sf):
    """Twenty channels: eighteen components of the vectors and the norms of the first two threes."""
    e = base.table(spark, sf, "embeddings").select("label", *[F.get("embedding", F.lit(k)).cast("double").alias(f"c{k}") for k in range(18)])
    out = features.audit(e, "label", [f"c{k}" for k in range(18)], {"acc": ("c0", "c1", "c2"), "gyro": ("c3", "c4", "c5")})
    return out.select(*[c if c in ("channel", "n") else r6(c).alias(c) for c in out.columns])


@query(f"WITH {base.RUN} SELECT user_id AS key, any_value(state) AS state, min(t_ms) AS first_ms, max(t_ms) AS last_ms, CAST(min(i) AS BIGINT) AS start_idx, CAST(max(i) AS BIGINT) AS end_idx, round(avg(value), 4) AS prob FROM run GROUP BY user_id, run_id")
def runs_by_sql(spark, sf):
    """Runs of states by the table function, called from SQL."""
    tables.register(spark)
    ev = base.events(spark, sf).select(F.col("user_id").cast("long").alias("user_id"), "t_ms", "event_id", "state", "value")
    return spark.sql("SELECT key, state, first_ms, last_ms, start_idx, end_idx, round(prob, 4) AS prob FROM state_runs(TABLE(SELECT * FROM {ev}) PARTITION BY user_id ORDER BY (t_ms, event_id))", ev=ev)


@query(f"WITH {base.PAIRS} SELECT user_id AS key, CAST(pred_id AS BIGINT) AS pred_id, CAST(gold_id AS BIGINT) AS gold_id FROM matched")
def matches_by_sql(spark, sf):
    """One-to-one matches by the table function, called from SQL."""
    tables.register(spark)
    gold, pred = base.gold_and_pred(spark, sf)
    pairs = intervals.candidates(pred, gold, [KEY, "class_idx"]).select(F.col(KEY).cast("long").alias("user_id"), "pred_id", "gold_id", "iou")
    return spark.sql("SELECT key, pred_id, gold_id FROM one_to_one(TABLE(SELECT * FROM {pairs}) PARTITION BY user_id ORDER BY (iou DESC, pred_id, gold_id))", pairs=pairs)


def _recordings(spark, sf):
    """Each user's events as a recording: steps with times from its start and a column a class, true records, length."""
    p = ordered.posteriors(spark, sf)
    starts = p.groupBy("user_id").agg(F.min("t_ms").alias("_t0"), F.max("t_ms").alias("_t1"))
    steps = p.join(starts, "user_id").select("user_id", (F.col("t_ms") - F.col("_t0")).alias("t_ms"), "event_id", "state", *[F.element_at("p3", k + 1).alias(f"c{k}") for k in range(5)])
    spans = starts.select("user_id", (F.col("_t1") - F.col("_t0")).alias("span_ms"))
    true = segments.midpoint_runs(steps.join(spans, "user_id").withColumn("sure", F.lit(1.0)), KEY, ORDER, "state", "sure", "t_ms", "span_ms")
    gold = true.select("user_id", F.col("run_id").alias("gold_id"), F.col("state").alias("class_idx"), F.col("start").alias("start_ms"), F.col("end").alias("end_ms"))
    return steps, gold, spans


HOUR = 3_600_000


@query()
def two_stage_full_grid(spark, sf):
    """288 sequence settings, then the 40 best of them with 96 record settings each; all settings are rows."""
    steps, gold, spans = _recordings(spark, sf)
    out = settings.two_stage(steps, gold, spans, KEY, ORDER, "t_ms", [f"c{k}" for k in range(5)], "state", gaps=(0, 6 * HOUR, 24 * HOUR, 72 * HOUR), lengths=(0, HOUR, 6 * HOUR, 24 * HOUR), ignored=(4,))
    return out.withColumns({c: r6(c) for c in ("f1", "miou", "records_per_hour", "accuracy")})


@query()
def policy_sweep(spark, sf):
    """Mean and micro F1 of policies over events, all in one plan: presets, and FULL with one parameter changed at a time."""
    p = ordered.posteriors(spark, sf)
    gold = sequence.runs(p, KEY, ORDER, "state").groupBy(KEY, F.col("run_id").alias("gold_id")).agg(F.first("state").alias("class_idx"), (F.min("t_ms") - HOUR).alias("start_ms"), (F.max("t_ms") + HOUR).alias("end_ms")).where("class_idx > 0")
    full = config.FULL.derive("full", merge_gap=3600.0, min_duration=3600.0, top_k=0, min_confidence=0.3, smooth=3, median=3)
    changes = {"smooth": (0, 5), "median": (0, 5), "self_stay": (0.5, 0.9), "merge_gap": (0.0, 86_400.0), "min_duration": (0.0, 14_400.0), "top_k": (3, 10), "min_confidence": (0.0, 0.6)}
    policies = [config.RAW, full, *[full.derive(f"{k}={v}", **{k: v}) for k, values in changes.items() for v in values]]
    out = pipeline.sweep(p.select(KEY, "t_ms", "event_id", F.col("p3").alias("probs")), gold, KEY, ORDER, 5, policies, pad_ms=HOUR)
    return out.select("ord", "policy", r6("mean_f1").alias("mean_f1"), r6("micro_f1").alias("micro_f1"))


@query()
def ablation_suites(spark, sf):
    """Mean and micro F1 of every preset of the suites, in one plan, with the difference to the suite's full preset. A
    user's events stand two minutes apart."""
    p = ordered.posteriors(spark, sf).withColumn("t_ms", sequence.synthetic_time(KEY, ORDER, 120_000).cast("long"))
    gold = sequence.runs(p, KEY, ORDER, "state").groupBy(KEY, F.col("run_id").alias("gold_id")).agg(F.first("state").alias("class_idx"), (F.min("t_ms") - 60_000).alias("start_ms"), (F.max("t_ms") + 60_000).alias("end_ms")).where("class_idx > 0")
    named = [(suite, policy) for suite, policies in config.SUITES.items() for policy in policies]
    out = pipeline.sweep(p.select(KEY, "t_ms", "event_id", F.col("p5").alias("probs")), gold, KEY, ORDER, 5, [policy for _, policy in named], pad_ms=60_000)
    suite = F.get(F.array(*[F.lit(s) for s, _ in named]), F.col("ord"))
    full = F.max(F.when(F.col("policy").rlike("full$"), F.col("mean_f1"))).over(Window.partitionBy("suite"))
    out = out.withColumn("suite", suite).withColumn("delta", F.col("mean_f1") - full)
    return out.select("suite", "policy", *[r6(c).alias(c) for c in ("mean_f1", "micro_f1", "delta")])


@query(f"""WITH {base.USERF}, s AS (SELECT 'all' AS policy, 1 AS rank, avg(f1) AS mean, stddev_pop(f1) AS std FROM uf UNION ALL SELECT 'twin', 2, avg(f1), stddev_pop(f1) FROM uf UNION ALL SELECT 'half', 0, avg(f1 / 2), stddev_pop(f1 / 2) FROM uf) SELECT policy FROM s ORDER BY mean DESC, std, rank LIMIT 1""")
def recommended_policy(spark, sf):
    gold, pred = base.gold_and_pred(spark, sf)
    u = evaluate.per_user(pred, gold, evaluate.matches(pred, gold, KEY), KEY)
    rows = u.select(F.explode(F.array(*[F.struct(F.lit(p).alias("policy"), F.lit(k).alias("rank"), (F.col("f1") * w).alias("f1")) for p, k, w in (("all", 1, 1.0), ("twin", 2, 1.0), ("half", 0, 0.5))])).alias("r")).select("r.*")
    return recommended(rows.groupBy("policy", "rank").agg(F.avg("f1").alias("mean"), F.stddev_pop("f1").alias("std")))


@query(f"""WITH {base.USERF} SELECT user_id, round(f1, 6) AS "all", round(f1 / 2, 6) AS half FROM uf""")
def policy_table_wide(spark, sf):
    gold, pred = base.gold_and_pred(spark, sf)
    u = evaluate.per_user(pred, gold, evaluate.matches(pred, gold, KEY), KEY)
    long = u.select("user_id", F.explode(F.create_map(F.lit("all"), F.col("f1"), F.lit("half"), F.col("f1") / 2)).alias("policy", "f1"))
    return readers.wide_scores(long, "user_id", "policy", "f1", ["all", "half"]).select("user_id", r6("all").alias("all"), r6("half").alias("half"))


@query(f"""WITH {base.RUN}, s AS (SELECT user_id, run_id AS seg_id, min(t_ms) AS a, max(t_ms) AS b FROM run GROUP BY ALL HAVING count(*) > 1), j AS (SELECT s.user_id, seg_id, event_id, t_ms, abs(t_ms - (a + b) / 2.0) <= 3600000 AS near FROM s JOIN ev ON s.user_id = ev.user_id AND t_ms BETWEEN a AND b),
k AS (SELECT *, bool_or(near) OVER (PARTITION BY user_id, seg_id) AS has, row_number() OVER (PARTITION BY user_id, seg_id ORDER BY t_ms) AS r FROM j) SELECT user_id, CAST(seg_id AS BIGINT) AS seg_id, count(*) AS n, min(t_ms) AS first_ms FROM k WHERE near OR (NOT has AND r <= 2) GROUP BY ALL""")
def middle_slices(spark, sf):
    ev = base.events(spark, sf)
    seg = sequence.runs(ev, KEY, ORDER, "state").groupBy(KEY, F.col("run_id").alias("seg_id")).agg(F.min("t_ms").alias("start_ms"), F.max("t_ms").alias("end_ms"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    near = intervals.around_middle(ev.select("user_id", "event_id", "t_ms"), seg, KEY, "t_ms", half_ms=3_600_000, rows=2)
    return near.groupBy("user_id", F.col("seg_id").cast("long").alias("seg_id")).agg(F.count(F.lit(1)).alias("n"), F.min("t_ms").alias("first_ms"))


@query(f"""WITH {base.RUN}, s AS (SELECT user_id, min(t_ms) AS a, max(t_ms) AS b, sum(CAST(round(value * 100) AS BIGINT)) AS cents, count(*) AS k FROM run GROUP BY user_id, run_id HAVING any_value(state) > 0)
SELECT user_id, count(*) AS n, CAST(sum(b - a) AS BIGINT) AS active_ms, CAST(sum(cents) AS BIGINT) AS cents, CAST(sum(k) AS BIGINT) AS samples, quantile_disc(b - a, 0.1) AS p10_ms, quantile_disc(b - a, 0.9) AS p90_ms FROM s GROUP BY 1""")
def cohort_totals(spark, sf):
    """A user's segments in whole numbers: durations, summed values, quantiles of durations that occur."""
    s = sequence.runs(base.events(spark, sf), KEY, ORDER, "state").groupBy(KEY, "run_id").agg(F.first("state").alias("state"), (F.max("t_ms") - F.min("t_ms")).alias("d"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"), F.count(F.lit(1)).alias("k")).where("state > 0")
    q = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY d)").cast("long")
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("d").alias("active_ms"), F.sum("cents").alias("cents"), F.sum("k").alias("samples"), q(0.1).alias("p10_ms"), q(0.9).alias("p90_ms"))
