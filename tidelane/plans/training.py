"""From samples to a judged model: windows, robust features, folds by key, retraining, choice of settings, test."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelane import storage
from tidelane.operators import features, segments, sequence
from tidelane.plans import base, settings
from tidelane.plans.base import KEY, ORDER
from tidelane.plans.experiments import fit_linear, macro_f1

QUERIES, SQL = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def windowed(samples: DataFrame, key: str, order: list[str], time: str, channels: list[str], truth: str, *, width: int, step: int, norms: dict[str, tuple[str, str, str]] | None = None) -> tuple[DataFrame, list[str]]:
    """A row a window of ``width`` samples: key, win_id, t_ms (its middle sample's time), label (the commonest ``truth``, the
    smallest of equals) and the robust figures of every channel and of the ``norms`` of three; and the figures' names."""
    wide = sequence.count_windows(samples.select(key, *order, F.col(time).alias("_t"), F.col(truth).alias("_y"), *channels), key, order, width, step)
    rows = F.sort_array(F.collect_list(F.struct("i", *channels)))
    middle = F.max(F.when(F.col("i") == F.col("win_id") * step + width // 2, F.col("_t")))
    votes = wide.groupBy(key, "win_id", "_y").agg(F.count(F.lit(1)).alias("_n")).groupBy(key, "win_id").agg(F.max_by("_y", F.struct("_n", -F.col("_y"))).cast("int").alias("label"))
    held = wide.groupBy(key, "win_id").agg(rows.alias("_r"), middle.alias("t_ms")).join(votes, [key, "win_id"])
    held = held.withColumns({f"_{c}": F.col("_r").getField(c).cast("array<double>") for c in channels})
    for name, part in (norms or {}).items():
        held = held.withColumn(f"_{name}", features.norm3(*[F.col(f"_{c}") for c in part]))
    figures = {f"{c}_{n}": v for c in [*channels, *(norms or {})] for n, v in features.robust(F.col(f"_{c}")).items()}
    return held.select(key, "win_id", "t_ms", "label", *[F.coalesce(v, F.lit(0.0)).alias(n) for n, v in figures.items()]), list(figures)


def folds(df: DataFrame, key: str, count: int, seed: int = 42) -> DataFrame:
    """``fold`` of each row, the same for all of a key."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(count)).cast("int"))


def cross_validated(windows: DataFrame, names: list[str], key: str, held_out: DataFrame, *, count: int = 5, strengths: tuple = (0.0, 0.01)) -> DataFrame:
    """part (fold0, ... and held_out), strength, macro_f1 and accuracy: grouped cross-validation by key over regularisation
    strengths, every fold retrained on the others; the best strength, retrained on all, on ``held_out``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import Evaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    class MacroF1(Evaluator):
        def _evaluate(self, dataset: DataFrame) -> float:
            return macro_f1(dataset, "label", "prediction").first().macro_f1

    spark = windows.sparkSession
    rows = storage.materialize(folds(windows, key, count), "folds")
    model = LogisticRegression(labelCol="label", maxIter=30)
    stages = [VectorAssembler(inputCols=names, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), model]
    grid = ParamGridBuilder().addGrid(model.regParam, list(strengths)).build()
    fitted = CrossValidator(estimator=Pipeline(stages=stages), estimatorParamMaps=grid, evaluator=MacroF1(), numFolds=count, foldCol="fold", collectSubModels=True).fit(rows)
    best = max(range(len(strengths)), key=lambda k: (fitted.avgMetrics[k], -k))
    out = []
    for n, by_strength in enumerate([*[m[best] for m in fitted.subModels], fitted.bestModel]):
        part = rows.where(F.col("fold") == n) if n < count else held_out
        r = macro_f1(by_strength.transform(part), "label", "prediction").first()
        out.append((f"fold{n}" if n < count else "held_out", float(strengths[best]), r.macro_f1, r.accuracy))
    return spark.createDataFrame(out, "part string, strength double, macro_f1 double, accuracy double")


def portability(windows: DataFrame, names: list[str], key: str, spans: DataFrame, classes: int, split: dict[str, DataFrame], *, gaps: tuple, lengths: tuple, least: float = 0.0, **grid) -> DataFrame:
    """Fit on the keys of ``split['train']``, choose settings on ``split['dev']``, and judge the likeliest class of each
    window (mode argmax) against decoding by the chosen settings (mode decoded) on ``split['test']``."""
    from pyspark.ml.functions import vector_to_array

    of = lambda name: windows.join(split[name].select(key).distinct(), key, "left_semi")
    model = fit_linear(of("train"), names, "label")
    columns = [f"c{k}" for k in range(classes)]

    def scored(name: str) -> tuple[DataFrame, DataFrame]:
        p = model.transform(of(name)).withColumn("_p", vector_to_array("probability"))
        steps = p.select(key, "win_id", "t_ms", "label", *[F.coalesce(F.get("_p", F.lit(k)), F.lit(0.0)).alias(c) for k, c in enumerate(columns)])
        steps = storage.materialize(steps, f"portability-{name}")
        true = segments.midpoint_runs(steps.join(spans.select(key, "span_ms"), key).withColumn("_one", F.lit(1.0)), key, ["win_id"], "label", "_one", "t_ms", "span_ms")
        return steps, storage.materialize(true.select(key, F.col("run_id").alias("gold_id"), F.col("state").alias("class_idx"), F.col("start").alias("start_ms"), F.col("end").alias("end_ms")), f"gold-{name}")

    def judged(name: str, **chosen) -> DataFrame:
        steps, gold = scored(name)
        here = spans.join(split[name].select(key).distinct(), key, "left_semi")
        return settings.two_stage(steps, gold, here, key, ["win_id"], "t_ms", columns, "label", **chosen)

    dev = settings.best_of(judged("dev", gaps=gaps, lengths=lengths, least=least, **grid)).first()
    one = {"smooth": (dev.smooth,), "median": (dev.median,), "stay": (dev.stay,), "run": (dev.run,)}
    decoded = judged("test", gaps=(dev.gap,), lengths=(dev.least,), sure=(dev.sure,), kept=1, **one).where("stage = 2")
    # With all transitions alike the decoder takes each step's likeliest class.
    plain = judged("test", gaps=(0.0,), lengths=(dev.least,), sure=(0.0,), kept=1, smooth=(1,), median=(1,), stay=(1.0 / classes,), run=(1,)).where("stage = 2")
    return decoded.withColumn("mode", F.lit("decoded")).unionByName(plain.withColumn("mode", F.lit("argmax"))).drop("stage", "setting")


def _event_windows(spark, sf):
    """Windows of 12 events, 4 apart, of each user; hours since the user's first event as time."""
    ev = base.events(spark, sf)
    w = Window.partitionBy(KEY).orderBy(*ORDER)
    first = ev.groupBy(KEY).agg(F.min("t_ms").alias("_t0"), F.max("t_ms").alias("_t1"))
    rows = ev.join(first, KEY).withColumn("gap", F.coalesce((F.col("t_ms") - F.lag("t_ms").over(w)) / 3.6e6, F.lit(0.0))).withColumn("wave", F.sin(F.col("t_ms") / 1.4e7) + F.col("state"))
    rows = rows.withColumn("t_ms", F.col("t_ms") - F.col("_t0"))
    windows, names = windowed(rows, KEY, ORDER, "t_ms", ["value", "gap", "wave"], "state", width=12, step=4, norms={"size": ("value", "gap", "wave")})
    return storage.materialize(windows, "windows"), names, first.select(KEY, (F.col("_t1") - F.col("_t0")).alias("span_ms"))


@query
def retraining_cv(spark, sf):
    """Five folds by user, each retrained; a fifth of the users is held out of all of them."""
    windows, names, _ = _event_windows(spark, sf)
    outside = F.pmod(F.xxhash64(KEY, F.lit(7)), F.lit(5)) == 0
    out = cross_validated(windows.where(~outside), names, KEY, windows.where(outside))
    return out.select("part", "strength", F.round("macro_f1", 6).alias("macro_f1"), F.round("accuracy", 6).alias("accuracy"))


@query
def portability_run(spark, sf):
    """Train on three fifths of the users, choose on a fifth, test on the rest."""
    windows, names, spans = _event_windows(spark, sf)
    part = spans.withColumn("_f", F.pmod(F.xxhash64(KEY, F.lit(11)), F.lit(5)))
    split = {"train": part.where("_f > 1"), "dev": part.where("_f = 1"), "test": part.where("_f = 0")}
    hour = 3_600_000
    out = portability(windows, names, KEY, spans, 5, split, gaps=(0, 12 * hour), lengths=(0, 6 * hour), smooth=(1, 3), median=(1, 3), stay=(0.5, 0.9), run=(1, 2))
    return out.withColumns({c: F.round(c, 6) for c in ("f1", "miou", "records_per_hour", "accuracy")})
