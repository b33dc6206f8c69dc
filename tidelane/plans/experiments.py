"""Experiments over results: policy choice on split halves, cohorts, robustness conditions, window classifiers."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelane.operators import clean, features, sequence, stats
from tidelane.plans import base
from tidelane.plans.base import KEY, ORDER

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


r6 = lambda c: F.round(c, 6)


def split_halves(scores: DataFrame, splits: int, seed: int = 20260311) -> DataFrame:
    """split, policy and its mean F1 on either half of the users (tune_f1, outer_f1), in whole billionths over the count.

    ``scores`` has user_id, policy, f1; a user's half in a split is the first digit of the digest of (seed, split, user).
    """
    numbered = scores.withColumn("split", F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))).withColumn("x", F.floor(F.col("f1") * 1_000_000_000 + 0.5).cast("long"))
    digit = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "split", F.col("user_id").cast("string"))), 1, 1), 16, 10).cast("int")
    mean = lambda tune: (F.sum(F.when((digit % 2 == 0) == F.lit(tune), F.col("x"))) / F.count(F.when((digit % 2 == 0) == F.lit(tune), 1)) / 1e9)
    return numbered.groupBy("split", "policy").agg(mean(True).alias("tune_f1"), mean(False).alias("outer_f1"))


def split_selection(scores: DataFrame, splits: int, seed: int = 20260311) -> DataFrame:
    """Per split: the policy that is best on one half of the users (the last by name of equals), and its mean F1 on either."""
    best = split_halves(scores, splits, seed).groupBy("split").agg(F.max_by(F.struct("policy", "tune_f1", "outer_f1"), F.struct("tune_f1", "policy")).alias("c"))
    return best.select("split", "c.*")


def selection_frequency(selected: DataFrame) -> DataFrame:
    """How often each policy was chosen, and the mean F1 on the halves that didn't choose it."""
    total = selected.agg(F.count(F.lit(1)).alias("_t"))
    by = selected.groupBy("policy").agg(F.count(F.lit(1)).alias("n"), F.avg("outer_f1").alias("outer_f1"))
    return by.join(F.broadcast(total)).select("policy", "n", (F.col("n") / F.col("_t")).alias("share"), "outer_f1")  # one row


def selection_against(scores: DataFrame, splits: int, reference: str, seed: int = 20260311) -> DataFrame:
    """Paired test over the splits: the chosen policy's F1 on the outer half against that of a fixed one."""
    fixed = split_halves(scores, splits, seed).where(F.col("policy") == reference).select("split", F.col("outer_f1").alias("fixed_f1"))
    return stats.paired_effect(split_selection(scores, splits, seed).join(fixed, "split"), "outer_f1", "fixed_f1")


def split_summary(df: DataFrame, by: str, x: str) -> DataFrame:
    """Mean, sample deviation and quantiles over repeats."""
    q = F.percentile(x, F.array(*[F.lit(v) for v in (0.05, 0.25, 0.5, 0.75, 0.95)])).alias("q")
    out = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("std"), q)
    return out.select(by, "n", "mean", "std", *[F.col("q")[i].alias(n) for i, n in enumerate(("q05", "q25", "q50", "q75", "q95"))])


def against_clean(scores: DataFrame, condition: str = "clean") -> DataFrame:
    """Each condition's score less that of the clean one, per policy."""
    clean_ = scores.where(F.col("condition") == condition).select("policy", F.col("score").alias("clean_score"))
    return scores.join(clean_, "policy").withColumn("delta", F.col("score") - F.col("clean_score"))


def timed(run, repeats: int = 3) -> dict[str, float]:
    """Mean and median seconds of a callable that returns a DataFrame."""
    took = []
    for _ in range(repeats):
        began = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
    return {"mean": sum(took) / len(took), "median": sorted(took)[len(took) // 2]}


def fit_linear(df: DataFrame, columns: list[str], label: str):
    """Standardised features, multinomial logistic regression with balanced class weights."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_t"), F.count(F.lit(1)).alias("_k"))
    weighed = df.join(F.broadcast(counts.join(F.broadcast(total)).select(label, (F.col("_t") / (F.col("_k") * F.col("_n"))).alias("weight"))), label)
    stages = [VectorAssembler(inputCols=columns, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(labelCol=label, weightCol="weight", maxIter=50)]
    return Pipeline(stages=stages).fit(weighed)


def macro_f1(df: DataFrame, truth: str, found: str) -> DataFrame:
    """Macro F1 and accuracy over the classes in either column."""
    one = df.groupBy(F.col(truth).alias("c")).agg(F.count(F.lit(1)).alias("t"), F.sum((F.col(truth) == F.col(found)).cast("long")).alias("tp"))
    two = df.groupBy(F.col(found).alias("c")).agg(F.count(F.lit(1)).alias("p"))
    both = one.join(two, "c", "full").na.fill(0)
    return both.agg(F.avg(F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("t") + F.col("p")), F.lit(0.0))).alias("macro_f1"), (F.sum("tp") / F.sum("t")).alias("accuracy"))


_POLICY = f"""{base.USERF}, ps AS (SELECT user_id, 'all' AS policy, f1 FROM uf UNION ALL SELECT user_id, 'half', f1 / 2 FROM uf)"""


def _scores(spark, sf):
    from tidelane.operators import evaluate

    gold, pred = base.gold_and_pred(spark, sf)
    u = evaluate.per_user(pred, gold, evaluate.matches(pred, gold, KEY), KEY).select("user_id", "f1")
    return u.select("user_id", F.lit("all").alias("policy"), "f1").unionByName(u.select("user_id", F.lit("half").alias("policy"), (F.col("f1") / 2).alias("f1")))


@query(f"WITH {_POLICY} SELECT policy, count(*) AS n, round(avg(f1), 6) AS mean, round(stddev_samp(f1), 6) AS std, round(quantile_cont(f1, 0.05), 6) AS q05, round(quantile_cont(f1, 0.25), 6) AS q25, round(quantile_cont(f1, 0.5), 6) AS q50, round(quantile_cont(f1, 0.75), 6) AS q75, round(quantile_cont(f1, 0.95), 6) AS q95 FROM ps GROUP BY 1")
def policy_split_summary(spark, sf):
    s = split_summary(_scores(spark, sf), "policy", "f1")
    return s.select("policy", "n", *[r6(c).alias(c) for c in s.columns[2:]])


@query(f"WITH {_POLICY}, m AS (SELECT policy, avg(f1) AS f FROM ps GROUP BY 1) SELECT arg_max(policy, f) AS policy, round(max(f), 6) AS f1 FROM m")
def policy_argmax(spark, sf):
    m = _scores(spark, sf).groupBy("policy").agg(F.avg("f1").alias("f"))
    return m.agg(F.max_by("policy", "f").alias("policy"), r6(F.max("f")).alias("f1"))


_LENGTHS = {"all": 0, "day": 86_400_000, "hour": 3_600_000}
_CHOSEN = f"""{base.PAIRS}, le AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v})" for k, v in _LENGTHS.items())}) t(policy, least)),
sp AS (SELECT user_id, policy, least, count(*) AS g FROM gold, le GROUP BY ALL), np AS (SELECT user_id, policy, count(*) AS p FROM pred, le WHERE end_ms - start_ms >= least GROUP BY ALL),
tp AS (SELECT user_id, policy, count(*) AS t FROM matched, le WHERE p1 - p0 >= least GROUP BY ALL),
ps AS (SELECT user_id, policy, 2.0::DOUBLE * coalesce(t, 0) / (g + coalesce(p, 0)) AS f1 FROM sp LEFT JOIN np USING (user_id, policy) LEFT JOIN tp USING (user_id, policy)),
nu AS (SELECT split, policy, CAST(floor(f1 * 1000000000 + 0.5) AS BIGINT) AS x, CAST('0x' || md5('20260311:' || split || ':' || user_id)[1:1] AS INTEGER) % 2 = 0 AS tune FROM ps, (SELECT unnest(generate_series(0, 49)) AS split)),
me AS (SELECT split, policy, CAST(sum(x) FILTER (WHERE tune) AS BIGINT)::DOUBLE / count(*) FILTER (WHERE tune) / 1e9::DOUBLE AS tune_f1, CAST(sum(x) FILTER (WHERE NOT tune) AS BIGINT)::DOUBLE / count(*) FILTER (WHERE NOT tune) / 1e9::DOUBLE AS outer_f1 FROM nu GROUP BY ALL),
ch AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY tune_f1 DESC, policy DESC) AS r FROM me) WHERE r = 1)"""


def _by_length(spark, sf):
    """F1 of each user under three policies: predictions of any length, of an hour or more, of a day or more."""
    from tidelane.operators import evaluate

    gold, pred = base.gold_and_pred(spark, sf)
    limits = F.explode(F.array(*[F.struct(F.lit(k).alias("policy"), F.lit(v).alias("least")) for k, v in _LENGTHS.items()])).alias("_l")
    users = gold.groupBy(KEY).agg(F.count(F.lit(1)).alias("g")).select(KEY, "g", limits).select(KEY, "g", "_l.policy")
    made = pred.select(KEY, (F.col("end_ms") - F.col("start_ms")).alias("d"), limits).where("d >= _l.least").groupBy(KEY, F.col("_l.policy")).agg(F.count(F.lit(1)).alias("p"))
    hits = evaluate.matches(pred, gold, KEY).select(KEY, (F.col("p1") - F.col("p0")).alias("d"), limits).where("d >= _l.least").groupBy(KEY, F.col("_l.policy")).agg(F.count(F.lit(1)).alias("t"))
    wide = users.join(made, [KEY, "policy"], "left").join(hits, [KEY, "policy"], "left").na.fill(0, ["p", "t"])
    return wide.select("user_id", "policy", (2.0 * F.col("t") / (F.col("g") + F.col("p"))).alias("f1"))


@query(f"WITH {_CHOSEN} SELECT CAST(split AS INTEGER) AS split, policy, round(tune_f1, 9) AS tune_f1, round(outer_f1, 9) AS outer_f1 FROM ch")
def split_separated_selection(spark, sf):
    s = split_selection(_by_length(spark, sf), 50)
    return s.select("split", "policy", F.round("tune_f1", 9).alias("tune_f1"), F.round("outer_f1", 9).alias("outer_f1"))


@query(f"WITH {_CHOSEN} SELECT policy, count(*) AS n, count(*) / 50.0::DOUBLE AS share, round(avg(outer_f1), 6) AS outer_f1 FROM ch GROUP BY policy")
def selection_frequencies(spark, sf):
    return selection_frequency(split_selection(_by_length(spark, sf), 50)).select("policy", "n", "share", r6("outer_f1").alias("outer_f1"))


@query(f"WITH {_CHOSEN}, d AS (SELECT ch.outer_f1 - me.outer_f1 AS d FROM ch JOIN me ON ch.split = me.split AND me.policy = 'hour') SELECT count(*) AS n, round(avg(d), 6) AS mean_diff, round(CASE WHEN coalesce(stddev_samp(d), 0) < 1e-12 THEN 0 ELSE avg(d) / stddev_samp(d) END, 6) AS cohen_d FROM d")
def selection_paired(spark, sf):
    out = selection_against(_by_length(spark, sf), 50, "hour")
    return out.select("n", r6("mean_diff").alias("mean_diff"), r6("cohen_d").alias("cohen_d"))


@query("""WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings)
SELECT vec_id, round(list_avg(x), 6) AS mean, round(list_stddev_pop(x), 6) AS std, round(list_min(x), 6) AS lo, round(list_max(x), 6) AS hi, round(list_median(x), 6) AS median,
 round(list_avg(list_transform(x, lambda v: v * v)), 6) AS energy, round(list_sum(list_transform(generate_series(2, 64), lambda i: abs(sign(x[i] - list_avg(x)) - sign(x[i - 1] - list_avg(x))))) / 128.0, 6) AS zcr FROM x""")
def handcrafted_features(spark, sf):
    e = base.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    f = features.channel(F.col("x"))
    names = {"mean": "mean", "std": "std", "min": "lo", "max": "hi", "median": "median", "energy": "energy", "zcr": "zcr"}
    return e.select("vec_id", *[r6(f[k]).alias(v) for k, v in names.items()])


@query()
def augmented_windows(spark, sf):
    e = base.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return features.augment(e, "x", "vec_id").select("vec_id", r6(features.mean(F.col("x"))).alias("mean"))


@query(f"""WITH {base.SEGD}, u AS (SELECT user_id, user_id % 2 AS cohort, count(*) AS n, sum(duration_sec) AS d FROM segd GROUP BY ALL)
SELECT CAST(cohort AS BIGINT) AS cohort, round(sum(n) / sum(d) * 3600, 6) AS pooled, round(avg(n / d * 3600), 6) AS mean_rate, round(quantile_cont(n / d * 3600, 0.5), 6) AS median_rate FROM u GROUP BY 1""")
def policy_summary(spark, sf):
    u = base.run_segments(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("duration_sec").alias("d")).withColumn("cohort", F.col("user_id") % 2)
    rate = F.col("n") / F.col("d") * 3600
    return u.groupBy("cohort").agg(r6(F.sum("n") / F.sum("d") * 3600).alias("pooled"), r6(F.avg(rate)).alias("mean_rate"), r6(F.median(rate)).alias("median_rate"))


@query()
def robustness_conditions(spark, sf):
    ev = base.events(spark, sf).select("user_id", "event_id", "t_ms", "value")
    out = None
    for kind, amount in (("clean", 0), ("noise", 20), ("dropout", 0.1), ("burst", 0.1), ("clip", 60), ("hold", 2), ("bias", 5), ("scale", 1.1)):
        df = ev if kind == "clean" else clean.perturb(ev, KEY, ORDER, "value", kind, amount)
        df = sequence.interpolate(df, KEY, ORDER, "value", "value") if kind in ("dropout", "burst") else df
        row = df.agg(F.lit(kind).alias("condition"), F.lit("mean").alias("policy"), F.avg("value").alias("score"))
        out = row if out is None else out.unionByName(row)
    return against_clean(out).select("condition", r6("score").alias("score"), r6("delta").alias("delta"))


@query()
def linear_window_classifier(spark, sf):
    e = base.table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("int").alias("label"), *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)])
    fold = F.pmod(F.xxhash64("vec_id"), F.lit(5))
    model = fit_linear(e.where(fold != 0), [f"x{i}" for i in range(64)], "label")
    return macro_f1(model.transform(e.where(fold == 0)), "label", "prediction")


@query(f"WITH {base.EV}, d AS (SELECT user_id, t_ms - lag(t_ms) OVER (PARTITION BY user_id ORDER BY t_ms, event_id) AS d FROM ev), m AS (SELECT user_id, quantile_cont(d, 0.5) FILTER (WHERE d > 0) AS p FROM d GROUP BY 1) SELECT round(1000 / quantile_cont(p, 0.5), 9) AS hz, (SELECT max(value) <> 0 FROM events) AS alive FROM m")
def sensor_audit(spark, sf):
    ev = base.events(spark, sf)
    period = sequence.median_period(ev, KEY, ["t_ms", "event_id"], "t_ms").agg(F.median("period").alias("p"))
    alive = ev.agg(F.bool_or(F.col("value") != 0).alias("alive"))
    return period.join(F.broadcast(alive)).select(F.round(1000 / F.col("p"), 9).alias("hz"), "alive")


@query("WITH c AS (SELECT user_id, count(*) AS n, avg(value) AS m FROM events GROUP BY 1), p AS (SELECT user_id % 2 AS g, avg(n) AS n, avg(m) AS m FROM c GROUP BY 1) SELECT round(max(n) FILTER (WHERE g = 1) - max(n) FILTER (WHERE g = 0), 6) AS d_n, round(max(m) FILTER (WHERE g = 1) - max(m) FILTER (WHERE g = 0), 6) AS d_mean FROM p")
def cohort_difference(spark, sf):
    c = base.table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"))
    p = c.groupBy((F.col("user_id") % 2).alias("g")).agg(F.avg("n").alias("n"), F.avg("m").alias("m"))
    side = lambda c, g: F.max(F.when(F.col("g") == g, F.col(c)))
    return p.agg(r6(side("n", 1) - side("n", 0)).alias("d_n"), r6(side("m", 1) - side("m", 0)).alias("d_mean"))
