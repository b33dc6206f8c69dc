"""Windows, folds, retraining and the portability runner against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelane.plans import training


@pytest.fixture(scope="module")
def corpus(spark):
    """Keys whose channels tell the class of a sample most of the time."""
    rng = np.random.default_rng(5)
    rows = []
    for k in range(10):
        truth = np.repeat(rng.integers(0, 2, 14), rng.integers(10, 30, 14))
        x = rng.normal(size=(len(truth), 3)) + truth[:, None] * 1.5
        rows += [(f"k{k}", 10 * i, i, int(c), *map(float, v)) for i, (c, v) in enumerate(zip(truth, x, strict=True))]
    df = spark.createDataFrame(rows, "k string, t long, i long, y int, ax double, ay double, az double")
    windows, names = training.windowed(df.withColumnRenamed("i", "seq"), "k", ["t", "seq"], "t", ["ax", "ay", "az"], "y", width=10, step=5, norms={"acc": ("ax", "ay", "az")})
    return rows, training.storage.materialize(windows, "windows"), names


def test_windows_have_robust_figures(corpus):
    rows, windows, names = corpus
    assert len(names) == 24 and names[-1] == "acc_p75"
    mine = [r for r in rows if r[0] == "k3"]
    got = {r.win_id: r for r in windows.where("k = 'k3'").collect()}
    assert sorted(got) == list(range((len(mine) - 10) // 5 + 1))
    for n in (0, 1, max(got)):
        part = mine[5 * n : 5 * n + 10]
        x = {"ax": np.array([r[4] for r in part]), "acc": np.array([np.linalg.norm(r[4:7]) for r in part])}
        for c, v in x.items():
            want = [v.mean(), v.std(), v.min(), v.max(), *np.percentile(v, [25, 75])]
            assert [got[n][f"{c}_{f}"] for f in ("mean", "std", "min", "max", "p25", "p75")] == pytest.approx(want, abs=1e-9)
        labels = [r[3] for r in part]
        assert (got[n].label, got[n].t_ms) == (max((labels.count(c), -c) for c in (0, 1))[1] * -1, part[5][1])


def test_every_fold_is_judged_by_a_model_that_did_not_see_its_keys(spark, corpus):
    _, windows, names = corpus
    inside, outside = windows.where("k < 'k8'"), windows.where("k >= 'k8'")
    dealt = training.folds(inside, "k", 3)
    assert dealt.groupBy("k").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    out = {r.part: r for r in training.cross_validated(inside, names, "k", outside, count=3, strengths=(0.0,)).collect()}
    assert sorted(out) == ["fold0", "fold1", "fold2", "held_out"]
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    fit = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="raw"), StandardScaler(inputCol="raw", outputCol="features", withMean=True), LogisticRegression(labelCol="label", maxIter=30)]).fit(dealt.where("fold <> 1"))
    rows = [(r.label, int(r.prediction)) for r in fit.transform(dealt.where("fold = 1")).select("label", "prediction").collect()]
    f1 = [2 * sum(a == b == c for a, b in rows) / (sum(a == c for a, _ in rows) + sum(b == c for _, b in rows)) for c in (0, 1)]
    assert out["fold1"].macro_f1 == pytest.approx(np.mean(f1), abs=1e-6) and out["held_out"].accuracy > 0.85


def test_decoding_beats_the_likeliest_class_alone(spark, corpus):
    _, windows, names = corpus
    spans = windows.groupBy("k").agg(F.max("t_ms").alias("span_ms"))
    split = {n: spans.where(w) for n, w in (("train", "k < 'k6'"), ("dev", "k IN ('k6', 'k7')"), ("test", "k > 'k7'"))}
    out = {r["mode"]: r for r in training.portability(windows, names, "k", spans, 2, split, gaps=(0, 100), lengths=(0,), smooth=(1, 3), median=(1,), stay=(0.5, 0.9), run=(1, 2)).collect()}
    assert sorted(out) == ["argmax", "decoded"]
    assert out["decoded"].f1 >= out["argmax"].f1 and out["argmax"].accuracy > 0.8 and out["argmax"].stay == 0.5
