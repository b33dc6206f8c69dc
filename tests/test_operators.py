"""Hand-derived vectors and properties of the operators."""

import hashlib
import itertools
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidelane.config import FULL, RAW, split_path
from tidelane.operators import clean, decode, features, fusion, intervals, segments, sequence, stats
from tidelane.plans import pipeline
from tidelane.sources import readers, writers


def series(spark, xs):
    return spark.createDataFrame([("u", i, float(x)) for i, x in enumerate(xs)], "k string, i int, x double")


def column(df, c):
    return [r[0] for r in df.select("i", c.alias("v")).orderBy("i").select("v").collect()]


def test_smoothing_vectors(spark):
    d = series(spark, [1, 2, 6])
    assert column(d, sequence.moving_average("x", "k", "i", 3)) == pytest.approx([4 / 3, 3, 14 / 3])
    assert column(d, sequence.moving_average("x", "k", "i", 4)) == pytest.approx([1.25, 2.5, 3.75])
    assert column(series(spark, [1, 2, 3]), sequence.median_filter("x", "k", "i", 5)) == [1, 1, 1]
    assert column(series(spark, [0, 1, 4]), sequence.gradient("x", "k", "i")) == [1, 2, 3]


def test_count_windows(spark):
    d = series(spark, range(500))
    w = sequence.count_windows(d, "k", ["i"], 300, 100)
    assert sorted(r[0] for r in w.groupBy("win_id").agg(F.min("x").alias("m")).select("m").collect()) == [0, 100, 200]
    assert sequence.count_windows(series(spark, range(299)), "k", ["i"], 300, 100).count() == 0


def test_iou(spark):
    d = spark.createDataFrame([(0, 10, 0, 20), (0, 10, 2, 10), (5, 5, 5, 5), (0, 5, 10, 20)], "a int, b int, c int, d int")
    assert [r[0] for r in d.select(intervals.iou(*[F.col(x) for x in "abcd"])).collect()] == pytest.approx([0.5, 0.8, 0, 0])


def test_label_points_last_row_wins(spark):
    points = spark.createDataFrame([("u", 150, 1), ("u", 99, 2), ("u", 300, 3)], "k string, t long, id int")
    labels = spark.createDataFrame([("u", 100, 200, 1, 0), ("u", 150, 300, 2, 1)], "k string, start_ms long, end_ms long, state int, row_no int")
    assert {r.id: r.label for r in intervals.label_points(points, labels, "k", "t", ["id"]).collect()} == {1: 2, 2: 0, 3: 2}


def test_greedy_match_contested(spark):
    pairs = spark.createDataFrame([("u", 1, 1, 0.9), ("u", 1, 2, 0.8), ("u", 2, 1, 0.7), ("u", 2, 2, 0.6), ("v", 1, 1, 0.6)], "k string, pred_id long, gold_id long, iou double")
    assert {(r.k, r.pred_id, r.gold_id) for r in intervals.greedy_match(pairs, "k").collect()} == {("u", 1, 1), ("u", 2, 2), ("v", 1, 1)}


def seg(spark, rows):
    return spark.createDataFrame([("u", *r, (r[1] - r[0]) / 1000.0) for r in rows], "k string, start_ms long, end_ms long, class_idx int, confidence double, duration_sec double")


def spans(df):
    return sorted((r.start_ms, r.end_ms) for r in df.collect())


def test_segment_folds(spark):
    assert spans(segments.resolve_overlaps(seg(spark, [(0, 100, 1, 0.5), (60, 200, 2, 0.9)]), "k")) == [(0, 80), (80, 200)]
    assert spans(segments.resolve_overlaps(seg(spark, [(0, 100, 1, 0.9), (60, 200, 2, 0.5)]), "k")) == [(0, 100), (100, 200)]
    assert spans(segments.resolve_overlaps(seg(spark, [(0, 100, 1, 0.5), (60, 70, 2, 0.9)]), "k")) == [(0, 100)]
    merged = segments.merge_same_class(seg(spark, [(0, 10_000, 1, 0.6), (20_000, 30_000, 1, 0.8), (40_000, 50_000, 1, 0.4)]), "k", 60_000).collect()
    assert len(merged) == 1 and merged[0].confidence == pytest.approx(0.55)
    assert segments.merge_same_class(seg(spark, [(0, 10_000, 1, 0.6), (70_000, 80_000, 1, 0.8)]), "k", 60_000).count() == 2
    best = segments.min_confidence(segments.top_k_diverse(seg(spark, [(0, 1, 1, 0.9), (2, 3, 1, 0.8), (4, 5, 2, 0.5), (6, 7, 3, 0.4)]), "k", 3), 0.45)
    assert {(r.class_idx, r.confidence) for r in best.collect()} == {(1, 0.9), (2, 0.5)}


def test_viterbi():
    m = decode.transitions(6)
    assert m[0, 0] == pytest.approx(0.97 / 1.02) and m[1, 2] == pytest.approx(0.001 / 1.024)
    r = np.random.default_rng(0)
    p = r.dirichlet(np.ones(4), 30)
    m = decode.transitions(4)
    score = lambda path: np.log(p[np.arange(30), path] + 1e-10).sum() + np.log(m[path[:-1], path[1:]] + 1e-10).sum()
    assert score(decode.viterbi(p, m)) >= score(p.argmax(axis=1))
    assert decode.repair(np.array([1, 1, 2, 1, 1]), np.ones((5, 3)), 2).tolist() == [1] * 5


def test_butterworth_keeps_constants():
    assert decode.zero_phase(np.full(200, 3.0), *decode.butterworth()) == pytest.approx(np.full(200, 3.0))


def test_auroc_and_bins(spark):
    d = spark.createDataFrame([(0.5, 1), (0.5, 0), (0.9, 1)], "p double, y int")
    assert stats.rank_auroc(d, "p", "y").first()[0] == pytest.approx(0.75)
    one = spark.createDataFrame([(1.0, 1)], "p double, y int")
    assert stats.calibration_bins(one, "p", "y").first().bin == 4 and stats.rank_auroc(one, "p", "y").first()[0] == 0


def test_fusion_weights_sum_to_one(spark):
    d = spark.createDataFrame([("u", i, [0.2, 0.8] if i > 3 else [0.9, 0.1], [0.5, 0.5], [0.4, 0.6]) for i in range(8)], "k string, i int, p3 array<double>, p5 array<double>, p8 array<double>")
    for mode in [*fusion.FUSIONS, "unheard of"]:
        assert [sum(r.fused) for r in fusion.fuse(d, "k", ["i"], mode).collect()] == pytest.approx([1.0] * 8)


def test_perturbations_keep_schema(spark):
    d = series(spark, range(50))
    for kind in ("noise", "dropout", "burst", "clip", "hold", "bias", "scale"):
        out = clean.perturb(d, "k", ["i"], "x", kind, 2 if kind == "hold" else 0.5)
        assert out.columns == d.columns and out.count() == 50


def test_post_process_and_sweep(spark):
    probs = [[0.9, 0.05, 0.05]] * 60 + [[0.1, 0.8, 0.1]] * 300 + [[0.9, 0.05, 0.05]] * 60
    steps = spark.createDataFrame([("u", i * 1000, i, p) for i, p in enumerate(probs)], "k string, t_ms long, i int, probs array<double>")
    out = pipeline.post_process(steps, "k", ["t_ms"], 3).collect()
    assert [(r.class_idx, r.start_ms, r.end_ms) for r in out] == [(1, 58_500, 360_500)]
    gold = spark.createDataFrame([("u", 1, 60_000, 360_000, 1)], "k string, class_idx int, start_ms long, end_ms long, gold_id long")
    scores = pipeline.sweep(steps, gold, "k", ["t_ms"], 3, [RAW, FULL])
    assert [r.mean_f1 for r in scores.orderBy("ord").collect()] == [1.0, 1.0]
    assert pipeline.best_policy(scores).first().policy == "raw"
    best = pipeline.coordinate_ascent(FULL, {"smooth": [3, 9]}, lambda ps: [p.smooth for p in ps])
    assert best.smooth == 9


def test_refine_moves_towards_energy(spark):
    signal = spark.createDataFrame([("u", i * 10, i, 5.0 if 2000 <= i < 4000 else 0.0, 0.0, 0.0) for i in range(6000)], "k string, t_ms long, seq long, ax double, ay double, az double")
    out = pipeline.refine(seg(spark, [(15_000, 45_000, 1, 0.9)]), signal, "k", smooth=20).first()
    assert abs(out.start_ms - 20_000) < 300 and abs(out.end_ms - 40_000) < 300


def test_split_path():
    assert split_path("train", environment={}) == "data/train/signal"
    with pytest.raises(ValueError, match="internal_eval"):
        split_path("nowhere")


HEADER = "ACC_TIME\tPPG\tACC_X\tACC_Y\tACC_Z\tGYRO_X\tGYRO_Y\tGYRO_\n"


def test_signal_reader(spark, tmp_path):
    line = lambda t, x="1": f"{t}\t0\t{x}\t2\t3\t4\t5\t6\n"
    (tmp_path / "u1.txt").write_text(HEADER + line(20) + line(10) + HEADER + line(0) + line(30, "oops") + "1\t2\n" + line(10))
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\x00" * 60)
    (tmp_path / "note.md").write_text(HEADER)
    rows = readers.signals(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.user_id, r.t_ms, r.gz) for r in rows] == [("u1", 10, 6), ("u1", 10, 6), ("u1", 20, 6)]
    assert {r.user_id: r.readable for r in readers.sniff(spark, str(tmp_path)).collect()} == {"u1": True, "bad": False}
    assert readers.texts(spark, str(tmp_path / "nowhere")).count() == 0


def test_annotation_and_prediction_files(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("﻿user_id,category,start,end,split\nHNU1,羽毛球,1000,2000,x\n", encoding="utf-8")
    r = readers.annotations(spark, str(p)).first()
    assert (r.user_id, r.category, r.start, r.end) == ("HNU1", "羽毛球", 1000, 2000)
    p.write_text("user_id,start\n1,2\n")
    with pytest.raises(ValueError, match="category, end"):
        readers.annotations(spark, str(p))
    out = spark.createDataFrame([("u", "c", 1, 2)], "user_id string, category string, start long, end long")
    writers.write_records(out, str(tmp_path / "out"), "csv")
    assert readers.predictions(spark, str(tmp_path / "out")).collect()[0].end == 2
    with pytest.raises(ValueError, match="no records"):
        writers.write_records(out.where("start > 5"), str(tmp_path / "none"))


def test_frames(spark):
    body = bytes([0x55, 0x61, 0x00, 0x08]) + bytes(16)
    df = spark.createDataFrame([(1, bytearray(b"\x00\x55\x00" + body + body))], "dev int, content binary")
    rows = readers.frames(df).collect()
    assert len(rows) == 2 and rows[0].accX == 1.0 and rows[0].accY == 0.0


def test_line_records(spark):
    lines = spark.createDataFrame([(0, "7,Walk,1,1.0,2.0,3.0;"), (1, "7,Sit,2,1,2"), (2, "7,Sit,2,1,2,x;"), (3, "7,Jog,3,4,5,6;")], "line_no long, value string")
    assert [(r.activity, r.label, r.t_s) for r in readers.line_records(lines).orderBy("line_no").collect()] == [("Walk", 1, 0.0), ("Jog", 0, 0.05)]


def test_bootstrap_weighs_rows_by_key(spark):
    x = {f"k{i}": i % 7 / 7 for i in range(60)}
    df = spark.createDataFrame(list(x.items()), "k string, f1 double").repartition(3)
    limits = stats.poisson_limits()
    means = []
    for b in range(300):
        w = {k: sum(int(hashlib.md5(f"42:{b}:{k}".encode()).hexdigest()[:8], 16) >= t for t in limits) for k in x}
        means.append(sum(w[k] * x[k] for k in x) / sum(w.values()))
    got = stats.bootstrap_ci(df, "f1", "k", resamples=300).first()
    assert (got["mean"], got["low"], got["high"]) == pytest.approx((np.mean(list(x.values())), *np.percentile(means, [2.5, 97.5])), abs=1e-8)
    assert abs(np.std(means) - np.std(list(x.values())) / 60**0.5) < 0.01
    assert stats.bootstrap_ci(df.limit(0), "f1", "k", resamples=10).count() == 0


def test_recordings_lie_side_by_side(spark):
    """One listing finds all of them, and each has a name of its own, by which readers tell them apart."""
    from tidelane.plans import base, files

    folder = files._recordings(spark, SMALL)
    users = base.events(spark, SMALL).select("user_id").distinct().count()
    found = readers.texts(spark, folder)
    assert found.columns == ["user_id", "text"] and found.count() == found.select("user_id").distinct().count() == users > 1
    assert not [p for p in os.listdir(folder.removeprefix("file://")) if os.path.isdir(os.path.join(folder.removeprefix("file://"), p))]


def test_models_are_averaged_in_place(spark):
    """Also of unequal length, null or empty; no place becomes a row, and nothing is collected."""
    rows = [(1, 0, "p3", 0, [0.2, 0.8]), (1, 0, "p3", 1, [0.4, 0.6]), (1, 0, "p5", 0, [1.0]), (1, 0, "p5", 1, [0.0, 0.5, None]), (1, 1, "p5", 0, None), (1, 2, "p3", 0, []), (1, 3, "other", 0, [1.0])]
    df = spark.createDataFrame(rows, "k int, i int, scale string, model int, probs array<double>")
    got = {(r.i, r.scale): r.probs for r in fusion.ensemble(df, ["k", "i", "scale"]).collect()}
    assert got == {(0, "p3"): pytest.approx([0.3, 0.7]), (0, "p5"): [0.5, 0.5, None], (3, "other"): [1.0]}
    two = fusion.orchestrate(df, "k", ["i"])
    assert [(r.i, r.p3, r.p5, r.p8) for r in two.collect()] == [(0, pytest.approx([0.3, 0.7]), [0.5, 0.5, None], None)]
    assert fusion.orchestrate(df.where("scale = 'other'"), "k", ["i"]).count() == fusion.ensemble(df.limit(0), ["k"]).count() == 0
    plan = two._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and "collect_list" not in plan


def test_bootstrap_draws_once_and_in_many_tasks(spark, monkeypatch):
    """A digest a draw, not one for each comparison with a limit; draws are dealt to tasks by their number."""
    df = spark.createDataFrame([(f"k{i}", i / 60) for i in range(60)], "k string, f1 double").coalesce(1)
    whole = stats.bootstrap_ci(df, "f1", "k", resamples=100)
    monkeypatch.setattr(stats, "DRAWS", 1000)
    dealt = stats.bootstrap_ci(df, "f1", "k", resamples=100)
    assert whole.first() == dealt.first()
    plan = dealt._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1 and "Repartition 6, true" in plan


def test_p_values(spark):
    rng = np.random.default_rng(0)
    for n in (1, 6, 12):
        d = np.round(rng.normal(0.3, 1, n), 6)
        ranks = np.argsort(np.argsort(np.abs(d))) + 1
        w = int(ranks[d > 0].sum())
        tail = np.mean([sum(r for r, s in zip(ranks, signs, strict=True) if s) >= w for signs in itertools.product((0, 1), repeat=n)])
        row = stats.paired_effect(spark.createDataFrame([(float(v), 0.0) for v in d], "a double, b double"), "a", "b").first()
        assert row.w_plus == w and row.p_value == pytest.approx(tail, abs=1e-12)
    many = spark.createDataFrame([(float(i % 5 - 1), 0.0) for i in range(80)], "a double, b double")  # zeros and ties
    row = stats.paired_effect(many, "a", "b").first()
    k, ties = 64, (32**3 - 32) + 2 * (16**3 - 16)
    z = (row.w_plus - k * (k + 1) / 4) / math.sqrt(k * (k + 1) * (2 * k + 1) / 24 - ties / 48)
    assert row.p_value == pytest.approx(math.erfc(z / math.sqrt(2)) / 2, abs=1e-12)
    for z in (-9.0, -1.5, 0.0, 2.5, 6.0):
        assert spark.range(1).select(stats.normal_tail(F.lit(z)).alias("p")).first().p == pytest.approx(math.erfc(max(z, -8) / math.sqrt(2)) / 2, abs=1e-13)
    got = spark.range(1).select(stats.kolmogorov_p(F.lit(0.3), F.lit(40.0), F.lit(60.0)).alias("p")).first().p
    t = 0.3 * math.sqrt(24)
    assert got == pytest.approx(2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101)), abs=1e-12)


def test_align_linear_over_whole_inputs(spark):
    from tests.conftest import SMALL
    from tidelane.plans import base

    ev = base.events(spark, SMALL).select(base.KEY, "t_ms", "event_type", "value").dropDuplicates([base.KEY, "t_ms"]).persist()
    got = intervals.align_linear(ev.where("event_type = 'view'"), ev.where("event_type <> 'view'"), base.KEY, "t_ms", "value", "aligned")
    rows, want = ev.collect(), {}
    for g in rows:
        if g.event_type == "view":
            s = sorted((r.t_ms, r.value) for r in rows if r[0] == g[0] and r.event_type != "view")
            want[g[0], g.t_ms] = np.interp(g.t_ms, *zip(*s, strict=True)) if s else None
    found = {(r[0], r.t_ms): r.aligned for r in got.collect()}
    assert found.keys() == want.keys() and len(want) > 100
    assert all((found[k] is None) == (want[k] is None) and (want[k] is None or found[k] == pytest.approx(want[k], abs=1e-9)) for k in want)


def test_discovery_csv_history_and_cache(spark, tmp_path):
    from tidelane.sources import writers

    (tmp_path / "src" / "raw").mkdir(parents=True)
    for name, text in (("readme.txt", "x"), ("raw/a.txt", "1"), ("raw/b.txt", "2"), ("raw/about.txt", "3"), ("raw/s1.csv", "t,x,y,label\n1,0.5,2,3\n2,bad,2,3\n3,1,4,1\n")):
        (tmp_path / "src" / name).write_text(text)
    names = lambda files: [f.rsplit("/", 1)[1] for f in files]
    top = str(tmp_path / "src")
    assert names(readers.discover(spark, top, ("none", "raw"))) == ["a.txt", "b.txt"]
    assert names(readers.discover(spark, top, (), ("b.txt",))) == ["b.txt"] and readers.discover(spark, top + "none") == []
    got = readers.headered_csv(spark, top + "/raw/s1.csv", {"ax": "x", "ay": "y"}, "label").orderBy("label").collect()
    assert [(r.user_id, r.ax, r.ay, r.label) for r in got] == [("s1", 1.0, 4.0, 1), ("s1", 0.5, 2.0, 3)]
    with pytest.raises(ValueError, match="missing"):
        readers.headered_csv(spark, top + "/raw/s1.csv", {"ax": "z"}, "label")
    path = str(tmp_path / "history")
    for epoch, loss in ((0, 1.0), (1, 0.5), (1, 0.4)):
        kept = writers.append_history(spark.createDataFrame([(epoch, loss)], "epoch int, loss double"), path)
    assert {(r.epoch, r.loss) for r in kept.collect()} == {(0, 1.0), (1, 0.4)}
    w = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (1, [3.0])], "user_id int, x array<double>")
    assert sorted(map(tuple, writers.cache_windows(w, str(tmp_path / "cache"), "user_id", 2).collect())) == sorted(map(tuple, w.collect()))
    spark.createDataFrame([(1, "p", 0.5), (1, "p", 0.7), (1, "q", 0.1)], "user_id int, policy string, f1 double").write.option("header", True).csv(str(tmp_path / "res"))
    assert [(r.p, r.q) for r in readers.result_table(spark, str(tmp_path / "res")).collect()] == [(pytest.approx(0.6), 0.1)]


def test_jitter_keeps_span_and_order(spark):
    df = spark.createDataFrame([(k, 100.0 * i) for k in (1, 2) for i in range(50)] + [(3, 7.0)], "k int, t double")
    out = {k: [r.t for r in clean.jitter(df, "k", ["t"], "t", 0.9).where(f"k = {k}").orderBy("t").collect()] for k in (1, 2, 3)}
    assert out[3] == [7.0] and out[1] != out[2]
    for k in (1, 2):
        t = out[k]
        assert t[0] == 0 and t[-1] == pytest.approx(4900) and all(b > a for a, b in zip(t, t[1:], strict=False)) and t != [100.0 * i for i in range(50)]


def test_mixup_and_augment(spark):
    df = spark.createDataFrame([(i, i % 3, [float(i)] * 4) for i in range(300)], "id int, y int, x array<double>")
    rows = features.mixup(df, "x", "y", "id", groups=4).collect()
    assert len(rows) == 300 and all(0 <= r.weight <= 1 for r in rows) and sum(r.weight < 0.1 or r.weight > 0.9 for r in rows) > 100
    assert sum(abs(r.x[0] - r.id) > 1e-9 for r in rows) > 200
    again = features.augment(df, "x", "id").collect()
    assert again == features.augment(df, "x", "id").collect() and sum(r.x == [float(r.id)] * 4 for r in again) > 30


def test_running_totals_and_repeated_points(spark):
    rows = [(v, v % 5 + 1) for v in random.Random(2).sample(range(10_000), 500)]
    got = {r.v: r.n_below for r in sequence.running_totals(spark.createDataFrame(rows, "v int, n int"), "v", ["n"], 8).collect()}
    assert got == {v: sum(n for u, n in rows if u < v) for v, _ in rows}
    points = spark.createDataFrame([(1, 5), (1, 5), (1, 50)], "k int, t long")
    labels = spark.createDataFrame([(1, 0, 10, 3, 0)], "k int, start_ms long, end_ms long, state int, row_no long")
    assert sorted(r.label for r in intervals.label_points(points, labels, "k", "t", []).collect()) == [0, 3, 3]


def test_candidates_meet_once_over_buckets(spark):
    rnd = random.Random(8)
    rows = [[(1, i, a := rnd.randrange(500), a + rnd.randrange(200)) for i in range(60)] for _ in range(2)]
    pred, gold = (spark.createDataFrame(r, f"k int, {n} int, start_ms long, end_ms long") for r, n in zip(rows, ("pred_id", "gold_id"), strict=True))
    got = sorted((r.pred_id, r.gold_id) for r in intervals.candidates(pred, gold, ["k"], 0.3, bucket_ms=37).collect())
    want = sorted((p, g) for _, p, a, b in rows[0] for _, g, c, d in rows[1] if a < d and c < b and (min(b, d) - max(a, c)) > 0.3 * (max(b, d) - min(a, c)))
    assert got == want


def test_onnx_like_scorer(spark):
    from tidelane.plans import records

    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "id long, x array<double>")
    got = records.score_windows(df, "x", lambda: lambda x: x / x.sum(axis=1, keepdims=True), "id").collect()
    assert {r.id: r.probs for r in got} == {i: [i / (i + 1), 1 / (i + 1)] for i in range(5)}
