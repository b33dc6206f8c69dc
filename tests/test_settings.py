"""Settings as rows against decoding and scoring each setting on its own."""

import itertools

import numpy as np
import pytest

from tidelane.operators import decode, scan
from tidelane.plans import settings

PACKED = getattr(scan, "packed", None)


def padded(p, width):
    return np.pad(p, ((width // 2, width - 1 - width // 2), (0, 0)), mode="edge")


def share(p):
    return p / p.sum(axis=1, keepdims=True)


def plain_records(p, t, span, setting, gap=0.0):
    smooth, median, stay, run = setting
    if smooth > 1:
        p = share(np.stack([padded(p, smooth)[i : i + smooth].mean(axis=0) for i in range(len(p))]))
    if median > 1:
        p = share(np.stack([np.median(padded(p, median)[i : i + median], axis=0) for i in range(len(p))]))
    path = decode.repair(decode.viterbi(p, decode.uniform_transitions(p.shape[1], stay), 1e-12, True), p, run)
    cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
    rows = [[0.0 if a == 0 else (t[a - 1] + t[a]) / 2, span if b == len(path) else (t[b - 1] + t[b]) / 2, a, b, int(path[a]), float(p[a:b, path[a]].mean())] for a, b in itertools.pairwise(cuts)]
    from tests.test_scans import merged_plainly

    return path, merged_plainly([tuple(r) for r in rows], gap, p)


def plain_scores(data, setting, gap, least, sure, ignored):
    tp = records = golds = right = known = 0
    ious, hours = [], 0.0
    for p, t, truth, span, gold in data.values():
        path, found = plain_records(p, t, span, setting, gap)
        found = [r for r in found if r[4] not in ignored and r[1] - r[0] >= least and (sure <= 0 or r[5] >= sure)]
        real = [g for g in gold if g[2] not in ignored and g[1] - g[0] >= least]
        for r, g in itertools.product(found, real):
            iou = max(0.0, min(r[1], g[1]) - max(r[0], g[0])) / (max(r[1], g[1]) - min(r[0], g[0]))
            if r[4] == g[2] and iou > 0.5:
                ious.append(iou)
        records, golds, hours = records + len(found), golds + len(real), hours + span / 3.6e6
        right += sum(a == b and b not in ignored for a, b in zip(path, truth, strict=True))
        known += sum(b not in ignored for b in truth)
    tp = len(ious)
    return tp, records - tp, golds - tp, 2 * tp / (records + golds) if records + golds else 0.0, float(np.mean(ious)) if ious else None, records / hours, right / known


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    out = {}
    for k in range(4):
        truth = np.repeat(rng.integers(0, 3, 30), rng.integers(1, 8, 30))
        p = np.full((len(truth), 3), 0.15)
        p[np.arange(len(truth)), truth] = 0.7
        p = share(np.round(p + rng.dirichlet(np.ones(3), len(truth)), 2))
        t = (np.cumsum(rng.integers(1, 5, len(truth))) * 1000).tolist()
        cuts = [0, *(np.flatnonzero(np.diff(truth)) + 1).tolist(), len(truth)]
        span = t[-1] + 500
        gold = [(0.0 if a == 0 else (t[a - 1] + t[a]) / 2, float(span) if b == len(truth) else (t[b - 1] + t[b]) / 2, int(truth[a])) for a, b in itertools.pairwise(cuts)]
        out[f"k{k}"] = (p, t, truth.tolist(), float(span), gold)
    return out


def test_two_stages_equal_each_setting_alone(spark, data):
    grid = {"smooth": (1, 4, 5), "median": (1, 3), "stay": (0.5, 0.9), "run": (1, 3)}
    steps = spark.createDataFrame([(k, i, int(t[i]), truth[i], *p[i].tolist()) for k, (p, t, truth, _, _) in data.items() for i in range(len(t))], "k string, i long, t long, truth int, a double, b double, c double")
    gold = spark.createDataFrame([(k, j, g[2], g[0], g[1]) for k, v in data.items() for j, g in enumerate(v[4])], "k string, gold_id long, class_idx int, start_ms double, end_ms double")
    spans = spark.createDataFrame([(k, int(v[3])) for k, v in data.items()], "k string, span_ms long")
    gaps, lengths, sure, ignored = (0, 6000), (0, 9000), (0.0, 0.55), (2,)
    out = settings.two_stage(steps, gold, spans, "k", ["i"], "t", ["a", "b", "c"], "truth", gaps=gaps, lengths=lengths, least=2000.0, sure=sure, kept=3, ignored=ignored, **grid)
    rows = [r.asDict() for r in out.collect()]
    names = ["tp", "fp", "fn", "f1", "miou", "records_per_hour", "accuracy"]
    combos = list(itertools.product(*grid.values()))
    one = {r["setting"]: r for r in rows if r["stage"] == 1}
    assert sorted(one) == list(range(len(combos)))
    for n, setting in enumerate(combos):
        assert tuple(one[n][c] for c in settings.SEQUENCE) == setting
        want = plain_scores(data, setting, 0.0, 2000.0, 0.0, ignored)
        for c, w in zip(names, want, strict=True):
            assert one[n][c] == (w if w is None else pytest.approx(w, abs=1e-9)), (setting, c)
    best = sorted(one.values(), key=lambda r: (-r["f1"], -(r["miou"] or -1.0), r["records_per_hour"], r["setting"]))[:3]
    two = {(r["setting"], r["gap"], r["least"], r["sure"]): r for r in rows if r["stage"] == 2}
    assert sorted(two) == sorted(itertools.product([r["setting"] for r in best], gaps, lengths, sure))
    for (n, gap, least, s), r in two.items():
        for c, w in zip(names, plain_scores(data, combos[n], gap, least, s, ignored), strict=True):
            assert r[c] == (w if w is None else pytest.approx(w, abs=1e-9)), (n, gap, least, s, c)
    top = settings.best_of(out).first()
    assert top.f1 == max(r["f1"] for r in rows)


def tables(spark, data):
    steps = spark.createDataFrame([(k, i, int(t[i]), truth[i], *p[i].tolist()) for k, (p, t, truth, _, _) in data.items() for i in range(len(t))], "k string, i long, t long, truth int, a double, b double, c double")
    gold = spark.createDataFrame([(k, j, g[2], g[0], g[1]) for k, v in data.items() for j, g in enumerate(v[4])], "k string, gold_id long, class_idx int, start_ms double, end_ms double")
    return steps, gold, spark.createDataFrame([(k, int(v[3])) for k, v in data.items()], "k string, span_ms long")


def test_steps_are_written_once_and_not_for_each_setting(spark, data, monkeypatch):
    from pyspark.sql import functions as F

    from tidelane import storage

    written, write = [], storage.materialize

    def counted(df, name):
        out = write(df, name)
        written.append(out.agg(F.sum(F.size("rows"))).first()[0] if "rows" in out.columns else out.count())
        return out

    monkeypatch.setattr(storage, "materialize", counted)
    grid = {"smooth": (1, 3, 5), "median": (1, 3), "stay": (0.35, 0.9), "run": (1, 2)}
    out = settings.two_stage(*tables(spark, data), "k", ["i"], "t", ["a", "b", "c"], "truth", gaps=(0, 6000), lengths=(0,), sure=(0.0,), kept=2, **grid)
    assert out.count() == 24 + 4
    assert sum(written) <= sum(len(v[1]) for v in data.values()) + 24 + 4


@pytest.mark.parametrize("gap", [0, 6000])
def test_longer_keys_are_cut_and_count_alike(spark, data, monkeypatch, gap):
    from functools import partial

    p, t, truth, _, gold = data["k0"]
    given = data | {"short": (p[:20], t[:20], truth[:20], float(t[19]), [g for g in gold if g[1] < t[19]])}
    assert min(len(v[1]) for k, v in given.items() if k != "short") > 64
    grid = {"smooth": (1, 4), "median": (1, 3), "stay": (0.5, 0.9), "run": (1, 3)}
    found = []
    for size in (64, scan.CHUNK):
        monkeypatch.setattr(settings.scan, "packed", partial(PACKED, size=size))
        out = settings.two_stage(*tables(spark, given), "k", ["i"], "t", ["a", "b", "c"], "truth", gaps=(gap,), lengths=(0, 9000), least=2000.0, sure=(0.0, 0.55), kept=3, ignored=(2,), **grid)
        found.append({(r.stage, r.setting, r.gap, r.least, r.sure): r.asDict() for r in out.collect()})
    cut, whole = found
    assert len(whole) == 16 + 3 * 4 and sorted(cut) == sorted(whole)
    for name, row in whole.items():
        assert cut[name] == {c: v if v is None else pytest.approx(v, abs=1e-9) for c, v in row.items()}, name


def test_pieces_of_runs_pass_over_missing_times_and_probabilities(spark):
    rows = [("a", 0, None, 0, [0]), ("a", 1, 30, 1, [0]), ("a", 2, 20, None, [0]), ("a", 3, None, 1, [1]), ("b", 4, 7, 0, [1]), ("b", 5, 9, 1, [1])]
    paths = spark.createDataFrame([((1, 1, k), i, t, truth, [0.75 if i % 4 else None, None if i == 3 else 0.25], p) for k, i, t, truth, p in rows], "_unit struct<smooth:int,median:int,key:string>, _i long, _t long, _truth int, probs array<double>, paths array<int>").coalesce(1)
    found = sorted((r._unit.key, r.start_idx, r.end_idx, r._stay, r._label, r._n, r._sums, r.hits, r.t0, r.t1) for r in settings.cut_runs(paths, 2, 1).collect())
    assert found == [("a", 0, 3, 0, 0, 3, [1.5, 0.75], [1, 1], 20, 30), ("a", 3, 4, 0, 1, 1, [0.75, None], [0, 1], None, None), ("b", 4, 6, 0, 1, 2, [0.75, 0.5], [1, 1], 7, 9)]


def test_policies_as_rows_equal_one_at_a_time(spark):
    from tidelane.config import BASELINE, FULL, RAW
    from tidelane.plans import pipeline

    rng = np.random.default_rng(1)
    rows, signal = [], []
    for k in ("a", "b"):
        truth = np.repeat(rng.integers(0, 3, 12), rng.integers(3, 15, 12))
        p = share(rng.dirichlet(np.ones(3), len(truth)) + np.eye(3)[truth])
        rows += [(k, 1000 * i, np.round(x, 3).tolist()) for i, x in enumerate(p)]
        signal += [(k, 20 * i, i, float(x), float(y), 1.0) for i, (x, y) in enumerate(rng.normal(size=(50 * len(truth), 2)))]
    steps = spark.createDataFrame(rows, "k string, t_ms long, probs array<double>")
    moves = spark.createDataFrame(signal, "k string, t_ms long, seq long, ax double, ay double, az double")
    short = dict(min_duration=4.0, merge_gap=3.0)
    policies = [FULL.derive("a", **short), RAW, BASELINE.derive("b", **short), FULL.derive("c", top_k=1, median=3, **short), FULL.derive("d", viterbi=False, resolve=False, min_confidence=0.0, merge_gap=0.0, min_duration=0.0), FULL.derive("e", smooth=0, median=0, self_stay=0.8, **short)]
    for given in (None, moves):
        found = pipeline.post_process_all(steps, "k", ["t_ms"], 3, policies, signal=given).collect()
        for n, policy in enumerate(policies):
            want = pipeline.post_process(steps, "k", ["t_ms"], 3, policy, signal=given).collect()
            line = lambda r: (r.k, r.start_ms, r.end_ms, r.class_idx, round(r.confidence, 9), round(r.duration_sec, 9))
            assert sorted(line(r) for r in found if r.ord == n) == sorted(line(r) for r in want), policy
    assert len({r.ord for r in found}) == len(policies)


def test_steps_are_written_once_for_all_policies_and_longer_keys_end_alike(spark, monkeypatch):
    from functools import partial

    from pyspark.sql import functions as F

    from tidelane import storage
    from tidelane.config import FULL, RAW
    from tidelane.plans import pipeline

    rng = np.random.default_rng(5)
    rows = [(k, 1000 * i, np.round(x, 3).tolist()) for k, n in (("a", 90), ("b", 70), ("c", 9), ("d", 1)) for i, x in enumerate(share(rng.dirichlet(np.ones(3), n) + 2 * np.eye(3)[np.repeat(rng.integers(0, 3, n), 6)[:n]]))]
    steps = spark.createDataFrame(rows, "k string, t_ms long, probs array<double>")
    short = {"min_duration": 4.0, "merge_gap": 3.0, "min_confidence": 0.3}
    policies = [RAW, FULL.derive("a", **short), FULL.derive("b", smooth=4, median=4, self_stay=0.8, **short), FULL.derive("c", smooth=0, median=3, viterbi=False, **short), FULL.derive("d", median=0, self_stay=0.8, **short)]
    written, write = [], storage.materialize

    def counted(df, name):
        out = write(df, name)
        if "rows" in out.columns:
            written.append(out.agg(F.sum(F.size("rows"))).first()[0])
        return out

    monkeypatch.setattr(storage, "materialize", counted)
    found = []
    for size in (scan.CHUNK, 64):
        monkeypatch.setattr(scan, "packed", partial(PACKED, size=size))
        out = pipeline.post_process_all(steps, "k", ["t_ms"], 3, policies).collect()
        found.append({(r.ord, r.k, r.start_ms, r.class_idx): (r.end_ms, pytest.approx(r.confidence, abs=1e-9), r.duration_sec) for r in out})
        if size == scan.CHUNK:
            assert written == [len(rows)]
    whole, cut = found
    assert {r[0] for r in whole} == set(range(len(policies))) and {r[1] for r in whole} == {"a", "b", "c", "d"}
    assert sorted(whole) == sorted(cut)
    for name, (end, sure, long) in whole.items():
        assert (cut[name][0], cut[name][2]) == (end, long) and cut[name][1].expected == sure, name
