"""Scans over chunks of long keys against one pass over the whole key, and workers without the package's path."""

import os
import random
import subprocess
import sys
from collections import defaultdict

import numpy as np
import pytest

from tests.conftest import ROOT
from tidelane.operators import decode, scan


def by_key(rows):
    out = defaultdict(list)
    for k, t, *x in rows:
        out[k].append((t, x))
    return {k: [x for _, x in sorted(v, key=lambda r: r[0])] for k, v in out.items()}


@pytest.mark.parametrize("size", [16, 4096])
def test_paths_do_not_depend_on_chunks(spark, size):
    rng = np.random.default_rng(0)
    rows = []
    for k, n in [("a", 400), ("b", 3), ("c", 1), (None, 40), ("ties", 64), ("e", 33)]:
        p = np.full((n, 4), 0.25) if k == "ties" else np.round(rng.dirichlet(np.ones(4) * 0.5, n), 2)
        rows += [(k, t, p[t].tolist()) for t in range(n)]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, t long, p array<double>").repartition(5)
    matrices = [decode.transitions(4), decode.uniform_transitions(4, 0.6), decode.transitions(4, 0.5, 0.2, 0.2, 0.1)]
    got = {(r.k, r.t): r.paths for r in decode.with_paths(df, "k", ["t"], "p", matrices, size=size).collect()}
    fixed = {(r.k, r.t): r.path for r in decode.with_path(df, "k", ["t"], "p", matrix=matrices[1], least_run=4, size=size).collect()}
    assert len(got) == len(fixed) == len(rows)
    for k, v in by_key(rows).items():
        p = np.array([x[0] for x in v])
        for m, matrix in enumerate(matrices):
            assert [got[k, t][m] for t in range(len(p))] == decode.viterbi(p, matrix).tolist()
        assert [fixed[k, t] for t in range(len(p))] == decode.repair(decode.viterbi(p, matrices[1]), p, 4).tolist()
    assert decode.with_paths(df.limit(0), "k", ["t"], "p", matrices).count() == 0


def test_a_long_key_is_many_chunks(spark):
    df = spark.range(5000).selectExpr("'one' AS k", "id AS t")
    chunks = scan.chunked(df, "k", ["t"], 256).select("chunk", "first", "last", "rows").collect()
    assert max(len(r.rows) for r in chunks) <= 256 and sum(r.first for r in chunks) == sum(r.last for r in chunks) == 1
    assert [x.t for r in sorted(chunks, key=lambda r: r.chunk) for x in r.rows] == list(range(5000))


@pytest.mark.parametrize("size", [16, 4096])
def test_lowpass_does_not_depend_on_chunks(spark, size):
    rng = np.random.default_rng(0)
    data = {k: np.cumsum(rng.normal(size=(n, 2)), axis=0) for k, n in {"a": 700, "b": 3, None: 140, "d": 101, "e": 100}.items()}
    rows = [(k, t, *map(float, x[t]), "z") for k, x in data.items() for t in range(len(x))]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, t long, u double, v float, w string").repartition(5)
    out = decode.lowpass(df, "k", ["t"], ["u", "v"], size=size)
    assert out.schema == df.schema
    got = {(r.k, r.t): (r.u, r.v) for r in out.collect()}
    assert len(got) == len(rows)
    for k, x in data.items():
        want = [decode.zero_phase(x[:, 0], *decode.butterworth()), decode.zero_phase(x[:, 1].astype(np.float32), *decode.butterworth())] if len(x) > 100 else x.T
        for c in (0, 1):
            assert [got[k, t][c] for t in range(len(x))] == pytest.approx(list(want[c]), abs=(1e-9, 1e-4)[c])


def reckoned(rows):
    v, s, x, quiet, last, out = np.zeros(2), np.zeros(2), np.zeros(2), 0, None, []
    for t, ax, ay, pitch, roll in rows:
        pitch, roll = np.radians(pitch), np.radians(roll)
        s = 0.1 * np.array([ax + np.sin(pitch), ay - np.sin(roll) * np.cos(pitch)]) + 0.9 * s
        dt = 0.0 if last is None else min(max(t - last, 5), 100) / 1000
        last, quiet = t, quiet + 1 if np.abs(s).max() < 0.02 else 0
        v = np.zeros(2) if quiet >= 5 else v + s * 9.80665 * dt
        x = x + v * dt
        out.append(x)
    return np.array(out)


@pytest.mark.parametrize("size", [4, 32, 4096])
def test_dead_reckoning_does_not_depend_on_chunks(spark, size):
    rng = np.random.default_rng(2)
    data = {}
    for k, n in (("a", 300), ("b", 1), ("c", 90)):
        t, size_of = np.cumsum(rng.integers(1, 150, n)), np.repeat(rng.choice([0.0, 0.02, 0.5], n // 10 + 1), 10)[:n]
        data[k] = [(int(t[i]), *(float(x) for x in size_of[i] * rng.normal(size=4))) for i in range(n)]
    df = spark.createDataFrame([(k, *r) for k, v in data.items() for r in v], "k string, t_ms long, ax double, ay double, pitch double, roll double").repartition(4)
    got = {(r.k, r.t_ms): (r.x, r.y) for r in decode.dead_reckoning(df, "k", ["t_ms"], size=size).collect()}
    for k, v in data.items():
        assert np.abs(reckoned(v) - np.array([got[k, r[0]] for r in v])).max() < 1e-9


def merged_plainly(rows, gap, p):
    """start, end, start_idx, end_idx, label, confidence: each in turn swallows up to the next of its label."""
    if gap <= 0 or len(rows) <= 2:
        return rows
    out, i = [], 0
    while i < len(rows):
        now, j = list(rows[i]), i + 1
        while (found := next((m for m in range(j, len(rows)) if rows[m][0] - now[1] <= gap and rows[m][4] == now[4]), None)) is not None:
            now[1], now[3], j = rows[found][1], rows[found][3], found + 1
            now[5] = float(np.mean(p[now[2] : now[3], now[4]]))
        out.append(tuple(now))
        i = j
    return out


@pytest.mark.parametrize("gap", [0, 3, 10])
def test_interruptions(spark, gap):
    rng = np.random.default_rng(3)
    segments, steps, want = [], [], {}
    for key in ("a", "b", "two", None):
        p, rows, at = rng.dirichlet(np.ones(3), 120), [], 0
        for _ in range(2 if key == "two" else 25):
            n, label = int(rng.integers(1, 5)), int(rng.integers(0, 3))
            rows.append((at, at + n, at, at + n, label, 0.25))
            at += n
        segments += [(key, *r) for r in rows]
        steps += [(key, i, x.tolist()) for i, x in enumerate(p)]
        want |= {(key, *r[:5]): pytest.approx(r[5], abs=1e-9) for r in merged_plainly(rows, gap, p)}
    found = spark.createDataFrame(segments, "k string, start long, end long, start_idx long, end_idx long, label int, confidence double").repartition(3)
    got = decode.merge_interrupted(found, "k", gap, spark.createDataFrame(steps, "k string, _i long, probs array<double>"), "probs", label="label", start="start", end="end")
    assert {(r.k, r.start, r.end, r.start_idx, r.end_idx, r.label): r.confidence for r in got.collect()} == want


FRESH = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local-cluster[1,2,1024]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {shared!r}).config("spark.log.level", "ERROR").getOrCreate()
from tidelane.plans import catalog
assert catalog.queries()[{name!r}](spark, "/root/testdata/sf0.001").count() > 0
print("fine")
"""


@pytest.mark.parametrize("name", ["viterbi_path", "lowpass_filtfilt", "user_hook", "window_features_64", "merge_interrupted"])
def test_workers_get_the_package(tmp_path, name):
    """First query of a session, from an empty folder, without PYTHONPATH."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = FRESH.format(root=ROOT, shared=f"file://{tmp_path}/shared", name=name)
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]


def test_batches_of_chunks_are_bounded(spark):
    """Short keys are a chunk each; a worker sees no more of them at once than ``BATCH_CHUNKS``."""
    from tidelane.operators import scan

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    chunks = scan.chunked(spark.range(8000).selectExpr("id AS k", "0 AS i"), "k", ["i"])
    seen = [r.n for r in scan.each(chunks.coalesce(1), lambda c: iter([{"n": [len(c["chunk"])]}]), "n long").collect()]
    assert sum(seen) == 8000 and max(seen) <= 1000
