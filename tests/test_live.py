"""Live sessions: triggers, revision, resets, restarts, idle sessions."""

import numpy as np
import pytest

from tidelane.config import FULL
from tidelane.plans import pipeline
from tidelane.streaming import live

SCHEMA = "device string, t_ms long, probs array<double>, reset boolean"
POLICY = FULL.derive("live", min_duration=0.5, merge_gap=0.2)


def sample(i, device="d"):
    return (device, 10 * i, [0.1, 0.9] if i % 200 >= 100 else [0.95, 0.05], False)


@pytest.fixture
def feed(spark, tmp_path):
    """Files of rows, each a micro-batch; and a run of the stream over what hasn't been read."""
    seen, snaps, count = [], [], iter(range(100))

    def put(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"{next(count):03}"))

    def run(seconds=None, **options):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))

        def keep(batch, number):
            if batch.isEmpty():
                return
            batch = batch.persist()
            snaps.extend(batch.select("device", "version", "warm_up", "i", "t_ms").collect())
            seen.extend(live.revised(batch, 2, POLICY).collect())
            batch.unpersist()

        q = live.snapshots(stream, **options).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(keep)
        q = q.trigger(**({"availableNow": True} if seconds is None else {"processingTime": "1 second"})).start()
        if seconds is None:
            assert q.awaitTermination(120)
        else:
            assert not q.awaitTermination(seconds)
            q.stop()

    return put, run, seen, snaps


def versions(snaps, device="d"):
    return {v: max(s.i for s in snaps if s.device == device and s.version == v) + 1 for v in {s.version for s in snaps if s.device == device}}


def test_triggers_reset_and_restart(spark, feed):
    put, run, seen, snaps = feed
    put([sample(i) for i in reversed(range(450))] + [sample(i, "e") for i in range(299)])
    run()
    assert versions(snaps) == {1: 300, 2: 400} and versions(snaps, "e") == {}  # two in a batch; a session of 299 is too short
    assert {s.warm_up for s in snaps if s.version == 1} == {300 / 800}
    for v, n in ((1, 300), (2, 400)):
        steps = spark.createDataFrame([(*sample(i), i) for i in range(n)], SCHEMA + ", i long")
        want = {(r.class_idx, r.start_ms, r.end_ms, r.confidence) for r in pipeline.post_process(steps, "device", ["i"], 2, POLICY).collect()}
        assert want and {(r.class_idx, r.start_ms, r.end_ms, r.confidence) for r in seen if r.version == v} == want
    put([sample(i) for i in range(450, 500)] + [sample(299, "e")])  # a new run of the query goes on from the state
    run()
    assert versions(snaps) == {1: 300, 2: 400, 3: 500} and versions(snaps, "e") == {1: 300}
    put([("d", 5000, None, True)] + [sample(i) for i in range(501, 800)])
    run()
    assert max(versions(snaps)) == 3  # 299 since the reset
    put([sample(800)])
    run()
    assert versions(snaps)[5] == 300 and min(s.t_ms for s in snaps if s.version == 5) == 5010
    last = live.latest(spark.createDataFrame(seen)).where("device = 'd'").collect()
    assert {r.version for r in last} == {5}


def test_current_is_the_last_step(spark):
    rows = [("d", 4, 0.5, i, 10 * i, p) for i, p in enumerate([[0.9, 0.1]] * 50 + [[0.2, 0.8]] * 50)]
    out = live.current(spark.createDataFrame(rows, live.SNAPSHOT), 2, FULL.derive("x", smooth=0, median=0)).first()
    assert (out.device, out.version, out.class_idx, out.confidence) == ("d", 4, 1, 0.8)


def test_idle_sessions_end(spark, feed):
    put, run, _, snaps = feed
    put([sample(i) for i in range(250)])
    run(seconds=20, idle_ms=1)
    put([sample(i) for i in range(250, 350)])
    run(seconds=15, idle_ms=1)
    assert versions(snaps) == {}  # 100 samples since the timer, not 350


def test_sink_gets_revised_segments(spark, tmp_path):
    spark.createDataFrame([sample(i) for i in range(300)], SCHEMA).write.parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    q = live.start(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), lambda df, n: df.write.mode("append").parquet(out), str(tmp_path / "ck"), classes=2, policy=POLICY, trigger={"availableNow": True})
    assert q.awaitTermination(120)
    found = spark.read.parquet(out)
    assert found.columns[:3] == ["device", "version", "warm_up"] and np.isclose(found.first().warm_up, 300 / 800)


def test_windows_drop_what_is_too_late(spark, tmp_path):
    for n, times in enumerate((["2024-01-01 00:00:01", "2024-01-01 00:00:02"], ["2024-01-01 01:00:00"], ["2024-01-01 01:00:01"], ["2024-01-01 00:00:03"], ["2024-01-01 02:00:00"])):
        spark.createDataFrame([("k", t) for t in times], "k string, s string").selectExpr("k", "CAST(s AS TIMESTAMP) AS t").coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    stream = spark.readStream.schema("k string, t timestamp").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = live.windows(stream, "t", "k", "1 minute", "10 minutes").writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("late").collect()) == [2, 2]  # the late third sample of the first minute is gone
