"""Live sessions: samples arrive per device, results revise what came before.

``snapshots`` keeps each device's samples as list state (appended to, never rewritten) and, whenever ``step`` new ones have
arrived and there are ``least``, emits the whole session under a new version: as often in a micro-batch as that comes about.
A control row empties the state; so does a timer after ``idle_ms`` without input, if set. ``revised`` runs the full post-processing
over the sessions of a micro-batch, as any other table of steps, and ``start`` joins the two in ``foreachBatch``.
``windows`` are plain event-time aggregates with a watermark.

A device's rows of one micro-batch are sorted by (t_ms, reset last) in memory: bound them by the source's options, such as
maxFilesPerTrigger. Results of an older version are superseded, see ``latest``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from tidelane import shipping
from tidelane.config import FULL, Policy
from tidelane.plans import pipeline

SNAPSHOT = "device string, version long, warm_up double, i long, t_ms long, probs array<double>"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Sessions(StatefulProcessor):
    """State of a device: its samples, and how many there are, how many are new, the version."""

    def __init__(self, step: int, least: int, full: int, idle_ms: int | None):
        self.step, self.least, self.full, self.idle_ms = step, least, full, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.samples = handle.getListState("samples", "t_ms long, probs array<double>")
        self.counts = handle.getValueState("counts", "n long, since long, version long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, since, version = self.counts.get() if self.counts.exists() else (0, 0, 0)
        whole: list[tuple] | None = None  # the session's samples, once a trigger has asked for them
        new: list[tuple] = []
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["t_ms", "reset"], kind="stable")
        for t, probs, reset in zip(batch["t_ms"], batch["probs"], batch["reset"], strict=True):
            if reset:
                self.samples.clear()
                n, since, version, whole, new = 0, 0, version + 1, None, []
                continue
            new.append((int(t), [float(v) for v in probs]))
            n, since = n + 1, since + 1
            if since >= self.step and n >= self.least:
                since, version = 0, version + 1
                if whole is None:
                    whole = [tuple(x) for x in self.samples.get()]
                self.samples.appendList(new)
                whole, new = whole + new, []
                yield pd.DataFrame({"device": key[0], "version": version, "warm_up": min(1.0, n / self.full), "i": np.arange(n), "t_ms": [x[0] for x in whole], "probs": [list(x[1]) for x in whole]})
        if new:
            self.samples.appendList(new)
        self.counts.update((n, since, version))
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, since, version = self.counts.get()
        self.samples.clear()
        self.counts.update((0, 0, version + 1))  # versions never run backwards
        return iter([])

    def close(self) -> None:
        pass


def snapshots(stream: DataFrame, *, step: int = 100, least: int = 300, full: int = 800, idle_ms: int | None = None) -> DataFrame:
    """Whole sessions of a stream of (device, t_ms, probs, reset), each time enough new samples are there.

    With ``idle_ms`` sessions end by timer; Spark then also runs micro-batches without input, so such a query never ends by
    itself (no availableNow).
    """
    spark = stream.sparkSession
    shipping.ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)  # what this kind of state needs
    rows = stream.select("device", "t_ms", "probs", "reset")
    return rows.groupBy("device").transformWithStateInPandas(Sessions(step, least, full, idle_ms), SNAPSHOT, "Update", "None" if idle_ms is None else "ProcessingTime")


def revised(sessions: DataFrame, classes: int, policy: Policy = FULL, *, signal: DataFrame | None = None, pad_ms: int = 1500) -> DataFrame:
    """device, version, warm_up and segments of the sessions in a batch of ``snapshots``."""
    steps = sessions.withColumn("session", F.struct("device", "version", "warm_up"))
    found = pipeline.post_process(steps, "session", ["i"], classes, policy, signal=signal, pad_ms=pad_ms)
    return found.select("session.*", *[c for c in found.columns if c != "session"])


def start(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, *, classes: int, policy: Policy = FULL, pad_ms: int = 1500, trigger: dict | None = None, **options) -> StreamingQuery:
    """Runs sessions: ``sink(segments, batch number)`` gets each micro-batch's revised segments."""

    def run(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            sink(revised(batch, classes, policy, pad_ms=pad_ms), number)

    return snapshots(stream, **options).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(run).trigger(**(trigger or {"processingTime": "1 second"})).start()


def latest(results: DataFrame) -> DataFrame:
    """Of each device the segments of its newest version."""
    newest = F.max("version").over(Window.partitionBy("device"))
    return results.withColumn("_newest", newest).where("version = _newest").drop("_newest")


def current(sessions: DataFrame, classes: int, policy: Policy = FULL) -> DataFrame:
    """Of each session its last step's state and smoothed probability: device, version, warm_up, class_idx, confidence."""
    steps = sessions.withColumn("session", F.struct("device", "version", "warm_up"))
    decoded = pipeline.decoded(steps, "session", ["i"], classes, policy)
    last = decoded.groupBy("session").agg(F.max_by(F.struct(F.col("path").alias("class_idx"), F.col("prob").alias("confidence")), "i").alias("r"))
    return last.select("session.*", "r.*")


def windows(stream: DataFrame, time: str, key: str, length: str, late: str) -> DataFrame:
    """Counts per key and tumbling window; rows later than ``late`` behind the newest are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length), key).agg(F.count(F.lit(1)).alias("n"))


def rate(stream: DataFrame, time: str, late: str = "10 seconds") -> DataFrame:
    """Frames in each second."""
    return stream.withWatermark(time, late).groupBy(F.window(time, "1 second")).agg(F.count(F.lit(1)).alias("n"))
