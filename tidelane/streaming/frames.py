"""Frames out of live notifications: the byte machine's unfinished frame is state between micro-batches."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidelane import shipping
from tidelane.sources import readers
from tidelane.streaming.live import ROCKSDB


class Machine(StatefulProcessor):
    """State of a device: the bytes, under 20, of a frame that hasn't ended."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "bytes binary")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = bytes(self.held.get()[0]) if self.held.exists() else b""
        batch = pd.concat(list(rows), ignore_index=True).sort_values("seq", kind="stable")
        out = []
        for seq, content in zip(batch["seq"], batch["content"], strict=True):
            found, held = readers.cut_frames(held, b"" if content is None else bytes(content))
            out += [(key[0], int(seq), i, f.hex().upper()) for i, f in enumerate(found)]
        self.held.update((held,))
        yield pd.DataFrame(out, columns=["device", "seq", "i", "frame"])

    def close(self) -> None:
        pass


def frames(stream: DataFrame) -> DataFrame:
    """Decoded frames of a stream of notifications (device, seq, content), as ``readers.notified_frames`` gives them."""
    spark = stream.sparkSession
    shipping.ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    rows = stream.select("device", "seq", "content").groupBy("device")
    return readers.frame_values(rows.transformWithStateInPandas(Machine(), "device string, seq long, i int, frame string", "Append", "None"))
