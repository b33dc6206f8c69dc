"""Best-fit packing of tokenised documents by hierarchical residuals.

Documents are encoded and cut into pieces of at most ``capacity`` tokens; only a document's last piece can be shorter.
Full pieces are sequences of their own. The others are dealt at random into groups of bounded size, packed best-fit by
falling length in each group, and nearly full bins are emitted. What has more room goes on as an item: the emptiest bins
of a group, its fill as length, join those of ``fan_in`` groups, to be packed best-fit again, until one group is left.

A group holds at most about ``group_items`` items in the first round and ``fan_in * carry`` in later ones, whatever the
input. Every piece is placed; ``carry`` only bounds which bins are tried again.

Defined cases: a null text has the closing token alone. Repeated rows are each packed. Empty tables give no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm import bpe, shared

CAPACITY = 4096
END_ID = 1
#: Bins with at most this many free places are emitted at once.
SLACK = 16
GROUP_ITEMS, FAN_IN, CARRY = 8192, 32, 64
#: The table of re-packed bins is broadcast up to this many rows (24 bytes each), else joined by shuffle.
BROADCAST_ROWS = 200_000

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, and each bin's fill: longest first, each into the fullest bin that has room.

    A bit set of the residuals in use finds that bin in one step.
    """
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fills: list[int] = []
    by_room: dict[int, list[int]] = {}
    rooms = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        above = rooms >> need
        if above:
            room = need + (above & -above).bit_length() - 1
            bins = by_room[room]
            b = bins.pop()
            if not bins:
                rooms ^= 1 << room
        else:
            b = len(fills)
            fills.append(0)
            room = capacity
        where[i], offset[i] = b, fills[b]
        fills[b] += need
        left = room - need
        bins = by_room.setdefault(left, [])
        if not bins:
            rooms |= 1 << left
        bins.append(b)
    return where, offset, np.array(fills, np.int64)


def pieces_of(docs: DataFrame, path: str | None = None, *, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of every row of ``docs`` (doc_id, text), with the CRC of their ids."""
    path = path or bpe.vocabulary_path()
    shared.prepare(docs.sparkSession)
    end, width = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def run(batches):
        encoder = bpe.load(path)
        for batch in batches:
            who, number, start, length, crc = [], [], [], [], []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), width)):
                    part = ids[at : at + width]
                    who.append(doc_id)
                    number.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(number, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, PIECE)


def _packer(round_: int, capacity: int, slack: int, carry: int):
    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        """One group's best fit. ``open`` marks the bins that go on to the next round."""
        order = [c for c in frame.columns if c != "box"]
        frame = frame.sort_values(["length", *(c for c in order if c != "length")], ascending=False, ignore_index=True)
        where, offset, fills = best_fit(frame["length"].to_numpy(np.int64), capacity)
        emptiest = np.argsort(fills, kind="stable")[:carry]
        on = np.zeros(len(fills), bool)
        on[emptiest] = fills[emptiest] < capacity - slack
        frame["offset"] = offset
        frame["fill"] = fills[where]
        frame["open"] = on[where]
        frame["bin"] = (round_ << 56) + (int(frame["box"].iloc[0]) << 24) + where
        return frame

    return pack


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, slack: int = SLACK, group_items: int = GROUP_ITEMS, fan_in: int = FAN_IN, carry: int = CARRY) -> DataFrame:
    """Adds sequence_id and offset to ``pieces`` (as of ``pieces_of``)."""
    pieces = shared.materialize(pieces, "pieces")
    short = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-short.count() // group_items))
    box = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups))  # by row, so repeated rows spread too
    first = (
        short.withColumn("box", box).groupBy("box")
        .applyInPandas(_packer(0, capacity, slack, carry), f"{PIECE}, box long, offset long, fill long, open boolean, bin long")
        .select(*pieces.columns, "offset", "fill", "open", "bin", "box")
    )
    full = pieces.where(F.col("length") >= capacity).select(
        *pieces.columns, F.lit(0).cast("long").alias("offset"), F.col("length").alias("fill"), F.lit(False).alias("open"), (F.monotonically_increasing_id() + F.lit(1 << 62)).alias("bin"), F.lit(-1).cast("long").alias("box")
    )
    placed = shared.materialize(first.unionByName(full), "placed")
    going = placed.where("open").groupBy("bin").agg(F.max("fill").alias("length"), F.max("box").alias("box"))
    moves, round_ = None, 0
    while groups > 1:
        round_, groups = round_ + 1, -(-groups // fan_in)
        step = (
            going.select(F.col("bin").alias("item"), "length", F.pmod("box", F.lit(groups)).alias("box")).groupBy("box")
            .applyInPandas(_packer(round_, capacity, slack, carry), "item long, length long, box long, offset long, fill long, open boolean, bin long")
        )
        step = shared.materialize(step, "round")
        if moves is None:
            moves = step.select("item", F.col("bin").alias("into"), F.col("offset").alias("base"))
        else:
            again = step.select(F.col("item").alias("into"), F.col("bin").alias("then"), F.col("offset").alias("more"))
            moves = moves.join(again, "into", "left").select("item", F.coalesce("then", "into").alias("into"), (F.col("base") + F.coalesce("more", F.lit(0))).alias("base"))
        going = step.where("open").groupBy("bin").agg(F.max("fill").alias("length"), F.max("box").alias("box"))
    own = placed.withColumn("sequence_id", F.col("bin"))
    if moves is not None:
        moves = shared.materialize(moves, "moves")
        moves = F.broadcast(moves) if moves.count() <= BROADCAST_ROWS else moves
        moved = own.where("open").join(moves, own["bin"] == moves["item"], "left")
        moved = moved.withColumns({"sequence_id": F.coalesce("into", "bin"), "offset": F.col("offset") + F.coalesce("base", F.lit(0))})
        own = own.where(~F.col("open")).unionByName(moved.select(*own.columns))
    return own.select(*pieces.columns, "sequence_id", "offset")


def op3_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces_of(shared.table(spark, sf_dir, "documents")))


QUERIES = {"op3_best_fit": op3_best_fit}
ORACLE_SQL: dict[str, str] = {}
