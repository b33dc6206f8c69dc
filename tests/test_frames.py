"""Frames cut over notifications at every byte, in batches and streams, against a plain byte machine."""

import random

import pytest

from tidelane.sources import readers
from tidelane.streaming import frames


def machine(data):
    """A byte at a time."""
    held, out = bytearray(), []
    for b in data:
        held.append(b)
        if len(held) == 1 and b != 0x55 or len(held) == 2 and b not in (0x61, 0x71, 0x54):
            held.clear()
        elif len(held) == 20:
            out.append(bytes(held))
            held.clear()
    return out


@pytest.fixture(scope="module")
def noise():
    r = random.Random(3)
    data = b""
    for _ in range(12):
        data += r.choice([b"", b"\x55", b"\x55\x55", b"\x00\x61", b"\x55\x00\x55\x61"]) + bytes([0x55, r.choice([0x61, 0x71, 0x54])]) + r.randbytes(18)
    return data + b"\x55\x61\x01"


def test_machine_is_the_same_however_bytes_are_cut(noise):
    want = machine(noise)
    assert len(want) > 3
    for size in range(1, 45):
        held, found = b"", []
        for at in range(0, len(noise), size):
            some, held = readers.cut_frames(held, noise[at : at + size])
            found += some
            assert len(held) < 20
        assert found == want


def line(r):
    return (r.device, r.kind, r.accX, r.gyroZ, r.angleY, r.magZ)


def test_batch_and_stream_agree(spark, noise, tmp_path):
    rows = []
    for size in (1, 3, 7, 19, 20, 21, 500):
        rows += [(f"d{size}", n, bytearray(noise[at : at + size])) for n, at in enumerate(range(0, len(noise), size))]
    rows += [("null", 0, bytearray(noise[:7])), ("null", 1, None), ("null", 2, bytearray(noise[7:]))]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "device string, seq long, content binary").repartition(3)
    whole = [line(r)[1:] for r in readers.frames(spark.createDataFrame([("x", bytearray(noise))], "device string, content binary")).orderBy("i").collect()]
    assert len(whole) == len(machine(noise))
    got = {}
    for r in readers.notified_frames(df, "device", ["seq"]).orderBy("device", "seq", "i").collect():
        got.setdefault(r.device, []).append(line(r)[1:])
    assert len(got) == 8 and all(v == whole for v in got.values())
    for n in range(4):  # a micro-batch each, cut where the notifications were
        cut = df.where(f"seq * 4 >= {n} * 60 AND seq * 4 < {n + 1} * 60" if n < 3 else "seq >= 45")
        cut.coalesce(1).write.parquet(str(tmp_path / "in" / str(n)))
    stream = spark.readStream.schema("device string, seq long, content binary").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = frames.frames(stream).writeStream.format("memory").queryName("frames").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    live = {}
    for r in spark.table("frames").orderBy("device", "seq", "i").collect():
        live.setdefault(r.device, []).append(line(r)[1:])
    assert live == got
