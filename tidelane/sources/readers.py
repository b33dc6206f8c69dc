"""Readers of recordings, labels, predictions and indexes. All go through Spark's own file readers."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelane import shipping
from tidelane.functions.scalars import stem
from tidelane.operators import clean

#: Fixed names: the columns that are used of a recording's header line.
SIGNAL = ("ACC_TIME", "ACC_X", "ACC_Y", "ACC_Z", "GYRO_X", "GYRO_Y", "GYRO_Z")
ALIAS = ("GYRO_", "GYRO_Z")
FRAME_BYTES, SYNC = 20, "55"


def missing(columns: list[str], wanted: tuple[str, ...]) -> None:
    lost = [c for c in wanted if c not in columns]
    if lost:
        raise ValueError(f"missing columns: {', '.join(lost)}")


def texts(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """user_id (file stem) and whole text of each .txt file; none for a folder that isn't there."""
    empty = spark.createDataFrame([], "user_id string, text string")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return empty
    reader = spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", str(recursive).lower())
    return reader.text(folder, wholetext=True).select(stem(F.col("_metadata.file_name")).alias("user_id"), F.col("value").alias("text"))


def sniff(spark: SparkSession, folder: str) -> DataFrame:
    """user_id and whether the first 100 bytes are UTF-8 text with the header's first column."""
    head = F.substring("content", 1, 100)
    text = F.try_validate_utf8(F.substring("content", 1, 97).cast("string"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(folder)
    return files.select(stem(F.col("path")).alias("user_id"), F.coalesce(F.contains(text, F.lit("ACC_TIME")), F.contains(head.cast("string"), F.lit("ACC_TIME")) & text.isNotNull(), F.lit(False)).alias("readable"))


def parse_signal(text: DataFrame, strict: bool = False) -> DataFrame:
    """user_id, seq, t_ms and six channels of whole texts (user_id, text) with a tab-separated header.

    Lines are split in place; a line is dropped if it is short, repeats the header, has a cell that isn't a number, or a
    time of 0 or less. Texts without the header give no rows; ``strict`` raises for them. seq follows (time, line).
    """
    bom = F.regexp_replace("text", "^﻿", "")
    lines = F.split(F.regexp_replace(bom, "\r", ""), "\n")
    rows = text.withColumn("lines", lines).withColumn("header", F.transform(F.split(F.element_at("lines", 1), "\t"), F.trim))
    known = F.array_contains("header", SIGNAL[0])
    if strict:
        known = known | F.raise_error(F.concat(F.lit("no header in "), "user_id")).cast("boolean")
    rows = rows.where(known)
    at = {c: F.array_position("header", c) for c in SIGNAL}
    at[ALIAS[1]] = F.when(at[ALIAS[1]] > 0, at[ALIAS[1]]).otherwise(F.array_position("header", ALIAS[0]))
    rows = rows.select("user_id", *[p.alias(f"_{c}") for c, p in at.items()], F.posexplode("lines").alias("line_no", "line"))
    cells = F.split("line", "\t")
    for c in SIGNAL:
        rows = rows.withColumn(c, F.trim(F.get(cells, F.col(f"_{c}").cast("int") - 1)).try_cast("double"))
    rows = rows.na.drop(subset=list(SIGNAL)).where(F.col("ACC_TIME") > 0)
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("t_ms", "line_no")) - 1
    out = rows.select("user_id", "line_no", F.col("ACC_TIME").cast("long").alias("t_ms"), *[F.col(c).cast("float").alias(n) for c, n in zip(SIGNAL[1:], ("ax", "ay", "az", "gx", "gy", "gz"), strict=True)])
    return out.withColumn("seq", seq.cast("long")).drop("line_no")


def signals(spark: SparkSession, folder: str, strict: bool = False) -> DataFrame:
    return parse_signal(texts(spark, folder), strict)


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """user_id, category, start, end (ms) and any further columns, numbered as in the file (``row_no``); a BOM is dropped."""
    df = spark.read.option("header", True).option("encoding", "UTF-8").csv(path)
    df = df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])
    missing(df.columns, ("user_id", "category", "start", "end"))
    df = df.withColumns({"user_id": F.col("user_id").cast("string"), "start": F.col("start").cast("double").cast("long"), "end": F.col("end").cast("double").cast("long")})
    return df.withColumn("row_no", F.monotonically_increasing_id())


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """Four columns with or without a header line."""
    names = ["user_id", "category", "start", "end"]
    df = spark.read.option("header", False).csv(path)
    if len(df.columns) < 4:
        raise ValueError("predictions need four columns")
    df = df.select(*df.columns[:4]).toDF(*names)
    df = df.where(~((F.col("user_id") == "user_id") & (F.col("start") == "start")))
    return df.withColumns({"start": F.col("start").cast("long"), "end": F.col("end").cast("long")})


def raw_index(spark: SparkSession, path: str) -> DataFrame:
    """externalid, sensorData, start, end, duration_h (0 where unknown or negative)."""
    df = spark.read.option("header", True).csv(path)
    missing(df.columns, ("externalid", "sensorData", "timeStamp.startTime", "timeStamp.endTime"))
    df = df.select("externalid", "sensorData", F.try_to_timestamp("`timeStamp.startTime`").alias("start"), F.try_to_timestamp("`timeStamp.endTime`").alias("end"))
    hours = (F.unix_micros("end") - F.unix_micros("start")) / 3.6e9
    return df.withColumn("duration_h", F.greatest(F.coalesce(hours, F.lit(0.0)), F.lit(0.0)))


def zipped_texts(spark: SparkSession, folder: str) -> DataFrame:
    """user_id and the first .txt member of each .zip; bad archives give no row."""

    def run(frames):
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        name = next((n for n in z.namelist() if n.endswith(".txt")), None)
                        if name is not None:
                            out.append((path.rsplit("/", 1)[-1].rsplit(".", 1)[0], z.read(name).decode("utf-8", "replace")))
                except zipfile.BadZipFile:
                    continue
            yield pd.DataFrame(out, columns=["user_id", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(folder)
    shipping.ship(files.sparkSession)
    return files.select("path", "content").mapInPandas(run, "user_id string, text string")


def subject_union(parts: DataFrame, least: int = 300) -> DataFrame:
    """Rows of several files of a subject (``file_seq``, ``seq``): files and subjects of ``least`` rows or more, the
    first row of each time."""
    big = parts.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("user_id", "file_seq"))).where(F.col("_n") >= least).drop("_n")
    return clean.at_least(clean.distinct_on(big, ["user_id", "t_ms"], ["file_seq", "seq"]), "user_id", least)


def line_records(lines: DataFrame, rate: float = 20.0) -> DataFrame:
    """subject, activity, label, t_s, x, y, z of ``user,activity,time,x,y,z;`` lines (``value``, ``line_no``)."""
    cells = F.split(F.regexp_replace(F.trim("value"), ";+$", ""), ",")
    rows = lines.select("line_no", *[F.trim(F.get(cells, F.lit(i))).alias(c) for i, c in enumerate(("subject", "activity", "time", "x", "y", "z"))])
    rows = rows.withColumns({c: F.col(c).try_cast("double") for c in "xyz"}).na.drop(subset=["x", "y", "z"]).where((F.col("subject") != "") & (F.col("activity") != ""))
    rows = rows.withColumn("t_s", (F.row_number().over(Window.partitionBy("subject").orderBy("line_no")) - 1) / rate)
    return clean.dense_labels(rows, "activity", "label").select("subject", "activity", "label", "t_s", "x", "y", "z", "line_no")


def spaced_records(lines: DataFrame, columns: dict[str, int]) -> DataFrame:
    """Numbers of white-space separated lines, by position from 0; NaN becomes null."""
    cells = F.split(F.trim("value"), r"\s+")
    number = lambda i: F.when(F.get(cells, F.lit(i)) != "NaN", F.get(cells, F.lit(i)).try_cast("double"))
    return lines.select("line_no", *[number(i).alias(c) for c, i in columns.items()])


def body_columns(names: list[str]) -> list[int]:
    """Places (2 to 134) of the accelerometer and body-motion columns in a column catalogue."""
    tokens = ("acc", "gyro", "Nav", "Body", "AngVel")
    return [i for i, n in enumerate(names) if 2 <= i <= 134 and (n.startswith("Accelerometer") or ("InertialMeasurementUnit" in n and any(t in n for t in tokens)))]


#: The byte machine, a step a match: a frame; a sync byte with a wrong second one, which both go; any other byte.
MACHINE = re.compile(rb"(\x55[\x61\x71\x54].{18})|\x55[^\x61\x71\x54]|[^\x55]", re.DOTALL)


def frames(df: DataFrame, content: str = "content") -> DataFrame:
    """Decodes the 20-byte frames (0x55, kind, nine little-endian int16) of each binary value on its own, skipping what
    isn't one. A wrong second byte goes together with the sync byte before it."""
    found = F.regexp_extract_all(F.hex(content), F.lit(r"\G(?:(?!55)..|55(?!61|71|54)..)*(55(?:61|71|54).{36})"), F.lit(1))
    return frame_values(df.select(*[c for c in df.columns if c != content], F.posexplode(found).alias("i", "frame")))


def cut_frames(held: bytes, data: bytes) -> tuple[list[bytes], bytes]:
    """Whole frames of ``held + data`` and what may yet become one, under 20 bytes."""
    data, found, end = held + data, [], 0
    while match := MACHINE.match(data, end):
        end = match.end()
        if match[1]:
            found.append(match[1])
    return found, data[end:]


def notified_frames(df: DataFrame, key: str, order: list[str], content: str = "content") -> DataFrame:
    """Frames of each ``key``'s notifications, read as one stream of bytes in order: a frame may begin in one notification
    and end in a later one, whose row it then belongs to. What a key holds between rows is under 20 bytes."""
    shipping.ship(df.sparkSession)
    rows = df.select(key, *order, content).repartition(key).sortWithinPartitions(key, *order)
    schema = T.StructType([*[f for f in rows.schema if f.name != content], T.StructField("i", T.IntegerType()), T.StructField("frame", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, b""
        for batch in batches:
            at, place, out = [], [], []
            for n, (k, data) in enumerate(zip(batch.column(0).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)):
                if k != now:
                    now, held = k, b""
                found, held = cut_frames(held, data or b"")
                at += [n] * len(found)
                place += range(len(found))
                out += [f.hex().upper() for f in found]
            taken = batch.select(list(range(batch.num_columns - 1))).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(place, pa.int32()), pa.array(out, pa.string())], names=[f.name for f in schema])

    return frame_values(rows.mapInArrow(run, schema))


def frame_values(out: DataFrame) -> DataFrame:
    """kind and values of ``frame`` (hexadecimal): 61 has acceleration (g), turn rate and angle (degrees), 54 magnetism (raw)."""

    def word(k: int):
        at = 5 + 4 * k
        raw = F.conv(F.concat(F.substring("frame", at + 2, 2), F.substring("frame", at, 2)), 16, 10).cast("int")
        return F.when(raw >= 32768, raw - 65536).otherwise(raw)

    kind = F.substring("frame", 3, 2)
    scaled = {"acc": 16.0, "gyro": 2000.0, "angle": 180.0}
    columns = {f"{n}{axis}": F.when(kind == "61", word(3 * g + a) / 32768.0 * s) for g, (n, s) in enumerate(scaled.items()) for a, axis in enumerate("XYZ")}
    columns |= {f"mag{axis}": F.when(kind == "54", word(a).cast("double")) for a, axis in enumerate("XYZ")}
    return out.select(*[c for c in out.columns if c != "frame"], kind.alias("kind"), *[v.alias(k) for k, v in columns.items()])


def best_models(spark: SparkSession, path: str) -> DataFrame:
    """scale and model of a JSON catalogue: chosen explicitly, else the best by validation F1."""
    doc = spark.read.option("multiLine", True).schema("models array<string>, selected_models map<string,string>, val_f1 map<string,double>, window_configs array<struct<suffix:string,window_size:int,window_step:int,window_sec:double>>").json(path)
    chosen = doc.select(F.explode("selected_models").alias("scale", "model"))
    scored = doc.select(F.explode("models").alias("model"), "val_f1", "window_configs").select("model", F.coalesce(F.try_element_at("val_f1", F.col("model")), F.lit(float("-inf"))).alias("f1"), F.explode("window_configs").alias("w"))
    best = scored.where(F.contains("model", F.col("w.suffix"))).groupBy(F.col("w.suffix").alias("scale")).agg(F.max_by("model", F.struct("f1", "model")).alias("model"))
    return chosen.unionByName(best.join(chosen, "scale", "left_anti"))


def normaliser(spark: SparkSession, path: str) -> DataFrame:
    """mean and std (not under 1e-6) from JSON."""
    doc = spark.read.option("multiLine", True).schema("mean array<double>, std array<double>").json(path)
    return doc.select("mean", F.transform("std", lambda s: F.greatest(s, F.lit(1e-6))).alias("std"))


def discover(spark: SparkSession, folder: str, preferred: tuple[str, ...] = (), names: tuple[str, ...] = (), suffix: str = ".txt") -> list[str]:
    """Files of a source: below the first of the ``preferred`` folders that is there, those of ``names``, else all with the
    suffix but read-me files. A listing by Spark's file system, in order."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    top = hadoop.Path(folder)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    root = next((p for p in (hadoop.Path(top, x) for x in preferred) if fs.exists(p)), top)
    listing, found = fs.listFiles(root, True), []
    while listing.hasNext():
        found.append(listing.next().getPath())
    named = sorted(p.toString() for p in found if p.getName() in names)
    return named or sorted(p.toString() for p in found if p.getName().endswith(suffix) and not p.getName().lower().startswith(("readme", "about")))


def headered_csv(spark: SparkSession, path: str, columns: dict[str, str], label: str, order: str | None = None) -> DataFrame:
    """Signals (new name by column) and an integer label of CSV files with a header; other columns aren't read."""
    df = spark.read.option("header", True).csv(path)
    missing(df.columns, (*columns.values(), label))
    out = df.select(stem(F.col("_metadata.file_name")).alias("user_id"), *[F.col(c).try_cast("double").alias(n) for n, c in columns.items()], F.col(label).try_cast("int").alias("label"), *([F.col(order)] if order else []))
    return out.na.drop(subset=[*columns, "label"])


def result_table(spark: SparkSession, path: str, key: str = "user_id", policy: str = "policy", score: str = "f1") -> DataFrame:
    """A CSV or JSON table of results as one row a key with a column for each policy (its mean score)."""
    df = spark.read.json(path) if path.rstrip("/").endswith("json") else spark.read.option("header", True).csv(path)
    missing(df.columns, (key, policy, score))
    return wide_scores(df.withColumn(score, F.col(score).try_cast("double")), key, policy, score)


def wide_scores(df: DataFrame, key: str, policy: str, score: str, policies: list[str] | None = None) -> DataFrame:
    return df.groupBy(key).pivot(policy, policies).agg(F.avg(score))
