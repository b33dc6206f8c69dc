"""Queries through files: events are written by Spark as recordings, records and indexes, and read back by the readers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane import storage
from tidelane.operators import segments
from tidelane.plans import base
from tidelane.plans.base import KEY, ORDER
from tidelane.sources import readers, writers

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _recordings(spark, sf) -> str:
    """A folder with a tab-separated recording of each user: files side by side, as a folder for each would have to be listed.
    Tasks move their own files into place; a file's name is fixed by its task, so one that is run again replaces them."""
    ev = base.events(spark, sf)
    line = F.concat_ws("\t", F.col("t_ms").cast("string"), F.col("value").cast("string"), F.lit("1"), F.lit("2"), F.lit("3"), F.lit("4"), F.col("event_id").cast("string"))
    whole = ev.groupBy(KEY).agg(F.concat(F.lit("\t".join(readers.SIGNAL) + "\n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(F.col("event_id").alias("i"), line.alias("l")))), lambda x: x["l"]), "\n")).alias("value"))
    folder = storage.new_folder(spark, "recordings")
    whole.select("value").write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).text(folder)
    return folder


@query("SELECT epoch_us(ts) // 1000 AS t_ms, CAST(value AS FLOAT) AS ax, CAST(event_id AS FLOAT) AS gz FROM events WHERE epoch_us(ts) // 1000 > 0")
def recording_files(spark, sf):
    return readers.signals(spark, _recordings(spark, sf)).select("t_ms", "ax", "gz")


@query("SELECT true AS readable, count(DISTINCT user_id) AS n FROM events")
def readable_files(spark, sf):
    return readers.sniff(spark, _recordings(spark, sf)).groupBy("readable").agg(F.count(F.lit(1)).alias("n"))


def _records(spark, sf) -> DataFrame:
    found = segments.from_states(base.events(spark, sf), KEY, ORDER, "state", "value", "t_ms", base.PAD_MS)
    category = F.element_at(F.array(*[F.lit(c) for c in base.CLASSES]), F.col("class_idx") + 1)
    return found.select(F.col(KEY).cast("string").alias("user_id"), category.alias("category"), F.col("start_ms").alias("start"), F.col("end_ms").alias("end"))


_RECORDS = f"""WITH {base.SEG} SELECT CAST(user_id AS VARCHAR) AS user_id, ['click', 'error', 'purchase', 'signup', 'view'][class_idx + 1] AS category, start_ms AS "start", end_ms AS "end" FROM seg"""


@query(_RECORDS)
def annotation_files(spark, sf):
    folder = storage.new_folder(spark, "annotations")
    writers.write_records(_records(spark, sf), folder, "csv")
    return readers.annotations(spark, folder).select("user_id", "category", "start", "end")


@query(_RECORDS)
def prediction_files(spark, sf):
    folder = storage.new_folder(spark, "predictions")
    _records(spark, sf).write.option("header", False).csv(folder)
    return readers.predictions(spark, folder)


@query("SELECT CAST(user_id AS VARCHAR) AS externalid, 'f' || user_id AS \"sensorData\", round(CASE WHEN count(*) % 2 = 0 THEN epoch_us(max(ts)) - epoch_us(min(ts)) ELSE 0 END / 3.6e9::DOUBLE, 6) AS duration_h FROM events GROUP BY user_id")
def raw_index_files(spark, sf):
    """An index of recordings; users with an odd number of events have their times the wrong way round."""
    span = base.table(spark, sf, "events").groupBy(KEY).agg(F.min("ts").alias("a"), F.max("ts").alias("b"), (F.count(F.lit(1)) % 2 == 0).alias("even"))
    time = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    rows = span.select(F.col(KEY).cast("string").alias("externalid"), F.concat(F.lit("f"), F.col(KEY).cast("string")).alias("sensorData"), time(F.when(F.col("even"), F.col("a")).otherwise(F.col("b"))).alias("timeStamp.startTime"), time(F.when(F.col("even"), F.col("b")).otherwise(F.col("a"))).alias("timeStamp.endTime"))
    folder = storage.new_folder(spark, "index")
    rows.write.option("header", True).csv(folder)
    return readers.raw_index(spark, folder).select("externalid", "sensorData", F.round("duration_h", 6).alias("duration_h"))


@query("SELECT event_id AS i, value AS x, CAST(event_id AS DOUBLE) AS y, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS label FROM events WHERE event_type <> 'error'")
def headered_files(spark, sf):
    """Columns chosen by a catalogue of names; lines with a cell that isn't a number are dropped."""
    ev = base.events(spark, sf)
    x = F.when(F.col("state") == 1, "broken").otherwise(F.col("value").cast("string"))
    folder = storage.new_folder(spark, "headered")
    ev.select(F.lit("unread").alias("note"), x.alias("back_x"), F.col("event_id").cast("string").alias("back_y"), F.col("state").alias("label"), F.col("event_id").alias("index")).write.option("header", True).csv(folder)
    out = readers.headered_csv(spark, folder, {"x": "back_x", "y": "back_y"}, "label", "index")
    return out.select(F.col("index").cast("long").alias("i"), "x", "y", "label")


@query("""WITH p AS (SELECT user_id, event_id % 3 AS file_seq, event_id AS seq, epoch_us(ts) // 3600000000 AS t_ms FROM events), b AS (SELECT *, count(*) OVER (PARTITION BY user_id, file_seq) AS n FROM p),
d AS (SELECT *, row_number() OVER (PARTITION BY user_id, t_ms ORDER BY file_seq, seq) AS r FROM b WHERE n >= 20), k AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS m FROM d WHERE r = 1) SELECT user_id, file_seq, seq, t_ms FROM k WHERE m >= 20""")
def subject_parts(spark, sf):
    """Three files a user, joined: files and users of twenty rows or more, the first row of each hour."""
    parts = base.events(spark, sf).select("user_id", (F.col("event_id") % 3).alias("file_seq"), F.col("event_id").alias("seq"), F.floor(F.col("t_ms") / 3_600_000).cast("long").alias("t_ms"))
    return readers.subject_union(parts, 20).select("user_id", "file_seq", "seq", "t_ms")
