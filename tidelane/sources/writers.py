"""Sinks: interval records, experiment tables, live recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RECORD = ("user_id", "category", "start", "end")


def write_records(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Interval records with exactly the four columns; an empty result is an error."""
    if list(df.columns) != list(RECORD):
        raise ValueError(f"records need the columns {RECORD}, not {tuple(df.columns)}")
    if df.isEmpty():
        raise ValueError("there are no records to write")
    out = df.select(F.col("user_id").cast("string"), F.col("category").cast("string"), F.col("start").cast("long"), F.col("end").cast("long"))
    writer = out.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def latex_table(rows: list[dict], columns: list[str], digits: int = 3) -> str:
    """A LaTeX table body of result rows; missing values as dashes."""
    show = lambda v: "--" if v is None else f"{v:.{digits}f}" if isinstance(v, float) else str(v)
    return "\n".join([" & ".join(columns) + r" \\", r"\midrule", *(" & ".join(show(r.get(c)) for c in columns) + r" \\" for r in rows)])


def record_stream(stream: DataFrame, path: str, checkpoint: str):
    """Appends a stream to CSV files; a restart goes on where it stopped."""
    return stream.writeStream.format("csv").option("header", True).option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def as_json(df: DataFrame, acc_digits: int = 3, other_digits: int = 2) -> DataFrame:
    """One JSON text per frame, values rounded."""
    rounded = [F.round(c, acc_digits if c.startswith("acc") else other_digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*rounded)).alias("value"))


def append_missing(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """``df`` and those rows of ``other`` whose key it lacks."""
    return df.unionByName(other.join(df.select(key).distinct(), key, "left_anti"))


def cache_windows(df: DataFrame, path: str, key: str, files: int = 64) -> DataFrame:
    """Windows written once, keys together, and read back: training passes read columns instead of building windows."""
    df.repartition(files, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_history(row: DataFrame, path: str) -> DataFrame:
    """Adds an epoch's figures to the history at ``path``; returns the newest row of each epoch, so repeats replace."""
    row.withColumn("written", F.current_timestamp()).write.mode("append").parquet(path)
    every = row.sparkSession.read.parquet(path)
    return every.groupBy("epoch").agg(*[F.max_by(c, "written").alias(c) for c in row.columns if c != "epoch"])
