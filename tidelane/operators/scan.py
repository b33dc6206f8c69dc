"""Recurrences along keys of any length: chunks of a key are worked at in parallel, joined by a scan over their summaries.

``chunked`` deals rows by ranges of (key, order) and cuts them into chunks of at most ``CHUNK`` rows, so a key that holds a
third of all rows is many chunks in many tasks. A recurrence then takes three steps: ``each`` gives a small summary of every
chunk, ``carried`` reads the summaries of a key in order as a stream (a row a chunk, nothing is held) and gives the state
that each chunk begins with, and ``each`` works through the chunks again from these states. ``carried`` can run backwards.

The chunks are written to the shared folder, as every step must see the same ones.

``packed`` tells keys of one chunk from longer ones: those need no scan, and a task can do all that is asked of them at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidelane import shipping, storage
from tidelane.operators import sequence

#: Rows of a chunk at most: a power of two. Chunks and bytes of an Arrow batch at most: what a Python worker holds at once.
CHUNK = 4096
BATCH_CHUNKS, BATCH_BYTES = 1000, 8_000_000


def bounded(spark: SparkSession) -> None:
    """Lower (never raise) the rows and bytes of an Arrow batch: a chunk is one row of up to ``CHUNK`` rows. Plans read the
    setting when they run, so it stays lowered for the session."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_CHUNKS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(spark.conf.get(key)).removesuffix("b")
        if not now.isdigit() or int(now) <= 0 or int(now) > most:
            spark.conf.set(key, str(most))


def chunked(df: DataFrame, key: str, order: list, size: int = CHUNK) -> DataFrame:
    """key, chunk (unique, rising along a key), first, last (whether it is the key's first or last) and rows."""
    shipping.ship(df.sparkSession)
    bounded(df.sparkSession)
    columns = [key, *order]
    placed = df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("_at", F.monotonically_increasing_id())
    block = F.shiftright("_at", size.bit_length() - 1).alias("_block")
    cut = placed.groupBy(key, block).agg(F.min("_at").alias("chunk"), F.sort_array(F.collect_list(F.struct("_at", *df.columns))).alias("rows")).drop("_block")
    cut = storage.materialize(cut, "chunks")
    along = Window.partitionBy(key).orderBy("chunk")
    ends = cut.select(key, "chunk").select("chunk", F.lag("chunk").over(along).isNull().alias("first"), F.lead("chunk").over(along).isNull().alias("last"))
    return cut.join(ends, "chunk")


def packed(df: DataFrame, key: str, order: list[str], columns: dict[str, Column], sound: Column, size: int = CHUNK) -> DataFrame:
    """key, block, rows (place ``_i`` and ``columns``, at most ``size``) and whole: they are all rows of their key, and all
    ``sound``."""
    shipping.ship(df.sparkSession)
    bounded(df.sparkSession)
    placed = df.select(key, sequence.place(key, order).cast("long").alias("_i"), *[c.alias(n) for n, c in columns.items()], sequence.size(key).alias("_size"), F.coalesce(sound, F.lit(False)).alias("_sound"))
    blocks = placed.groupBy(key, F.shiftright("_i", size.bit_length() - 1).alias("block"), (F.col("_size") <= size).alias("_fits"))
    return blocks.agg(F.sort_array(F.collect_list(F.struct("_i", *columns))).alias("rows"), F.bool_and("_sound").alias("_sound")).select(key, "block", (F.col("_fits") & F.col("_sound")).alias("whole"), "rows")


def each(chunks: DataFrame, f: Callable[[dict[str, pa.Array]], Iterator[dict[str, list]]], schema: str | T.StructType) -> DataFrame:
    """Rows that ``f`` makes of batches of chunks (columns by name)."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for out in f({n: batch.column(i) for i, n in enumerate(batch.schema.names)}):
                    columns = [x if isinstance(x, pa.Array) else pa.array(x, t.type) for x, t in zip((out[n] for n in arrow.names), arrow, strict=True)]
                    yield pa.RecordBatch.from_arrays([c if c.type == t.type else c.cast(t.type) for c, t in zip(columns, arrow, strict=True)], schema=arrow)

    return chunks.mapInArrow(run, schema)


def carried(summaries: DataFrame, key: str, start: Callable[[dict], object], step: Callable[[object, dict], object], given: Callable[[object], dict], schema: str, *, backwards: bool = False) -> DataFrame:
    """chunk and ``given(state)`` for the state that each chunk begins with (backwards: ends with).

    A key's state is ``start(its first summary)``, and ``step(state, summary)`` after each chunk.
    """
    begins = "last" if backwards else "first"
    ordered = summaries.repartition(key).sortWithinPartitions(key, F.desc("chunk") if backwards else F.asc("chunk"))
    kind = T.StructType([T.StructField("chunk", T.LongType()), *T.StructType.fromDDL(schema)])
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row[begins]:
                    state = start(row)
                out.append({"chunk": row["chunk"]} | given(state))
                state = step(state, row)
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return ordered.mapInArrow(run, kind)


def lengths(column: pa.Array) -> np.ndarray:
    return column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def grid(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Rows of chunks after one another as an array (chunk, place, ...), zeros behind shorter chunks."""
    row, place = places(size)
    out = np.zeros((len(size), int(size.max(initial=0)), *values.shape[1:]), values.dtype)
    out[row, place] = values
    return out


def places(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunk and place in it of every row."""
    row = np.repeat(np.arange(len(size)), size)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
