"""What the corpus operators share: written intermediates (see ``tidelane.storage``), Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidelane.shipping import ship
from tidelane.storage import materialize, new_folder, shared_dir  # noqa: F401

#: Rows and bytes of an Arrow batch at most. Texts may be long, and a batch is what a Python worker holds at once.
ARROW_ROWS, ARROW_BYTES = 500, 4_000_000

#: The white space that separates words, as bytes: space and 0x09 to 0x0D.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def prepare(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Lower (never raise) the rows and bytes of an Arrow batch, so that a batch of long texts fits a worker, and let
    workers import this package (see ``tidelane.shipping``).

    Plans read the setting when they run, so it stays lowered for the session.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = str(spark.conf.get(key)).removesuffix("b")
        if not now.isdigit() or int(now) <= 0 or int(now) > most:
            spark.conf.set(key, str(most))
    ship(spark)


def give_back() -> None:
    """Return freed memory to the system: workers live on between tasks, and from one stage to the next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_column(df: DataFrame, name: str) -> str:
    """``name``, lengthened until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def byte_column(column: pa.Array) -> tuple[pa.Buffer | None, list[int]]:
    """Buffer and offsets of a string column without nulls, for work on the raw UTF-8."""
    offsets = memoryview(column.buffers()[1]).cast("i")[column.offset : column.offset + len(column) + 1]
    return column.buffers()[2], list(offsets)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples."""
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


class Emitter:
    """Collects output rows and hands them on as Arrow batches of at most ``rows`` rows or ``size`` bytes."""

    def __init__(self, schema: pa.Schema, rows: int = 4000, size: int = 8_000_000):
        self.schema, self.rows, self.size = schema, rows, size
        self.kept: list[tuple] = []
        self.bytes = 0

    def add(self, row: tuple, size: int = 0) -> bool:
        self.kept.append(row)
        self.bytes += size
        return len(self.kept) >= self.rows or self.bytes >= self.size

    def flush(self) -> pa.RecordBatch:
        columns = zip(*self.kept, strict=True) if self.kept else [[] for _ in self.schema]
        batch = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)
        self.kept, self.bytes = [], 0
        return batch
