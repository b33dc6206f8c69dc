"""Exact top-k inner products with an impact-ordered index, a score at a time.

Vectors are turned into integers. Each shard of them keeps, for every quantised impact (a range of absolute component
values) from the highest to the lowest, the postings with that impact: segments by dimension of (vector, value). All
segments of one impact are processed for a block of queries before any of a lower one, so partial scores grow by ever
smaller steps. After each impact a vector's score can still change by at most the product of the query's norm and the
norm of the vector's unprocessed components (kept with the shard); a query stops only once that proves which vectors can
be among its best, and those are scored exactly. A query whose bound never suffices ends with exact scores of all. A level's postings are added for all live queries at once, as one dense product of the
block's queries with the level's plane: with dense vectors that is what fills the levels anyway.

Vectors are dealt into shards and queries into blocks, both of bounded size; every block meets every shard, the number
of meetings is the only product formed. Each meeting returns at most k rows a query. Nothing is joined, so no plan sends
blocks through the driver: a task gets its shards, builds their indexes, and then streams all blocks past them, holding
one at a time. With many shards a task holds several, so that fewer copies of the blocks are shuffled. Shards and blocks
travel as the narrowest integers that hold their components.

Defined cases: vectors that are null, empty or have a null or non-finite component, and rows without an id, take no
part. Vectors of different lengths never meet. Repeated rows are each candidates; a query's own row is left out by its
id. Ties go to the smaller id. Fewer candidates than k give fewer rows. A component that no long can hold after scaling,
or such a score among the best, is an error that names it: neither is ever cut to the largest long.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.llm import shared

SCALE, EVERY, BEST = 256, 50, 5
SHARD_ROWS, BLOCK_ROWS = 8192, 512
#: A task holds several shards only where that leaves this many tasks, and together at most so many components.
TASKS, HELD = 64, 2**22
#: Impact levels: level i holds absolute values of at least LEVELS[i] (and below LEVELS[i - 1]), as shares of the largest.
LEVELS = (0.5, 0.35, 0.25, 0.18, 0.12, 0.06, 0.0)
#: A query goes on to lower impacts while more of a shard's vectors than this may still be among its best.
RESCORE = 64


def _whole(e, scale: int):
    """The scaled component, rounded down, as a long; an error beyond."""
    return F.when(F.abs(e) < F.lit(2.0**63 / scale), F.floor(e * F.lit(float(scale))).cast("long")).otherwise(F.raise_error(F.concat(F.lit("component too large for a long: "), e.cast("string"))).cast("long"))


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and integer vector ``v`` of the rows of ``vectors`` (vec_id, embedding) that take part."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    fine = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    finite = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return vectors.where(fine & F.coalesce(finite, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: _whole(e, scale)).alias("v"))


def build(ids: np.ndarray, vectors: np.ndarray, levels: tuple[float, ...] = LEVELS) -> dict[str, np.ndarray]:
    """A shard's index: postings by falling impact, then dimension; segment ends; norms of what each level leaves."""
    size = np.abs(vectors.astype(np.int64))
    top = size.max() if size.size else 0
    floors = np.array([np.ceil(x * top) for x in levels], np.int64)
    level = (size[:, :, None] < floors).sum(axis=2) if size.size else np.zeros(size.shape, np.int64)
    vec, dim = np.nonzero(size)
    order = np.lexsort((vec, dim, level[vec, dim]))
    vec, dim = vec[order], dim[order]
    key = level[vec, dim] * vectors.shape[1] + dim
    ends = np.searchsorted(key, np.arange(len(floors) * vectors.shape[1]), side="right")
    rest = np.stack([np.where(level > i, vectors, 0).astype(np.float64) for i in range(len(floors))]) if len(ids) else np.zeros((len(floors), 0, vectors.shape[1]))
    return {"ids": ids, "vec": vec.astype(np.int32), "value": vectors[vec, dim], "ends": ends, "norm": np.sqrt((rest**2).sum(axis=2)), "vectors": vectors}


def search(index: dict[str, np.ndarray], query_ids: np.ndarray, queries: np.ndarray, best: int = BEST, rescore: int = RESCORE) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score) of each query's ``best`` vectors in a shard."""
    ids, dims, n = index["ids"], queries.shape[1], len(index["ids"])
    levels = len(index["ends"]) // dims
    weights = queries.astype(np.float64)
    length = np.sqrt((weights**2).sum(axis=1))
    total = np.sqrt((index["vectors"].astype(np.float64) ** 2).sum(axis=1))
    #: More than the sums' rounding errors, which grow with the norms.
    error = (dims + levels + 8) * 2.0**-52 * length[:, None] * total + 1e-6
    score = np.zeros((len(query_ids), n))
    out: list[tuple[int, int, int]] = []
    live = np.arange(len(query_ids))
    own = query_ids[:, None] == ids if len(np.intersect1d(query_ids, ids)) else None

    def finish(q: int, members: np.ndarray) -> None:
        members = members[ids[members] != query_ids[q]]
        kind = np.int64 if length[q] * total.max(initial=0) < 2.0**62 else object  # beyond that, longs could wrap
        exact = index["vectors"][members].astype(kind) @ queries[q].astype(kind)
        for m in sorted(range(len(members)), key=lambda m: (-exact[m], ids[members[m]]))[:best] if kind is object else np.lexsort((ids[members], -exact))[:best].tolist():
            if not -(2**63) <= int(exact[m]) < 2**63:
                raise ValueError(f"score too large for a long: query {query_ids[q]}, vector {ids[members[m]]}")
            out.append((int(query_ids[q]), int(ids[members[m]]), int(exact[m])))

    start = 0
    for level in range(levels):
        plane = np.zeros((n, dims))
        for d in range(dims):
            end = index["ends"][level * dims + d]
            plane[index["vec"][start:end], d] = index["value"][start:end]
            start = end
        score[live] += weights[live] @ plane.T
        slack = length[live, None] * index["norm"][level] + error[live]
        s = score[live]
        lower = s - slack
        if own is not None:
            lower[own[live]] = -np.inf
        done = np.zeros(len(live), bool)
        if n > best:
            kth = np.partition(lower, n - best, axis=1)[:, n - best]
            may = s + slack >= kth[:, None]
            counts = may.sum(axis=1)
            done = (counts <= rescore) & np.isfinite(kth)
        if level == levels - 1:
            done[:] = True
        for i in np.flatnonzero(done).tolist():
            finish(int(live[i]), np.flatnonzero(may[i]) if n > best and np.isfinite(kth[i]) else np.arange(n))
        live = live[~done]
        if not len(live):
            break
    return out


def _blobs(frame):
    """One row with the group's ids, as little-endian 64-bit integers, and vectors, as the narrowest integers that hold them."""
    frame = frame.sort_values("vec_id", kind="stable")
    v = np.stack(frame["v"].to_list())
    most = max(int(v.max()), -int(v.min()))
    narrow = next(f"<i{n}" for n in (1, 2, 4, 8) if most < 2 ** (8 * n - 1))
    return pd.DataFrame({"box": [int(frame["box"].iloc[0])], "width": [int(frame["width"].iloc[0])], "ids": [frame["vec_id"].to_numpy("<i8").tobytes()], "data": [v.astype(narrow).tobytes()]})


BLOBS = "box long, width int, ids binary, data binary"


def _arrays(width: int, ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of a row of ``_blobs``."""
    found = np.frombuffer(ids, "<i8")
    return found, np.frombuffer(data, f"<i{len(data) // (len(found) * width)}").reshape(-1, width)


def top_k(vectors: DataFrame, queries: DataFrame, *, scale: int = SCALE, best: int = BEST, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of the ``best`` inner products of each query with all other vectors."""
    spark = vectors.sparkSession
    shared.prepare(spark)  # before the first Python function is built
    rows, asked = quantised(vectors, scale), quantised(queries, scale)
    rows_in, widest = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    shards, blocks = (max(1, -(-x // n)) for x, n in ((rows_in, shard_rows), (asked.count(), block_rows)))
    tasks = -(-shards // max(1, min(shards // TASKS, HELD // (shard_rows * widest))))
    boxed = lambda x, n: x.withColumn("box", F.pmod(F.xxhash64("vec_id"), F.lit(n))).withColumn("width", F.size("v")).groupBy("box", "width").applyInPandas(_blobs, BLOBS)
    index = boxed(rows, shards).select((F.col("box") % tasks).cast("int").alias("task"), F.lit(False).alias("is_block"), "width", "ids", "data")
    block = boxed(asked, blocks).select(F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("task"), F.lit(True).alias("is_block"), "width", "ids", "data")
    meet = index.unionByName(block).repartitionById(tasks, "task").sortWithinPartitions("width", "is_block").select("width", "is_block", "ids", "data")

    def run(batches):
        names = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        kept, made = None, []
        for width, is_block, ids, data in shared.rows_of(batches):
            if kept != width:
                kept, made = width, []
            if not is_block:
                made.append(build(*_arrays(width, ids, data)))
                continue
            for shard in made:
                found = search(shard, *_arrays(width, ids, data), best)
                columns = list(zip(*found, strict=True)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], schema=names)

    near = meet.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best).select("query_id", "rank", "vec_id", "score")


def op4_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = shared.table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


QUERIES = {"op4_impact_topk": op4_impact_topk}
ORACLE_SQL = {
    "op4_impact_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
}
