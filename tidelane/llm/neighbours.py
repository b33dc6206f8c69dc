"""Approximate nearest neighbours: NN-descent builds a neighbour graph in Spark joins, queries walk it greedily.

Equal vectors are one node, so copies neither fill each other's lists nor crowd a task; a node keeps its ``best + 1``
smallest ids, which is all that any answer can hold of it. Every node is in the graph.

``build``: random hyperplanes (``TABLES`` hash tables, and one dealt at random so that no part stays apart) put nodes into
leaves of about ``LEAF`` nodes, larger ones being split by hash; nearest neighbours within a leaf start the graph. Then each
round joins every node's neighbours and reverse neighbours (the ``links`` nearest of either kind) with one another, skips
pairs that met before, and keeps what beats a node's farthest neighbour. It ends when under ``DELTA`` of all links changed,
or after ``ROUNDS`` rounds.

``search``: a query's beam holds the ``beam`` nearest nodes found. Every hop expands all that aren't yet expanded, and a
query stops when none is left: nothing that leaves a beam can come back, as beams only get nearer. A query that is a row of
the index starts at its own node, any other at ``SEEDS`` nodes. The beam's nodes are then ranked by their distance on the
original vectors in double precision.

Building and walking compare codes of a byte a component with a scale for each vector. Recall, measured against brute force
with these parameters, is in the README.

Defined cases: vectors that are null, empty, zero or have a null or non-finite component, and rows without an id, take no
part. Vectors of different lengths never meet. Repeated rows are each candidates; a query's own row is left out by its id.
Ties go to the smaller id. Fewer candidates than ``best`` give fewer rows; empty tables none. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.llm import shared

EVERY, BEST = 100, 10
LINKS, BEAM = 20, 200
TABLES, LEAF, ROUNDS, DELTA, SEEDS = 3, 256, 12, 0.01, 16
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("d", pa.float32())])


def usable(vectors: DataFrame, id_column: str = "vec_id") -> DataFrame:
    """id and ``v`` (doubles) of the rows that take part."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    fine = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf")))) & F.exists("v", lambda e: e != 0)
    return vectors.where(F.col(id_column).isNotNull() & F.col("embedding").isNotNull()).select(F.col(id_column).cast("long").alias("id"), x.alias("v")).where(F.coalesce(fine, F.lit(False)))


def encode(v: np.ndarray) -> np.ndarray:
    """Scale (a double) and components as signed bytes, a row of bytes for each vector."""
    scale = np.abs(v).max(axis=1) / 127
    small = np.clip(np.rint(v / np.maximum(scale, 5e-324)[:, None]), -127, 127).astype(np.int8)
    return np.concatenate([scale.astype("<f8").reshape(-1, 1).view(np.uint8), small.view(np.uint8)], axis=1)


def decode(codes: np.ndarray) -> np.ndarray:
    return codes[:, 8:].view(np.int8) * np.ascontiguousarray(codes[:, :8]).view("<f8")


def _fixed(column: pa.Array) -> np.ndarray:
    """Byte rows of a binary column whose values have one length."""
    offsets = np.frombuffer(column.buffers()[1], "<i4")[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data.reshape(len(column), -1)


def _by_dims(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Rows of one vector length at a time."""
    for batch in batches:
        dims = batch.column("dims").to_numpy(zero_copy_only=False)
        for d in np.unique(dims).tolist():
            yield d, batch.filter(pa.array(dims == d))


def nodes_of(vectors: DataFrame, best: int = BEST) -> DataFrame:
    """One row for each different vector: node (its smallest id), its smallest ids, dims, code and ``v``."""
    shared.prepare(vectors.sparkSession)
    first = Window.partitionBy("v").orderBy("id")
    rows = usable(vectors).withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= best + 1)
    rows = rows.groupBy("v").agg(F.min("id").alias("node"), F.sort_array(F.collect_list("id")).alias("ids")).withColumn("dims", F.size("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dims, part in _by_dims(batches):
            codes = encode(part.column("v").flatten().to_numpy().reshape(-1, dims))
            yield pa.RecordBatch.from_arrays([part.column("node"), part.column("ids"), part.column("dims"), pa.array([c.tobytes() for c in codes], pa.binary()), part.column("v")], names=["node", "ids", "dims", "code", "v"])

    return rows.select("node", "ids", "dims", "v").mapInArrow(run, "node long, ids array<long>, dims int, code binary, v array<double>")


def _leaves(nodes: DataFrame, counts: dict[int, int], tables: int, leaf: int) -> DataFrame:
    """Nodes in the leaves of each table: rows of (dims, members). ``counts`` are the nodes of each vector length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dims, part in _by_dims(batches):
            x, bits = decode(_fixed(part.column("code"))), max(0, int(np.ceil(np.log2(counts[dims] / leaf))))
            mixed = (part.column("node").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            at_random = (mixed % np.uint64(-(-counts[dims] // leaf))).astype(np.int64)
            for t in range(tables + 1):
                sides = np.random.default_rng([t, dims]).standard_normal((dims, bits))
                at = ((x @ sides) > 0) @ (1 << np.arange(bits, dtype=np.int64)) if t < tables else at_random
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(at, pa.int64()), part.column("dims"), part.column("node"), part.column("code")], names=["t", "leaf", "dims", "node", "code"])

    dealt = nodes.select("node", "dims", "code").mapInArrow(run, "t int, leaf long, dims int, node long, code binary")
    sizes = dealt.groupBy("t", "leaf", "dims").agg(F.ceil(F.count(F.lit(1)) / leaf).alias("parts"))
    part = F.pmod(F.xxhash64("node", "t"), "parts").alias("part")
    return dealt.join(sizes, ["t", "leaf", "dims"]).groupBy("t", "leaf", "dims", part).agg(F.collect_list(F.struct("node", "code")).alias("members")).select("dims", "members")


def _nearest_in_leaves(leaves: DataFrame, links: int) -> DataFrame:
    """(a, b, d): the ``links`` nearest of each node within each of its leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in _by_dims(batches):
            column = part.column("members")
            ends = np.cumsum(np.array(column.value_lengths().to_numpy(), np.int64))
            flat = column.flatten()
            ids, codes = flat.field("node").to_numpy(), _fixed(flat.field("code"))
            for start, end in zip([0, *ends[:-1]], ends, strict=True):
                n = int(end - start)
                if n < 2:
                    continue
                d = distances(decode(codes[start:end])[None])[0]
                np.fill_diagonal(d, np.inf)
                k = min(links, n - 1)
                near = np.argpartition(d, k - 1, axis=1)[:, :k]
                own = ids[start:end]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, k)), pa.array(own[near].ravel()), pa.array(np.take_along_axis(d, near, 1).ravel(), pa.float32())], schema=PAIRS)

    return leaves.mapInArrow(run, "a long, b long, d float")


def distances(x: np.ndarray) -> np.ndarray:
    """Of groups of vectors (group, member, component): squared distances within each group."""
    x = x.astype(np.float32 if np.abs(x).max(initial=0) < 1e15 else np.float64)
    square = (x**2).sum(axis=2)
    return np.nan_to_num(np.maximum(square[:, :, None] + square[:, None, :] - 2 * x @ x.transpose(0, 2, 1), 0), nan=np.inf)


def _merged(pairs: DataFrame, links: int) -> DataFrame:
    """(node, near) with the ``links`` nearest of (a, b, d, fresh); a link that was there before isn't fresh."""
    order = Window.partitionBy("a").orderBy("d", "b")
    once = pairs.repartition("a").groupBy("a", "b").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    kept = once.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= links)
    return kept.groupBy(F.col("a").alias("node")).agg(F.sort_array(F.collect_list(F.struct("d", "b", "fresh"))).alias("near"))


def _both_ways(graph: DataFrame, links: int) -> DataFrame:
    """(at, other, fresh): links and the ``links`` nearest reverse links of each node, each pair once."""
    out = graph.select(F.col("node").alias("at"), F.explode("near").alias("x")).select("at", F.col("x.b").alias("other"), "x.d", "x.fresh")
    order = Window.partitionBy("other").orderBy("d", "at")
    back = out.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= links)
    both = out.select("at", "other", "fresh").unionByName(back.select(F.col("other").alias("at"), F.col("at").alias("other"), "fresh"))
    return both.groupBy("at", "other").agg(F.max("fresh").alias("fresh"))


def _met(groups: DataFrame) -> DataFrame:
    """(a, b, d) of members of one group that hadn't met and beat a's farthest link; rows of (dims, members)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dims, part in _by_dims(batches):
            column = part.column("members")
            size = np.array(column.value_lengths().to_numpy(), np.int64)
            flat = column.flatten()
            row, most = np.repeat(np.arange(len(size)), size), int(size.max(initial=0))
            place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            x = np.zeros((len(size), most, dims))
            x[row, place] = decode(_fixed(flat.field("code")))
            ids, limit, fresh = np.zeros((len(size), most), np.int64), np.full((len(size), most), -1.0), np.zeros((len(size), most), bool)
            ids[row, place], limit[row, place], fresh[row, place] = flat.field("node").to_numpy(), flat.field("limit").to_numpy(), flat.field("fresh").to_numpy(zero_copy_only=False)
            d = distances(x)
            better = (d < limit[:, :, None]) & (limit[:, None, :] >= 0) & (fresh[:, :, None] | fresh[:, None, :]) & ~np.eye(most, dtype=bool)
            r, i, j = np.nonzero(better)
            yield pa.RecordBatch.from_arrays([pa.array(ids[r, i]), pa.array(ids[r, j]), pa.array(d[r, i, j].astype(np.float32))], schema=PAIRS)

    return groups.mapInArrow(run, "a long, b long, d float")


def build(nodes: DataFrame, *, links: int = LINKS, tables: int = TABLES, leaf: int = LEAF, rounds: int = ROUNDS, delta: float = DELTA) -> DataFrame:
    """The neighbour graph of written ``nodes``: (node, near), near holding (d, b, fresh) by rising squared distance."""
    shared.prepare(nodes.sparkSession)
    # A row a vector length: k lengths take at least k * k / 2 components, so these are few.
    counts = {r.dims: r["count"] for r in nodes.groupBy("dims").count().collect()}
    count = sum(counts.values())
    graph = shared.materialize(_merged(_nearest_in_leaves(_leaves(nodes, counts, tables, leaf), links).withColumn("fresh", F.lit(True)), links), "neighbours-start")
    for _ in range(rounds):
        full = F.when(F.size("near") >= links, F.element_at("near", -1)["d"].cast("double")).otherwise(F.lit(float("inf")))
        known = nodes.select("node", "dims", "code").join(graph.select("node", full.alias("limit")), "node")
        met = _both_ways(graph, links).join(known.withColumnRenamed("node", "other"), "other")
        groups = met.groupBy("at", "dims").agg(F.collect_list(F.struct(F.col("other").alias("node"), "code", "limit", "fresh")).alias("members"))
        found = _met(groups.select("dims", "members")).withColumn("fresh", F.lit(True))
        old = graph.select(F.col("node").alias("a"), F.explode("near").alias("x")).select("a", "x.b", "x.d", F.lit(False).alias("fresh"))
        graph = shared.materialize(_merged(old.unionByName(found), links), "neighbours-round")
        changed = graph.agg(F.sum(F.size(F.filter("near", lambda x: x["fresh"])))).first()[0] or 0
        if changed <= delta * links * count:
            break
    return graph


def search(nodes: DataFrame, graph: DataFrame, queries: DataFrame, *, best: int = BEST, beam: int = BEAM, links: int = LINKS) -> DataFrame:
    """query_id, rank, vec_id and score of the ``best`` rows found nearest to each of ``queries`` (vec_id, embedding)."""
    spark = nodes.sparkSession
    asked = usable(queries).withColumnRenamed("id", "query_id")
    targets = nodes_of(queries, 0).select(F.col("node").alias("target"), F.col("code").alias("asked"), "dims", F.col("v").alias("w"))
    targets = shared.materialize(targets.join(nodes.select(F.col("v").alias("w"), "node"), "w", "left"), "neighbours-targets")
    roads = shared.materialize(_both_ways(graph, links).groupBy(F.col("at").alias("node")).agg(F.collect_list("other").alias("others")), "neighbours-roads")
    seeds = [r.node for r in nodes.select("node").orderBy(F.xxhash64("node")).limit(SEEDS).collect()]
    strange = targets.where(F.col("node").isNull()).select("target", F.explode(F.array(*[F.lit(s).cast("long") for s in seeds])).alias("node")) if seeds else targets.select("target", "node").limit(0)
    codes = nodes.select("node", F.col("dims").alias("node_dims"), "code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in _by_dims(batches):
            x, y = decode(_fixed(part.column("asked"))), decode(_fixed(part.column("code")))
            d = np.nan_to_num(((x - y) ** 2).sum(axis=1), nan=np.inf).astype(np.float32)
            yield pa.RecordBatch.from_arrays([part.column("target"), part.column("node"), pa.array(d)], names=["target", "node", "d"])

    def measured(pairs: DataFrame) -> DataFrame:
        rows = pairs.join(targets.select("target", "asked", "dims"), "target").join(codes, "node").where("dims = node_dims")
        return rows.select("target", "node", "dims", "asked", "code").mapInArrow(run, "target long, node long, d float").withColumn("seen", F.lit(False))

    nearest = Window.partitionBy("target").orderBy("d", "node")
    own = targets.where(F.col("node").isNotNull()).select("target", "node", F.lit(0.0).cast("float").alias("d"), F.lit(False).alias("seen"))
    front = shared.materialize(own.unionByName(measured(strange)), "neighbours-beam")
    while front.where(~F.col("seen")).limit(1).count():
        steps = front.where(~F.col("seen")).select("target", "node").join(roads, "node").select("target", F.explode("others").alias("node")).distinct()
        both = front.withColumn("seen", F.lit(True)).unionByName(measured(steps)).repartition("target").groupBy("target", "node").agg(F.min("d").alias("d"), F.max("seen").alias("seen"))
        front = shared.materialize(both.withColumn("rn", F.row_number().over(nearest)).where(F.col("rn") <= beam).drop("rn"), "neighbours-beam")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dims, part in _by_dims(batches):
            x, y = (part.column(c).flatten().to_numpy().reshape(-1, dims) for c in ("w", "v"))
            with np.errstate(over="ignore"):
                score = np.sqrt(((x - y) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([part.column("target"), part.column("ids"), pa.array(score)], names=["target", "ids", "score"])

    pairs = front.select("target", "node").join(targets.select("target", "dims", "w"), "target").join(nodes.select("node", "ids", "v"), "node")
    scored = pairs.select("target", "dims", "ids", "w", "v").mapInArrow(exact, "target long, ids array<long>, score double")
    rows = scored.select("target", "score", F.explode("ids").alias("vec_id"))
    top = Window.partitionBy("target").orderBy("score", "vec_id")
    rows = rows.withColumn("rn", F.row_number().over(top)).where(F.col("rn") <= best + 1).drop("rn")  # a query's own row may be one
    named = asked.join(targets.select("target", F.col("w").alias("v")), "v").select("query_id", "target")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    answers = named.distinct().join(rows, "target").where("vec_id <> query_id").withColumn("rank", F.row_number().over(order))
    return answers.where(F.col("rank") <= best).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries: DataFrame, *, best: int = BEST, beam: int = BEAM, links: int = LINKS, **building) -> DataFrame:
    """Nodes, graph (both written to the shared folder) and search in a row."""
    nodes = shared.materialize(nodes_of(vectors, best), "neighbours-nodes")
    return search(nodes, build(nodes, links=links, **building), queries, best=best, beam=beam, links=links)


def op12_neighbour_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = shared.table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


QUERIES = {"op12_neighbour_graph": op12_neighbour_graph}
ORACLE_SQL: dict[str, str] = {}
