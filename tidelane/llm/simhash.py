"""SimHash near-duplicates by segment popcounts and a grid range join.

A fingerprint's 64 bits are cut into 32 segments of two bits, and the bit count of each segment gives a point with 32
small coordinates. A differing bit moves one coordinate by at most one, so the Manhattan distance of two points is a
lower bound of the Hamming distance of their fingerprints. Points within Manhattan distance ``radius`` are found on a
unit grid: the coordinates are split into two halves, and in at least one of them two such points are at most
``radius // 2`` apart. Each point is filed in its own cell of either half and, when that half's sum is odd, also asks
all cells one step away: cells one step apart differ in parity, so each such pair meets exactly once. Pairs that meet
must then pass the Manhattan bound over all coordinates, and the exact Hamming distance.

Equal fingerprints are one point from the start, so groups of copies make no pairs. The links' connected components are
found by alternating star contractions, with written intermediates between the rounds.

Defined cases: null or empty texts, and texts without a word, have the fingerprint zero and link like any other.
Repeated rows are each returned. A null doc_id never names a component unless all ids in it are null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm import shared

WORDS, SEED, RADIUS = 3, 42, 3
SPLIT = re.compile(rb"[\x20\x09-\x0d]+")
SEGMENTS, SEGMENT_BITS = 32, 2
LANE = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, words: int = WORDS, seed: int = SEED) -> list[int]:
    """XXH64 of every run of ``words`` words, joined by spaces; of the whole sequence where there are fewer."""
    found = text.split()  # of bytes: splits at exactly the six ASCII white-space characters
    if not found:
        return []
    joined = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    n = len(found) - words + 1
    if n <= 1:
        return [digest(joined, seed)]
    sizes = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[:n].tolist()
    return [digest(joined[a:b], seed) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist(), strict=True)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints of consecutive runs of hashes: a bit is set if it is in over half of the run's.

    Eight bits of each hash are counted at once, a byte lane each, over stretches of at most 255 hashes.
    """
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    stretches = -(-n // 255)
    owner = np.repeat(np.arange(len(full)), stretches)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(stretches) - stretches, stretches)
    cuts = starts[owner] + 255 * within
    first = np.cumsum(stretches) - stretches
    bits = np.zeros(len(full), np.uint64)
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & LANE, cuts)
        for byte in range(8):
            total = np.add.reduceat(((lanes >> np.uint64(8 * byte)) & np.uint64(255)).astype(np.int64), first)
            bits |= (2 * total > n).astype(np.uint64) << np.uint64(8 * byte + shift)
    out[full] = bits
    return out


def fingerprints(docs: DataFrame, *, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id and 64-bit fingerprint ``fp`` (as a signed long) of every row of ``docs`` (doc_id, text)."""
    shared.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, counts = [], []
            for text in batch.column(1).cast(pa.binary()).to_pylist():
                found = shingle_hashes(text.lower(), words, seed)  # bytes.lower() changes A-Z alone
                hashes.append(np.array(found, np.uint64))
                counts.append(len(found))
            flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            prints = majority(flat, np.array(counts, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def popcounts(fp) -> F.Column:
    """The 32 segment bit counts, two bits each in one long (each is 0, 1 or 2)."""
    low = fp.bitwiseAND(F.lit(0x5555555555555555))
    high = F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(0x5555555555555555))
    return low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))  # 1 + 1 = 2 is written 10


def manhattan(p, q) -> F.Column:
    """Distance of two packed points. Coordinates are 0, 1, 2, written 00, 01, 10, and go to 00, 01, 11 (unary); their
    XOR has as many bits as the coordinates differ by."""
    unary = lambda x: x.bitwiseOR(F.shiftrightunsigned(x.bitwiseAND(F.lit(-0x5555555555555556)), 1))
    return F.bit_count(unary(p).bitwiseXOR(unary(q)))


def _halves(point) -> list[F.Column]:
    return [point.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(point, 32)]


def _neighbours(cell) -> F.Column:
    """The cells one step away along one coordinate."""
    steps = []
    for k in range(SEGMENTS // 2):
        one, at = 1 << (SEGMENT_BITS * k), F.shiftrightunsigned(cell, SEGMENT_BITS * k).bitwiseAND(F.lit(3))
        steps += [F.when(at > 0, cell - F.lit(one)), F.when(at < 2, cell + F.lit(one))]
    return F.array_compact(F.array(*steps))


def _odd(cell) -> F.Column:
    """Whether a half's coordinates have an odd sum: its ones are what counts."""
    return F.bit_count(cell.bitwiseAND(F.lit(0x55555555))) % 2 == 1


def links(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints at ``radius`` (3 at most) or fewer differing bits, each once or twice."""
    if not 0 <= radius <= 3:
        raise ValueError("the grid's two halves serve radii up to 3")
    p = points.select("fp").withColumn("point", popcounts(F.col("fp")))
    cells = F.array(*[F.struct(F.lit(k).alias("half"), h.alias("cell")) for k, h in enumerate(_halves(F.col("point")))])
    own = p.select("fp", "point", F.inline(cells))
    filed = own.select("half", "cell", F.col("fp").alias("a"))
    asking = F.when(_odd(F.col("cell")), F.concat(F.array("cell"), _neighbours(F.col("cell")))).otherwise(F.array("cell"))
    asked = own.select("half", F.col("fp").alias("b"), (F.col("cell")).alias("own"), F.explode(asking).alias("cell"))
    met = filed.join(asked, ["half", "cell"]).where((F.col("own") != F.col("cell")) | (F.col("a") < F.col("b")))
    near = met.where(manhattan(popcounts(F.col("a")), popcounts(F.col("b"))) <= radius)
    near = near.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); root is the component's smallest node.

    Alternates large-star and small-star contractions, each a minimum by key joined back, until nothing changes; every
    round's edges are written to the shared folder.
    """
    edges = shared.materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    before = None
    while True:  # the number of rounds grows with the logarithm of the nodes
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = shared.materialize(small.where("u <> v").distinct(), "stars")
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, *, radius: int = RADIUS, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, fp and component_id (smallest reachable doc_id) of every row of ``docs``."""
    prints = shared.materialize(fingerprints(docs, words=words, seed=seed), "prints")
    distinct = shared.materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    found = components(links(distinct, radius))
    named = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = named.join(least, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


#: The table of dropped ids is broadcast up to this many rows (8 bytes each), else joined by shuffle.
BROADCAST_ROWS = 200_000


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents whose group has one with a smaller id. Rows without an id stay: none names them."""
    found = near_duplicates(docs, **options)
    named = shared.new_column(docs, "gone_id")
    gone = shared.materialize(found.where("doc_id <> component_id").select(F.col("doc_id").alias(named)).distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone
    return docs.join(gone, docs["doc_id"] == gone[named], "left_anti")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(shared.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op2_simhash": op2_simhash}
ORACLE_SQL: dict[str, str] = {}
