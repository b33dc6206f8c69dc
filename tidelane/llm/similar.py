"""Near-duplicates by shingle similarity: all pairs of texts whose sets of shingles have a Jaccard index of 0.8 or more.

Fingerprints alone don't reach so far: at 0.8 two differ in about ten bits, in seventeen and more now and then, where
unrelated ones come close. So they only propose, and the sets decide. Equal sets are one node from the start. Pairs are
proposed in three ways, each time verified on the whole sets and joined to components (sketches, which bound what two
sets can share from above, save most dissimilar pairs the sets):

1. by fingerprints, equal ones and those ``simhash.links`` finds, which brings most copies together cheaply;
2. by shared prefix shingles, each node with one leader among those that share it, in LEADERS rounds;
3. by shared prefix shingles, all pairs that are not yet in one component.

A prefix is a set's first ``n - ceil(similarity * n) + 1`` shingles in an order common to all sets; two sets that are
similar enough share a shingle of their prefixes, whatever that order is, so no pair is missed. At the first one they
share, what both have left must still suffice, so pairs meet only at shingles where it does. The order has shingles
that a sample finds common last, which keeps common passages out of most prefixes. As pairs of one component are not
proposed again, a large group of near copies makes a number of pairs that grows with its size, not its square.

Defined cases: null or empty texts, and texts without a word, have the empty set and are copies of each other. Shingles
count as equal by their 64-bit hashes. Repeated rows share their fate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.llm import shared, simhash

WORDS, SIMILARITY = 5, 0.8
#: One set in SAMPLE is asked for common shingles; those in LEAST or more of them count, COMMON of them at most. They only
#: order prefixes: any order gives the same pairs.
SAMPLE, LEAST, COMMON = 16, 3, 200_000
#: Tables of nodes with a few numbers (40 bytes at most) are broadcast up to this many rows, else joined by shuffle.
BROADCAST_ROWS = 200_000
#: Rounds that only compare with leaders. They bound the work, not the result: the last round has all pairs left.
LEADERS = 2
#: Places of a sketch: how many of a set's shingles (255 at most) fall in each. A posting has only whether that is odd.
PLACES = 128
ODD = [f"odd{k}" for k in range(PLACES // 64)]
#: Meetings of two nodes that a task looks at together.
MEETINGS = 500_000
EPS = 1e-9


def least_shared(n, similarity: float):
    """How many of its ``n`` shingles a set shares at least with any set that is similar enough."""
    return np.ceil(similarity * n - EPS).astype(np.int64)


def shingle_sets(docs: DataFrame, *, words: int = WORDS, sample: int = 1) -> DataFrame:
    """row, doc_id, fingerprint ``fp``, set's hash ``node``, its ``size``, ``sketch`` and sorted 64-bit ``hashes``; the last
    for one node in ``sample`` only."""
    shared.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, sets, sizes, nodes, sketches = [], [], [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                hashes.append(np.array(simhash.shingle_hashes(text.lower(), words), np.uint64))
                distinct = np.unique(hashes[-1])
                data = distinct.tobytes()
                sketches.append(np.minimum(np.bincount((distinct >> np.uint64(17)).astype(np.int64) % PLACES, minlength=PLACES), 255).astype(np.uint8).tobytes())
                sizes.append(len(distinct))
                nodes.append(simhash.xxhash.xxh64_intdigest(data))
                sets.append(data if nodes[-1] % sample == 0 else None)
            flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
            prints = simhash.majority(flat, np.array([len(h) for h in hashes], np.int64))
            columns = [pa.array(prints.view(np.int64)), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=["row", "doc_id", "fp", "node", "size", "sketch", "hashes"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "row long, doc_id long, fp long, node long, size long, sketch binary, hashes binary")


class Sets:
    """The distinct shingle sets of a table's documents. Sets are several times as large as what is kept of them, so they
    are made anew from the texts of the documents that are asked for."""

    def __init__(self, docs: DataFrame, words: int):
        self.docs, self.words = docs, words
        self.every = shared.materialize(shingle_sets(docs, words=words, sample=SAMPLE), "sets")
        grouped = self.every.groupBy("node").agg(F.min_by(F.struct("doc_id"), "row").alias("who"), F.min("doc_id").alias("least"), F.min("fp").alias("fp"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))
        #: One row a set: a document that has it, the smallest id of those, fingerprint, size, sketch.
        self.nodes = shared.materialize(grouped.withColumn("who", F.col("who.doc_id")), "nodes")

    def sample(self) -> DataFrame:
        """Hashes of the sets in the sample; copies may be there more than once."""
        return self.every.where("hashes IS NOT NULL AND size > 0").select("hashes")

    def of(self, nodes: DataFrame | None = None) -> DataFrame:
        """node and hashes of the given nodes (of all that aren't empty without); rows may repeat where documents' ids do."""
        nodes = (self.nodes if nodes is None else self.nodes.join(_small(nodes), "node", "left_semi")).where("size > 0")
        asked = _small(shared.materialize(nodes.select("who", F.col("node").alias("asked")), "asked"))
        texts = self.docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(asked.select("who"), F.col("doc_id").eqNullSafe(F.col("who")), "left_semi")
        return shingle_sets(texts, words=self.words).select("node", "hashes").join(asked.select("asked"), F.col("node") == F.col("asked"), "left_semi")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def common_shingles(hashes: DataFrame, least: int = LEAST, most: int = COMMON) -> np.ndarray:
    """Shingles that are common in a sample's sets, from the less to the more common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int64)
            value, n = np.unique(flat, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(n)], names=["key", "n"])

    counts = hashes.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    rows = counts.orderBy(F.desc("n"), "key").limit(most).collect()
    return np.array([r.key for r in reversed(rows)], np.int64).view(np.uint64)


def shared_prefixes(sets: Sets, similarity: float = SIMILARITY) -> DataFrame:
    """key, node, size, ``rest`` (shingles from this one on) and sketch's parities of the prefix shingles that two nodes or
    more have. Only keys, nodes and rests are shuffled by key; what else a node has joins those that are left."""
    common = common_shingles(sets.sample())
    order = np.argsort(common)
    shipped = sets.docs.sparkSession.sparkContext.broadcast((common[order], order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place = shipped.value
        for batch in batches:
            keys, rest = [], []
            for data in batch.column(1).to_pylist():
                h = np.frombuffer(data, np.uint64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                    h = h[np.argsort(np.where(known[at] == h, place[at] + 1, 0), kind="stable")]
                keys.append(h[: len(h) - int(least_shared(len(h), similarity)) + 1])
                rest.append(len(h) - np.arange(len(keys[-1])))
            flat = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            nodes = np.repeat(batch.column(0).to_numpy(), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(nodes), pa.array(np.concatenate(rest) if rest else nodes)], names=["key", "node", "rest"])

    def parity(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odd = parities(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(odd[:, k]) for k in range(len(ODD)))], names=["node", "size", *ODD])

    postings = sets.of().mapInArrow(run, "key long, node long, rest long")
    met = postings.groupBy("key").agg(F.collect_set(F.struct("node", F.col("rest").cast("int").alias("rest"))).alias("members")).where(F.size("members") > 1)
    facts = sets.nodes.where("size > 0").select("node", "size", "sketch").mapInArrow(parity, f"node long, size long, {', '.join(f'{c} long' for c in ODD)}")
    facts = _small(shared.materialize(facts, "facts"))
    return shared.materialize(met.select("key", F.explode("members").alias("m")).select("key", "m.*").join(facts, "node"), "prefixes")


def parities(sketches: list[bytes]) -> np.ndarray:
    """Whether a sketch's places have odd counts, as longs. Two sets differ in at least as many shingles as in parities."""
    flat = np.frombuffer(b"".join(sketches), np.uint8).reshape(-1, PLACES)
    return np.packbits((flat & 1) * (flat < 255), axis=1).view(np.int64)


def proposed(nodes: np.ndarray, sizes: np.ndarray, rest: np.ndarray, roots: np.ndarray, odd: np.ndarray, similarity: float, leader: int, lengths: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a key's nodes with different roots, with sizes, rests and parities that allow the similarity; ``lengths``
    are the numbers of nodes of consecutive keys (one key without).

    With a ``leader`` number, each node meets only one of its key's largest component, another one for each number. With 0
    all pairs meet; members of the largest component are met by the others, so the work is bounded by the pairs left.
    """
    lengths = np.array([len(nodes)]) if lengths is None else np.asarray(lengths)
    key = np.repeat(np.arange(len(lengths)), lengths)
    begins = np.cumsum(lengths) - lengths
    part, part_key, counts = _components_by_key(key, roots)
    by_size = np.lexsort((-counts, part_key))
    largest = np.zeros(len(counts), bool)
    largest[by_size[_firsts(part_key[by_size])]] = True
    largest = largest[part]
    mixed = (nodes.view(np.uint64) ^ np.uint64(leader)) * np.uint64(0x9E3779B97F4A7C15)
    if leader:
        asking = np.flatnonzero(largest)
        asking = asking[np.lexsort((mixed[asking], key[asking]))]
        asking = asking[_firsts(key[asking])]
    else:
        asking = np.flatnonzero(~largest)
    met = lengths[key[asking]]
    for some in np.split(np.arange(len(asking)), np.flatnonzero(np.diff(np.cumsum(met) // MEETINGS)) + 1):
        n = met[some]
        i = np.repeat(asking[some], n)
        j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n - begins[key[asking[some]]], n)
        meets = part[i] != part[j]
        if not leader:
            meets &= largest[j] | (j > i)
        i, j = i[meets], j[meets]
        both = sizes[i] + sizes[j]
        fits = np.minimum(sizes[i], sizes[j]) >= similarity * np.maximum(sizes[i], sizes[j]) - EPS
        fits &= np.minimum(rest[i], rest[j]) >= similarity / (1 + similarity) * both - EPS
        fits &= np.bitwise_count((odd[i] ^ odd[j]).view(np.uint64)).sum(axis=1) <= (1 - similarity) / (1 + similarity) * both + EPS
        i, j = nodes[i[fits]], nodes[j[fits]]
        yield np.minimum(i, j), np.maximum(i, j)


def _firsts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, as a mask."""
    return np.concatenate((np.ones(min(len(values), 1), bool), values[1:] != values[:-1]))


def _components_by_key(key: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of each member's (key, root), and those pairs' keys and sizes, in order of key and root."""
    order = np.lexsort((roots, key))
    first = _firsts(key[order]) | _firsts(roots[order])
    part = np.empty(len(order), np.int64)
    part[order] = np.cumsum(first) - 1
    return part, key[order][first], np.bincount(part)


def pairs_by_prefix(prefixes: DataFrame, roots: DataFrame, similarity: float, leader: int) -> DataFrame:
    """Distinct pairs (a, b) that ``proposed`` names; ``roots`` (node, root) are the components so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = batch.column(0)
            flat = members.flatten()
            columns = [flat.field(k).to_numpy() for k in range(4 + len(ODD))]
            lengths = members.value_lengths().to_numpy()
            for a, b in proposed(*columns[:4], np.stack(columns[4:], axis=1), similarity, leader, lengths):
                pairs = np.unique(np.stack([a, b]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    named = prefixes.join(_small(roots), "node", "left").withColumn("root", F.coalesce("root", "node"))
    groups = named.groupBy("key").agg(F.collect_list(F.struct("node", "size", "rest", "root", *ODD)).alias("members"), F.min("root").alias("low"), F.max("root").alias("high"))
    return groups.where("low < high").select("members").mapInArrow(run, "a long, b long").distinct()


def _with_both(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` with the ``columns`` of both nodes, a's first."""
    first, second = (table.select(F.col("node").alias(c), *[F.col(x).alias(f"{c}_{x}") for x in columns]) for c in "ab")
    return pairs.join(first, "a").join(second, "b").select("a", "b", *[f"{c}_{x}" for c in "ab" for x in columns])


def possible(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` that their sketches don't rule out: what differs in a place can't be shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, p, m, q = (batch.column(k) for k in range(2, 6))
            x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint8).reshape(-1, PLACES).astype(np.int16) for c in (p, q))
            total = n.to_numpy() + m.to_numpy()
            most = (total - np.abs(x - y).sum(axis=1)) / 2
            yield batch.select([0, 1]).filter(pa.array(most >= similarity / (1 + similarity) * total - EPS))

    return _with_both(pairs, sets, ["size", "sketch"]).mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: Sets, similarity: float = SIMILARITY) -> DataFrame:
    """The ``pairs`` (a, b) whose sets have the similarity."""
    pairs = shared.materialize(possible(pairs, sets.nodes.where("size > 0"), similarity), "pairs")
    asked = shared.materialize(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "asked")
    found = sets.of(asked).dropDuplicates(["node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for p, q in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both) - EPS)
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return shared.materialize(_with_both(pairs, found, ["hashes"]).mapInArrow(run, "a long, b long"), "verified")


def near_duplicates(docs: DataFrame, *, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """row, doc_id, node and component_id (smallest reachable doc_id) of every row of ``docs``."""
    sets = Sets(docs, words)
    by_print = sets.nodes.groupBy("fp").agg(F.min("node").alias("head"))
    heads = by_print.select("fp", "head")
    equal = sets.nodes.join(heads, "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    # Of a fingerprint's links one is tried here; the rounds below find what that leaves apart.
    near = simhash.links(by_print).groupBy("b").agg(F.min("a").alias("a"))
    near = near.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("p")), "a").join(heads.select(F.col("fp").alias("b"), F.col("head").alias("q")), "b")
    edges = verified(equal.unionByName(near.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))), sets, similarity)
    prefixes = shared_prefixes(sets, similarity)
    for leader in (*range(1, LEADERS + 1), 0):
        roots = shared.materialize(simhash.components(edges), "roots")
        edges = edges.unionByName(verified(pairs_by_prefix(prefixes, roots, similarity, leader), sets, similarity))
    roots = simhash.components(edges)
    named = sets.nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return sets.every.select("row", "doc_id", "node").join(named.join(least, "root").select("node", "component_id"), "node").select("row", "doc_id", "node", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents whose group has one with a smaller id. Rows without an id stay: none names them."""
    found = near_duplicates(docs, **options)
    named = shared.new_column(docs, "gone_id")
    gone = shared.materialize(found.where("doc_id <> component_id").select(F.col("doc_id").alias(named)).distinct(), "gone")
    gone = _small(gone)
    return docs.join(gone, docs["doc_id"] == gone[named], "left_anti")
