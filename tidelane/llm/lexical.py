"""Ranked lexical search with a length-stratified index, exact to the last integer.

``build`` turns documents into index pieces where they lie, without a shuffle: a task reads its documents and closes a
piece whenever ``PIECE_BYTES`` of text have been read (one longer text is a piece of its own). In a piece documents are
grouped by equal normaliser m (strata); a term's postings are sorted by stratum, then tf, and point at the distinct
(stratum, tf) pairs, so that an impact is computed once for each pair and not for each posting.

``search`` brings blocks of items to the pieces. For an item, a stratum's bound is the sum over the item's terms of weight
times the impact of the term's largest tf in that stratum. Strata are visited by falling bound, and the visit stops once
the next bound is below the lowest of the item's best scores so far (an equal one could still hold a smaller id). A task
carries these lowest scores on to its later pieces. Each meeting returns at most ``best`` rows an item.

The blocks' bytes are measured: up to ``BROADCAST_BYTES`` they are broadcast, beyond that blocks are copied to slots and
joined with the pieces by slot.

Defined cases: rows without doc_id (or item_id) take no part. A null text, or one without terms, has no rank and counts
for nothing. Repeated rows of a doc_id are documents of their own; repeated rows of an item_id are one item with the terms
of all. An item without terms found anywhere returns no rows; empty tables return none. Other columns aren't read. Long
texts are read whole.
"""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelane.llm import shared

BEST = 50
#: Bytes of text after which a piece of the index is closed, items in a block, bytes of blocks that are broadcast at most.
PIECE_BYTES, BLOCK_ITEMS, BROADCAST_BYTES = 8_000_000, 256, 8_000_000

#: What a byte becomes before texts are split at spaces: A-Z small, other letters, digits and all beyond ASCII as they are.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))

INDEX = "vocabulary binary, held binary, starts binary, doc binary, pair binary, pair_stratum binary, pair_tf binary, norms binary, stratum_of binary, docs binary"
FIELDS = [x.split()[0] for x in INDEX.split(", ")]
SCORED = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


def _texts(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.col(key).isNotNull() & F.col("text").isNotNull()).select(F.col(key).cast("long").alias("id"), F.col("text").cast("binary").alias("text"))


def totals(documents: DataFrame) -> tuple[int, int]:
    """N, the documents with a term, and L, all their terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = length = 0
        for _, text in shared.rows_of(batches):
            terms = len(terms_of(text))
            n, length = n + (terms > 0), length + terms
        yield pa.RecordBatch.from_pydict({"n": [n], "length": [length]})

    shared.prepare(documents.sparkSession)
    row = _texts(documents, "doc_id").mapInArrow(run, "n long, length long").agg(F.sum("n"), F.sum("length")).first()
    return int(row[0] or 0), int(row[1] or 0)


class Builder:
    """Collects documents' counts as plain integers; ``row`` gives the piece as one row of INDEX."""

    def __init__(self) -> None:
        self.number: dict[bytes, int] = {}
        self.term, self.tf, self.docs, self.lengths, self.widths, self.bytes = array("i"), array("q"), array("q"), array("q"), array("q"), 0

    def add(self, doc_id: int, counts: Counter, size: int = 0) -> None:
        number = self.number
        self.term.extend([number.setdefault(t, len(number)) for t in counts])
        self.tf.extend(counts.values())
        self.docs.append(doc_id)
        self.lengths.append(counts.total())
        self.widths.append(len(counts))
        self.bytes += size

    def row(self, n: int, length: int) -> tuple[bytes, ...]:
        norms, stratum_of = np.unique(np.array([50 + 50 * x * n // length for x in self.lengths], np.int64), return_inverse=True)
        term, tf = np.frombuffer(self.term, np.int32), np.frombuffer(self.tf, np.int64)
        doc = np.repeat(np.arange(len(self.docs)), np.frombuffer(self.widths, np.int64))
        pairs, pair = np.unique(np.stack([stratum_of[doc], tf], axis=1), axis=0, return_inverse=True)
        pair = pair.reshape(-1)
        order = np.lexsort((pair, term))
        held = np.bincount(term, minlength=len(self.number))
        small = lambda x: x.astype("<i4").tobytes()
        starts = np.concatenate([[0], np.cumsum(held)]).astype("<i8").tobytes()
        return (b" ".join(self.number), small(held), starts, small(doc[order]), small(pair[order]), small(pairs[:, 0]), pairs[:, 1].astype("<i8").tobytes(), norms.astype("<i8").tobytes(), small(stratum_of), np.frombuffer(self.docs, np.int64).astype("<i8").tobytes())


def build(documents: DataFrame, n: int, length: int, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The index pieces of ``documents`` (doc_id, text), for the totals ``n`` and ``length`` of the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(f, pa.binary()) for f in FIELDS])
        row = lambda: pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in made.row(n, length)], schema=schema)
        made = Builder()
        for doc_id, text in shared.rows_of(batches):
            if made.docs and made.bytes + len(text) > piece_bytes:
                yield row()
                made = Builder()
            if counts := Counter(terms_of(text)):
                made.add(doc_id, counts, len(text))
        if made.docs:
            yield row()

    shared.prepare(documents.sparkSession)
    return _texts(documents, "doc_id").mapInArrow(run, INDEX)


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and its distinct terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, t) for i, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for t in set(terms_of(text))]
            yield pa.RecordBatch.from_pydict({"item_id": pa.array([r[0] for r in rows], pa.int64()), "term": pa.array([r[1] for r in rows], pa.binary())})

    return _texts(items, "item_id").mapInArrow(run, "item_id long, term binary").distinct()


def meet(index: DataFrame, blocks: DataFrame, pieces: int, small: bool) -> DataFrame:
    """Each index piece beside each block: through a broadcast, or by slots that blocks are copied to."""
    slots = 1 if small else max(1, pieces)
    copies = blocks.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    return index.withColumn("slot", F.pmod(F.xxhash64("held"), F.lit(slots)).cast("int")).join(F.broadcast(copies) if small else copies, "slot").drop("slot")


class Piece:
    """An index piece as arrays."""

    def __init__(self, row: dict[str, bytes]):
        self.number = {t: i for i, t in enumerate(row["vocabulary"].split(b" "))}
        for name, kind in (("starts", "<i8"), ("doc", "<i4"), ("pair", "<i4"), ("pair_stratum", "<i4"), ("pair_tf", "<i8"), ("norms", "<i8"), ("stratum_of", "<i4"), ("docs", "<i8")):
            setattr(self, name, np.frombuffer(row[name], kind).astype(np.int64))
        #: Once for each tf of a stratum.
        self.impact = (1_000_000_000 * self.pair_tf) // (1000 * self.pair_tf + 20 * self.norms[self.pair_stratum])
        self.size = np.bincount(self.stratum_of, minlength=len(self.norms))

    def best_impacts(self, term: int) -> np.ndarray:
        """The impact of the term's largest tf in each stratum; zero where it doesn't occur."""
        pairs = self.pair[self.starts[term] : self.starts[term + 1]]
        out = np.zeros(len(self.norms), np.int64)
        out[self.pair_stratum[pairs]] = self.impact[pairs]  # sorted by stratum and tf: the last one written is the largest
        return out

    def ranked(self, terms: list[tuple[int, int]], floor: int, best: int, bounds: dict[int, np.ndarray]) -> list[tuple[int, int]]:
        """(score, doc_id) of the ``best`` documents for (term number, weight) that score ``floor`` or more, best first."""
        bound = np.zeros(len(self.norms), np.int64)
        for t, w in terms:
            if t not in bounds:
                bounds[t] = self.best_impacts(t)
            bound += w * bounds[t]
        order = np.lexsort((np.arange(len(bound)), -bound))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        spans = [slice(self.starts[t], self.starts[t + 1]) for t, _ in terms]
        doc = np.concatenate([self.doc[s] for s in spans])
        gain = np.concatenate([w * self.impact[self.pair[s]] for s, (_, w) in zip(spans, terms, strict=True)])
        at = rank[self.stratum_of[doc]]
        exact_in_doubles = sum(w for _, w in terms) * 1_000_000 < 2**53  # no impact is over 1,000,000
        found: list[tuple[int, int]] = []
        start = 0
        width = int(np.searchsorted(np.cumsum(self.size[order]), best)) + 1
        while start < len(order) and bound[order[start]] >= max(floor, 1):
            end = min(len(order), start + width)
            pick = (at >= start) & (at < end)
            if exact_in_doubles:
                score = np.bincount(doc[pick], gain[pick], len(self.docs)).astype(np.int64)
            else:
                score = np.zeros(len(self.docs), np.int64)
                np.add.at(score, doc[pick], gain[pick])
            some = np.flatnonzero(score >= max(floor, 1))
            if len(some) > best:
                some = some[score[some] >= np.partition(score[some], len(some) - best)[len(some) - best]]
            found = sorted([*found, *zip(score[some].tolist(), self.docs[some].tolist(), strict=True)], key=lambda x: (-x[0], x[1]))[:best]
            if len(found) == best:
                floor = max(floor, found[-1][0])
            start, width = end, 2 * width
        return found


def search(index: DataFrame, items: DataFrame, n: int, *, best: int = BEST, block_items: int = BLOCK_ITEMS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``best`` documents in a written index of ``n`` documents."""
    spark = index.sparkSession
    terms = shared.materialize(item_terms(items), "item-terms")
    pieces = index.count()
    count, size = terms.agg(F.count_distinct("item_id"), F.coalesce(F.sum(F.octet_length("term") + F.lit(24)), F.lit(0))).first()
    blocks, small = max(1, -(-count // block_items)), size <= broadcast_bytes
    block = F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int").alias("block")

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, number = None, {}
        for vocabulary, counts, wanted in shared.rows_of(batches):
            if kept != vocabulary:
                kept, number = vocabulary, {t: i for i, t in enumerate(vocabulary.split(b" "))}
            df = np.frombuffer(counts, "<i4")
            rows = [(t, int(df[number[t]])) for t in wanted if t in number]
            yield pa.RecordBatch.from_pydict({"term": pa.array([r[0] for r in rows], pa.binary()), "df": pa.array([r[1] for r in rows], pa.int64())})

    words = F.pmod(F.xxhash64("term"), F.lit(blocks)).cast("int").alias("block")
    asked = terms.select("term").distinct().groupBy(words).agg(F.collect_list("term").alias("wanted")).drop("block")
    df = meet(index, asked, pieces, small).select("vocabulary", "held", "wanted").mapInArrow(held, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n + 2.0) / (2 * F.col("df") + 1))).alias("weight")
    weighted = shared.materialize(terms.join(df, "term").select("item_id", "term", weight), "item-weights")
    blocked = weighted.groupBy(block).agg(F.collect_list(F.struct("item_id", "term", "weight")).alias("wanted")).drop("block")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floors: dict[int, int] = {}
        for *fields, wanted in shared.rows_of(batches):
            part, bounds, rows = Piece(dict(zip(FIELDS, fields, strict=True))), {}, []
            asked_for: dict[int, list[tuple[int, int]]] = {}
            for x in wanted:
                if (t := part.number.get(x["term"])) is not None and x["weight"] > 0:
                    asked_for.setdefault(x["item_id"], []).append((t, x["weight"]))
            for item, pairs in asked_for.items():
                found = part.ranked(pairs, floors.get(item, 1), best, bounds)
                if len(found) == best:
                    floors[item] = max(floors.get(item, 1), found[-1][0])
                rows += [(item, d, s) for s, d in found]
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], schema=SCORED)

    shared.prepare(spark)
    near = meet(index, blocked, pieces, small).select(*FIELDS, "wanted").mapInArrow(score, "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best).select("item_id", "rank", "doc_id", "score")


def top_documents(documents: DataFrame, items: DataFrame, *, best: int = BEST, piece_bytes: int = PIECE_BYTES, block_items: int = BLOCK_ITEMS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Totals, index (written to the shared folder) and search in a row."""
    n, length = totals(documents)
    index = shared.materialize(build(documents, n, max(1, length), piece_bytes), "lexical-index")
    return search(index, items, n, best=best, block_items=block_items, broadcast_bytes=broadcast_bytes)


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_documents(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))


QUERIES = {"op13_lexical_search": op13_lexical_search}
ORACLE_SQL = {
    "op13_lexical_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), c AS (SELECT count(*) AS n, CAST(sum(len(t)) AS BIGINT) AS l FROM d WHERE len(t) > 0
), tf AS (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d
), p AS (SELECT r, doc_id, term, any_value(n) AS n, count(*) AS tf FROM tf WHERE term IN (SELECT term FROM i) GROUP BY ALL
), w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(c.n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term
), s AS (
  SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * p.n * c.n) // c.l)))) AS BIGINT) AS score
  FROM i JOIN p USING (term) JOIN w USING (term), c GROUP BY item_id, r, doc_id
), k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 50
"""
}
