"""Repeated windows across documents: what the byte-wise and the word-wise substring deduplication share.

A window is ``width`` consecutive units (bytes or words) of one document. A window is removed if the same sequence also
starts in a document with a smaller doc_id. Equal windows are brought together without shipping every window:

1. Documents are dealt into chunks of a bounded number of rows and bytes on average. In each window the smallest hash of
   its ``gram``-unit runs is the window's anchor: equal windows have equal anchors. Neighbouring windows mostly share
   theirs, so a chunk has far fewer anchors than units. It sends its distinct anchors, packed, to buckets of the hash range.
2. A bucket answers each chunk by bits: which anchors occur in another document or chunk, and which are hot, being in
   very many chunks.
3. A chunk ships the stretches of text whose windows have a shared anchor, identical ones once with their smallest
   doc_id, to the bucket of their anchor. Windows of hot anchors go singly, each to the bucket of its own prefix, so that
   what follows a common run of units spreads over the buckets.
4. A bucket takes its groups a bounded number of units at a time, sorts the suffixes (``order``: the operator's method),
   finds each window's smallest doc_id, and answers each chunk by a bit per window.
5. The chunk removes the units that its removed windows cover.

Hashes only route and propose. Whether two stretches are identical is decided by comparing all their units, and whether
two windows are equal by the operator's method, on bytes or on codes that stand for whole words of one bucket.

Texts are shuffled once; the three steps that read them reuse that exchange, which is why they make up one plan. Nothing
is gathered for a whole group of copies: a chunk sends a sequence once however many of its documents have it, and a
bucket's share is a hash range's. Chunks are dealt by row number, so rows that repeat each other spread like any others.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelane.llm import bpe, shared
from tidelane.llm.shared import give_back

#: Texts and bytes of text in a chunk, on average at most.
CHUNK_ROWS, CHUNK_BYTES = 512, 2_000_000
CHUNKS_A_PARTITION, MOST_PARTITIONS = 8, 20_000
LEAST_BUCKETS = 24
#: Documents (or as many times their usual size in bytes) for which there is a bucket; chunks from which on an anchor is hot.
BUCKET_ROWS, USUAL_BYTES = 4000, 4000
HOT_CHUNKS = 500
#: Units that a bucket sorts at once (whole groups; one that has more is sorted by itself), and windows hashed at once.
SORT_UNITS, BLOCK = 400_000, 1 << 19
NOBODY = np.iinfo(np.int64).max
ODD, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(29))) * MIX
    return x ^ (x >> np.uint64(32))


@dataclass(frozen=True)
class Method:
    """Units of the texts, and how equal windows are found among stretches."""

    words: bool
    width: int
    gram: int
    #: order(units, begin, windows, width): for stretches of units a number per window, equal where windows are equal.
    order: Callable[[np.ndarray, np.ndarray, np.ndarray, int], np.ndarray]


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers starts[i], starts[i] + 1, ..., counts[i] of them, for all i in order."""
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def word_codes(data: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Codes of words that are each followed by one space, equal for equal words only; where they begin (and the end of
    the last); the words by code, with their space."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32).astype(np.int32) + np.int32(1)
    starts = np.concatenate([np.zeros(1, np.int32), ends])
    words = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(starts), pa.py_buffer(data)]).dictionary_encode()
    return words.indices.to_numpy(), starts.astype(np.int64), words.dictionary.to_pylist()


def differ(units: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, size: int = 1 << 20) -> np.ndarray:
    """Whether the ranges of ``n`` units that begin at ``a`` and at ``b`` differ, some units at a time."""
    out, total, at = np.zeros(len(n), bool), np.cumsum(n), 0
    while at < len(n):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + size, side="right")))
        m = n[at:stop]
        bad = units[spread(a[at:stop], m)] != units[spread(b[at:stop], m)]
        out[at:stop] = np.logical_or.reduceat(bad, np.cumsum(m) - m)
        at = stop
    return out


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it in any column; the first row always does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


class Chunk:
    """A chunk's texts as one sequence of units, their windows' anchors and stretches."""

    def __init__(self, method: Method, ids: list, texts: list[bytes]):
        self.method = method
        self.ids = np.array([NOBODY if i is None else i for i in ids], np.int64)
        self.texts = [b" ".join(t.split()) for t in texts] if method.words else texts
        if method.words:
            self.data = b" ".join([t for t in self.texts if t] + [b""])
            self.units, self.word_start, words = word_codes(self.data)
            self.hash_of = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
            self.counts = np.fromiter((t.count(b" ") + 1 if t else 0 for t in self.texts), np.int64, len(texts))
        else:
            self.data = b"".join(texts)
            self.units = np.frombuffer(self.data, np.uint8)
            self.hash_of = np.arange(1, 257, dtype=np.uint64)
            self.counts = np.fromiter(map(len, texts), np.int64, len(texts))
        self.ends = np.cumsum(self.counts)
        self._find_runs()

    def _grams(self, start: int, stop: int) -> np.ndarray:
        """Hashes of the runs of ``gram`` units that lie in units[start:stop]."""
        h, size, power = self.hash_of[self.units[start:stop]], 1, ODD
        while size < self.method.gram:  # gram is a power of two
            h = h[:-size] * power + h[size:]
            size, power = size * 2, np.uint64(int(power) ** 2 % (1 << 64))
        return mix(h)

    def _find_runs(self) -> None:
        """Runs of neighbouring windows of one text with the same anchor (and in the same block)."""
        width, gram = self.method.width, self.method.gram
        n, span = len(self.units) - width + 1, width - gram + 1
        text = np.repeat(np.arange(len(self.counts), dtype=np.int32), self.counts)
        found: list[list[np.ndarray]] = [[] for _ in range(4)]
        for a in range(0, n, BLOCK):
            b = min(n, a + BLOCK)
            low, size = self._grams(a, b + width - 1), 1
            while size * 2 <= span:
                low = np.minimum(low[:-size], low[size:])
                size *= 2
            if size < span:
                low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
            at = np.flatnonzero(text[a:b] == text[a + width - 1 : b + width - 1])  # else it would cross texts
            value, owner = low[at], text[a + at]
            cut = np.flatnonzero(changes(value, owner))
            # Smallest hashes crowd near 0; mixed again, one to one, they spread evenly over the buckets.
            for column, x in zip(found, (mix(value[cut] ^ ODD), a + at[cut], owner[cut], np.diff(np.append(cut, len(at)))), strict=True):
                column.append(x)
        kinds = (np.uint64, np.int64, np.int64, np.int64)
        self.anchor, self.start, self.owner, self.run = (np.concatenate([np.zeros(0, k), *c]).astype(k) for c, k in zip(found, kinds, strict=True))

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors in order, and whether several documents of the chunk have it."""
        order = np.lexsort((self.ids[self.owner], self.anchor))
        a, d = self.anchor[order], self.ids[self.owner][order]
        firsts = np.flatnonzero(changes(a))
        other = changes(a, d) & ~changes(a)
        return a[firsts], np.add.reduceat(other, firsts) > 0 if len(firsts) else np.zeros(0, bool)

    def stretches(self, flags: np.ndarray, buckets: int) -> dict[str, np.ndarray]:
        """Stretches with shared anchors; ``rep`` numbers the distinct ones, which are in order of (bucket, group)."""
        distinct, _ = self.anchors()
        flag = flags[np.searchsorted(distinct, self.anchor)] if len(distinct) else np.zeros(0, np.uint8)
        warm, hot = flag == 1, flag == 2
        n = self.run[hot]
        single = spread(self.start[hot], n)
        start = np.concatenate([self.start[warm], single])
        run = np.concatenate([self.run[warm], np.ones(len(single), np.int64)])
        owner = np.concatenate([self.owner[warm], np.repeat(self.owner[hot], n)])
        width, gram = self.method.width, self.method.gram
        sums = np.zeros(max(1, len(self.units) - gram + 2), np.uint64)
        for a in range(0, len(self.units) - gram + 1, BLOCK):
            b = min(len(self.units) - gram + 1, a + BLOCK)
            sums[a + 1 : b + 1] = sums[a] + np.cumsum(self._grams(a, b + gram - 1), dtype=np.uint64)
        key = sums[start + run + width - gram] - sums[start]  # proposes identical stretches
        prefix = mix(sums[single + gram + 1] - sums[single] + ODD)  # of twice as many units as an anchor has
        group = np.concatenate([self.anchor[warm], prefix])
        bucket, doc = bucket_of(group, buckets), self.ids[owner]
        order = np.lexsort((start, doc, run, key, group))
        bucket, group, key, run, doc, start, owner = (x[order] for x in (bucket, group, key, run, doc, start, owner))
        new = changes(group, key, run)
        copies = np.flatnonzero(~new)
        new[copies] = differ(self.units, start[copies - 1], start[copies], run[copies] + width - 1)
        return {"bucket": bucket, "group": group, "run": run, "doc": doc, "start": start, "owner": owner, "rep": np.cumsum(new) - 1, "first": np.flatnonzero(new)}

    def content(self, start: np.ndarray, run: np.ndarray) -> bytes:
        """The bytes of stretches, one after the other. Words have a space behind them."""
        end = start + run + self.method.width - 1
        a, b = (self.word_start[start], self.word_start[end]) if self.method.words else (start, end)
        return b"".join([self.data[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)])

    def covered(self, s: dict[str, np.ndarray], bits: np.ndarray) -> np.ndarray:
        """Which units removed windows cover, given a bit per window of each distinct stretch."""
        runs = s["run"][s["first"]]
        offset = np.cumsum(runs) - runs
        removed = bits[spread(offset[s["rep"]], s["run"])] | np.repeat(s["doc"] > s["doc"][s["first"]][s["rep"]], s["run"])
        at = spread(s["start"], s["run"])[removed]
        n = len(self.units) + 1
        return np.cumsum(np.bincount(at, minlength=n) - np.bincount(at + self.method.width, minlength=n))[:-1] > 0


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of the hash, in order."""
    return (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Each bucket of a sorted column, with the range of its rows."""
    cuts = [*np.flatnonzero(changes(bucket)).tolist(), len(bucket)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield int(bucket[a]), a, b


def _smallest(method: Method, group: np.ndarray, doc: np.ndarray, run: np.ndarray, units: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The smallest doc_id of each window's sequence, for all windows of these stretches in order.

    Identical stretches of a group, compared unit by unit, stand for one; the method orders the windows of all others.
    """
    lengths = run + method.width - 1
    units = units[spread(begin, lengths)]
    begin = np.cumsum(lengths) - lengths
    weight = mix(np.arange(1, int(lengths.max()) + 1, dtype=np.uint64))
    key = np.add.reduceat((units.astype(np.uint64) + np.uint64(1)) * weight[spread(np.zeros_like(begin), lengths)], begin)
    order = np.lexsort((doc, run, key, group))
    new = changes(group[order], key[order], run[order])
    copies = np.flatnonzero(~new)
    new[copies] = differ(units, begin[order[copies - 1]], begin[order[copies]], lengths[order[copies]])
    reps = order[np.flatnonzero(new)]  # with the smallest id, being the first
    leaf = np.empty(len(order), np.int64)
    leaf[order] = np.cumsum(new) - 1
    size, runs = lengths[reps], run[reps]
    names = method.order(units[spread(begin[reps], size)], np.cumsum(size) - size, runs, method.width)
    lowest = np.full(int(names.max()) + 1, NOBODY)
    np.minimum.at(lowest, names, np.repeat(doc[reps], runs))
    return lowest[names][spread((np.cumsum(runs) - runs)[leaf], run)]


def removed_windows(method: Method, group: np.ndarray, doc: np.ndarray, run: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Whether a smaller id has a window's sequence, for all windows of a bucket's stretches, which lie end to end."""
    lengths = run + method.width - 1
    begin, first = np.cumsum(lengths) - lengths, np.cumsum(run) - run
    out = np.zeros(int(run.sum()), bool)
    order = np.argsort(group, kind="stable")
    total, heads, at = np.cumsum(lengths[order]), np.append(np.flatnonzero(changes(group[order])), len(order)), 0
    while at < len(order):
        stop = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SORT_UNITS, side="right")))
        # Groups stay whole: back to the last border, or on to the next one where a single group is larger.
        border = heads[np.searchsorted(heads, stop, side="right") - 1]
        stop = int(border if border > at else heads[np.searchsorted(heads, stop)])
        part = order[at:stop]
        least = _smallest(method, group[part], doc[part], run[part], units, begin[part])
        out[spread(first[part], run[part])] = least < np.repeat(doc[part], run[part])
        at = stop
    return out


def _layout(docs: DataFrame) -> tuple[int, int, int]:
    """Chunks, partitions and buckets for a table, by its rows and the bytes of its texts."""
    n, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    chunks = max(1, -(-n // CHUNK_ROWS), -(-size // CHUNK_BYTES))
    return chunks, max(1, min(MOST_PARTITIONS, chunks // CHUNKS_A_PARTITION)), max(LEAST_BUCKETS, n // BUCKET_ROWS, size // (BUCKET_ROWS * USUAL_BYTES))


def deduplicate(docs: DataFrame, method: Method, finish: Callable, schema, *, hot_chunks: int = HOT_CHUNKS, layout: tuple[int, int, int] | None = None) -> DataFrame:
    """Apply ``finish(chunk, covered, table)``, which gives an Arrow table of ``schema``, to every chunk of ``docs``.

    ``docs`` needs doc_id and text (no nulls in text); other columns reach ``finish`` in the table.
    """
    shared.prepare(docs.sparkSession)
    chunks, partitions, buckets = layout or _layout(docs)
    where = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks))
    texts = docs.withColumn("chunk", where).repartition(partitions, "chunk")

    def opened(table: pa.Table) -> Chunk:
        bpe.unload()  # of a packing before, in the same worker
        return Chunk(method, table["doc_id"].to_pylist(), table["text"].cast(pa.large_binary()).to_pylist())

    def send_anchors(key, table):
        anchors, several = opened(table).anchors()
        rows = [(b, anchors[x:y].tobytes(), np.packbits(several[x:y]).tobytes()) for b, x, y in by_bucket(bucket_of(anchors, buckets))] if len(anchors) else []
        give_back()
        b, a, s = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({"bucket": pa.array(b, pa.int64()), "chunk": pa.array([key[0].as_py()] * len(b), pa.int64()), "anchors": pa.array(a, pa.binary()), "several": pa.array(s, pa.binary())})

    def answer_anchors(key, table):
        bpe.unload()
        blobs = [np.frombuffer(x, np.uint64) for x in table["anchors"].to_pylist()]
        own = [np.unpackbits(np.frombuffer(s, np.uint8), count=len(b)) for s, b in zip(table["several"].to_pylist(), blobs, strict=True)]
        everything = np.sort(np.concatenate(blobs))
        first = np.flatnonzero(changes(everything))
        count = np.diff(np.append(first, len(everything)))
        often, times = everything[first][count > 1], count[count > 1]
        del everything
        flags = []
        for blob, several in zip(blobs, own, strict=True):
            if len(often):
                at = np.minimum(np.searchsorted(often, blob), len(often) - 1)
                several = np.where(often[at] == blob, np.where(times[at] > hot_chunks, 2, 1), several)
            flags.append(several.astype(np.uint8).tobytes())
        give_back()
        return pa.table({"chunk": table["chunk"], "bucket": pa.array([key[0].as_py()] * len(flags), pa.int64()), "flags": pa.array([_pack2(f) for f in flags], pa.binary())})

    def shared_of(chunk: Chunk, answers: pa.Table) -> dict[str, np.ndarray]:
        anchors, _ = chunk.anchors()
        got = dict(zip(answers["bucket"].to_pylist(), answers["flags"].to_pylist(), strict=True))
        flags = [_unpack2(got[b], y - x) for b, x, y in by_bucket(bucket_of(anchors, buckets))] if len(anchors) else []
        return chunk.stretches(np.concatenate(flags) if flags else np.zeros(0, np.uint8), buckets)

    def send_stretches(key, table, answers):
        columns: list[list] = [[] for _ in range(5)]
        if table.num_rows and answers.num_rows:
            chunk = opened(table)
            s = shared_of(chunk, answers)
            f = s["first"]
            for b, x, y in by_bucket(s["bucket"][f]) if len(f) else ():
                part = f[x:y]
                data = chunk.content(s["start"][part], s["run"][part])
                row = (b, s["group"][part].tobytes(), s["doc"][part].tobytes(), s["run"][part].astype(np.int32).tobytes(), zlib.compress(data, 1))
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            del chunk, s
        names, types = ("bucket", "groups", "docs", "runs", "data"), (pa.int64(), *[pa.binary()] * 4)
        arrays = {k: pa.array(c, t) for k, c, t in zip(names, columns, types, strict=True)}
        del columns
        give_back()
        return pa.table({"chunk": pa.array([key[0].as_py()] * len(arrays["bucket"]), pa.int64()), **arrays})

    def answer_stretches(key, table):
        bpe.unload()
        read = lambda name, kind: [np.frombuffer(x, kind) for x in table[name].to_pylist()]
        groups, docs_, runs = read("groups", np.uint64), read("docs", np.int64), read("runs", np.int32)
        group, doc, run = np.concatenate(groups), np.concatenate(docs_), np.concatenate(runs).astype(np.int64)
        data = bytearray()
        for x in table["data"]:
            data += zlib.decompress(x.as_buffer())
        units = word_codes(data)[0] if method.words else np.frombuffer(data, np.uint8)
        removed = removed_windows(method, group, doc, run, units)
        cuts = np.cumsum([0, *(int(r.sum()) for r in runs)])
        bits = [np.packbits(removed[a:b]).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
        del units, data, removed
        give_back()
        return pa.table({"chunk": table["chunk"], "answer": pa.array([key[0].as_py()] * len(bits), pa.int64()), "bits": pa.array(bits, pa.binary())})

    def conclude(key, table, answers):
        if not table.num_rows:
            return finish(None, np.zeros(0, bool), table)
        chunk = opened(table)
        flags = answers.filter(answers["bucket"].is_valid()) if answers.num_rows else answers
        covered = np.zeros(len(chunk.units), bool)
        if flags.num_rows:
            s = shared_of(chunk, flags)
            windows = answers.filter(answers["answer"].is_valid())
            got = dict(zip(windows["answer"].to_pylist(), windows["bits"].to_pylist(), strict=True))
            f = s["first"]
            runs = s["run"][f]
            bits = [np.unpackbits(np.frombuffer(got[b], np.uint8), count=int(runs[x:y].sum())) for b, x, y in by_bucket(s["bucket"][f])] if len(f) else []
            covered = chunk.covered(s, np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool))
            del s, bits, got
        out = finish(chunk, covered, table)
        del chunk, covered
        give_back()
        return out

    by_chunk = texts.groupBy("chunk")
    sent = by_chunk.applyInArrow(send_anchors, "bucket long, chunk long, anchors binary, several binary")
    flags = sent.groupBy("bucket").applyInArrow(answer_anchors, "chunk long, bucket long, flags binary")
    stretches = by_chunk.cogroup(flags.groupBy("chunk")).applyInArrow(send_stretches, "chunk long, bucket long, groups binary, docs binary, runs binary, data binary")
    bits = stretches.groupBy("bucket").applyInArrow(answer_stretches, "chunk long, answer long, bits binary")
    both = flags.select("chunk", "bucket", "flags", F.lit(None).cast("long").alias("answer"), F.lit(None).cast("binary").alias("bits")).unionByName(
        bits.select("chunk", F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("flags"), "answer", "bits")
    )
    return by_chunk.cogroup(both.groupBy("chunk")).applyInArrow(conclude, schema)


def _pack2(flags: bytes) -> bytes:
    """Two bits a flag."""
    f = np.frombuffer(flags, np.uint8)
    return np.packbits(np.stack([f >> 1, f & 1], axis=1).ravel()).tobytes()


def _unpack2(data: bytes, n: int) -> np.ndarray:
    pairs = np.unpackbits(np.frombuffer(data, np.uint8), count=2 * n).reshape(n, 2)
    return pairs[:, 0] * 2 + pairs[:, 1]
