"""Substring deduplication of words by prefix-partitioned suffix trees.

The suffixes that start a window are first dealt to tasks by anchors (see ``repeats``), so that equal windows meet. In a
task they are split into groups by variable-length prefixes: a group's prefix is extended word by word until the group
fits ``GROUP`` suffixes. Over each group a subtree is grown from the top down: a node's suffixes are read on together for
as long as they agree, and where they first differ the node branches by the next word; a branch with one suffix is a
leaf. An internal node's depth is the length of a sequence that is found at least twice and can't be extended to the
right; such nodes, where what stands before their suffixes differs too, are the maximal repeats (``maximal_repeats``).

For windows of one width, branches are grown to that depth only. Internal nodes that deep hold the suffixes of one window
each, and the smallest id among their documents decides.

Words are compared as whole words: tasks number the distinct ones of theirs, and trees hold these numbers.

Defined cases: a null text has no words; texts of fewer words than a window keep all. Rows that repeat a doc_id remove
nothing from each other; a null doc_id counts as larger than any other. Columns but doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm import repeats, shared

WIDTH, GRAM = 50, 8
#: Suffixes of a group at most, unless they share a prefix of a whole window.
GROUP = 1 << 16


@dataclass
class Tree:
    """A subtree: its suffixes in tree order, and of each internal node the depth and the range of its suffixes."""

    leaves: np.ndarray
    depth: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def _branch(symbols: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts members (already grouped by ``node``) by their next symbol, and where a branch begins."""
    order = np.lexsort((symbols, node))
    return order, np.flatnonzero(repeats.changes(node[order], symbols[order]))


def prefix_groups(units: np.ndarray, places: np.ndarray, limit: int, most: int = GROUP) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(suffixes, sizes, prefix lengths) of groups with a common prefix, some groups of at most ``most`` together.

    All groups begin as one without a prefix. Those that are too large are split by their next word.
    """
    done: list[tuple[np.ndarray, int]] = []
    large, depth = ([places] if len(places) > most else []), 0
    if len(places) and not large:
        done.append((places, 0))
    while large:
        members = np.concatenate(large)
        node = np.repeat(np.arange(len(large)), [len(x) for x in large])
        order, cuts = _branch(units[members + depth], node)
        depth, parts = depth + 1, np.split(members[order], cuts[1:])
        large = [x for x in parts if len(x) > most and depth < limit]
        done += [(x, depth) for x in parts if len(x) > 1 and (len(x) <= most or depth >= limit)]
    batch: list[tuple[np.ndarray, int]] = []
    held = 0
    for x in done:
        if batch and held + len(x[0]) > most:
            yield np.concatenate([p for p, _ in batch]), np.array([len(p) for p, _ in batch]), np.array([d for _, d in batch])
            batch, held = [], 0
        batch.append(x)
        held += len(x[0])
    if batch:
        yield np.concatenate([p for p, _ in batch]), np.array([len(p) for p, _ in batch]), np.array([d for _, d in batch])


def grow(units: np.ndarray, places: np.ndarray, sizes: np.ndarray, depths: np.ndarray, limit: int | None = None) -> Tree:
    """The subtree (a forest, of one tree per group) of suffixes that lie in groups with so long common prefixes.

    Branches end at depth ``limit``; without one, at a negative unit, which differs from all others.
    """
    leaves = places.copy()
    begin, depth = np.cumsum(sizes) - sizes, depths.copy()
    some = sizes > 1
    begin, sizes, depth = begin[some], sizes[some], depth[some]
    nodes: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(begin):
        if limit is not None:
            deep = depth >= limit
            nodes.append((depth[deep], begin[deep], begin[deep] + sizes[deep]))
            begin, sizes, depth = begin[~deep], sizes[~deep], depth[~deep]
            if not len(begin):
                break
        at = repeats.spread(begin, sizes)
        symbols = units[leaves[at] + np.repeat(depth, sizes)]
        first = np.cumsum(sizes) - sizes
        splits = np.logical_or.reduceat((symbols != np.repeat(symbols[first], sizes)) | (symbols < 0), first)
        nodes.append((depth[splits], begin[splits], begin[splits] + sizes[splits]))
        on = begin[~splits], sizes[~splits], depth[~splits] + 1
        member = np.repeat(splits, sizes)
        at, symbols, node = at[member], symbols[member], np.repeat(np.arange(len(sizes)), sizes)[member]
        symbols = np.where(symbols < 0, -1 - leaves[at], symbols)  # each end is a branch of its own
        order, cuts = _branch(symbols, node)
        leaves[at] = leaves[at[order]]
        size = np.diff(np.append(cuts, len(at)))
        more = size > 1
        begin = np.concatenate([on[0], at[cuts[more]]])
        sizes = np.concatenate([on[1], size[more]])
        depth = np.concatenate([on[2], depth[node[order[cuts[more]]]] + 1])
    found = [np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*nodes, strict=True)] if nodes else [np.zeros(0, np.int64)] * 3
    return Tree(leaves, *found)


def deep_nodes(units: np.ndarray, begin: np.ndarray, windows: np.ndarray, width: int) -> np.ndarray:
    """A number for each window of stretches that begin so in ``units``: of the internal node at depth ``width`` that holds
    it, or its own. Stretches lie end to end and are ``width - 1`` words longer than they have windows."""
    at = repeats.spread(begin, windows)
    names = np.arange(len(units), dtype=np.int64)
    for places, sizes, depths in prefix_groups(units, at, width):
        tree = grow(units, places, sizes, depths, width)
        deep = tree.depth >= width
        first, size = tree.begin[deep], (tree.end - tree.begin)[deep]
        names[tree.leaves[repeats.spread(first, size)]] = np.repeat(tree.leaves[first], size)
    return names[at]


def maximal_repeats(texts: list[np.ndarray], least: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(length, [(text, place), ...]) of every maximal repeat of ``least`` units or more in sequences of units from 0 on.

    A maximal repeat is a sequence found twice or more whose occurrences neither all follow nor all precede equal units.
    """
    units = np.concatenate([np.append(t, -1) for t in texts]).astype(np.int64) if texts else np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    start = np.searchsorted(text, np.arange(len(texts)))
    before = np.append(-1, units[:-1])
    places = np.flatnonzero(units >= 0)
    tree = grow(units, places, np.array([len(places)]), np.zeros(1, np.int64))
    out = []
    for depth, a, b in zip(tree.depth.tolist(), tree.begin.tolist(), tree.end.tolist(), strict=True):
        left = before[tree.leaves[a:b]]
        if depth >= least and ((left < 0).any() or (left != left[0]).any()):
            out.append((depth, sorted((int(text[p]), int(p - start[text[p]])) for p in tree.leaves[a:b])))
    return out


METHOD = repeats.Method(words=True, width=WIDTH, gram=GRAM, order=deep_nodes)


def kept_words(chunk: repeats.Chunk, covered: np.ndarray) -> list[bytes]:
    """What is left of each text, joined by single spaces."""
    out = []
    for text, a, b in zip(chunk.texts, (chunk.ends - chunk.counts).tolist(), chunk.ends.tolist(), strict=True):
        gone = covered[a:b]
        out.append(b" ".join([w for w, g in zip(text.split(b" "), gone.tolist(), strict=True) if not g]) if gone.any() else text)
    return out


def digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def finish(chunk, covered, table):
        ids, counts, removed, kept = [], [], [], []
        if chunk is not None:
            ids, counts = table["doc_id"].to_pylist(), chunk.counts
            total = np.concatenate([[0], np.cumsum(covered)])
            removed = total[chunk.ends] - total[chunk.ends - counts]
            kept = [hashlib.sha256(k).hexdigest() for k in kept_words(chunk, covered)]
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(kept, pa.string())})

    return repeats.deduplicate(rows, METHOD, finish, "doc_id long, n_words long, n_removed long, kept_sha256 string", **options)


def op5_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(shared.table(spark, sf_dir, "documents"))


QUERIES = {"op5_suffix_trees": op5_suffix_trees}
ORACLE_SQL: dict[str, str] = {}
