"""Keys of one chunk (see ``scan.packed``) as arrays: the rows of many keys lie behind one another, and every step works on all
of them. Each function is the twin of an operator on tables, which longer keys go through; sums run in the same order."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Overlaps are added up as whole multiples of 1 / FIXED, so that their sum doesn't depend on tasks.
FIXED = 2.0**40


class Places:
    """Where the rows of keys with ``size`` rows each lie."""

    def __init__(self, size: np.ndarray):
        self.key = np.repeat(np.arange(len(size)), size)
        self.here = np.arange(len(self.key))
        self.at = self.here - np.repeat(np.cumsum(size) - size, size)
        self.n = np.repeat(size, size)

    def average(self, x: np.ndarray, width: int) -> np.ndarray:
        """``sequence.moving_average`` of (row, class)."""
        back, ahead = width // 2, width - 1 - width // 2
        total = np.zeros_like(x)
        for step in range(-back, ahead + 1):
            inside = np.flatnonzero((self.at + step >= 0) & (self.at + step < self.n))
            total[inside] += x[inside + step]
        first, last = x[self.here - self.at], x[self.here - self.at + self.n - 1]
        return (total + np.maximum(0, back - self.at)[:, None] * first + np.maximum(0, self.at + ahead - (self.n - 1))[:, None] * last) / float(width)

    def median(self, x: np.ndarray, width: int, pad: str = "zero") -> np.ndarray:
        """``sequence.median_filter`` of (row, class)."""
        width += pad == "zero" and width % 2 == 0
        back, ahead, frames = width // 2, width - 1 - width // 2, []
        for step in range(-back, ahead + 1):
            near = np.clip(self.at + step, 0, self.n - 1)
            values = x[self.here - self.at + near]
            frames.append(np.where((near == self.at + step)[:, None], values, 0.0) if pad == "zero" else values)
        frames = np.sort(np.stack(frames), axis=0)
        return frames[width // 2] if width % 2 else (frames[width // 2 - 1] + frames[width // 2]) / 2


def shares(x: np.ndarray) -> np.ndarray:
    """``sequence.renormalised`` of (row, class)."""
    total = x[:, 0].copy()
    for k in range(1, x.shape[1]):
        total += x[:, k]
    none = total <= 0
    return np.where(none[:, None], 1.0 / x.shape[1], x / np.where(none, 1.0, total)[:, None])


def sums(group: np.ndarray, values: np.ndarray, many: int) -> np.ndarray:
    """Of (row, class) by group, added in the order of rows."""
    return np.stack([np.bincount(group, values[:, k], many) for k in range(values.shape[1])], axis=1)


@dataclass
class Runs:
    """Runs of the keys in order: key (its number), label, n rows, sums (of probabilities by class), first and last time."""

    key: np.ndarray
    label: np.ndarray
    n: np.ndarray
    sums: np.ndarray
    t0: np.ndarray
    t1: np.ndarray

    def first(self) -> np.ndarray:
        return np.concatenate([[True], self.key[1:] != self.key[:-1]])

    def last(self) -> np.ndarray:
        return np.concatenate([self.key[1:] != self.key[:-1], [True]])

    def joined(self) -> Runs:
        """Neighbours of one key with the same label as one run."""
        cut = self.first()
        cut[1:] |= self.label[1:] != self.label[:-1]
        at = np.flatnonzero(cut)
        return Runs(self.key[at], self.label[at], np.add.reduceat(self.n, at), sums(np.cumsum(cut) - 1, self.sums, len(at)), np.minimum.reduceat(self.t0, at), np.maximum.reduceat(self.t1, at))

    def repaired(self, least: int, passes: int = 2) -> Runs:
        """``decode.repaired_runs``."""
        runs = self
        for _ in range(passes):
            first, last = runs.first(), runs.last()
            short = np.flatnonzero((runs.n < least) & ~(first & last))
            if not len(short):
                break
            before, after = runs.label[np.maximum(short - 1, 0)], runs.label[np.minimum(short + 1, len(runs.n) - 1)]
            mean = lambda label: np.round(runs.sums[short, label] / runs.n[short], 9)  # noqa: B023, E731
            earlier = ~first[short] & (last[short] | (before == after) | (mean(before) >= mean(after)))
            label = runs.label.copy()
            label[short] = np.where(earlier, before, after)
            runs = Runs(runs.key, label, runs.n, runs.sums, runs.t0, runs.t1).joined()
        return runs


def runs(key: np.ndarray, label: np.ndarray, p: np.ndarray, t: np.ndarray) -> Runs:
    """Runs of equal labels of rows."""
    return Runs(key, label.astype(np.int64), np.ones(len(key), np.int64), p, t, t).joined()


@dataclass
class Records:
    """Records of the keys in order; ``sums`` and ``n`` are what their confidence is made of."""

    key: np.ndarray
    label: np.ndarray
    start: np.ndarray
    end: np.ndarray
    sums: np.ndarray
    n: np.ndarray

    def confidence(self) -> np.ndarray:
        return self.sums[np.arange(len(self.n)), self.label] / self.n

    def at(self, rows: np.ndarray) -> Records:
        return Records(*(v[rows] for v in (self.key, self.label, self.start, self.end, self.sums, self.n)))

    def merged(self, gap: float) -> Records:
        """``decode.chained`` and what its groups are: all keys go on from head to head together."""
        if gap <= 0 or not len(self.n):
            return self
        same = self.key[1:] == self.key[:-1]
        if (same & (self.start[1:] < self.start[:-1])).any():
            return self.at(np.lexsort((np.arange(len(self.n)), self.start, self.key))).merged(gap)
        many, size = len(self.n), np.bincount(self.key)
        to = np.full(many, -1)
        for k in np.unique(self.label):
            of = np.flatnonzero(self.label == k)
            a, b = of[:-1], of[1:]
            near = (self.key[a] == self.key[b]) & (self.start[b] - self.end[a] <= gap) & (size[self.key[a]] > 2)
            to[a[near]] = b[near]
        onward, head = np.where(to >= 0, to, np.arange(1, many + 1)), np.zeros(many, bool)
        at = np.flatnonzero(np.concatenate([[True], ~same]))
        linked = np.zeros(len(at), bool)
        while len(at):
            head[at[~linked]] = True
            after = onward[at]
            inside = (after < many) & (self.key[np.minimum(after, many - 1)] == self.key[at])
            linked, at = to[at[inside]] >= 0, after[inside]
        at = np.flatnonzero(head)
        ends = np.concatenate([at[1:], [many]]) - 1
        return Records(self.key[at], self.label[at], self.start[at], self.end[ends], sums(np.cumsum(head) - 1, self.sums, len(at)), np.add.reduceat(self.n, at))


def records(found: Runs, span: np.ndarray) -> Records:
    """Runs from half-way to their neighbours; the first begins at 0, the last ends at its key's ``span``."""
    first, last = found.first(), found.last()
    start = np.where(first, 0.0, (np.roll(found.t1, 1) + found.t0) / 2.0)
    end = np.where(last, span[found.key], (found.t1 + np.roll(found.t0, -1)) / 2.0)
    return Records(found.key, found.label, start, end, found.sums, found.n)


class Gold:
    """True intervals of the keys, disjoint, by rising start."""

    def __init__(self, key: np.ndarray, start: np.ndarray, end: np.ndarray, label: np.ndarray):
        self.key, self.start, self.end, self.label = key, start, end, label

    def overlaps(self, found: Records, above: float = 0.5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Records whose overlap over hull with a true one of their class is over ``above`` (0.5 at least): their numbers,
        that value and the true one's length. It then holds the record's middle, so there is one to look at."""
        if not len(self.key) or not len(found.key):
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        middle = (found.start + found.end) / 2
        low = min(self.start.min(), middle.min())
        width = max(self.start.max(), middle.max()) - low + 1
        g = np.searchsorted(self.key * width + (self.start - low), found.key * width + (middle - low), "right") - 1
        at = np.flatnonzero((g >= 0) & (self.key[g] == found.key) & (self.label[g] == found.label) & (found.start <= found.end))
        g = g[at]
        inside = np.maximum(0.0, np.minimum(found.end[at], self.end[g]) - np.maximum(found.start[at], self.start[g]))
        hull = np.maximum(found.end[at], self.end[g]) - np.minimum(found.start[at], self.start[g])
        value = np.where(hull > 0, inside / np.where(hull > 0, hull, 1.0), 0.0)
        hit = value > above
        return at[hit], value[hit], (self.end[g] - self.start[g])[hit]


class Conditions:
    """Counts under every pair of a least length and a least confidence (rising each; 0 or less asks for none)."""

    def __init__(self, lengths: list[float], sure: list[float]):
        self.lengths, self.sure = np.array(lengths, np.float64), np.array(sure, np.float64)
        self.shape = (len(lengths) + 1, len(sure) + 1)

    def of(self, length: np.ndarray, confidence: np.ndarray) -> np.ndarray:
        sure = np.maximum(np.searchsorted(self.sure, confidence, "right"), (self.sure <= 0).sum())
        return np.searchsorted(self.lengths, length, "right") * self.shape[1] + sure

    def count(self, of: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """(length, confidence), flat: how many meet both, or the sum of their whole ``weights`` under 2^53."""
        found = np.bincount(of, weights, self.shape[0] * self.shape[1]).astype(np.int64).reshape(self.shape)
        return found[::-1, ::-1].cumsum(axis=0).cumsum(axis=1)[::-1, ::-1][1:, 1:].ravel()

    def total(self, of: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Sums of values up to 1 in multiples of 1 / FIXED."""
        fixed = np.floor(values * FIXED + 0.5).astype(np.int64)
        return (self.count(of, fixed >> 20) << 20) + self.count(of, fixed & (2**20 - 1))
