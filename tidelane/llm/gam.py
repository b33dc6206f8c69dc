"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted in cycles, a feature at a time, each tree on one feature's histogram of gradients; their sum is
a look-up table for each feature. What the single features leave is boosted the same way on pairs of features, after the
pairs are ranked by the gain of a split along both. A score is the logistic of the intercept and of one table entry for
each feature and pair, looked up by bin for whole batches.

Features come from the bytes and words of the whole text alone. The model is fitted on at most ``FIT_ROWS`` labelled
rows (those with the smallest hashed ids, so the same at every layout); a thirtieth of them or more is set aside to
choose the number of cycles. The result is a few thousand numbers, whatever the input.

Defined cases: null texts are empty; texts without words have zero features and are scored like any other. Rows that
repeat an id are each scored; a null id is scored, never learnt from, and not held out. Without any usable label the
score is 0.5 throughout; with labels of one class it tends to that class.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm import shared

FIT_ROWS, BINS, PAIR_BINS, PAIRS = 20_000, 48, 8, 6
CYCLES, PAIR_CYCLES, RATE, LEAVES = 150, 60, 0.12, 3
FOLDS, HELD_FOLD, THRESHOLD = 5, 0, 0.3

NAMES = (
    "log_bytes", "log_words", "mean_word", "upper", "digit", "space", "exclaim", "pipe", "symbol", "stop", "comma", "other_punct",
    "high_byte", "distinct_words", "same_as_last", "same_as_second_last", "repeat_lines", "line_words",
)
#: Byte classes by name; what is in none of them isn't counted.
CLASSES = {
    "upper": range(65, 91), "digit": range(48, 58), "space": (*range(9, 14), 32), "exclaim": b"!", "pipe": b"|",
    "symbol": b"#*$%&<>", "stop": b".", "comma": b",", "other_punct": b"\"'()+-/:;=?@[\\]^_`{}~", "high_byte": range(128, 256),
}


def features(texts: list[str]) -> np.ndarray:
    """One row of ``NAMES`` per text."""
    data = [t.encode() for t in texts]
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    flat = np.frombuffer(b"".join(data), np.uint8)
    table = np.zeros(256, np.uint8)
    for k, members in enumerate(CLASSES.values(), 1):
        table[list(members)] = k
    kinds = table[flat]
    owner_cuts = np.concatenate([[0], np.cumsum(sizes)])
    shares = {}
    for k, name in enumerate(CLASSES, 1):
        at = np.flatnonzero(kinds == k)
        shares[name] = np.diff(np.searchsorted(at, owner_cuts)) / np.maximum(sizes, 1)
    rows = np.zeros((len(texts), len(NAMES)))
    words = [d.split() for d in data]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    some = np.maximum(counts, 1)
    letters = np.fromiter((sum(map(len, w)) for w in words), np.int64, len(words))
    distinct = np.fromiter((len(set(w)) for w in words), np.int64, len(words))
    last = np.fromiter((sum(map(eq, w, w[1:])) for w in words), np.int64, len(words))
    second = np.fromiter((sum(map(eq, w, w[2:])) for w in words), np.int64, len(words))
    lines = [[x for x in d.split(b"\n") if x.strip()] for d in data]
    n_lines = np.maximum(np.fromiter(map(len, lines), np.int64, len(lines)), 1)
    repeat = np.fromiter((len(x) - len(set(x)) for x in lines), np.int64, len(lines))
    columns = {
        "log_bytes": np.log1p(sizes), "log_words": np.log1p(counts), "mean_word": letters / some, **shares, "distinct_words": distinct / some,
        "same_as_last": last / some, "same_as_second_last": second / some, "repeat_lines": repeat / n_lines, "line_words": np.log1p(counts / n_lines),
    }
    for k, name in enumerate(NAMES):
        rows[:, k] = columns[name]
    return rows


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1])) if len(values) else np.zeros(0)


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int, least: float = 4.0) -> np.ndarray:
    """Leaf values by bin of a tree that splits a histogram best-first."""
    parts, g, h = [(0, len(gradient))], np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])

    def best(a: int, b: int) -> tuple[float, int]:
        if b - a < 2:
            return 0.0, -1
        at = np.arange(a + 1, b)
        lg, lh, rg, rh = g[at] - g[a], h[at] - h[a], g[b] - g[at], h[b] - h[at]
        gain = np.where((lh >= least) & (rh >= least), lg**2 / (lh + 1) + rg**2 / (rh + 1) - (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1), 0)
        k = int(gain.argmax())
        return float(gain[k]), int(at[k])

    while len(parts) < leaves:
        found = [(*best(a, b), k) for k, (a, b) in enumerate(parts)]
        gain, at, k = max(found)
        if gain <= 1e-9:
            break
        a, b = parts.pop(k)
        parts += [(a, at), (at, b)]
    out = np.zeros(len(gradient))
    for a, b in parts:
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1)
    return out


def _pair_tree(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree that splits a two-way histogram once along each side (four leaves)."""
    g, h = (np.pad(np.cumsum(np.cumsum(x, 0), 1), ((1, 0), (1, 0))) for x in (gradient, weight))
    m, n = gradient.shape
    i, j = np.arange(1, m)[:, None], np.arange(1, n)[None, :]
    if m < 2 or n < 2:
        return 0.0, np.zeros_like(gradient)
    quarter = lambda x: (x[i, j], x[i, n] - x[i, j], x[m, j] - x[i, j], x[m, n] - x[i, n] - x[m, j] + x[i, j])
    qg, qh = quarter(g), quarter(h)
    gain = sum(a**2 / (b + 1) for a, b in zip(qg, qh, strict=True)) - g[m, n] ** 2 / (h[m, n] + 1)
    a, b = np.unravel_index(int(gain.argmax()), gain.shape)
    leaf = [x[a, b] / (y[a, b] + 1) for x, y in zip(qg, qh, strict=True)]
    out = np.empty_like(gradient)
    out[: a + 1, : b + 1], out[: a + 1, b + 1 :], out[a + 1 :, : b + 1], out[a + 1 :, b + 1 :] = leaf
    return float(gain[a, b]), out


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _loss(y: np.ndarray, z: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z)) if len(y) else 0.0


def fit(x: np.ndarray, y: np.ndarray, *, bins: int = BINS, pair_bins: int = PAIR_BINS, pairs: int = PAIRS, cycles: int = CYCLES, pair_cycles: int = PAIR_CYCLES, rate: float = RATE, leaves: int = LEAVES) -> dict:
    """Tables of the additive model for features ``x`` and labels ``y`` (0 or 1)."""
    d = x.shape[1]
    share = (y.sum() + 1) / (len(y) + 2)
    model = {"intercept": float(np.log(share / (1 - share))), "cuts": [_cuts(x[:, k], bins) for k in range(d)], "tables": [], "pairs": []}
    coarse = [_cuts(x[:, k], pair_bins) for k in range(d)]
    model["tables"] = [np.zeros(len(c) + 1) for c in model["cuts"]]
    if len(y) < 20:
        return model
    test = np.arange(len(y)) % 30 == 0
    binned = [np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(model["cuts"])]
    rough = [np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(coarse)]
    z, train = np.full(len(y), model["intercept"]), (~test).astype(float)
    best, kept, since = _loss(y[test], z[test]), [t.copy() for t in model["tables"]], 0
    for _ in range(cycles):
        for k in range(d):
            p = _logistic(z)
            n = len(model["tables"][k])
            step = rate * _tree(np.bincount(binned[k], (y - p) * train, n), np.bincount(binned[k], p * (1 - p) * train, n), leaves)
            model["tables"][k] += step
            z += step[binned[k]]
        now = _loss(y[test], z[test])
        if now < best - 1e-6:
            best, kept, since = now, [t.copy() for t in model["tables"]], 0
        elif (since := since + 1) >= 15:
            break
    model["tables"] = kept
    z = model["intercept"] + sum(t[b] for t, b in zip(kept, binned, strict=True))

    def histograms(i: int, j: int, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m, n = len(coarse[i]) + 1, len(coarse[j]) + 1
        cell = rough[i] * n + rough[j]
        return np.bincount(cell, (y - p) * train, m * n).reshape(m, n), np.bincount(cell, p * (1 - p) * train, m * n).reshape(m, n), cell

    p = _logistic(z)
    ranked = sorted(((_pair_tree(*histograms(i, j, p)[:2])[0], i, j) for i in range(d) for j in range(i)), reverse=True)[:pairs]
    model["pairs"] = [(i, j, coarse[i], coarse[j], np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for _, i, j in ranked]
    kept, since = [t[4].copy() for t in model["pairs"]], 0
    for _ in range(pair_cycles):
        for i, j, _, _, t in model["pairs"]:
            g, h, cell = histograms(i, j, _logistic(z))
            step = rate * _pair_tree(g, h)[1]
            t += step
            z += step.ravel()[cell]
        now = _loss(y[test], z[test])
        if now < best - 1e-6:
            best, kept, since = now, [t[4].copy() for t in model["pairs"]], 0
        elif (since := since + 1) >= 10:
            break
    model["pairs"] = [(*t[:4], k) for t, k in zip(model["pairs"], kept, strict=True)]
    return model


def score(model: dict, x: np.ndarray) -> np.ndarray:
    """Probability of label 1: one look-up per feature and pair, summed."""
    z = np.full(len(x), model["intercept"])
    for k, (cuts, t) in enumerate(zip(model["cuts"], model["tables"], strict=True)):
        z += t[np.searchsorted(cuts, x[:, k], side="left")]
    for i, j, a, b, t in model["pairs"]:
        z += t[np.searchsorted(a, x[:, i], side="left"), np.searchsorted(b, x[:, j], side="left")]
    return _logistic(z)


def fold(folds: int) -> F.Column:
    """The fold of a row: crc32 of its id as text. Null for a null id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds))


def fit_rows_of(labels: DataFrame, column: str, folds: int, held_fold: int, rows: int) -> DataFrame:
    """doc_id and label ``y`` of at most ``rows`` labelled rows outside the held fold, those with the smallest hashed ids.
    Several labels of an id count as the smallest."""
    known = labels.where(F.col(column).isin(0, 1) & (fold(folds) != held_fold)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(column).alias("y"))
    return known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def train(docs: DataFrame, labels: DataFrame, *, folds: int = FOLDS, held_fold: int = HELD_FOLD, fit_rows: int = FIT_ROWS) -> dict:
    """The model. Only figures of the chosen rows reach the driver, one text an id (the smallest)."""
    shared.prepare(docs.sparkSession)
    ids = fit_rows_of(labels, "quality", folds, held_fold, fit_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def measure(batches):
        for batch in batches:
            x = features(batch.column(1).to_pylist()).astype(np.float32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(NAMES)), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, batch.column(2)], names=["doc_id", "x", "y"])

    measured = rows.join(F.broadcast(ids), "doc_id").select("doc_id", "text", F.col("y").cast("double")).mapInArrow(measure, "doc_id long, x array<float>, y double")
    chosen = measured.groupBy("doc_id").agg(F.min("x").alias("x"), F.min("y").alias("y")).collect()
    chosen.sort(key=lambda r: r.doc_id)
    return fit(np.array([r.x for r in chosen], np.float64).reshape(-1, len(NAMES)), np.array([r.y for r in chosen], np.float64))


def _scores(model: dict, texts: list) -> np.ndarray:
    return score(model, features([t or "" for t in texts]).astype(np.float32).astype(np.float64))


def classify(docs: DataFrame, labels: DataFrame, *, folds: int = FOLDS, held_fold: int = HELD_FOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out and score of every row of ``docs`` (doc_id, text); learns ``labels`` (doc_id, quality)."""
    model = train(docs, labels, folds=folds, held_fold=held_fold, fit_rows=fit_rows)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(model, batch.column(1).to_pylist()))], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(fold(folds) == held_fold, F.lit(False)).alias("held_out"), "score")


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, folds: int = FOLDS, held_fold: int = HELD_FOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns; by the model that ``classify`` has."""
    model = train(docs, labels, folds=folds, held_fold=held_fold, fit_rows=fit_rows)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scores(model, batch.column(at).to_pylist()) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op10_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels"))
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


QUERIES = {"op10_quality_gam": op10_quality_gam}
ORACLE_SQL: dict[str, str] = {}
