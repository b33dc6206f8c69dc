"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

A text's words (letters and digits, in lower case) are cut into overlapping windows. A word's input is a learned vector
of its hash bucket beside the mean of learned vectors of its characters' four-byte runs, with a mark at its beginning.
Two gated recurrent layers read a window forwards and backwards; attention weighs their states into one, which gives the
window's logit. A text's score comes from its highest window, all windows of the whole text being scored.

Training takes at most ``FIT_ROWS`` labelled rows (those with the smallest hashed ids) and marks only texts, so each
epoch trains on a text's currently highest window, beside a random one of clean texts. The input vectors start from the
log-odds of their bucket between the two labels. Last, a logistic on the texts' highest logits sets the scores' scale.

Defined cases: null texts are empty; texts without a word take the lowest logit seen in training. Repeated rows are each
scored; a null id is scored, never learnt from, and not held out. Without both labels the score is the share of label 1.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.llm import gam, shared

FIT_ROWS, WINDOW, STRIDE = 4000, 32, 16
WORD_BUCKETS, GRAM_BUCKETS, WORD_DIM, GRAM_DIM, HIDDEN = 1 << 15, 1 << 15, 6, 6, 6
#: Small samples get more epochs than EPOCHS: as many as LEAST_STEPS steps take.
EPOCHS, LEAST_STEPS, BATCH, RATE = 6, 200, 64, 0.01
FOLDS, HELD_FOLD, THRESHOLD = 3, 1, 0.7
GRAM = 4
#: Windows that go through the network at once, and texts whose words are encoded at once.
CHUNK = 4096
WORD = re.compile(r"[^\W_]+")


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64)


def word_inputs(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word bucket of each word; buckets of all words' four-byte runs, and where each word's begin."""
    data = [b"^" + w.encode() + b"$$" for w in words]  # at least one run of four
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    flat = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    rolled = np.zeros(len(flat), np.uint64)
    for k in range(GRAM):
        rolled[: len(flat) - k] = rolled[: len(flat) - k] * np.uint64(0x100000001B3) + flat[k:] + np.uint64(1)
    inside = np.ones(len(flat), bool)
    for k in range(1, GRAM):
        inside[ends - k] = False
    grams = _bucket(rolled[inside], GRAM_BUCKETS)
    counts = sizes - (GRAM - 1)
    first = np.cumsum(counts) - counts
    mixed = (rolled * (np.arange(len(flat), dtype=np.uint64) - np.repeat(starts, sizes).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))[inside]
    whole = np.add.reduceat(mixed ^ (mixed >> np.uint64(31)), first) if len(words) else np.zeros(0, np.uint64)
    return _bucket(whole, WORD_BUCKETS), grams, first


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner, first word and length of the overlapping windows of texts with so many words each."""
    n = np.where(counts <= 0, 0, 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE)))
    owner = np.repeat(np.arange(len(counts)), n)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    start = within * STRIDE
    return owner, start, np.minimum(WINDOW, counts[owner] - start)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


class Network:
    """Parameters, scoring and one training step. All arrays are float32."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        d, h = WORD_DIM + GRAM_DIM, HIDDEN
        small = lambda *shape: (r.standard_normal(shape) * 0.25).astype(np.float32)
        self.p = {"word": small(WORD_BUCKETS, WORD_DIM) * 0.1, "gram": small(GRAM_BUCKETS, GRAM_DIM) * 0.1, "attend": small(2 * h), "out": small(2 * h), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {f"x{side}": small(d, 3 * h), f"h{side}": small(h, 3 * h), f"b{side}": np.zeros(3 * h, np.float32)}
        self.moments: dict[str, tuple] = {}
        self.steps = 0
        #: Small samples move the many input vectors less than the few weights that read them.
        self.table_rate = 1.0

    def vectors(self, word: np.ndarray, grams: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Input vectors of distinct words."""
        if not len(word):
            return np.zeros((0, WORD_DIM + GRAM_DIM), np.float32)
        sums = np.add.reduceat(self.p["gram"][grams], first, axis=0)
        sizes = np.diff(np.concatenate([first, [len(grams)]])).astype(np.float32)
        return np.concatenate([self.p["word"][word], sums / sizes[:, None]], axis=1)

    def _read(self, side: str, projected: np.ndarray, ids: np.ndarray, keep: list | None) -> np.ndarray:
        """States of one direction: (time, window, hidden). ``ids`` is (time, window) into ``projected``; -1 pads.

        A padded step leaves the state as it is, so windows of any length go together.
        """
        h = HIDDEN
        state = np.zeros((ids.shape[1], h), np.float32)
        states = np.empty((len(ids), ids.shape[1], h), np.float32)
        u = self.p[f"h{side}"]
        for t in range(len(ids)) if side == "f" else range(len(ids) - 1, -1, -1):
            on = (ids[t] >= 0)[:, None]
            x = projected[ids[t]]
            gates = _sigmoid(x[:, : 2 * h] + state @ u[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            candidate = np.tanh(x[:, 2 * h :] + (r * state) @ u[:, 2 * h :])
            if keep is not None:
                keep.append((t, on, state, z, r, candidate))
            state = np.where(on, state + z * (candidate - state), state)
            states[t] = state
        return states

    def forward(self, vectors: np.ndarray, ids: np.ndarray, trace: dict | None = None) -> np.ndarray:
        """Logits of windows; ``ids`` is (time, window)."""
        both, projected = [], {}
        for side in "fb":
            projected[side] = np.concatenate([vectors @ self.p[f"x{side}"] + self.p[f"b{side}"], np.zeros((1, 3 * HIDDEN), np.float32)])
            kept = None if trace is None else trace.setdefault(side, [])
            both.append(self._read(side, projected[side], ids, kept))
        states = np.concatenate(both, axis=2)
        energy = np.where(ids >= 0, states @ self.p["attend"], -1e9)
        weight = np.exp(energy - energy.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tw,twh->wh", weight, states)
        if trace is not None:
            trace |= {"states": states, "weight": weight, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["bias"][0]

    def train(self, inputs: tuple, ids: np.ndarray, labels: np.ndarray) -> None:
        """One Adam step on windows with labels."""
        word, grams, first = inputs
        vectors, trace, p, h = self.vectors(word, grams, first), {}, self.p, HIDDEN
        logits = self.forward(vectors, ids, trace)
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "gram")}
        d_logit = ((_sigmoid(logits) - labels) / len(labels)).astype(np.float32)
        states, weight = trace["states"], trace["weight"]
        g["bias"][0], g["out"] = d_logit.sum(), trace["pooled"].T @ d_logit
        d_pooled = d_logit[:, None] * p["out"]
        d_weight = np.einsum("wh,twh->tw", d_pooled, states)
        d_energy = weight * (d_weight - (weight * d_weight).sum(axis=0))
        d_states = weight[:, :, None] * d_pooled + d_energy[:, :, None] * p["attend"]
        g["attend"] = np.einsum("tw,twh->h", d_energy, states)
        d_vectors = np.zeros((len(vectors) + 1, vectors.shape[1]), np.float32)
        for k, side in enumerate("fb"):
            u, d_state = p[f"h{side}"], np.zeros((ids.shape[1], h), np.float32)
            padded = np.concatenate([vectors, np.zeros((1, vectors.shape[1]), np.float32)])
            for t, on, before, z, r, c in reversed(trace[side]):
                d_state = d_state + d_states[t][:, k * h : (k + 1) * h]
                live = np.where(on, d_state, 0)
                d_c = live * z * (1 - c * c)
                d_z = live * (c - before) * z * (1 - z)
                d_rs = d_c @ u[:, 2 * h :].T
                d_r = d_rs * before * r * (1 - r)
                d_gates = np.concatenate([d_z, d_r, d_c], axis=1)
                x = padded[ids[t]]
                g[f"x{side}"] += x.T @ d_gates
                g[f"b{side}"] += d_gates.sum(axis=0)
                g[f"h{side}"][:, : 2 * h] += before.T @ d_gates[:, : 2 * h]
                g[f"h{side}"][:, 2 * h :] += (r * before).T @ d_c
                np.add.at(d_vectors, ids[t], d_gates @ p[f"x{side}"].T)
                d_state = np.where(on, d_state * (1 - z) + d_rs * r + d_gates[:, : 2 * h] @ u[:, : 2 * h].T, d_state)
        d_vectors = d_vectors[:-1]
        sizes = np.diff(np.concatenate([first, [len(grams)]]))
        self.steps += 1
        for name, grad in g.items():
            self._adam(name, slice(None), grad)
        rows, back = np.unique(word, return_inverse=True)
        part = np.zeros((len(rows), WORD_DIM), np.float32)
        np.add.at(part, back, d_vectors[:, :WORD_DIM])
        self._adam("word", rows, part)
        rows, back = np.unique(grams, return_inverse=True)
        part = np.zeros((len(rows), GRAM_DIM), np.float32)
        np.add.at(part, back, np.repeat(d_vectors[:, WORD_DIM:] / sizes[:, None], sizes, axis=0))
        self._adam("gram", rows, part)

    def _adam(self, name: str, rows, grad: np.ndarray) -> None:
        m, v = self.moments.setdefault(name, (np.zeros_like(self.p[name]), np.zeros_like(self.p[name])))
        m[rows] = 0.9 * m[rows] + 0.1 * grad
        v[rows] = 0.99 * v[rows] + 0.01 * grad * grad
        slow = self.table_rate if name in ("word", "gram") else 1.0
        scale = slow * RATE * np.sqrt(1 - 0.99**self.steps) / (1 - 0.9**self.steps)
        self.p[name][rows] -= scale * m[rows] / (np.sqrt(v[rows]) + 1e-6)


def prepare(texts: list[str]) -> tuple[tuple, np.ndarray, np.ndarray]:
    """Inputs of the texts' distinct words; each place's word; words of each text."""
    split = [WORD.findall(t.lower()) for t in texts]
    counts = np.fromiter(map(len, split), np.int64, len(split))
    flat = np.empty(int(counts.sum()), object)
    flat[:] = [w for words in split for w in words]
    codes, distinct = pd.factorize(flat)
    return word_inputs(list(distinct)), codes.astype(np.int32), counts


def _ids(codes: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """(time, window) word ids of windows that begin at these places; -1 pads."""
    t = np.arange(int(length.max()) if len(length) else 1)[:, None]
    at = np.minimum(begin + t, max(0, len(codes) - 1))
    return np.where(t < length, codes[at], -1)


def highest(net: Network, inputs: tuple, codes: np.ndarray, counts: np.ndarray, empty: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
    """Highest logit of each text over all its windows, and that window's first place in ``codes``."""
    owner, start, length = windows_of(counts)
    begin = start + (np.cumsum(counts) - counts)[owner]
    vectors, logits = net.vectors(*inputs), np.empty(len(owner), np.float32)
    for k in range(0, len(owner), CHUNK):
        logits[k : k + CHUNK] = net.forward(vectors, _ids(codes, begin[k : k + CHUNK], length[k : k + CHUNK]))
    best, where = np.full(len(counts), empty, np.float64), np.zeros(len(counts), np.int64)
    if len(owner):
        order = np.lexsort((logits, owner))
        last = np.flatnonzero(np.diff(np.concatenate([owner[order], [-1]])))
        best[owner[order][last]], where[owner[order][last]] = logits[order][last], begin[order][last]
    return best, where


def fit(texts: list[str], labels: np.ndarray, *, epochs: int = EPOCHS, seed: int = 7) -> dict:
    """A trained network and the scale of its logits."""
    share = float(labels.mean()) if len(labels) else 0.5
    if len(np.unique(labels)) < 2:
        return {"net": None, "share": share}
    net, r = Network(seed), np.random.default_rng(seed)
    net.table_rate = min(1.0, len(texts) / FIT_ROWS) ** 2
    (word, grams, first), codes, counts = prepare(texts)
    ends = np.cumsum(counts)
    owner = np.repeat(np.arange(len(texts)), counts)
    sizes = np.diff(np.concatenate([first, [len(grams)]]))
    seen = np.unique(owner.astype(np.int64) * len(word) + codes)  # a word counts once a text
    of_text, of_word = seen // len(word), seen % len(word)
    n1, n0 = labels.sum(), len(labels) - labels.sum()

    def odds(buckets: np.ndarray, texts_: np.ndarray, size: int) -> np.ndarray:
        keys = np.unique(texts_.astype(np.int64) * size + buckets)
        y = labels[keys // size] == 1
        a, b = np.bincount(keys[y] % size, minlength=size), np.bincount(keys[~y] % size, minlength=size)
        raw = np.log((a + 1) / (n1 + 2)) - np.log((b + 1) / (n0 + 2))
        return (np.clip(raw, -3, 3) * np.clip((a + b - 3) / 8, 0, 1)).astype(np.float32)

    net.p["word"][:, 0] = odds(word[of_word], of_text, WORD_BUCKETS)
    gram_words = np.repeat(np.arange(len(word)), sizes)
    by_word = np.argsort(of_word, kind="stable")
    span = np.searchsorted(of_word[by_word], np.arange(len(word) + 1))
    many = np.diff(span)[gram_words]
    g_text = of_text[by_word][np.repeat(span[gram_words], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
    net.p["gram"][:, 0] = odds(np.repeat(grams, many), g_text, GRAM_BUCKETS)
    del seen, g_text
    steps = -(-2 * len(texts) // BATCH)
    for _ in range(max(epochs, -(-LEAST_STEPS // steps))):
        _, top = highest(net, (word, grams, first), codes, counts)
        other = np.where(counts > WINDOW, ends - counts + (r.random(len(counts)) * np.maximum(1, counts - WINDOW)).astype(np.int64), top)
        use = np.flatnonzero(counts > 0)
        begin = np.concatenate([top[use], other[use[labels[use] == 0]]])
        text = np.concatenate([use, use[labels[use] == 0]])
        order = r.permutation(len(begin))
        for k in range(0, len(order), BATCH):
            o = order[k : k + BATCH]
            ids = _ids(codes, begin[o], np.minimum(WINDOW, ends[text[o]] - begin[o]))
            used, back = np.unique(ids[ids >= 0], return_inverse=True)
            local = np.full(ids.shape, -1)
            local[ids >= 0] = back
            n = sizes[used]
            at = np.repeat(first[used], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            net.train((word[used], grams[at], np.cumsum(n) - n), local, labels[text[o]].astype(np.float32))
    best, _ = highest(net, (word, grams, first), codes, counts)
    floor = float(best[counts > 0].min()) if (counts > 0).any() else 0.0
    x = np.where(counts > 0, best, floor)
    scale, shift = 1.0, 0.0
    for _ in range(50):  # Newton steps of a logistic with a mild pull to (1, 0)
        q = _sigmoid(np.clip(scale * x + shift, -30, 30))
        w = q * (1 - q) + 1e-9
        grad = np.array([((q - labels) * x).sum() + (scale - 1), (q - labels).sum() + 0.1 * shift])
        hess = np.array([[(w * x * x).sum() + 1, (w * x).sum()], [(w * x).sum(), w.sum() + 0.1]])
        move = np.clip(np.linalg.solve(hess, grad), -1, 1)
        scale, shift = max(0.05, scale - move[0]), shift - move[1]
    net.moments = {}
    return {"net": net, "share": share, "floor": floor, "scale": float(scale), "shift": float(shift)}


def score(model: dict, texts: list[str]) -> np.ndarray:
    """Probability of label 1 of whole texts."""
    if model["net"] is None:
        return np.full(len(texts), model["share"])
    best, _ = highest(model["net"], *prepare(texts), empty=model["floor"])
    return _sigmoid(np.clip(model["scale"] * best + model["shift"], -30, 30))


def classify(docs: DataFrame, labels: DataFrame, *, folds: int = FOLDS, held_fold: int = HELD_FOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out and score of every row of ``docs`` (doc_id, text); learns ``labels`` (doc_id, toxic)."""
    spark = docs.sparkSession
    shared.prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = gam.fit_rows_of(labels, "toxic", folds, held_fold, fit_rows)
    chosen = rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y")).collect()
    chosen.sort(key=lambda r: r.doc_id)
    shipped = spark.sparkContext.broadcast(fit([r.text for r in chosen], np.array([r.y for r in chosen], np.float64)))

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(shipped.value, batch.column(1).to_pylist()))], names=["doc_id", "score"])

    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(gam.fold(folds) == held_fold, F.lit(False)).alias("held_out"), "score")


def op6_toxicity_gru(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels"))
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


QUERIES = {"op6_toxicity_gru": op6_toxicity_gru}
ORACLE_SQL: dict[str, str] = {}
