"""Sequential decoders: Viterbi paths, run repair, merging across interruptions, filtering, dead reckoning.

These are recurrences over a key's rows. Paths, filters and positions run as scans over chunks of a key (see ``scan``).
``viterbi``, ``repair`` and ``zero_phase`` are the same on one array in memory, for sessions and as what tests compare with.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelane import shipping, storage
from tidelane.operators import scan, sequence


def transitions(states: int = 6, stay: float = 0.97, enter: float = 0.01, leave: float = 0.05, cross: float = 0.001) -> np.ndarray:
    """Rows normalised; state 0 is the background."""
    m = np.full((states, states), cross)
    m[0, :], m[:, 0] = enter, leave
    np.fill_diagonal(m, stay)
    return m / m.sum(axis=1, keepdims=True)


def uniform_transitions(states: int, stay: float) -> np.ndarray:
    m = np.full((states, states), (1 - stay) / max(1, states - 1))
    np.fill_diagonal(m, stay)
    return m


def viterbi(p: np.ndarray, m: np.ndarray, eps: float = 1e-10, clip: bool = False) -> np.ndarray:
    """The likeliest path; equal scores go to the lowest state. ``eps`` is added to probabilities, or bounds them below."""
    logp, logm = fixed_logs(p, eps, clip), fixed_logs(m, eps, clip)
    score, back = logp[0].copy(), np.zeros(p.shape, np.int64)
    for t in range(1, len(p)):
        step = score[:, None] + logm
        back[t] = step.argmax(axis=0)
        score = step.max(axis=0) + logp[t]
    path = np.empty(len(p), np.int64)
    path[-1] = score.argmax()
    for t in range(len(p) - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def repair(path: np.ndarray, p: np.ndarray, least: int, passes: int = 2) -> np.ndarray:
    """Runs shorter than ``least`` take their neighbours' state, or the likelier one of two (the left one if equal)."""
    path = path.copy()
    for _ in range(passes):
        cuts = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
        ends = np.concatenate([cuts[1:], [len(path)]])
        if len(cuts) < 2:
            break
        labels, new = path[cuts], path.copy()
        for k, (a, b) in enumerate(zip(cuts, ends, strict=True)):
            if b - a >= least:
                continue
            sides = [labels[j] for j in (k - 1, k + 1) if 0 <= j < len(labels)]
            new[a:b] = sides[0] if len(sides) == 1 or sides[0] == sides[1] or p[a:b, sides[0]].mean() >= p[a:b, sides[1]].mean() else sides[1]
        path = new
    return path


#: Log probabilities are whole multiples of 1 / FIXED, so that sums don't depend on how a key is cut.
FIXED = 2.0**32
LOWEST = -(2**60)
#: Cells of the back pointers that are held at once.
CELLS = 32_000_000


def fixed_logs(p, eps: float, clip: bool):
    """Of a numpy array or a column of arrays: whole logs, rounded down from the half."""
    if isinstance(p, np.ndarray):
        return np.floor(np.log(np.clip(p, eps, 1) if clip else p + eps) * FIXED + 0.5).astype(np.int64)
    bounded = (lambda v: F.greatest(F.lit(eps), F.least(F.lit(1.0), v))) if clip else (lambda v: v + F.lit(eps))
    return F.transform(p, lambda v: F.floor(F.ln(bounded(v.cast("double"))) * F.lit(FIXED) + 0.5).cast("long"))


def _forward(logs: np.ndarray, size: np.ndarray, before: np.ndarray, has: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Final scores (chunk, matrix, state) and back pointers (place, chunk, matrix, state), all chunks a place at a time.

    ``before`` are the scores at the row before a chunk, where ``has``; equal scores come from the lowest state.
    """
    back = np.zeros((logs.shape[1], len(logs), *before.shape[1:]), np.int8)
    score = before
    for t in range(logs.shape[1]):
        step = score[..., :, None] + moves
        back[t] = step.argmax(axis=-2)
        new = step.max(axis=-2)
        if t == 0:
            new = np.where(has[:, None, None], new, 0)
        score = np.where((t < size)[:, None, None], new + logs[:, t, None, :], score)
    return score, back


def _trace(back: np.ndarray, size: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Paths (place, chunk, matrix, exit) that end in ``states`` (chunk, matrix, exit), and the states before them."""
    path = np.zeros((len(back), *states.shape), np.int8)
    now = states
    for t in range(len(back) - 1, -1, -1):
        here = (t < size)[:, None, None]
        path[t] = now
        now = np.where(here, np.take_along_axis(back[t], now.astype(np.int64), axis=-1), now)
    return path, now


def _dealt(size: np.ndarray, cells: int) -> Iterator[np.ndarray]:
    """Numbers of chunks by falling size, as many as the pointers' bound allows at ``cells`` a row."""
    order, at = np.argsort(-size, kind="stable"), 0
    while at < len(order):
        many = max(1, CELLS // max(1, int(size[order[at]]) * cells))
        yield order[at : at + many]
        at += many


def _batches(c: dict, moves: np.ndarray, extra: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Numbers, logs (chunk, place, state) and sizes of a batch's chunks, as many as the pointers' bound allows."""
    size, states = scan.lengths(c["rows"]), moves.shape[-1]
    logs = c["rows"].flatten().field("_logs").flatten().to_numpy().reshape(-1, states)
    for some in _dealt(size, moves.shape[0] * states * extra):
        yield some, scan.grid(logs[_rows(size, some)], size[some]), size[some]


def _rows(size: np.ndarray, some: np.ndarray) -> np.ndarray:
    starts = np.cumsum(size) - size
    return np.concatenate([np.arange(starts[k], starts[k] + size[k]) for k in some])


def whole_paths(p: np.ndarray, size: np.ndarray, matrices: list[np.ndarray], eps: float = 1e-10, clip: bool = False) -> np.ndarray:
    """Paths (row, matrix) of whole keys whose rows lie behind one another in ``p``, ``size`` rows each."""
    moves = np.stack([fixed_logs(np.asarray(m, np.float64), eps, clip) for m in matrices])
    logs, out = fixed_logs(p, eps, clip), np.empty((len(p), len(moves)), np.int8)
    for some in _dealt(size, moves.shape[0] * moves.shape[1]):
        rows, part = _rows(size, some), size[some]
        score, back = _forward(scan.grid(logs[rows], part), part, np.zeros((len(some), *moves.shape[:2]), np.int64), np.zeros(len(some), bool), moves)
        path, _ = _trace(back, part, score.argmax(axis=-1)[..., None])
        row, place = scan.places(part)
        out[rows] = path[place, row, :, 0]
    return out


def _taken(column: pa.Array, some: np.ndarray, *shape: int) -> np.ndarray:
    return column.take(pa.array(some)).flatten().to_numpy().reshape(len(some), *shape)


def with_paths(df: DataFrame, key: str, order: list[str], probs: str, matrices: list[np.ndarray], *, eps: float = 1e-10, clip: bool = False, name: str = "paths", size: int = scan.CHUNK) -> DataFrame:
    """Adds to every row an array of decoded states, one for each of ``matrices``.

    A max-plus matrix scan over chunks (see ``scan``): every chunk's product of its steps (by entry and exit state), a scan
    over these for the scores each chunk begins with, the entry state for each exit state under those scores, a backward
    scan over these, and a local back-trace. Logs are whole numbers, so the result is the one of a single pass, ties to the
    lowest state included. Keys of one chunk are decoded at once.
    """
    moves = np.stack([fixed_logs(np.asarray(m, np.float64), eps, clip) for m in matrices])
    count, states = moves.shape[:2]
    chunks = scan.chunked(df.withColumn("_logs", fixed_logs(F.col(probs), eps, clip)), key, order, size)
    whole = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])
    fields = df.columns
    none = lambda some: (np.zeros((len(some), count, states), np.int64), np.zeros(len(some), bool))

    def rows_with(c: dict, some: np.ndarray, size: np.ndarray, path: np.ndarray) -> dict:
        """Rows of chunks ``some`` with their paths (place, chunk, matrix)."""
        taken = c["rows"].take(pa.array(some)).flatten()
        row, place = scan.places(size)
        return {f: taken.field(f) for f in fields} | {name: pa.FixedSizeListArray.from_arrays(pa.array(path[place, row].astype(np.int32).ravel()), count)}

    def alone(c: dict) -> Iterator[dict]:
        for some, logs, size in _batches(c, moves, 1):
            score, back = _forward(logs, size, *none(some), moves)
            path, _ = _trace(back, size, score.argmax(axis=-1)[..., None])
            yield rows_with(c, some, size, path[..., 0])

    def products(c: dict) -> Iterator[dict]:
        first = c["first"].to_numpy(zero_copy_only=False)
        for some, logs, size in _batches(c, moves, states):
            entries = np.where(np.eye(states, dtype=bool), 0, LOWEST)
            before = np.broadcast_to(np.repeat(entries, count, axis=0), (len(some), states * count, states))
            wide = np.tile(moves, (states, 1, 1))
            score, _ = _forward(logs, size, before.copy(), ~first[some], wide)
            yield {"chunk": c["chunk"].take(pa.array(some)), key: c[key].take(pa.array(some)), "first": first[some], "product": list(score.reshape(len(some), -1))}

    def entries(c: dict) -> Iterator[dict]:
        first, last = (c[n].to_numpy(zero_copy_only=False) for n in ("first", "last"))
        for some, logs, size in _batches(c, moves, states):
            score, back = _forward(logs, size, _taken(c["scores"], some, count, states), ~first[some], moves)
            _, before = _trace(back, size, np.broadcast_to(np.arange(states), (len(some), count, states)).copy())
            yield {"chunk": c["chunk"].take(pa.array(some)), key: c[key].take(pa.array(some)), "last": last[some], "best": list(score.argmax(axis=-1)), "before": list(before.reshape(len(some), -1))}

    def traced(c: dict) -> Iterator[dict]:
        first = c["first"].to_numpy(zero_copy_only=False)
        for some, logs, size in _batches(c, moves, 1):
            _, back = _forward(logs, size, _taken(c["scores"], some, count, states), ~first[some], moves)
            path, _ = _trace(back, size, _taken(c["exits"], some, count, 1))
            yield rows_with(c, some, size, path[..., 0])

    def onward(scores: np.ndarray, row: dict) -> np.ndarray:
        product = np.array(row["product"]).reshape(states, count, states)
        new = product[0] if row["first"] else (scores.T[:, :, None] + product).max(axis=0)
        return new - new.max(axis=-1, keepdims=True)

    kind = dict(chunks.dtypes)[key]
    many, short = chunks.where("NOT (first AND last)"), scan.each(chunks.where("first AND last").select("rows"), alone, whole)
    if many.select("chunk").isEmpty():
        return short
    product = scan.each(many.select("chunk", key, "first", "rows"), products, f"chunk long, {key} {kind}, first boolean, product array<long>")
    scores = scan.carried(product, key, lambda row: np.zeros((count, states), np.int64), onward, lambda v: {"scores": v.ravel().tolist()}, "scores array<long>")
    many = storage.materialize(many.join(scores, "chunk"), "scores")
    entry = scan.each(many.select("chunk", key, "first", "last", "scores", "rows"), entries, f"chunk long, {key} {kind}, last boolean, best array<long>, before array<long>")
    back = lambda state, row: np.array(row["before"]).reshape(count, states)[np.arange(count), state]
    exits = scan.carried(entry, key, lambda row: np.array(row["best"]), back, lambda v: {"exits": v.tolist()}, "exits array<long>", backwards=True)
    found = scan.each(many.join(exits, "chunk").select("first", "scores", "exits", "rows"), traced, whole)
    return short.unionByName(found)


def with_path(df: DataFrame, key: str, order: list[str], probs: str, *, matrix: np.ndarray, least_run: int = 0, eps: float = 1e-10, clip: bool = False, name: str = "path", size: int = scan.CHUNK) -> DataFrame:
    """Adds the decoded state of every row; runs shorter than ``least_run`` are repaired."""
    out = with_paths(df, key, order, probs, [matrix], eps=eps, clip=clip, name="_paths", size=size).withColumn(name, F.get("_paths", F.lit(0))).drop("_paths")
    return repaired(out, key, order, name, probs, len(matrix), least_run) if least_run > 1 else out


def repaired_runs(runs: DataFrame, key: str, states: int, least: Column, passes: int = 2, more: dict[str, Column] | None = None) -> DataFrame:
    """Of a table of runs (key, _run, _label, _n rows, _sums of probabilities) those after ``repaired``; ``more`` says how
    other columns of joined runs come together."""
    w = Window.partitionBy(key).orderBy("_run")
    for _ in range(passes):
        before, after = F.lag("_label").over(w), F.lead("_label").over(w)
        mean = lambda label: F.round(F.get("_sums", label) / F.col("_n"), 9)
        given = F.when(before.isNull(), after).when(after.isNull() | (before == after), before).when(mean(before) >= mean(after), before).otherwise(after)
        runs = runs.withColumn("_given", given).withColumn("_label", F.when((F.col("_n") < least) & F.col("_given").isNotNull(), F.col("_given")).otherwise(F.col("_label"))).drop("_given")
        joined = sequence.runs(runs, key, ["_run"], "_label").groupBy(key, F.col("run_id").alias("_group"))
        total = F.array(*[F.sum(F.get("_sums", F.lit(k))) for k in range(states)])
        runs = joined.agg(F.first("_label").alias("_label"), F.sum("_n").alias("_n"), total.alias("_sums"), *[v.alias(n) for n, v in (more or {}).items()]).withColumnRenamed("_group", "_run")
    return runs


def repaired(df: DataFrame, key: str, order: list[str], state: str, probs: str, states: int, least: int, passes: int = 2) -> DataFrame:
    """``state`` with runs shorter than ``least`` given to their neighbours, twice: to the one that both agree on, else to
    the one of higher mean probability over the run (to nine digits; the earlier one if equal). A lone run stays.

    Runs are rows of a table from the first pass on: the second joins what became equal.
    """
    rows = sequence.runs(df, key, order, state).withColumnRenamed("run_id", "_run")
    sums = F.array(*[F.sum(F.element_at(probs, k + 1).cast("double")) for k in range(states)])
    runs = rows.groupBy(key, "_run").agg(F.first(state).alias("_label"), F.count(F.lit(1)).alias("_n"), sums.alias("_sums"))
    runs = repaired_runs(runs.withColumn("_runs", F.array("_run")), key, states, F.lit(least), passes, {"_runs": F.flatten(F.collect_list("_runs"))})
    named = runs.select(F.col(key).alias("_key"), F.explode("_runs").alias("_was"), "_label")
    out = rows.join(named, rows[key].eqNullSafe(named["_key"]) & (rows["_run"] == named["_was"]))
    return out.select(*[F.col("_label").cast(dict(df.dtypes)[state]).alias(c) if c == state else F.col(c) for c in df.columns])


def chained(segments: DataFrame, key: str, gap: Column, label: str, start: str, end: str) -> DataFrame:
    """``segments`` with ``chunk``, the place in the key from 1, and ``_head``, that of the segment which swallows it (or is
    it); see ``merge_interrupted``."""
    shipping.ship(segments.sparkSession)
    along, same = Window.partitionBy(key).orderBy(start, "start_idx"), Window.partitionBy(key, label).orderBy(start, "start_idx")
    placed = segments.withColumn("chunk", F.row_number().over(along).cast("long")).withColumn("first", F.col("chunk") == 1)
    near = F.lead(start).over(same) - F.col(end) <= gap
    over_two = (F.col("chunk") > 2) | F.when(F.col("first"), F.lead("chunk", 2).over(along).isNotNull()).otherwise(F.lead("chunk").over(along).isNotNull())
    placed = placed.withColumn("to", F.when(near & over_two & (gap > 0), F.lead("chunk").over(same)))
    ordered = placed.select("chunk", "first", "to", *[c for c in placed.columns if c not in ("chunk", "first", "to")]).repartition(key).sortWithinPartitions(key, "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = due = 0
        linked = False
        for batch in batches:
            heads = []
            for at, first, to in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if first:
                    head, due, linked = 0, 1, False
                if at == due:
                    head = head if linked else at
                    due, linked = (to, True) if to is not None else (at + 1, False)
                heads.append(head)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(heads, pa.int64())], names=[*batch.schema.names, "_head"])

    return ordered.mapInArrow(run, T.StructType([*ordered.schema.fields, T.StructField("_head", T.LongType())])).drop("first", "to")


def merge_interrupted(segments: DataFrame, key: str, gap: float, steps: DataFrame, probs: str, *, label: str = "class_idx", start: str = "start_ms", end: str = "end_ms") -> DataFrame:
    """From each segment on, the next of its class that starts within ``gap`` of its end swallows what is between, and so on
    from that one; the confidence becomes the mean probability over [start_idx, end_idx). Keys of up to two segments stay.

    ``segments`` has start_idx and end_idx (places in the key, the end excluded) besides its label, start, end and
    confidence, and rising starts within a key; ``steps`` has ``_i``, the place, and ``probs``. Which segment a segment goes
    on to depends on the two alone, so a window finds it; who is reached is read off in order, a row at a time. Means are
    differences of running sums of whole numbers.
    """
    joined = chained(segments, key, F.lit(gap), label, start, end)
    last = lambda c: F.max_by(c, "chunk").alias(c)
    first = lambda c: F.min_by(c, "chunk").alias(c)
    # A head's group ends with the last that it reached; what it swallowed lies before that.
    taken = {start: first, "start_idx": first, label: first, "confidence": first, end: last, "end_idx": last}
    groups = joined.groupBy(key, "_head").agg(*[taken[c](c) for c in taken], F.count(F.lit(1)).alias("_n"))
    whole = F.aggregate(F.transform(probs, lambda v: F.floor(v.cast("double") * F.lit(2.0**40) + 0.5).cast("long")), F.array().cast("array<long>"), lambda all_, v: F.array_append(all_, v))
    states = steps.select(F.col(key).alias("_key"), (F.col("_i") + 1).alias("_to"), whole.alias("_w")).select("_key", "_to", F.posexplode("_w").alias("_state", "_w"))
    sums = states.withColumn("_sum", F.sum("_w").over(Window.partitionBy("_key", "_state").orderBy("_to").rowsBetween(Window.unboundedPreceding, 0))).drop("_w")
    for side in ("start_idx", "end_idx"):
        found = sums.select("_key", "_state", F.col("_to").alias("_place"), F.col("_sum").alias(f"_{side}"))
        groups = groups.join(found, groups[key].eqNullSafe(found["_key"]) & (F.col(label) == F.col("_state")) & (F.col(side) == F.col("_place")), "left").drop("_key", "_state", "_place")
    mean = (F.col("_end_idx") - F.coalesce("_start_idx", F.lit(0))) / F.lit(2.0**40) / (F.col("end_idx") - F.col("start_idx"))
    return groups.select(key, label, start, end, "start_idx", "end_idx", F.when(F.col("_n") > 1, mean).otherwise(F.col("confidence")).alias("confidence"))


def butterworth(order: int = 4, cutoff: float = 40.0, rate: float = 100.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Low-pass coefficients by the bilinear transform, and the state that a constant input of 1 leaves."""
    warped = 2 * rate * np.tan(np.pi * cutoff / rate)
    poles = warped * np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    digital = (2 * rate + poles) / (2 * rate - poles)
    a = np.real(np.poly(digital))
    b = np.real(np.poly(-np.ones(order)))
    b *= a.sum() / b.sum()
    companion = np.zeros((order, order))
    companion[0], companion[1:, :-1] = -a[1:], np.eye(order - 1)
    zi = np.linalg.solve(np.eye(order) - companion.T, b[1:] - a[1:] * b[0])
    return b, a, zi


def zero_phase(x: np.ndarray, b: np.ndarray, a: np.ndarray, zi: np.ndarray) -> np.ndarray:
    """Filter forwards and backwards, with odd reflections of 3 * len(a) values at the ends."""
    pad = 3 * max(len(a), len(b))
    if len(x) <= pad:
        return x

    def once(y: np.ndarray) -> np.ndarray:
        z, out = [*(zi * y[0]).tolist(), 0.0], []
        first, rest = float(b[0]), list(zip(b[1:].tolist(), a[1:].tolist(), strict=True))
        for v in y.tolist():
            o = first * v + z[0]
            out.append(o)
            z = [z[k + 1] + p * v - q * o for k, (p, q) in enumerate(rest)] + [0.0]
        return np.array(out)

    wide = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    return once(once(wide)[::-1])[::-1][pad : len(x) + pad]


class Linear:
    """Values y = c.z + d x of a state z that goes on to a.z + b x, for columns of values; ``BLOCK`` of them at a time."""

    BLOCK = 64

    def __init__(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: float):
        n = self.BLOCK
        self.a, self.powers = a, [np.linalg.matrix_power(a, k) for k in range(n + 1)]
        reach = np.array([c @ p for p in self.powers[:n]])  # y at a place by the state before the block
        answer = np.concatenate([[d], reach[: n - 1] @ b])
        self.by_state, self.to_state = reach, np.stack([p @ b for p in reversed(self.powers[:n])], axis=1)
        self.by_input = np.array([[answer[i - j] if i >= j else 0.0 for j in range(n)] for i in range(n)])

    def run(self, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """y (place, column) and the state after it (state, column)."""
        n, out = self.BLOCK, np.empty_like(x)
        for at in range(0, len(x), n):
            part = x[at : at + n]
            k = len(part)
            out[at : at + k] = self.by_input[:k, :k] @ part + self.by_state[:k] @ z
            z = self.powers[k] @ z + self.to_state[:, n - k :] @ part
        return out, z

    def leap(self, z: np.ndarray, n: int, response: np.ndarray) -> np.ndarray:
        """The state ``n`` places on, where values alone would leave ``response``."""
        return np.linalg.matrix_power(self.a, n) @ z + response


def _filter_of(b: np.ndarray, a: np.ndarray) -> Linear:
    n = len(a) - 1
    step = np.zeros((n, n))
    step[:, 0], step[:-1, 1:] = -a[1:], np.eye(n - 1)
    return Linear(step, b[1:] - a[1:] * b[0], np.eye(n)[0], float(b[0]))


def linear_scan(chunks: DataFrame, key: str, system: Linear, column: str, width: int, start: np.ndarray | None, name: str, *, backwards: bool = False) -> DataFrame:
    """Adds ``name`` (the values of a chunk's rows, flat) to chunks: ``system`` over column ``column`` of ``width`` values a
    row, which lies in rows or is itself flat. It begins at ``start`` times the first value, or at zero."""
    turn = (lambda x: x[::-1]) if backwards else (lambda x: x)
    inside = column in chunks.schema["rows"].dataType.elementType.names
    states = system.a.shape[0]

    def values(c: dict) -> Iterator[np.ndarray]:
        size = scan.lengths(c["rows"])
        flat = (c["rows"].flatten().field(column) if inside else c[column]).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
        return (turn(x) for x in np.split(flat, np.cumsum(size)[:-1]))

    def summary(c: dict) -> Iterator[dict]:
        found = [(len(x), x[0].tolist(), system.run(x, np.zeros((states, width)))[1].ravel().tolist()) for x in values(c)]
        n, head, response = zip(*found, strict=True)
        yield {"chunk": c["chunk"], key: c[key], "first": c["first"], "last": c["last"], "n": list(n), "head": list(head), "response": list(response)}

    def begin(row: dict) -> np.ndarray:
        return np.zeros((states, width)) if start is None else np.outer(start, np.array(row["head"]))

    def apply(c: dict) -> Iterator[dict]:
        z = c["state"].flatten().to_numpy().reshape(-1, states, width)
        y = [turn(system.run(x, z[k])[0]).ravel().tolist() for k, x in enumerate(values(c))]
        yield {n: c[n] for n in names} | {name: y}

    names = ["chunk", key, "first", "last", "rows"]
    kind = dict(chunks.dtypes)[key]
    used = chunks.select(*names, *([] if inside else [column]))
    found = scan.each(used, summary, f"chunk long, {key} {kind}, first boolean, last boolean, n long, head array<double>, response array<double>")
    onward = lambda z, row: system.leap(z, row["n"], np.array(row["response"]).reshape(states, width))
    given = scan.carried(found, key, begin, onward, lambda z: {"state": z.ravel().tolist()}, "state array<double>", backwards=backwards)
    schema = T.StructType([*[chunks.schema[n] for n in names], T.StructField(name, T.ArrayType(T.DoubleType()))])
    return scan.each(used.join(given, "chunk"), apply, schema)


def lowpass(df: DataFrame, key: str, order: list[str], columns: list[str], *, cutoff: float = 40.0, rate: float = 100.0, least_rows: int = 100, size: int = scan.CHUNK) -> DataFrame:
    """Each column filtered forwards and backwards per key, with odd reflections at the ends, where there are more than
    ``least_rows`` rows; no filter at or over half the rate. Two linear scans over chunks."""
    if cutoff >= rate / 2:
        return df
    b, a, zi = butterworth(4, cutoff, rate)
    pad, system = 3 * len(a), _filter_of(b, a)
    counts = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_count")).where(F.col("_count") > max(least_rows, pad))
    is_long = df[key].eqNullSafe(counts["_key"])
    x = F.array(*[F.col(c).cast("double") for c in columns])
    rows = df.join(counts, is_long, "left_semi").withColumns({"_x": x, "_side": F.lit(0), "_pad": F.lit(0)})
    padded = rows
    for side, way in ((-1, F.asc), (1, F.desc)):
        end = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(*[way(c) for c in order]))).where(F.col("_rn") <= pad + 1)
        end = end.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_rn", "_x"))).alias("_r"))
        far = end.select(key, F.element_at("_r", 1)["_x"].alias("_e"), F.posexplode(F.slice("_r", 2, pad)).alias("_k", "_r"))
        padded = padded.unionByName(far.select(key, F.zip_with("_e", "_r._x", lambda e, v: 2 * e - v).alias("_x"), F.lit(side).alias("_side"), (F.lit(side) * (F.col("_k") + 1)).alias("_pad")), allowMissingColumns=True)
    chunks = scan.chunked(padded, key, ["_side", "_pad", *order], size)
    once = storage.materialize(linear_scan(chunks, key, system, "_x", len(columns), zi, "_y"), "filtered")
    twice = linear_scan(once, key, system, "_y", len(columns), zi, "_z", backwards=True)
    n = len(columns)
    flat = twice.select(F.posexplode("rows").alias("_k", "_row"), "_z").where("_row._side = 0")
    new = {c: F.element_at("_z", F.col("_k") * n + k + 1).cast(df.schema[c].dataType) for k, c in enumerate(columns)}
    return df.join(counts, is_long, "left_anti").unionByName(flat.select(*[new[c].alias(c) if c in new else F.col(f"_row.{c}").alias(c) for c in df.columns]))


#: Standard gravity.
GRAVITY = 9.80665


def dead_reckoning(df: DataFrame, key: str, order: list[str], *, alpha: float = 0.1, still: float = 0.02, still_frames: int = 5, size: int = scan.CHUNK) -> DataFrame:
    """Positions x, y from ax, ay (g), pitch and roll (degrees) and t_ms: gravity out, smoothing, zero-velocity resets.

    The smoothing is a linear scan. Speed and place are a second one: what a chunk does depends on how many still rows came
    just before it (0 to ``still_frames``, more count as that), on the speed and the place, and in the last two it is linear.
    """
    pitch, roll = F.radians(F.col("pitch").cast("double")), F.radians(F.col("roll").cast("double"))
    pull = F.array(F.col("ax").cast("double") + F.sin(pitch), F.col("ay").cast("double") - F.sin(roll) * F.cos(pitch))
    chunks = scan.chunked(df.withColumn("_a", pull), key, order, size)
    smoothed = storage.materialize(linear_scan(chunks, key, Linear(np.array([[1 - alpha]]), np.array([alpha]), np.array([1 - alpha]), alpha), "_a", 2, None, "_s"), "smoothed")
    kind, fields = dict(df.dtypes)[key], df.columns

    def parts(c: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        size = scan.lengths(c["rows"])
        cuts = np.cumsum(size)[:-1]
        time = c["rows"].flatten().field("t_ms").to_numpy(zero_copy_only=False).astype(np.float64)
        return zip(np.split(time, cuts), np.split(c["_s"].flatten().to_numpy().reshape(-1, 2), cuts), strict=True)

    def ends(c: dict) -> Iterator[dict]:
        yield {"chunk": c["chunk"], key: c[key], "first": c["first"], "last": c["last"], "time": [float(t[-1]) for t, _ in parts(c)]}

    def moved(t: np.ndarray, s: np.ndarray, before: float | None, quiet: int, v: np.ndarray, x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """Still rows at the end, speeds and places of a chunk's rows."""
        dt = np.diff(t, prepend=t[0] if before is None else before)
        dt = np.clip(dt, 5, 100) / 1000
        if before is None:
            dt[0] = 0
        at, is_still = np.arange(len(t)), np.abs(s).max(axis=1) < still
        last_move = np.maximum.accumulate(np.where(is_still, -1, at))
        count = np.where(last_move < 0, quiet + at + 1, at - last_move)
        stopped = is_still & (count >= still_frames)
        gained = np.cumsum(s * GRAVITY * dt[:, None], axis=0)
        stop = np.maximum.accumulate(np.where(stopped, at, -1))
        speed = gained + np.where((stop < 0)[:, None], v, -gained[stop])
        return min(still_frames, int(count[-1]) if is_still[-1] else 0), speed, x + np.cumsum(speed * dt[:, None], axis=0)

    def summary(c: dict) -> Iterator[dict]:
        """For each number of still rows before: those after, whether the speed before counts, speed, its share, place."""
        out = []
        for (t, s), before, first in zip(parts(c), c["before"].to_pylist(), c["first"].to_pylist(), strict=True):
            for quiet in range(still_frames + 1):
                zero = np.zeros(2)
                after, v, x = moved(t, s, None if first else before, quiet, zero, zero)
                _, w, y = moved(t, s, None if first else before, quiet, zero + 1, zero)
                out += [after, float(w[-1, 0] - v[-1, 0] > 0.5), *v[-1], float(y[-1, 0] - x[-1, 0]), *x[-1]]
        yield {"chunk": c["chunk"], key: c[key], "first": c["first"], "last": c["last"], "of": list(np.array(out).reshape(len(c["chunk"]), -1))}

    def onward(state: list[float], row: dict) -> list[float]:
        quiet, vx, vy, x, y = state
        after, keeps, gx, gy, share, px, py = row["of"][7 * int(quiet) : 7 * int(quiet) + 7]
        return [after, keeps * vx + gx, keeps * vy + gy, x + share * vx + px, y + share * vy + py]

    def apply(c: dict) -> Iterator[dict]:
        found = []
        for (t, s), before, first, state in zip(parts(c), c["before"].to_pylist(), c["first"].to_pylist(), c["state"].to_pylist(), strict=True):
            found.append(moved(t, s, None if first else before, int(state[0]), np.array(state[1:3]), np.array(state[3:]))[2])
        x, rows = np.concatenate(found), c["rows"].flatten()
        yield {n: rows.field(n) for n in fields} | {"x": x[:, 0], "y": x[:, 1]}

    head = f"chunk long, {key} {kind}, first boolean, last boolean"
    times = scan.carried(scan.each(smoothed, ends, f"{head}, time double"), key, lambda row: 0.0, lambda state, row: row["time"], lambda state: {"before": state}, "before double")
    smoothed = storage.materialize(smoothed.join(times, "chunk"), "timed")
    states = scan.carried(scan.each(smoothed, summary, f"{head}, of array<double>"), key, lambda row: [0.0] * 5, onward, lambda state: {"state": state}, "state array<double>")
    return scan.each(smoothed.join(states, "chunk"), apply, T.StructType([*df.schema.fields, T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))
