"""Queries over ordered rows: windows, smoothing, runs, decoding, segments."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelane.operators import decode, fusion, segments, sequence
from tidelane.plans import base
from tidelane.plans.base import KEY, ORDER

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _per_event(name: str, column):
    """A query that adds one column to every event."""
    return lambda spark, sf: base.events(spark, sf).select("user_id", "event_id", F.round(column(), 6).alias(name))


W, STEP = 20, 5


@query(f"WITH {base.IX}, w AS (SELECT user_id, i, n, t_ms, unnest(generate_series(0, (n - {W}) // {STEP})) AS win_id FROM ix WHERE n >= {W}) "
       f"SELECT user_id, win_id, max(t_ms) AS center_ms FROM w WHERE i = win_id * {STEP} + {W // 2} GROUP BY ALL")
def window_centers(spark, sf):
    w = sequence.count_windows(base.events(spark, sf), KEY, ORDER, W, STEP)
    return w.where(F.col("i") == F.col("win_id") * STEP + W // 2).select("user_id", "win_id", F.col("t_ms").alias("center_ms"))


@query(f"WITH {base.IX}, w AS (SELECT user_id, i, n, value, unnest(generate_series(0, (n - {W}) // {STEP})) AS win_id FROM ix WHERE n >= {W}) "
       f"SELECT user_id, win_id, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS lo, max(value) AS hi, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.75), 6) AS p75 "
       f"FROM w WHERE i BETWEEN win_id * {STEP} AND win_id * {STEP} + {W - 1} GROUP BY ALL")
def windowed_features(spark, sf):
    w = sequence.count_windows(base.events(spark, sf), KEY, ORDER, W, STEP)
    r = lambda c: F.round(c, 6)
    return w.groupBy("user_id", "win_id").agg(r(F.avg("value")).alias("mean"), r(F.stddev_pop("value")).alias("std"), F.min("value").alias("lo"), F.max("value").alias("hi"), r(F.percentile("value", 0.25)).alias("p25"), r(F.percentile("value", 0.75)).alias("p75"))


def _edge_sql(name: str, offsets: range, body: str) -> str:
    """SQL over the values at clamped offsets: ``v`` is their list."""
    return f"WITH {base.IX}, l AS (SELECT user_id, n, list(value ORDER BY i) AS a FROM ix GROUP BY user_id, n) SELECT ix.user_id, event_id, round({body}, 6) AS {name} FROM ix JOIN l ON ix.user_id = l.user_id".replace(
        "{v}", f"list_transform(generate_series({offsets[0]}, {offsets[-1]}), lambda d: a[CAST(greatest(0, least(ix.n - 1, i + d)) AS BIGINT) + 1])")


for _name, _k in (("moving_avg_edge_k7", 7), ("moving_avg_even_k8", 8)):
    QUERIES[_name] = _per_event("smoothed", lambda k=_k: sequence.moving_average("value", KEY, ORDER, k))
    SQL[_name] = _edge_sql("smoothed", range(-(_k // 2), _k - _k // 2), f"list_sum({{v}}) / {_k}")
QUERIES["median_edge_pad_k5"] = _per_event("median", lambda: sequence.median_filter("value", KEY, ORDER, 5, "edge"))
SQL["median_edge_pad_k5"] = _edge_sql("median", range(-2, 3), "list_sort({v})[3]")
QUERIES["median_zero_pad_k5"] = _per_event("median", lambda: sequence.median_filter("value", KEY, ORDER, 5))
SQL["median_zero_pad_k5"] = f"""WITH {base.IX}, l AS (SELECT user_id, list(value ORDER BY i) AS a FROM ix GROUP BY user_id)
SELECT ix.user_id, event_id, round(list_sort(list_transform(generate_series(-2, 2), lambda d: CASE WHEN i + d BETWEEN 0 AND n - 1 THEN a[CAST(i + d AS BIGINT) + 1] ELSE 0 END))[3], 6) AS median FROM ix JOIN l ON ix.user_id = l.user_id"""
QUERIES["gradient_local"] = _per_event("gradient", lambda: sequence.gradient("value", KEY, ORDER))
SQL["gradient_local"] = f"""WITH {base.IX}, s AS (SELECT *, lag(value) OVER w AS b, lead(value) OVER w AS a FROM ix WINDOW w AS (PARTITION BY user_id ORDER BY i))
SELECT user_id, event_id, round(CASE WHEN n = 1 THEN 0 WHEN b IS NULL THEN a - value WHEN a IS NULL THEN value - b ELSE (a - b) / 2 END, 6) AS gradient FROM s"""


@query(f"WITH {base.RUN} SELECT user_id, CAST(run_id AS BIGINT) AS run_id, any_value(state) AS state, min(t_ms) AS first_ms, max(t_ms) AS last_ms, count(*) AS n FROM run GROUP BY user_id, run_id")
def state_runs(spark, sf):
    r = sequence.runs(base.events(spark, sf), KEY, ORDER, "state")
    return r.groupBy("user_id", "run_id").agg(F.first("state").alias("state"), F.min("t_ms").alias("first_ms"), F.max("t_ms").alias("last_ms"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {base.RUN}, d AS (SELECT user_id, t_ms - lag(t_ms) OVER (PARTITION BY user_id ORDER BY i) AS d FROM ix), p AS (SELECT user_id, quantile_cont(d, 0.5) FILTER (WHERE d > 0) AS dt FROM d GROUP BY user_id)
SELECT user_id, CAST(run_id AS BIGINT) AS run_id, any_value(state) AS state, min(t_ms) AS start_ms, round(max(t_ms) + any_value(coalesce(dt, 10)), 3) AS end_ms FROM run JOIN p USING (user_id) GROUP BY user_id, run_id""")
def gt_runs_with_dt(spark, sf):
    ev = base.events(spark, sf)
    period = sequence.median_period(ev, KEY, ["t_ms", "event_id"], "t_ms", "dt")
    r = sequence.runs(ev, KEY, ORDER, "state").groupBy("user_id", "run_id").agg(F.first("state").alias("state"), F.min("t_ms").alias("start_ms"), F.max("t_ms").alias("b"))
    return r.join(period, "user_id").select("user_id", "run_id", "state", "start_ms", F.round(F.col("b") + F.coalesce("dt", F.lit(10.0)), 3).alias("end_ms"))


@query(f"""WITH {base.RUN}, r AS (SELECT user_id, run_id, any_value(state) AS state, min(t_ms) AS a, max(t_ms) AS b, avg(value) AS c FROM run GROUP BY user_id, run_id), e AS (SELECT user_id, max(t_ms) AS e FROM ev GROUP BY user_id)
SELECT user_id, CAST(run_id AS BIGINT) AS run_id, state, coalesce((lag(b) OVER w + a) / 2.0::DOUBLE, 0) AS start, coalesce((b + lead(a) OVER w) / 2.0::DOUBLE, e) AS "end", round(c, 6) AS confidence FROM r JOIN e USING (user_id) WINDOW w AS (PARTITION BY user_id ORDER BY run_id)""")
def midpoint_runs(spark, sf):
    ev = base.events(spark, sf).withColumn("last", F.max("t_ms").over(Window.partitionBy(KEY)))
    return segments.midpoint_runs(ev, KEY, ORDER, "state", "value", "t_ms", "last").select("user_id", "run_id", "state", "start", "end", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {base.IX}, c AS (SELECT *, CASE WHEN lag(state) OVER w <> state THEN 1.0 ELSE 0.0 END AS c FROM ix WINDOW w AS (PARTITION BY user_id ORDER BY i)),
m AS (SELECT *, max(c) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS m FROM c),
s AS (SELECT *, coalesce(lag(m) OVER w, m) + m + coalesce(lead(m) OVER w, m) AS s FROM m WINDOW w AS (PARTITION BY user_id ORDER BY i)) SELECT user_id, event_id, round(s / 3.0::DOUBLE, 6) AS boundary FROM s""")
def boundary_mask(spark, sf):
    return sequence.with_boundary(base.events(spark, sf), KEY, ORDER, "state").select("user_id", "event_id", F.round("boundary", 6).alias("boundary"))


@query("""SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS path, round(list_sort(p, 'DESC')[1] - list_sort(p, 'DESC')[2], 6) AS margin
FROM (SELECT vec_id, embedding, list_transform(e, lambda x: x / list_sum(e)) AS p FROM (SELECT vec_id, embedding, list_transform(embedding, lambda x: exp(CAST(x AS DOUBLE) - list_max(embedding))) AS e FROM embeddings))""")
def softmax_margin(spark, sf):
    e = base.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("z")).withColumn("p", fusion.softmax(F.col("z")))
    return e.select("vec_id", fusion.argmax(F.col("z")).alias("path"), F.round(fusion.margin(F.col("p")), 6).alias("margin"))


def posteriors(spark, sf):
    """Smoothed one-hot probabilities of five states at three widths, as three scales."""
    ev = base.events(spark, sf)
    for s in range(5):
        ev = ev.withColumn(f"h{s}", (F.col("state") == s).cast("double"))
    for name, k in (("p3", 3), ("p5", 5), ("p8", 9)):
        ev = ev.withColumn(name, F.array(*[sequence.moving_average(f"h{s}", KEY, ORDER, k) for s in range(5)]))
    return ev.select("user_id", "event_id", "t_ms", "state", "p3", "p5", "p8")


_SCALES = f"""{base.IX}, l AS (SELECT user_id, list(state ORDER BY i) AS a FROM ix GROUP BY user_id),
sc AS (SELECT ix.user_id, event_id, i, t_ms, n, state, {', '.join(f"list_transform([0, 1, 2, 3, 4], lambda s: list_sum(list_transform(generate_series({-(k // 2)}, {k // 2}), lambda d: CASE WHEN a[CAST(greatest(0, least(n - 1, i + d)) AS BIGINT) + 1] = s THEN 1.0::DOUBLE ELSE 0 END)) / {k}) AS {name}" for name, k in (('p3', 3), ('p5', 5), ('p8', 9)))} FROM ix JOIN l ON ix.user_id = l.user_id)"""
_ONE = ", ".join(f"round(f[{s + 1}], 6) AS f{s}" for s in range(5))


def _fused(spark, sf, mode):
    f = fusion.fuse(posteriors(spark, sf), KEY, ORDER, mode)
    return f.select("user_id", "event_id", *[F.round(F.element_at("fused", s + 1), 6).alias(f"f{s}") for s in range(5)])


def _mix(a: str, b: str, c: str) -> str:
    return f"list_transform([1, 2, 3, 4, 5], lambda s: (p3[s] * ({a}) + p5[s] * ({b}) + p8[s] * ({c})) / (({a}) + ({b}) + ({c})))"


for _mode, _w in (("average", ("1.0::DOUBLE",) * 3), ("weighted_long", ("0.15::DOUBLE", "0.30::DOUBLE", "0.55::DOUBLE")), ("weighted_balanced", ("0.25::DOUBLE", "0.35::DOUBLE", "0.40::DOUBLE"))):
    QUERIES[f"fusion_{_mode}"] = lambda spark, sf, mode=_mode: _fused(spark, sf, mode)
    SQL[f"fusion_{_mode}"] = f"WITH {_SCALES} SELECT user_id, event_id, {_ONE} FROM (SELECT *, {_mix(*_w)} AS f FROM sc)"
QUERIES["fusion_local_boundary"] = lambda spark, sf: _fused(spark, sf, "local_boundary")
_CHANGED = """c3 AS (SELECT *, list_position(p3, list_max(p3)) - 1 AS c FROM sc)"""
SQL["fusion_local_boundary"] = f"""WITH {_SCALES}, {_CHANGED}, ch AS (SELECT *, CASE WHEN lag(c) OVER (PARTITION BY user_id ORDER BY i) <> c THEN 1.0 ELSE 0.0 END AS x FROM c3),
mk AS (SELECT *, max(x) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS k FROM ch),
sm AS (SELECT *, (coalesce(lag(k) OVER w, k) + k + coalesce(lead(k) OVER w, k)) / 3.0::DOUBLE AS m FROM mk WINDOW w AS (PARTITION BY user_id ORDER BY i))
SELECT user_id, event_id, {_ONE} FROM (SELECT *, {_mix('0.20::DOUBLE + 0.30::DOUBLE * m', '0.35::DOUBLE - 0.08::DOUBLE * m', '0.45::DOUBLE - 0.22::DOUBLE * m')} AS f FROM sm)"""
_TOP = lambda p, k: f"list_reverse_sort({p})[{k}]"
_GAP = lambda p: f"({_TOP(p, 1)} - {_TOP(p, 2)})"
_VOTES = """vo AS (SELECT *, list_position(p3, list_max(p3)) AS c3, list_position(p5, list_max(p5)) AS c5, list_position(p8, list_max(p8)) AS c8 FROM sc),
di AS (SELECT *, CASE WHEN c3 = c5 AND c5 = c8 THEN 0 WHEN c3 = c5 OR c3 = c8 OR c5 = c8 THEN 1 - 2 / 3.0::DOUBLE ELSE 1 - 1 / 3.0::DOUBLE END AS split FROM vo)"""
_AROUND = lambda of, x, reach: f"list_sum(list_transform(generate_series(-{reach}, {reach}), lambda d: {of}.{x}[CAST(greatest(0, least(n - 1, i + d)) AS BIGINT) + 1])) / {2 * reach + 1}"
SQL["fusion_dynamic_boundary"] = f"""WITH {_SCALES}, {_VOTES}, la AS (SELECT *, lag(p3) OVER w AS q, coalesce(lag(c3) OVER w <> c3, false) OR coalesce(lead(c3) OVER w <> c3, false) AS turn FROM di WINDOW w AS (PARTITION BY user_id ORDER BY i)),
mo AS (SELECT *, CASE WHEN q IS NULL THEN 0.0::DOUBLE ELSE list_avg(list_transform(generate_series(1, 5), lambda k: abs(p3[k] - q[k]))) END AS v FROM la), ml AS (SELECT user_id, list(v ORDER BY i) AS vs FROM mo GROUP BY user_id),
en AS (SELECT mo.*, {_AROUND('ml', 'vs', 2)} AS e FROM mo JOIN ml ON mo.user_id = ml.user_id),
st AS (SELECT *, greatest(turn::DOUBLE, least(1, greatest(0, (0.18::DOUBLE - {_GAP('p3')}) / 0.18::DOUBLE)), least(1, greatest(0, e / 0.12::DOUBLE)), split) AS s FROM en)
SELECT user_id, event_id, {_ONE} FROM (SELECT *, {_mix('greatest(0.05, 0.20::DOUBLE + 0.35::DOUBLE * s)', 'greatest(0.05, 0.35::DOUBLE + 0.05::DOUBLE * (1 - abs(2 * s - 1)))', 'greatest(0.05, 0.45::DOUBLE - 0.30::DOUBLE * s)').replace('lambda s:', 'lambda j:').replace('[s]', '[j]')} AS f FROM st)"""
SQL["fusion_confident_conflict"] = f"""WITH {_SCALES}, {_VOTES}, ga AS (SELECT *, (split > 0 AND {_GAP('p3')} >= 0.12::DOUBLE AND {_GAP('p3')} - least({_GAP('p5')}, {_GAP('p8')}) >= 0.05::DOUBLE AND {_TOP('p3', 1)} - least({_TOP('p5', 1)}, {_TOP('p8', 1)}) >= 0.03::DOUBLE)::DOUBLE AS g FROM di),
gl AS (SELECT user_id, list(g ORDER BY i) AS gs FROM ga GROUP BY user_id), st AS (SELECT ga.*, {_AROUND('gl', 'gs', 1)} AS m FROM ga JOIN gl ON ga.user_id = gl.user_id)
SELECT user_id, event_id, {_ONE} FROM (SELECT *, {_mix('greatest(0.05, 0.20::DOUBLE + 0.28::DOUBLE * m)', 'greatest(0.05, 0.35::DOUBLE - 0.08::DOUBLE * m)', 'greatest(0.05, 0.45::DOUBLE - 0.20::DOUBLE * m)')} AS f FROM st)"""
QUERIES["fusion_dynamic_boundary"] = lambda spark, sf: _fused(spark, sf, "dynamic_boundary")
QUERIES["fusion_confident_conflict"] = lambda spark, sf: _fused(spark, sf, "confident_conflict")


@query(f"WITH {base.SEGD} SELECT user_id, class_idx, start_ms, end_ms, round(confidence, 6) AS confidence, duration_sec FROM segd")
def run_segments(spark, sf):
    return base.run_segments(spark, sf).select("user_id", "class_idx", "start_ms", "end_ms", base.six("confidence").alias("confidence"), "duration_sec")


_MERGED = base.SEG + """, mb AS (SELECT *, CASE WHEN lag(class_idx) OVER w = class_idx AND start_ms - lag(end_ms) OVER w < 172800000 THEN 0 ELSE 1 END AS brk FROM seg WINDOW w AS (PARTITION BY user_id ORDER BY start_ms, class_idx, end_ms)),
mi AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY start_ms, class_idx, end_ms ROWS UNBOUNDED PRECEDING) AS island FROM mb),
merged AS (SELECT user_id, any_value(class_idx) AS class_idx, min(start_ms) AS start_ms, arg_max(end_ms, start_ms) AS end_ms, list_reduce(list(confidence ORDER BY start_ms, end_ms), lambda a, b: (a + b) / 2) AS confidence, count(*) AS n_merged FROM mi GROUP BY user_id, island)"""


@query(f"WITH {_MERGED} SELECT user_id, class_idx, start_ms, end_ms, round(confidence, 6) AS confidence, n_merged FROM merged")
def merge_same_class(spark, sf):
    m = segments.merge_same_class(base.run_segments(spark, sf), KEY, 172_800_000)
    return m.select("user_id", "class_idx", "start_ms", "end_ms", base.six("confidence").alias("confidence"), "n_merged")


@query(f"""WITH {_MERGED}, a AS (SELECT *, row_number() OVER (PARTITION BY user_id, class_idx ORDER BY confidence DESC, start_ms, end_ms) AS c FROM merged),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c > 1, confidence DESC, start_ms, end_ms) AS r FROM a) SELECT user_id, class_idx, start_ms, end_ms, round(confidence, 6) AS confidence FROM b WHERE r <= 3""")
def topk_class_diverse(spark, sf):
    m = segments.merge_same_class(base.run_segments(spark, sf), KEY, 172_800_000)
    return segments.top_k_diverse(m, KEY, 3).select("user_id", "class_idx", "start_ms", "end_ms", base.six("confidence").alias("confidence"))


@query(f"""WITH {_MERGED}, b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY confidence DESC, end_ms - start_ms DESC, start_ms, class_idx) AS r FROM merged) SELECT user_id, class_idx, start_ms, end_ms FROM b WHERE r <= 5""")
def topk_plain(spark, sf):
    m = segments.merge_same_class(base.run_segments(spark, sf), KEY, 172_800_000)
    return segments.top_k_plain(m, KEY, 5).select("user_id", "class_idx", "start_ms", "end_ms")


@query(f"""WITH RECURSIVE {base.SEG}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_ms, class_idx, end_ms) AS k FROM seg),
f AS (SELECT user_id, k, [{{'s': start_ms, 'c': class_idx, 'e': end_ms, 'p': confidence}}] AS kept FROM o WHERE k = 1
 UNION ALL SELECT o.user_id, o.k, CASE WHEN o.start_ms >= kept[-1].e THEN list_append(kept, {{'s': o.start_ms, 'c': o.class_idx, 'e': o.end_ms, 'p': o.confidence}})
  WHEN o.class_idx = kept[-1].c THEN list_append(kept[:-2], {{'s': kept[-1].s, 'c': kept[-1].c, 'e': greatest(kept[-1].e, o.end_ms), 'p': kept[-1].p}})
  WHEN o.confidence > kept[-1].p THEN CASE WHEN o.end_ms > (o.start_ms + kept[-1].e) // 2 THEN list_concat(kept[:-2], [{{'s': kept[-1].s, 'c': kept[-1].c, 'e': (o.start_ms + kept[-1].e) // 2, 'p': kept[-1].p}}, {{'s': (o.start_ms + kept[-1].e) // 2, 'c': o.class_idx, 'e': o.end_ms, 'p': o.confidence}}]) ELSE kept END
  WHEN o.end_ms > kept[-1].e THEN list_append(kept, {{'s': kept[-1].e, 'c': o.class_idx, 'e': o.end_ms, 'p': o.confidence}}) ELSE kept END
 FROM f JOIN o ON o.user_id = f.user_id AND o.k = f.k + 1),
z AS (SELECT user_id, unnest(arg_max(kept, k)) AS r FROM f GROUP BY user_id) SELECT user_id, r.c AS class_idx, r.s AS start_ms, r.e AS end_ms, round(r.p, 6) AS confidence FROM z""")
def resolve_overlaps(spark, sf):
    return segments.resolve_overlaps(base.run_segments(spark, sf), KEY).select("user_id", "class_idx", "start_ms", "end_ms", base.six("confidence").alias("confidence"))


def _viterbi_sql(matrix, logs: str, eps: float, clip: bool) -> str:
    """CTEs down to ``vit``: user_id, i, event_id, p5 and path, a row of the recursion at a time."""
    moves = decode.fixed_logs(matrix, eps, clip).tolist()
    step = f"list_transform([1, 2, 3, 4, 5], lambda k: s[k] + ({moves})[k][j])"
    return f"""x AS (SELECT user_id, event_id, i, n, p5, list_transform(p5, lambda v: CAST(floor(ln({logs}) * 4294967296 + 0.5) AS BIGINT)) AS lp FROM sc),
f AS (SELECT user_id, i, n, lp AS s, CAST([] AS BIGINT[]) AS b FROM x WHERE i = 0
 UNION ALL SELECT x.user_id, x.i, x.n, list_transform([1, 2, 3, 4, 5], lambda j: list_max({step}) + lp[j]), list_transform([1, 2, 3, 4, 5], lambda j: list_position({step}, list_max({step})) - 1)
 FROM f JOIN x ON x.user_id = f.user_id AND x.i = f.i + 1),
g AS (SELECT user_id, i, list_position(s, list_max(s)) - 1 AS path, b FROM f WHERE i = n - 1 UNION ALL SELECT f.user_id, f.i, g.b[g.path + 1], f.b FROM g JOIN f ON f.user_id = g.user_id AND f.i = g.i - 1),
vit AS (SELECT x.user_id, x.i, x.event_id, p5, CAST(path AS INTEGER) AS path FROM g JOIN x ON x.user_id = g.user_id AND x.i = g.i)"""


def _repair_sql(of: str, name: str, least: int) -> str:
    mean = lambda label: f"round(q[{label} + 1] / n, 9)"
    return f"""{name}c AS (SELECT *, CASE WHEN path = lag(path) OVER (PARTITION BY user_id ORDER BY i) THEN 0 ELSE 1 END AS c FROM {of}), {name}r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY i) AS run FROM {name}c),
{name}g AS (SELECT user_id, run, any_value(path) AS path, count(*) AS n, [{', '.join(f'sum(p5[{k}])' for k in range(1, 6))}] AS q FROM {name}r GROUP BY user_id, run),
{name}w AS (SELECT *, lag(path) OVER w AS a, lead(path) OVER w AS z FROM {name}g WINDOW w AS (PARTITION BY user_id ORDER BY run)),
{name}n AS (SELECT user_id, run, CASE WHEN n >= {least} OR (a IS NULL AND z IS NULL) THEN path WHEN a IS NULL THEN z WHEN z IS NULL OR a = z THEN a WHEN {mean('a')} >= {mean('z')} THEN a ELSE z END AS path FROM {name}w),
{name} AS (SELECT r.user_id, r.i, r.event_id, r.p5, k.path FROM {name}r r JOIN {name}n k ON r.user_id = k.user_id AND r.run = k.run)"""


@query(f"WITH RECURSIVE {_SCALES}, {_viterbi_sql(decode.transitions(5), 'v + 1e-10', 1e-10, False)} SELECT user_id, event_id, path FROM vit")
def viterbi_path(spark, sf):
    p = posteriors(spark, sf).select("user_id", "event_id", "t_ms", "p5")
    return decode.with_path(p, KEY, ORDER, "p5", matrix=decode.transitions(5)).select("user_id", "event_id", "path")


@query(f"WITH RECURSIVE {_SCALES}, {_viterbi_sql(decode.uniform_transitions(5, 0.9), 'greatest(1e-12, least(1, v))', 1e-12, True)}, {_repair_sql('vit', 'ra', 3)}, {_repair_sql('ra', 'rb', 3)} SELECT user_id, event_id, path FROM rb")
def trl_viterbi_path(spark, sf):
    p = posteriors(spark, sf).select("user_id", "event_id", "t_ms", "p5")
    return decode.with_path(p, KEY, ORDER, "p5", matrix=decode.uniform_transitions(5, 0.9), eps=1e-12, clip=True, least_run=3).select("user_id", "event_id", "path")


def _lowpass_sql(least_rows: int) -> str:
    """The filter's recurrence a value at a time, forwards over the padded values and back again."""
    b, a, zi = (x.tolist() for x in decode.butterworth())
    start = lambda v: "[" + ", ".join(f"{z!r}::DOUBLE * {v}" for z in zi) + "]"
    y = f"({b[0]!r}::DOUBLE * w[t + 1] + z[1])"
    step = "[" + ", ".join((f"z[{k + 1}] + " if k < 4 else "") + f"{b[k]!r}::DOUBLE * w[t + 1] - ({a[k]!r}::DOUBLE) * {y}" for k in range(1, 5)) + "]"
    once = lambda name, of: f"""{name} AS (SELECT user_id, w, 0 AS t, {start('w[1]')} AS z, CAST([] AS DOUBLE[]) AS o FROM {of}
 UNION ALL SELECT user_id, w, t + 1, {step}, list_append(o, {y}) FROM {name} WHERE t < len(w))"""  # noqa: E731
    return f"""WITH RECURSIVE {base.IX}, l AS (SELECT user_id, list(value ORDER BY i) AS v, count(*) AS n FROM ix GROUP BY user_id HAVING count(*) > {least_rows}),
e AS (SELECT user_id, list_concat(list_transform(generate_series(16, 2, -1), lambda k: 2 * v[1] - v[k]), list_concat(v, list_transform(generate_series(1, 15), lambda k: 2 * v[n] - v[n - k]))) AS w FROM l),
{once('fw', 'e')}, h AS (SELECT user_id, list_reverse(o) AS w FROM fw WHERE t = len(w)), {once('bw', 'h')}, r AS (SELECT user_id, list_reverse(o) AS o FROM bw WHERE t = len(w))
SELECT ix.user_id, event_id, round(CASE WHEN o IS NULL THEN value ELSE o[i + 16] END, 6) AS filtered FROM ix LEFT JOIN r ON ix.user_id = r.user_id"""


@query(_lowpass_sql(50))
def lowpass_filtfilt(spark, sf):
    ev = base.events(spark, sf).select("user_id", "event_id", "t_ms", "value")
    return decode.lowpass(ev, KEY, ORDER, ["value"], least_rows=50).select("user_id", "event_id", F.round("value", 6).alias("filtered"))


_PULL = "CASE WHEN state < 3 THEN value / 10000 ELSE value / 100 END"


@query(f"""WITH RECURSIVE {base.IX}, a AS (SELECT user_id, event_id, i, t_ms, {_PULL} + sin(radians(state * 0.01::DOUBLE)) AS ax, value / 5000 - sin(radians(value / 100)) * cos(radians(state * 0.01::DOUBLE)) AS ay FROM ix),
r AS (SELECT user_id, CAST(-1 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS last, 0.0::DOUBLE AS s1, 0.0::DOUBLE AS s2, 0 AS q, 0.0::DOUBLE AS v1, 0.0::DOUBLE AS v2, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y FROM (SELECT DISTINCT user_id FROM ix)
 UNION ALL SELECT user_id, i, t_ms, p1, p2, k, w1, w2, x + w1 * dt, y + w2 * dt FROM (
  SELECT *, CASE WHEN k >= 3 THEN 0 ELSE v1 + p1 * 9.80665::DOUBLE * dt END AS w1, CASE WHEN k >= 3 THEN 0 ELSE v2 + p2 * 9.80665::DOUBLE * dt END AS w2 FROM (
   SELECT *, CASE WHEN greatest(abs(p1), abs(p2)) < 0.06::DOUBLE THEN q + 1 ELSE 0 END AS k FROM (
    SELECT a.user_id, a.i, a.t_ms, 0.8::DOUBLE * ax + 0.2::DOUBLE * s1 AS p1, 0.8::DOUBLE * ay + 0.2::DOUBLE * s2 AS p2, q, v1, v2, x, y, CASE WHEN last IS NULL THEN 0 ELSE least(greatest(t_ms - last, 5), 100) / 1000.0::DOUBLE END AS dt
    FROM r JOIN a ON a.user_id = r.user_id AND a.i = r.i + 1))))
SELECT a.user_id, a.event_id, round(x, 6) AS x, round(y, 6) AS y FROM r JOIN a ON a.user_id = r.user_id AND a.i = r.i""")
def dead_reckoning(spark, sf):
    """Events as samples: values as pulls (small ones, still frames, for the first three states), states as pitch."""
    pull = F.when(F.col("state") < 3, F.col("value") / 10000).otherwise(F.col("value") / 100)
    ev = base.events(spark, sf).select("user_id", "event_id", "t_ms", pull.alias("ax"), (F.col("value") / 5000).alias("ay"), (F.col("state") * 0.01).alias("pitch"), (F.col("value") / 100).alias("roll"))
    return decode.dead_reckoning(ev, KEY, ORDER, alpha=0.8, still=0.06, still_frames=3).select("user_id", "event_id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@query(f"""WITH RECURSIVE {_SCALES}, q AS (SELECT *, list_position(p5, list_max(p5)) - 1 AS path FROM sc), c AS (SELECT *, CASE WHEN path = lag(path) OVER (PARTITION BY user_id ORDER BY i) THEN 0 ELSE 1 END AS c FROM q),
d AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY i) AS run FROM c),
s AS (SELECT user_id, any_value(path) AS class_idx, min(t_ms) - 21600000 AS a, max(t_ms) + 21600000 AS z, min(i) AS ia, max(i) + 1 AS iz, avg(list_max(p5)) AS p FROM d GROUP BY user_id, run HAVING any_value(path) > 0),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY a, ia) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM s),
t AS (SELECT *, CASE WHEN n > 2 AND lead(a) OVER w - z <= 86400000 THEN lead(k) OVER w END AS nx FROM o WINDOW w AS (PARTITION BY user_id, class_idx ORDER BY a, ia)),
r AS (SELECT user_id, k, k AS head, nx FROM t WHERE k = 1 UNION ALL SELECT t.user_id, t.k, CASE WHEN r.nx IS NULL THEN t.k ELSE r.head END, t.nx FROM r JOIN t ON t.user_id = r.user_id AND t.k = coalesce(r.nx, r.k + 1)),
g AS (SELECT r.user_id, head, count(*) AS n, min_by(class_idx, t.k) AS class_idx, min_by(a, t.k) AS a, max_by(z, t.k) AS z, min_by(ia, t.k) AS ia, max_by(iz, t.k) AS iz, min_by(p, t.k) AS p FROM r JOIN t ON t.user_id = r.user_id AND t.k = r.k GROUP BY r.user_id, head),
m AS (SELECT g.user_id, g.head, avg(p5[class_idx + 1]) AS c FROM g JOIN q ON q.user_id = g.user_id AND q.i >= g.ia AND q.i < g.iz GROUP BY g.user_id, g.head)
SELECT g.user_id, class_idx, a AS start_ms, z AS end_ms, CAST(ia AS BIGINT) AS start_idx, CAST(iz AS BIGINT) AS end_idx, round(CASE WHEN n > 1 THEN c ELSE p END, 6) AS confidence FROM g JOIN m ON m.user_id = g.user_id AND m.head = g.head""")
def merge_interrupted(spark, sf):
    """Runs of the likeliest state, merged across interruptions, with the mean probability over all that lies between."""
    p = posteriors(spark, sf).withColumn("path", fusion.argmax(F.col("p5"))).withColumn("prob", F.array_max("p5"))
    found = segments.from_states(p, KEY, ORDER, "path", "prob", "t_ms", base.PAD_MS).withColumn("end_idx", F.col("end_idx") + 1)
    steps = p.select(KEY, sequence.place(KEY, ORDER).cast("long").alias("_i"), "p5")
    merged = decode.merge_interrupted(found, KEY, 86_400_000, steps, "p5")
    return merged.select("user_id", "class_idx", "start_ms", "end_ms", "start_idx", "end_idx", F.round("confidence", 6).alias("confidence"))


@query("WITH r AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) SELECT user_id, event_id FROM r WHERE k <= 10")
def last_n_per_user(spark, sf):
    return sequence.last_n(base.table(spark, sf, "events"), KEY, [F.desc("ts"), F.desc("event_id")], 10).select("user_id", "event_id")


@query("WITH c AS (SELECT o_custkey, o_orderkey, coalesce(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM orders) SELECT o_custkey, o_orderkey FROM c WHERE b < 500000")
def budget_gate(spark, sf):
    return sequence.budget_gate(base.table(spark, sf, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice", 500_000.0).select("o_custkey", "o_orderkey")


@query(f"WITH {base.IX}, d AS (SELECT user_id, t_ms - lag(t_ms) OVER (PARTITION BY user_id ORDER BY i) AS d FROM ix) SELECT user_id, quantile_cont(d, 0.5) FILTER (WHERE d > 0) AS period FROM d GROUP BY user_id")
def median_period(spark, sf):
    return sequence.median_period(base.events(spark, sf), KEY, ["t_ms", "event_id"], "t_ms")


@query(f"""WITH {base.IX}, g AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS x FROM ix), f AS (SELECT user_id, event_id, x, i,
 last_value(x IGNORE NULLS) OVER a AS xa, last_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ia, first_value(x IGNORE NULLS) OVER b AS xb, first_value(CASE WHEN x IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ib
 FROM g WINDOW a AS (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT user_id, event_id, round(coalesce(x, xa + (xb - xa) * (i - ia) / nullif(ib - ia, 0), xa, xb, 0), 6) AS filled FROM f""")
def interp_gap_fill(spark, sf):
    ev = base.events(spark, sf).withColumn("x", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    return sequence.interpolate(ev, KEY, ORDER, "x", "filled").select("user_id", "event_id", F.round("filled", 6).alias("filled"))


@query(f"WITH {base.IX} SELECT user_id, event_id, last_value(CASE WHEN state = 4 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS held FROM ix")
def last_known_merge(spark, sf):
    ev = base.events(spark, sf).withColumn("x", F.when(F.col("state") == 4, F.col("value")))
    return ev.select("user_id", "event_id", sequence.hold("x", KEY, ORDER).alias("held"))
