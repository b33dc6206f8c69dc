"""Queries over joins, matches, evaluation, statistics, parsing and splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelane.functions import scalars
from tidelane.operators import clean, evaluate, intervals, segments, sequence, stats
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


r6 = lambda c: F.round(c, 6)
_DAY = 86_400_000


def _labels(spark, sf):
    """Segments of the raw runs as label rows, numbered by user and start."""
    seg = base.run_segments(spark, sf)
    return seg.withColumn("row_no", F.row_number().over(Window.partitionBy(KEY).orderBy("start_ms", "class_idx"))).withColumn("cls", F.col("class_idx"))


@query(f"""WITH {base.SEG}, lab AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_ms, class_idx) AS row_no FROM seg)
SELECT ev.event_id, ev.user_id, CAST(coalesce(arg_max(lab.class_idx, row_no), 0) AS INTEGER) AS label FROM ev LEFT JOIN lab ON ev.user_id = lab.user_id AND t_ms BETWEEN start_ms AND end_ms GROUP BY ev.event_id, ev.user_id""")
def interval_label_join(spark, sf):
    points = base.events(spark, sf).select("event_id", "user_id", "t_ms")
    return intervals.label_points(points, _labels(spark, sf), KEY, "t_ms", ["event_id"], state="cls").select("event_id", "user_id", "label")


@query(f"""WITH {base.SEG}, lab AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY start_ms, class_idx) AS row_no FROM seg)
SELECT lab.user_id, row_no, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(sqrt(avg(value * value)), 6) AS rms FROM ev JOIN lab ON ev.user_id = lab.user_id AND t_ms BETWEEN start_ms AND end_ms GROUP BY ALL HAVING count(*) >= 2""")
def segment_slice_stats(spark, sf):
    s = intervals.slices(base.events(spark, sf), _labels(spark, sf), KEY, "t_ms")
    out = s.groupBy("user_id", F.col("row_no").cast("long").alias("row_no")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean"), r6(F.stddev_pop("value")).alias("std"), r6(F.sqrt(F.avg(F.col("value") * F.col("value")))).alias("rms"))
    return out.where("n >= 2")


@query(f"WITH {base.PAIRS} SELECT user_id, class_idx, pred_id, gold_id, round(iou, 6) AS iou FROM matched")
def greedy_match(spark, sf):
    gold, pred = base.gold_and_pred(spark, sf)
    return evaluate.matches(pred, gold, KEY).select("user_id", "class_idx", "pred_id", "gold_id", r6("iou").alias("iou"))


@query(f"WITH {base.PAIRS} SELECT user_id, class_idx, pred_id, gold_id, round(iou, 6) AS iou FROM cand WHERE iou > 0.1")
def iou_candidates(spark, sf):
    gold, pred = base.gold_and_pred(spark, sf)
    return intervals.candidates(pred, gold, [KEY, "class_idx"], 0.1).select("user_id", "class_idx", "pred_id", "gold_id", r6("iou").alias("iou"))


@query(f"WITH {base.USERF} SELECT user_id, tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall, round(f1, 6) AS f1 FROM uf")
def segment_prf(spark, sf):
    gold, pred = base.gold_and_pred(spark, sf)
    out = evaluate.per_user(pred, gold, evaluate.matches(pred, gold, KEY), KEY)
    return out.select("user_id", "tp", "fp", "fn", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query(f"""WITH {base.PAIRS}, u AS (SELECT user_id, class_idx, 1 AS g, 0 AS p, 0 AS m FROM gold UNION ALL SELECT user_id, class_idx, 0, 1, 0 FROM pred WHERE user_id IN (SELECT user_id FROM gold) UNION ALL SELECT user_id, class_idx, 0, 0, 1 FROM matched),
s AS (SELECT user_id, class_idx, CASE WHEN GROUPING(user_id) = 0 THEN 1 WHEN GROUPING(class_idx) = 0 THEN 2 ELSE 3 END AS level, CAST(sum(m) AS BIGINT) AS tp, CAST(sum(p) - sum(m) AS BIGINT) AS fp, CAST(sum(g) - sum(m) AS BIGINT) AS fn FROM u GROUP BY GROUPING SETS ((user_id), (class_idx), ()))
SELECT level, user_id, class_idx, tp, fp, fn, round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM s""")
def segment_prf_grouping_sets(spark, sf):
    gold, pred = base.gold_and_pred(spark, sf)
    return evaluate.grouped(pred, gold, evaluate.matches(pred, gold, KEY), KEY).select("level", "user_id", "class_idx", "tp", "fp", "fn", r6("f1").alias("f1"))


_ERR = """count(*) AS n, round(avg(iou), 6) AS mean_iou, round(quantile_cont(iou, 0.5), 6) AS median_iou, round(avg(abs(p0 - g0)) / 1000, 6) AS start_mae, round(avg(abs(p1 - g1)) / 1000, 6) AS end_mae,
 round(avg(p0 - g0) / 1000, 6) AS start_bias, round(avg(p1 - g1) / 1000, 6) AS end_bias, round(avg(abs((p1 - g1) - (p0 - g0))) / 1000, 6) AS duration_mae"""


@query(f"WITH {base.PAIRS} SELECT class_idx, {_ERR} FROM cand WHERE iou > 0.1 GROUP BY class_idx")
def boundary_by_group(spark, sf):
    gold, pred = base.gold_and_pred(spark, sf)
    e = evaluate.boundary_errors(intervals.candidates(pred, gold, [KEY, "class_idx"], 0.1), ["class_idx"])
    return e.select("class_idx", "n", *[r6(c).alias(c) for c in e.columns[2:]])


@query(f"WITH {base.PAIRS} SELECT {_ERR} FROM cand WHERE iou > 0.1")
def boundary_errors(spark, sf):
    gold, pred = base.gold_and_pred(spark, sf)
    e = evaluate.boundary_errors(intervals.candidates(pred, gold, [KEY, "class_idx"], 0.1), [])
    return e.select("n", *[r6(c).alias(c) for c in e.columns[1:]])


@query(f"WITH {base.PAIRS} SELECT p.user_id, p.pred_id, CAST(m.pred_id IS NOT NULL AS INTEGER) AS correct FROM pred p LEFT JOIN matched m ON p.user_id = m.user_id AND p.pred_id = m.pred_id")
def correctness_rows(spark, sf):
    gold, pred = base.gold_and_pred(spark, sf)
    return evaluate.correct_rows(pred, evaluate.matches(pred, gold, KEY), KEY).select("user_id", "pred_id", "correct")


@query(f"""WITH {base.PAIRS}, q AS (SELECT quantile_cont(end_ms - start_ms, 1.0 / 3) AS a, quantile_cont(end_ms - start_ms, 2.0 / 3) AS b FROM gold)
SELECT CASE WHEN end_ms - start_ms <= a THEN 'Short' WHEN end_ms - start_ms <= b THEN 'Medium' ELSE 'Long' END AS bin, count(*) AS n FROM gold, q GROUP BY 1""")
def tertile_bins(spark, sf):
    gold, _ = base.gold_and_pred(spark, sf)
    d = gold.select((F.col("end_ms") - F.col("start_ms")).alias("d"))
    cut = d.agg(F.percentile("d", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q"))
    bin_ = F.when(F.col("d") <= F.col("q")[0], "Short").when(F.col("d") <= F.col("q")[1], "Medium").otherwise("Long")
    return d.join(F.broadcast(cut)).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # cut: one row


_CAL = "c AS (SELECT least(1 - 1e-6::DOUBLE, greatest(1e-6::DOUBLE, n_chars / 20000.0::DOUBLE)) AS p, CAST(quality AS DOUBLE) AS y FROM labels JOIN documents USING (doc_id)), b AS (SELECT *, CAST(least(4, floor(p * 5)) AS INTEGER) AS bin FROM c)"


def _calibration(spark, sf):
    d = base.table(spark, sf, "documents").select("doc_id", (F.col("n_chars") / 20000.0).alias("p"))
    return d.join(base.table(spark, sf, "labels"), "doc_id").select("p", F.col("quality").alias("y"))


@query(f"WITH {_CAL} SELECT bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate FROM b GROUP BY bin")
def calibration_bins(spark, sf):
    return stats.calibration_bins(_calibration(spark, sf), "p", "y").select("bin", "n", r6("mean_p").alias("mean_p"), r6("rate").alias("rate"))


@query(f"""WITH {_CAL}, s AS (SELECT bin, count(*) AS n, avg(p) AS mp, avg(y) AS ry FROM b GROUP BY bin)
SELECT round(e.ece, 6) AS ece, round(e.mce, 6) AS mce, round(avg((p - y) * (p - y)), 6) AS brier, round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS nll, round(avg(p) - avg(y), 6) AS gap, count(*) AS n
FROM c, (SELECT sum(n * abs(mp - ry)) / sum(n) AS ece, max(abs(mp - ry)) AS mce FROM s) e GROUP BY e.ece, e.mce""")
def calibration_summary(spark, sf):
    s = stats.calibration_summary(_calibration(spark, sf), "p", "y")
    return s.select(*[r6(c).alias(c) for c in ("ece", "mce", "brier", "nll", "gap")], "n")


@query(f"""WITH {_CAL}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS k FROM (SELECT n_chars / 20000.0::DOUBLE AS p, quality AS y FROM labels JOIN documents USING (doc_id)))
SELECT round((sum(k) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * sum(1 - y))::DOUBLE, 6) AS auroc FROM r""")
def rank_auroc(spark, sf):
    return stats.rank_auroc(_calibration(spark, sf), "p", "y").select(r6("auroc").alias("auroc"))


@query(f"WITH {base.EV}, s AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS side, event_type FROM ev), c AS (SELECT event_type, count(*) FILTER (WHERE side = 'a') AS a, count(*) FILTER (WHERE side = 'b') AS b FROM s GROUP BY 1), p AS (SELECT a / sum(a) OVER () + 1e-12 AS a, b / sum(b) OVER () + 1e-12 AS b FROM c) "
       "SELECT round(sqrt(greatest(0, sum(a * log2(a / ((a + b) / 2)) + b * log2(b / ((a + b) / 2))) / 2)), 6) AS js FROM p")
def cohort_shift_js(spark, sf):
    ev = base.events(spark, sf).withColumn("side", F.when(F.col("user_id") % 2 == 0, "a").otherwise("b"))
    return stats.js_distance(ev, "side", "event_type").select(r6("js").alias("js"))


@query(f"""WITH {base.EV}, c AS (SELECT floor(value) AS v, sum(CASE WHEN user_id % 2 = 0 THEN 1.0 ELSE 0 END) AS a, sum(CASE WHEN user_id % 2 <> 0 THEN 1.0 ELSE 0 END) AS b FROM ev GROUP BY 1),
g AS (SELECT abs(sum(a) OVER (ORDER BY v) / sum(a) OVER () - sum(b) OVER (ORDER BY v) / sum(b) OVER ()) AS gap, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM c),
k AS (SELECT max(gap) AS d, any_value(na) AS na, any_value(nb) AS nb FROM g) SELECT round(d, 6) AS ks, round(least(1, greatest(0, 2 * list_sum(list_transform(generate_series(1, 100), lambda i: (CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END) * exp(-2.0::DOUBLE * i * i * d * d * na * nb / (na + nb)))))), 6) AS p_value FROM k""")
def cohort_shift_ks(spark, sf):
    ev = base.events(spark, sf).withColumn("side", F.when(F.col("user_id") % 2 == 0, "a").otherwise("b")).withColumn("v", F.floor("value"))
    return stats.ks_statistic(ev, "side", "v").select(r6("ks").alias("ks"), r6("p_value").alias("p_value"))


@query("""WITH u AS (SELECT user_id, avg(value) FILTER (WHERE event_type = 'view') AS a, avg(value) FILTER (WHERE event_type = 'click') AS b FROM events GROUP BY user_id), d AS (SELECT a - b AS d FROM u WHERE a IS NOT NULL AND b IS NOT NULL),
r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS k FROM d WHERE d <> 0),
t AS (SELECT sum(CASE WHEN d > 0 THEN k ELSE 0 END) AS w, CAST(count(*) AS DOUBLE) AS n FROM r), g AS (SELECT coalesce(sum(c * c * c - c), 0) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS c FROM r GROUP BY abs(d))),
z AS (SELECT greatest(-8, least(8, (w - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48))) AS z FROM t, g),
y AS (SELECT list_reduce(list_transform(generate_series(0, 200), lambda k: {'k': k, 't': z, 's': z}), lambda a, b: {'k': b.k, 't': a.t * b.t * b.t / (2 * b.k + 1), 's': a.s + a.t * b.t * b.t / (2 * b.k + 1)}).s AS s, z FROM z),
e AS (SELECT list_reduce(list_prepend(list_transform(generate_series(0, 1275), lambda s: CASE WHEN s = 0 THEN 1.0::DOUBLE ELSE 0 END), list_transform(generate_series(1, CAST(least(n, 50) AS BIGINT)), lambda k: [CAST(k AS DOUBLE)])),
 lambda a, k: list_transform(generate_series(1, 1276), lambda i: a[i] + CASE WHEN i > k[1] THEN a[CAST(i - k[1] AS BIGINT)] ELSE 0 END)) AS ways, w, n FROM t)
SELECT (SELECT count(*) FROM d) AS n, round((SELECT avg(d) FROM d), 6) AS mean_diff, round((SELECT avg(d) / stddev_samp(d) FROM d), 6) AS cohen_d, CAST(w AS DOUBLE) AS w_plus,
 round(CASE WHEN n <= 50 AND ties = 0 AND n = (SELECT count(*) FROM d) THEN list_sum(list_filter(ways, lambda v, s: s > w)) / pow(2, n) ELSE greatest(0, 0.5 - s * exp(-z * z / 2) / sqrt(2 * pi())) END, 6) AS p_value FROM e, y, g""")
def paired_effect(spark, sf):
    u = base.events(spark, sf).groupBy("user_id").agg(F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("a"), F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("b"))
    out = stats.paired_effect(u.where("a IS NOT NULL AND b IS NOT NULL"), "a", "b")
    return out.select("n", r6("mean_diff").alias("mean_diff"), r6("cohen_d").alias("cohen_d"), "w_plus", r6("p_value").alias("p_value"))


@query(f"""WITH {base.USERF}, b AS (SELECT b, user_id, CAST(floor(f1 * 1000000000 + 0.5) AS BIGINT) AS x, CAST('0x' || md5('42:' || b || ':' || user_id)[1:8] AS BIGINT) AS u FROM uf, (SELECT unnest(generate_series(0, 9999)) AS b)),
w AS (SELECT b, x, {' + '.join(f'(u >= {t})::BIGINT' for t in stats.poisson_limits())} AS w FROM b), m AS (SELECT b, CAST(sum(w * x) AS BIGINT)::DOUBLE / CAST(sum(w) AS BIGINT) / 1000000000 AS m FROM w WHERE w > 0 GROUP BY b)
SELECT round((SELECT CAST(sum(x) AS BIGINT)::DOUBLE / count(*) / 1000000000 FROM b WHERE b = 0), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.975), 6) AS high FROM m""")
def bootstrap_ci(spark, sf):
    gold, pred = base.gold_and_pred(spark, sf)
    out = stats.bootstrap_ci(evaluate.per_user(pred, gold, evaluate.matches(pred, gold, KEY), KEY), "f1", KEY)
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query("SELECT round(sum(n * (mu - o) * (mu - o)) / sum(n * v), 6) AS ratio FROM (SELECT event_type, count(*) AS n, avg(value) AS mu, var_pop(value) AS v FROM events GROUP BY 1), (SELECT avg(value) AS o FROM events)")
def variance_ratio(spark, sf):
    return stats.variance_ratio(base.table(spark, sf, "events"), "event_type", "value").select(r6("ratio").alias("ratio"))


_MICRO = lambda q: f"floor({q} / 1000 + 0.5001::DOUBLE) / 1e6::DOUBLE"


@query(f"""WITH {base.RUN}, s AS (SELECT user_id, max(t_ms) - min(t_ms) + 43200000 AS d, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) * 10000 // count(*) AS x FROM run GROUP BY user_id, run_id HAVING any_value(state) > 0)
SELECT u.user_id, count(d) AS n, coalesce(CAST(sum(d) AS BIGINT), 0) / 1000.0::DOUBLE AS active_s, {_MICRO('CAST(CAST(sum(x) AS BIGINT) // count(x) AS DOUBLE)')} AS mean_conf, {_MICRO('quantile_cont(x, 0.1)')} AS p10, {_MICRO('quantile_cont(x, 0.9)')} AS p90,
 quantile_cont(d, 0.5) / 1000 AS median_dur FROM (SELECT DISTINCT user_id FROM ev) u LEFT JOIN s ON u.user_id = s.user_id GROUP BY 1""")
def user_summary(spark, sf):
    """Segments of each user; confidences (mean value over 1000) in whole billionths, so that no sum depends on its order."""
    run = sequence.runs(base.events(spark, sf), KEY, ORDER, "state").groupBy(KEY, "run_id").agg(
        F.first("state").alias("state"), (F.max("t_ms") - F.min("t_ms") + 2 * base.PAD_MS).alias("d"), F.expr("sum(CAST(round(value * 100) AS BIGINT)) * 10000 div count(*)").alias("x")
    ).where("state > 0")
    users = base.events(spark, sf).select("user_id").distinct()
    micro = lambda q: F.floor(q / 1000 + 0.5001) / 1e6
    return users.join(run, "user_id", "left").groupBy("user_id").agg(
        F.count("d").alias("n"), (F.coalesce(F.sum("d"), F.lit(0)) / 1000.0).alias("active_s"), micro(F.expr("sum(x) div count(x)").cast("double")).alias("mean_conf"),
        micro(F.percentile("x", 0.1)).alias("p10"), micro(F.percentile("x", 0.9)).alias("p90"), (F.median("d") / 1000).alias("median_dur"),
    )


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'purchase') AS purchase, count(*) FILTER (WHERE event_type = 'signup') AS signup, count(*) FILTER (WHERE event_type = 'view') AS view FROM events GROUP BY 1 ORDER BY count(*) DESC, user_id LIMIT 30")
def category_pivot(spark, sf):
    p = base.table(spark, sf, "events").groupBy("user_id").pivot("event_type", list(base.CLASSES)).count().na.fill(0)
    total = sum((F.col(c) for c in base.CLASSES), F.lit(0))
    return p.orderBy(total.desc(), "user_id").limit(30)


@query(f"WITH {base.EV} SELECT user_id, count(*) AS n, round((max(t_ms) - min(t_ms)) / 60000.0, 6) AS minutes, round(count(*) * 1000.0 / nullif(max(t_ms) - min(t_ms), 0), 9) AS hz, round(100.0 * avg(CASE WHEN state = 0 THEN 1 ELSE 0 END), 6) AS zero_pct FROM ev GROUP BY 1")
def completeness(spark, sf):
    span = F.max("t_ms") - F.min("t_ms")
    return base.events(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), r6(span / 60000.0).alias("minutes"), F.round(F.count(F.lit(1)) * 1000.0 / F.nullif(span, F.lit(0)), 9).alias("hz"), r6(100.0 * F.avg((F.col("state") == 0).cast("double"))).alias("zero_pct"))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL")
def session_class_counts(spark, sf):
    return base.table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) AS hour_us, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def time_windows(spark, sf):
    w = base.table(spark, sf, "events").groupBy(F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.unix_micros(F.col("window.start").cast("timestamp")).alias("hour_us"), "n", "total")


@query("""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) < 21600000000 THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, sf):
    w = base.table(spark, sf, "events").groupBy("user_id", F.session_window("ts", "6 hours")).agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.unix_micros(F.col("session_window.start").cast("timestamp")).alias("start_us"), "n")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS k FROM (SELECT * FROM events WHERE event_type = 'view' UNION ALL SELECT * FROM events WHERE value > 50)) WHERE k = 1")
def union_distinct_on(spark, sf):
    e = base.table(spark, sf, "events")
    both = e.where(F.col("event_type") == "view").unionByName(e.where("value > 50"))
    return clean.distinct_on(both.withColumn("day", F.date_trunc("day", "ts")), ["user_id", "day"], ["ts", "event_id"]).select("event_id", "user_id")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS has_orders FROM customer")
def semi_anti_users(spark, sf):
    c, o = base.table(spark, sf, "customer").select("c_custkey"), base.table(spark, sf, "orders").select("o_custkey").distinct()
    semi, anti = c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi"), c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti")
    return semi.withColumn("has_orders", F.lit(True)).unionByName(anti.withColumn("has_orders", F.lit(False)))


@query("WITH s AS (SELECT o_custkey AS k FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0), i AS (SELECT o_custkey AS k FROM orders INTERSECT SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) SELECT 'only' AS kind, k FROM s UNION ALL SELECT 'both', k FROM i")
def set_operations(spark, sf):
    o = base.table(spark, sf, "orders").select(F.col("o_custkey").alias("k"))
    c = base.table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"))
    return o.subtract(c).select(F.lit("only").alias("kind"), "k").unionByName(o.intersect(c).select(F.lit("both").alias("kind"), "k"))


@query(f"""WITH {base.PAIRS}, m AS (SELECT class_idx, count(*) AS k FROM matched GROUP BY 1) SELECT g.class_idx, g.n AS support, coalesce(k, 0) AS matched, round(coalesce(k, 0) / g.n::DOUBLE, 6) AS match_rate FROM (SELECT class_idx, count(*) AS n FROM gold GROUP BY 1) g LEFT JOIN m USING (class_idx)""")
def support_match_rate(spark, sf):
    gold, pred = base.gold_and_pred(spark, sf)
    support = gold.groupBy("class_idx").agg(F.count(F.lit(1)).alias("support"))
    hit = evaluate.matches(pred, gold, KEY).groupBy("class_idx").agg(F.count(F.lit(1)).alias("matched"))
    out = support.join(hit, "class_idx", "left").na.fill(0, ["matched"])
    return out.withColumn("match_rate", r6(evaluate.ratio(F.col("matched"), F.col("support"))))


@query(f"""WITH {base.PAIRS} SELECT user_id, count(*) AS n, count(*) FILTER (WHERE p.class_idx <> g.class_idx) AS mismatches, max(abs(p.start_ms - g.start_ms)) AS max_shift FROM pred p JOIN gold g USING (user_id) WHERE pred_id = gold_id GROUP BY 1""")
def positional_zip_delta(spark, sf):
    gold, pred = base.gold_and_pred(spark, sf)
    g = gold.select(KEY, F.col("gold_id").alias("pred_id"), F.col("class_idx").alias("gc"), F.col("start_ms").alias("gs"))
    return pred.join(g, [KEY, "pred_id"]).groupBy(KEY).agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("class_idx") != F.col("gc")).cast("long")).alias("mismatches"), F.max(F.abs(F.col("start_ms") - F.col("gs"))).alias("max_shift"))


@query(f"""WITH {base.SEGD}, p AS (SELECT * FROM (VALUES (0, 43200.0, 0.0), (1, 43200.0, 0.03), (2, 86400.0, 0.03)) t(ord, min_d, min_c))
SELECT ord, user_id, count(*) AS n, round(sum(duration_sec), 4) AS active_s FROM segd, p WHERE duration_sec >= min_d AND confidence >= min_c GROUP BY ALL""")
def policy_cross_grid(spark, sf):
    policies = spark.createDataFrame([(0, 43200.0, 0.0), (1, 43200.0, 0.03), (2, 86400.0, 0.03)], "ord int, min_d double, min_c double")
    s = base.run_segments(spark, sf).join(F.broadcast(policies), F.expr("duration_sec >= min_d AND confidence >= min_c"))  # a few settings
    return s.groupBy("ord", "user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("duration_sec"), 4).alias("active_s"))


@query(f"""WITH {base.SEGD}, p AS (SELECT d, c FROM (SELECT unnest([0, 43200, 50000, 86400]) AS d), (SELECT unnest([0.0, 0.02, 0.04, 0.06]) AS c))
SELECT d, CAST(c AS DOUBLE) AS c, count(*) AS n, round(avg(confidence), 6) AS mean_conf FROM segd, p WHERE duration_sec >= d AND confidence >= c GROUP BY ALL ORDER BY n DESC, d, c LIMIT 10""")
def sweep_leaderboard(spark, sf):
    grid = spark.createDataFrame([(d, c) for d in (0, 43200, 50000, 86400) for c in (0.0, 0.02, 0.04, 0.06)], "d int, c double")
    s = base.run_segments(spark, sf).join(F.broadcast(grid), F.expr("duration_sec >= d AND confidence >= c"))
    return s.groupBy("d", "c").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("confidence")).alias("mean_conf")).orderBy(F.desc("n"), "d", "c").limit(10)


@query("SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(sqrt(greatest(avg(l_quantity * l_quantity) - avg(l_quantity) * avg(l_quantity), 1e-8)), 6) AS std, count(*) AS n FROM lineitem GROUP BY 1")
def norm_stats(spark, sf):
    x = F.col("l_quantity")
    return base.table(spark, sf, "lineitem").groupBy("l_returnflag").agg(r6(F.avg(x)).alias("mean"), r6(F.sqrt(F.greatest(F.avg(x * x) - F.avg(x) * F.avg(x), F.lit(1e-8)))).alias("std"), F.count(F.lit(1)).alias("n"))


@query("WITH s AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events) SELECT event_id, round((value - m) / CASE WHEN s < 1e-6 THEN 1 ELSE s END, 6) AS z FROM events, s")
def standardize(spark, sf):
    return clean.standardize(base.table(spark, sf, "events"), ["value"]).select("event_id", r6("value_z").alias("z"))


@query("WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT user_id, event_type AS majority FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM c) WHERE k = 1")
def majority_label(spark, sf):
    return base.table(spark, sf, "events").groupBy("user_id").agg(F.mode("event_type", True).alias("majority"))


@query("SELECT event_type, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*))::DOUBLE, 6) AS weight FROM events GROUP BY 1")
def class_weights(spark, sf):
    c = base.table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    total = Window.partitionBy()  # one row per class
    return c.withColumn("weight", r6(F.sum("n").over(total) / (F.count(F.lit(1)).over(total) * F.col("n"))))


@query("SELECT event_id, least(greatest(value, 5.0), 60.0) AS clipped, CASE WHEN value < 5 OR value > 60 THEN 1 ELSE 0 END AS saturated FROM events")
def saturation_clip(spark, sf):
    return base.table(spark, sf, "events").select("event_id", F.least(F.greatest(F.col("value"), F.lit(5.0)), F.lit(60.0)).alias("clipped"), ((F.col("value") < 5) | (F.col("value") > 60)).cast("int").alias("saturated"))


@query("SELECT user_id, dense_rank() OVER (ORDER BY user_id) - 1 AS dense_id, CASE WHEN 10 * (dense_rank() OVER (ORDER BY user_id) - 1) < 6 * count(*) OVER () THEN 'train' WHEN 10 * (dense_rank() OVER (ORDER BY user_id) - 1) < 8 * count(*) OVER () THEN 'dev' ELSE 'test' END AS split FROM (SELECT DISTINCT user_id FROM events)")
def fixed_subject_split(spark, sf):
    return clean.fixed_split(base.table(spark, sf, "events"), "user_id")


@query("SELECT user_id, CAST('0x' || md5('42:' || user_id)[1:8] AS BIGINT) % 5 AS fold FROM (SELECT DISTINCT user_id FROM events)")
def hash_split(spark, sf):
    return clean.hash_split(base.table(spark, sf, "events"), "user_id", folds=5, seed=42)


@query("SELECT c_custkey, c_name, CAST(coalesce(try_cast(regexp_replace(c_name, '[^0-9]', '', 'g') AS BIGINT), 0) AS BIGINT) AS natural_key, regexp_matches(c_name, '^Customer#[0-9]+$') AS is_id FROM customer")
def natural_sort(spark, sf):
    return base.table(spark, sf, "customer").select("c_custkey", "c_name", scalars.natural_key(F.col("c_name")).alias("natural_key"), F.col("c_name").rlike("^Customer#[0-9]+$").alias("is_id"))


@query("SELECT conv_id, turn, role, length(trim(text)) AS n_chars, len(string_split(trim(text), ' ')) AS n_fields FROM conversations")
def line_fields(spark, sf):
    return base.table(spark, sf, "conversations").select("conv_id", "turn", "role", F.length(F.trim("text")).cast("long").alias("n_chars"), F.size(F.split(F.trim("text"), " ", -1)).cast("long").alias("n_fields"))


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 HAVING count(*) >= 10 ORDER BY n DESC, user_id LIMIT 20")
def topn_ids(spark, sf):
    return base.table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 10").orderBy(F.desc("n"), "user_id").limit(20)


@query(f"""WITH {base.IX}, g AS (SELECT user_id, t_ms FROM ix WHERE i % 2 = 0), s AS (SELECT user_id, t_ms, value FROM ix WHERE i % 3 = 1),
j AS (SELECT g.user_id, g.t_ms, arg_max(s.value, s.t_ms) FILTER (WHERE s.t_ms <= g.t_ms) AS a, max(s.t_ms) FILTER (WHERE s.t_ms <= g.t_ms) AS ta, arg_min(s.value, s.t_ms) FILTER (WHERE s.t_ms >= g.t_ms) AS b, min(s.t_ms) FILTER (WHERE s.t_ms >= g.t_ms) AS tb FROM g JOIN s ON g.user_id = s.user_id GROUP BY ALL)
SELECT user_id, t_ms, round(coalesce(CASE WHEN ta = t_ms THEN a END, a + (b - a) * (t_ms - ta) / nullif(tb - ta, 0), a, b), 6) AS aligned FROM j""")
def asof_interp_align(spark, sf):
    ev = base.events(spark, sf).withColumn("i", sequence.place(KEY, ORDER))
    a = intervals.align_linear(ev.where("i % 2 = 0"), ev.where("i % 3 = 1"), KEY, "t_ms", "value", "aligned")
    return a.select("user_id", "t_ms", r6("aligned").alias("aligned"))


@query(f"""WITH {base.RUN}, c AS (SELECT user_id, run_id, min(t_ms) AS center FROM run GROUP BY ALL HAVING any_value(state) = 4) SELECT c.user_id, CAST(run_id AS BIGINT) AS run_id, count(*) AS n FROM c JOIN ev ON c.user_id = ev.user_id AND abs(t_ms - center) <= {2 * _DAY} GROUP BY ALL""")
def band_counts(spark, sf):
    ev = base.events(spark, sf)
    centers = sequence.runs(ev, KEY, ORDER, "state").where("state = 4").groupBy("user_id", "run_id").agg(F.min("t_ms").alias("center"))
    return intervals.band(ev.select("user_id", "t_ms"), centers, KEY, "t_ms", "center", 2 * _DAY).groupBy("user_id", "run_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {base.SEGD} SELECT user_id, class_idx, start_ms FROM segd WHERE duration_sec >= 50000 AND confidence >= 0.02")
def duration_confidence_filter(spark, sf):
    return segments.min_confidence(segments.min_duration(base.run_segments(spark, sf), 50_000), 0.02).select("user_id", "class_idx", "start_ms")
