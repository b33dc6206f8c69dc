"""How the driver's tables stand for recordings, labels and segments, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelane.operators import segments, sequence

KEY, ORDER = "user_id", ["t_ms", "event_id"]
CLASSES = ("click", "error", "purchase", "signup", "view")
PAD_MS = 21_600_000

#: SQL twins of the functions below, as CTEs that queries prepend.
EV = """ev AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS t_ms, event_type, value,
 CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS state FROM events)"""
IX = EV + """, ix AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t_ms, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM ev)"""
RUN = IX + """, chg AS (SELECT *, CASE WHEN state = lag(state) OVER (PARTITION BY user_id ORDER BY i) THEN 0 ELSE 1 END AS c FROM ix),
run AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY i) AS run_id FROM chg)"""
SEG = RUN + """, seg AS (SELECT user_id, any_value(state) AS class_idx, min(t_ms) - 21600000 AS start_ms, max(t_ms) + 21600000 AS end_ms, avg(value) / 1000 AS confidence
 FROM run GROUP BY user_id, run_id HAVING any_value(state) > 0)"""
SEGD = SEG + ", segd AS (SELECT *, (end_ms - start_ms) / 1000.0::DOUBLE AS duration_sec FROM seg)"
#: Gold: runs of the raw state. Predicted: runs of a state that is repaired where one event differs from equal neighbours.
PAIRS = RUN + """, gold0 AS (SELECT user_id, run_id, any_value(state) AS class_idx, min(t_ms) AS a, max(t_ms) AS b FROM run GROUP BY user_id, run_id HAVING any_value(state) > 0 AND count(*) > 1),
gold AS (SELECT user_id, class_idx, a AS start_ms, b AS end_ms, row_number() OVER (PARTITION BY user_id ORDER BY a) AS gold_id FROM gold0),
fix AS (SELECT *, CASE WHEN lag(state) OVER w = lead(state) OVER w THEN lag(state) OVER w ELSE state END AS s2 FROM ix WINDOW w AS (PARTITION BY user_id ORDER BY i)),
fc AS (SELECT *, CASE WHEN s2 = lag(s2) OVER (PARTITION BY user_id ORDER BY i) THEN 0 ELSE 1 END AS c FROM fix),
fr AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY i) AS run_id FROM fc),
pred0 AS (SELECT user_id, run_id, any_value(s2) AS class_idx, min(t_ms) AS a, max(t_ms) AS b FROM fr GROUP BY user_id, run_id HAVING any_value(s2) > 0 AND count(*) > 1),
pred AS (SELECT user_id, class_idx, a AS start_ms, b AS end_ms, row_number() OVER (PARTITION BY user_id ORDER BY a) AS pred_id FROM pred0),
cand AS (SELECT p.user_id, p.class_idx, p.pred_id, g.gold_id, p.start_ms AS p0, p.end_ms AS p1, g.start_ms AS g0, g.end_ms AS g1,
 (least(p.end_ms, g.end_ms) - greatest(p.start_ms, g.start_ms)) / (greatest(p.end_ms, g.end_ms) - least(p.start_ms, g.start_ms)) AS iou
 FROM pred p JOIN gold g ON p.user_id = g.user_id AND p.class_idx = g.class_idx AND p.start_ms < g.end_ms AND g.start_ms < p.end_ms),
matched AS (SELECT * FROM cand WHERE iou > 0.5)"""
USERF = PAIRS + """, spine AS (SELECT user_id, count(*) AS n_gold FROM gold GROUP BY user_id),
np AS (SELECT user_id, count(*) AS n_pred FROM pred GROUP BY user_id), tp AS (SELECT user_id, count(*) AS tp FROM matched GROUP BY user_id),
uf AS (SELECT s.user_id, coalesce(tp, 0) AS tp, coalesce(n_pred, 0) - coalesce(tp, 0) AS fp, n_gold - coalesce(tp, 0) AS fn,
 coalesce(2.0::DOUBLE * coalesce(tp, 0) / nullif(coalesce(n_pred, 0) + n_gold, 0), 0) AS f1 FROM spine s LEFT JOIN np USING (user_id) LEFT JOIN tp USING (user_id))"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, t_ms, event_type, value, state (0 background to 4)."""
    state = F.coalesce(*[F.when(F.col("event_type") == c, i) for i, c in enumerate(CLASSES)])
    time = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    return table(spark, sf_dir, "events").select("event_id", "user_id", time.alias("t_ms"), "event_type", "value", state.cast("int").alias("state"))


def run_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of the raw runs; the mean value over 1000 stands for the confidence (divided once, as the twin does)."""
    found = segments.from_states(events(spark, sf_dir), KEY, ORDER, "state", "value", "t_ms", PAD_MS).drop("start_idx", "end_idx")
    return found.withColumn("confidence", F.col("confidence") / 1000)


def six(c) -> F.Column:
    """Six digits, ties away from zero, decided on the binary value times 10^6; F.round decides on its decimal spelling.
    Means of two-digit values over 1000 lie on such ties often."""
    x = F.col(c) if isinstance(c, str) else c
    return F.signum(x) * F.floor(F.abs(x) * 1e6 + 0.5) / 1e6


def _closed_runs(ev: DataFrame, state: str, name: str) -> DataFrame:
    from pyspark.sql import Window

    run = sequence.runs(ev, KEY, ORDER, state).groupBy(KEY, "run_id").agg(F.first(state).alias("class_idx"), F.min("t_ms").alias("start_ms"), F.max("t_ms").alias("end_ms"), F.count(F.lit(1)).alias("n"))
    run = run.where((F.col("class_idx") > 0) & (F.col("n") > 1))
    return run.withColumn(name, F.row_number().over(Window.partitionBy(KEY).orderBy("start_ms")).cast("long")).select(KEY, "class_idx", "start_ms", "end_ms", name)


def gold_and_pred(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    ev = events(spark, sf_dir)
    w = Window.partitionBy(KEY).orderBy(*ORDER)
    fixed = ev.withColumn("s2", F.when(F.lag("state").over(w) == F.lead("state").over(w), F.lag("state").over(w)).otherwise(F.col("state")))
    return _closed_runs(ev, "state", "gold_id"), _closed_runs(fixed, "s2", "pred_id")
