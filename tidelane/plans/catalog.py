"""The queries of the interval engine and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelane.operators import segments, sequence
from tidelane.plans import base, experiments, files, ordered, records, tabular, training

_MODULES = (ordered, tabular, experiments, records, training, files)


def flagship(spark, sf_dir):
    """Events to states, smoothed and median-filtered, to merged segments, the three surest of each user."""
    ev = base.events(spark, sf_dir)
    for s in range(5):
        ev = ev.withColumn(f"h{s}", (F.col("state") == s).cast("double"))
        ev = ev.withColumn(f"h{s}", sequence.moving_average(f"h{s}", base.KEY, base.ORDER, 7))
        ev = ev.withColumn(f"h{s}", sequence.median_filter(f"h{s}", base.KEY, base.ORDER, 5))
    p = F.array(*[F.col(f"h{s}") for s in range(5)])
    ev = ev.withColumn("prob", F.array_max(p)).withColumn("path", (F.array_position(p, F.array_max(p)) - 1).cast("int"))
    found = segments.from_states(ev, base.KEY, base.ORDER, "path", "prob", "t_ms", base.PAD_MS)
    merged = segments.merge_same_class(found, base.KEY, 2 * base.PAD_MS)
    best = segments.top_k_diverse(merged, base.KEY, 3)
    category = F.element_at(F.array(*[F.lit(c) for c in base.CLASSES]), F.col("class_idx") + 1)
    return best.select("user_id", category.alias("category"), "start_ms", "end_ms", "confidence", "duration_sec")


def queries() -> dict:
    out = {"flagship": flagship}
    for module in _MODULES:
        out |= module.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for module in _MODULES:
        out |= module.SQL
    return out
