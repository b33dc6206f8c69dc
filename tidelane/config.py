"""Policies: the parameters of post-processing, with presets, and where a named split's data lie."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession

#: Window length in rows by scale, and the common step, at 100 rows a second.
SCALES = {"3s": 300, "5s": 500, "8s": 800}
STEP = 100


@dataclass(frozen=True)
class Policy:
    """Every step can be switched off; times are in seconds, widths in steps."""

    name: str = "full"
    smooth: int = 7
    median: int = 5
    viterbi: bool = True
    self_stay: float = 0.97
    enter: float = 0.01
    leave: float = 0.05
    cross: float = 0.001
    merge_gap: float = 60.0
    refine: bool = True
    resolve: bool = True
    min_duration: float = 180.0
    top_k: int = 3
    min_confidence: float = 0.45

    def derive(self, name: str, **changes) -> Policy:
        return replace(self, name=name, **changes)


# Presets, and the suites that take them apart or build them up a step at a time.
FULL = Policy()
BASELINE = FULL.derive("baseline", smooth=5, median=0, self_stay=0.90, cross=0.005, min_duration=120.0, top_k=0, min_confidence=0.0)
RAW = FULL.derive("raw", smooth=0, median=0, viterbi=False, merge_gap=0.0, refine=False, resolve=False, min_duration=0.0, top_k=0, min_confidence=0.0)
WIDER = BASELINE.derive("wider smoothing", smooth=7, min_duration=180.0)
STRONGER = WIDER.derive("stronger prior", self_stay=0.97, cross=0.001)
SUITES = {
    "ablation": [
        FULL.derive("A0 full"), FULL.derive("A1 no median", median=0), FULL.derive("A2 no top-k, no confidence", top_k=0, min_confidence=0.0),
        FULL.derive("A3 no refinement", refine=False), FULL.derive("A4 no decoder", viterbi=False),
    ],
    "policies": [
        FULL.derive("S0 full"), FULL.derive("S1 no median", median=0), FULL.derive("S2 no top-k, no confidence", top_k=0, min_confidence=0.0), FULL.derive("S3 no refinement", refine=False),
        FULL.derive("S4 no decoder", viterbi=False), BASELINE.derive("S5 baseline"), FULL.derive("S6 no top-k", top_k=0), FULL.derive("S7 no confidence", min_confidence=0.0),
        FULL.derive("S8 top 4, 0.50", top_k=4, min_confidence=0.50), FULL.derive("S9 top 4, 0.55", top_k=4, min_confidence=0.55), FULL.derive("S10 top 4, 0.50, 210 s", top_k=4, min_confidence=0.50, min_duration=210.0),
    ],
    "steps": [
        RAW.derive("I0 raw"), BASELINE.derive("I1 baseline"), WIDER.derive("I2 wider smoothing"), STRONGER.derive("I3 stronger prior"), STRONGER.derive("I4 median", median=5),
        STRONGER.derive("I5 confidence", median=5, min_confidence=0.45), FULL.derive("I6 full"),
    ],
}


def policy_table(spark: SparkSession, policies: list[Policy]) -> DataFrame:
    """One row per policy, in order: ``ord`` and the fields."""
    return spark.createDataFrame([(i, *asdict(p).values()) for i, p in enumerate(policies)], ["ord", *asdict(policies[0])])


def split_path(split: str, kind: str = "signal", environment: dict | None = None) -> str:
    """Folder of a split's data; TIDELANE_<SPLIT>_<KIND> overrides it."""
    splits = ("train", "internal_eval", "external_test")
    if split not in splits:
        raise ValueError(f"unknown split {split!r}; valid: {', '.join(splits)}")
    environment = os.environ if environment is None else environment
    return environment.get(f"TIDELANE_{split}_{kind}".upper(), f"data/{split}/{kind}")
