"""Runs of several phases, each for itself: one that fails doesn't keep the next from running."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession


def run_phases(spark: SparkSession, steps: Sequence[tuple[str, Callable[[SparkSession], object]]]) -> DataFrame:
    """(seq, phase, ok, seconds, result, error) of the phases, run one after the other. A phase is a job that may run
    again; its result is kept as text."""
    rows = []
    for seq, (name, step) in enumerate(steps):
        began = time.time()
        try:
            out = step(spark)
            rows.append((seq, name, True, time.time() - began, None if out is None else str(out), None))
        except Exception as e:  # noqa: BLE001  the report says what happened, the next phase runs
            rows.append((seq, name, False, time.time() - began, None, f"{type(e).__name__}: {e}"))
    return spark.createDataFrame(rows, "seq int, phase string, ok boolean, seconds double, result string, error string")
