"""Timing harness: warm-ups, then the mean of n runs; ms per run and ns per input tuple."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def timed(run: Callable[[], DataFrame], warmups: int = 3, reps: int = 3, tuples: int | None = None) -> dict[str, float]:
    """Each run computes every output row and column (the no-op sink), nothing is collected."""
    go = lambda: run().write.format("noop").mode("overwrite").save()
    for _ in range(warmups):
        go()
    began = time.perf_counter()
    for _ in range(reps):
        go()
    seconds = (time.perf_counter() - began) / reps
    return {"sec": round(seconds, 4)} | ({"ns_per_tuple": round(seconds * 1e9 / tuples, 1)} if tuples else {})


def selectivity_sweep(spark: SparkSession, rows: int = 1_000_000, steps: int = 10, reps: int = 3) -> list[dict[str, float]]:
    """Time of a selection on an integer column at 0 to 100 % of its rows, with ns per input row."""
    df = spark.range(rows).select(F.pmod(F.xxhash64("id"), F.lit(100)).alias("x"))
    out = []
    for k in range(steps + 1):
        percent = 100 * k // steps
        out.append({"percent": percent} | timed(lambda: df.filter(F.col("x") < percent), 1, reps, rows))  # noqa: B023
    return out
