"""Windowed group-by over a stream, the unbounded form of ``hash_group``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stream_group(stream: DataFrame, time: str, keys: list[str], every: str, late: str, **aggregates: Column) -> DataFrame:
    """Tumbling windows of ``every``; state is dropped once ``late`` has passed.

    Works on a static DataFrame too, where the watermark has no effect.
    """
    windowed = stream.withWatermark(time, late).groupBy(F.window(time, every), *keys)
    return windowed.agg(*(a.alias(n) for n, a in aggregates.items())).select(F.col("window.start").alias("start"), *keys, *aggregates)
