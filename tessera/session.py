"""SparkSession factory."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(app: str = "tessera", master: str | None = None, partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the engine's settings.

    On a cluster leave ``master`` and ``partitions`` unset: adaptive execution
    sizes the reducers. ``local[n]`` wants few shuffle partitions instead.
    Keyword names use ``__`` for the dots of a setting.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULTS)
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    settings |= {key.replace("__", "."): value for key, value in conf.items()}
    return builder.config(map=settings).getOrCreate()
